"""Byte-level BPE of many texts at once: distinct words are encoded together, texts are put together from their words.

Texts are cut before every single blank and line feed, which is a cut of the pattern too if no other white space touches
it. Arrow splits a batch and numbers its distinct words. Words of letters and signs behind them take their next merge
together, all in one go; the library encodes the others, and whole texts with white space side by side, at their ends, or
with the name of a special token. Nothing is kept from one batch to the next.

The words lie one after the other in one array of ids. A round finds each word's pair of lowest rank, merges all of its
occurrences, from the left, and asks for the ranks of the pairs that changed; words without a pair left are done. This is
the merge order of the usual algorithm, word by word. Ranks come from a hash table in two arrays.
"""

from __future__ import annotations

import json
import os
import re
import string

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

NONE = np.int32(2**31 - 1)
SPREAD = np.uint64(0x9E3779B97F4A7C15)
SIGNS = np.isin(np.arange(256), np.frombuffer(string.punctuation.encode(), dtype=np.uint8))
#: White space that a cut must not touch.
APART = re.compile(r"\s\s|^\s|\s\Z")
#: Words of more bytes go to the library.
LONGEST = 64
#: Letters of Latin script, the same in every version of Unicode, and signs behind them; other words are looked at one by one.
PLAIN = r"^\n?[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}]+[!-/:-@\[-`{-~]*$"


def byte_names() -> list[str]:
    """The character that stands for each byte in vocabularies of byte-level tokenizers."""
    shown = {b for low, high in (("!", "~"), ("¡", "¬"), ("®", "ÿ")) for b in range(ord(low), ord(high) + 1)}
    hidden = iter(range(256))
    return [chr(b) if b in shown else chr(256 + next(hidden)) for b in range(256)]


class Merges:
    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]]):
        self.ids = np.array([vocabulary[c] for c in byte_names()], dtype=np.int32)
        self.made = np.array([vocabulary[a + b] for a, b in merges], dtype=np.int32)
        keys = self.key(*(np.array([vocabulary[m[side]] for m in merges], dtype=np.int32) for side in (0, 1)))
        size = 1 << (4 * len(merges)).bit_length()
        self.mask, self.keys, self.ranks = np.int64(size - 1), np.full(size, -1, dtype=np.int64), np.full(size, NONE, dtype=np.int32)
        rank, at = np.arange(len(merges), dtype=np.int32), self.place(keys)
        while len(rank):  # of those that want one free place, the last one written stays
            free = self.keys[at] == -1
            self.keys[at[free]], self.ranks[at[free]] = keys[rank[free]], rank[free]
            out = self.keys[at] != keys[rank]
            rank, at = rank[out], (at[out] + 1) & self.mask
        self.byte_ranks = self.rank_of(np.repeat(self.ids, 256), np.tile(self.ids, 256)).reshape(256, 256)

    @classmethod
    def of_file(cls, path: str) -> Merges | None:
        """Of a tokenizer file, if that is byte-level BPE in its plain form; else nothing."""
        with open(path, encoding="utf-8") as file:
            whole = json.load(file)
        model, cut = whole["model"], whole.get("pre_tokenizer") or {}
        odd = ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "byte_fallback")
        plain = model.get("type") == "BPE" and not whole.get("normalizer") and not any(model.get(k) for k in odd)
        if not plain or cut.get("type") != "ByteLevel" or not cut.get("use_regex") or cut.get("add_prefix_space"):
            return None
        return cls(model["vocab"], [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]])

    @staticmethod
    def key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return (left.astype(np.int64) << 32) | right.astype(np.int64)

    def place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * SPREAD) >> np.uint64(32)).view(np.int64) & self.mask

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = self.key(left, right)
        at = self.place(keys)
        out, held = self.ranks[at], self.keys[at]
        open_ = np.flatnonzero((held != keys) & (held != -1))
        out[held == -1] = NONE
        while len(open_):
            at[open_] = (at[open_] + 1) & self.mask
            held = self.keys[at[open_]]
            out[open_] = np.where(held == keys[open_], self.ranks[at[open_]], NONE)
            open_ = open_[(held != keys[open_]) & (held != -1)]
        return out

    def encode(self, words: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words one after the other, and how many each has. A word is a line feed, or nothing for a blank, then
        letters, then ASCII punctuation or nothing."""
        begins = np.frombuffer(words.buffers()[1], dtype=np.int64)[words.offset :][: len(words) + 1]
        data = np.frombuffer(words.buffers()[2], dtype=np.uint8)[begins[0] : begins[-1]]
        begins = begins - begins[0]
        bare = data[begins[:-1]] != 0x0A
        data = np.insert(data, begins[:-1][bare], 0x20)
        of = np.repeat(np.arange(len(words), dtype=np.int32), np.diff(begins) + bare)
        blank, feed, sign = data == 0x20, data == 0x0A, SIGNS[data]
        # A match of the pattern begins with a blank, a line feed, the letter behind one, and the first of some signs.
        match = blank | feed
        match[1:] |= feed[:-1] | (sign[1:] & ~sign[:-1])
        word, ids = np.cumsum(match, dtype=np.int32) - np.int32(1), self.ids[data]
        word_of = of[match]
        rank = np.full(len(ids), NONE, dtype=np.int32)  # of the pair that begins here
        inner = np.flatnonzero(~match[1:])
        rank[inner] = self.byte_ranks[data[inner], data[inner + 1]]
        done_ids, done_words = [], []
        while len(ids):
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            sizes = np.diff(np.append(first, len(ids)))
            least = np.minimum.reduceat(rank, first)
            ended = least == NONE
            if ended.any():
                out = np.repeat(ended, sizes)
                done_ids.append(ids[out])
                done_words.append(word[out])
                ids, word, rank = ids[~out], word[~out], rank[~out]
                least, sizes = least[~ended], sizes[~ended]
                if not len(ids):
                    break
            hit = rank == np.repeat(least, sizes)
            at = np.flatnonzero(hit)
            # Pairs of one letter twice overlap in longer runs; every second one of a run goes.
            touch = np.flatnonzero(np.diff(at) == 1) + 1
            if len(touch):
                run_at = np.arange(len(at))
                begin = np.ones(len(at), dtype=bool)
                begin[touch] = False
                at = at[((run_at - np.maximum.accumulate(np.where(begin, run_at, 0))) & 1) == 0]
            ids[at] = self.made[rank[at]]
            stays = np.ones(len(ids), dtype=bool)
            stays[at + 1] = False
            new = np.cumsum(stays)[at] - 1
            ids, word, rank = ids[stays], word[stays], rank[stays]
            changed = np.concatenate([new, new[new > 0] - 1])
            rank[changed] = NONE
            inside = changed[changed < len(ids) - 1]
            inside = inside[word[inside] == word[inside + 1]]
            rank[inside] = self.rank_of(ids[inside], ids[inside + 1])
        ids, word = np.concatenate(done_ids), np.concatenate(done_words)
        return ids[np.argsort(word, kind="stable")], np.bincount(word_of[word], minlength=len(words))


class BatchEncoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark already runs a task on each core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.merges = Merges.of_file(path)

    def library(self, texts: list[str]) -> list[np.ndarray]:
        coded = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False) if texts else []
        return [np.array(c.ids, dtype=np.int32) for c in coded]

    @staticmethod
    def kinds(words: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each word is letters and signs behind them, and whether white space touches other white space in it or beside it."""
        plain = pc.match_substring_regex(words, PLAIN).to_numpy(zero_copy_only=False)
        apart = np.zeros(len(words), dtype=bool)
        rest = np.flatnonzero(~plain)
        for n, word in zip(rest.tolist(), words.take(pa.array(rest)).to_pylist(), strict=True):
            body = word[word[:1] == "\n" :]
            plain[n] = body.rstrip(string.punctuation).isalpha()
            apart[n] = not plain[n] and (not body or APART.search(body) is not None)
        return plain & (pc.binary_length(words).to_numpy() <= LONGEST), apart

    def words(self, words: pa.LargeStringArray, plain: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the distinct words that are asked for, where each word's begin, and how many it has (others: none)."""
        starts, sizes, ids = np.zeros(len(words), dtype=np.int64), np.zeros(len(words), dtype=np.int64), []
        merged, others = np.flatnonzero(asked & plain), np.flatnonzero(asked & ~plain)
        if len(merged):
            coded, sizes[merged] = self.merges.encode(words.take(pa.array(merged)))
            ids.append(coded)
        coded = self.library([w if w[:1] == "\n" else " " + w for w in words.take(pa.array(others)).to_pylist()])
        sizes[others] = [len(c) for c in coded]
        order = np.concatenate([merged, others])  # as their ids stand
        starts[order] = np.cumsum(sizes[order]) - sizes[order]
        return np.concatenate([*ids, *coded, np.zeros(0, dtype=np.int32)]), starts, sizes

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        if self.merges is None or not texts:
            return self.library(texts)
        # A line feed is put before each text, so that its first word is like any other; its id is left out again.
        lists = pc.split_pattern(pa.array(["\n" + t.replace("\n", " \n") for t in texts], pa.large_string()), " ")
        numbered = lists.values.dictionary_encode()
        at, ends = numbered.indices.to_numpy(), lists.offsets.to_numpy()
        plain, apart = self.kinds(numbered.dictionary)
        whole = np.logical_or.reduceat(apart[at], ends[:-1]) | [any(s in t for s in self.special) for t in texts]
        cut = np.repeat(~whole, np.diff(ends))
        asked = np.zeros(len(plain), dtype=bool)
        asked[at[cut]] = True
        ids, starts, sizes = self.words(numbered.dictionary, plain, asked)
        size = np.where(cut, sizes[at], 0)
        before = np.concatenate([[0], np.cumsum(size)])
        ids = ids[np.repeat(starts[at] - before[:-1], size) + np.arange(before[-1])]
        out = [ids[a + 1 : b] for a, b in zip(before[ends[:-1]].tolist(), before[ends[1:]].tolist(), strict=True)]
        alone = np.flatnonzero(whole).tolist()
        for n, coded in zip(alone, self.library([texts[n] for n in alone]), strict=True):
            out[n] = coded
        return out
