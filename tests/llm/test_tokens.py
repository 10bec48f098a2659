"""Encoding, decoding and packing against the public libraries."""

import base64
import struct
import zlib
from collections import defaultdict
from types import SimpleNamespace

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sitewarden.llm import byte_bpe, merges, packing
from sitewarden.llm.pieces import PartCoder, parts_of

RANKS, VOCABULARY = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json")
ODD = ["", " ", "  ", "a", " a", "a  b", "a   b\n  c", "x\n \ny", "é ü  z", "don't  we'll", "<|endoftext|>", "a <|endoftext|>  b",
       "\t\ttab", "end  ", "end \n", "日本語 テキスト 😀", "a" * 3000, "12345 1 22  333", "q   w", "\x1c \x1d a"]


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids_of(blob):
    return list(struct.unpack(f"<{len(blob) // 4}I", blob))


def test_whole_texts(reference):
    codec, tokens, tokenizer = byte_bpe.Codec(RANKS, P.PATTERN), packing.Tokens(VOCABULARY), Tokenizer.from_file(VOCABULARY)
    for text in [*ODD, " ".join(ODD), *ODD]:
        assert "".join(parts_of(text)) == text
        assert ids_of(codec.encode([text])[0]) == reference.encode_ordinary(text)
        assert codec.decode(codec.encode([text])[0]).decode() == text
        assert ids_of(next(tokens.encode([text]))) == tokenizer.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=" \n\tab'sé1. ", max_size=30))
def test_any_white_space(text):
    codec, tokens = byte_bpe.Codec.of(RANKS, P.PATTERN), packing.Tokens.of(VOCABULARY)
    want = tokens.encoder.tokenizer.encode(text, add_special_tokens=False).ids
    assert ids_of(next(tokens.encode([text]))) == want
    assert ids_of(codec.encode([text])[0]) == want


WORDS = ["the", "The", "aaaa", "aaaaaaa", "it's", "don't", "x,&&&", "###", "naïve", "Straße!!", "'s", "a'", "日本語", "e\u0301", "12", "a1", "\x1c", "\u2028", "\xa0", "a\tb", "z" * 80, "_a_", "q_", "😀", "<|endoftext|>"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.tuples(st.sampled_from(WORDS) | st.text(alphabet="abeinorst", min_size=1, max_size=12), st.sampled_from([" ", " ", "\n", "  ", ""])), max_size=12), max_size=5))
def test_batches_of_words(texts):
    texts = ["".join(w + gap for w, gap in t) for t in texts]
    tokens = packing.Tokens.of(VOCABULARY)
    want = [tokens.encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert [i.tolist() for i in tokens.encoder(texts)] == want


def test_only_odd_words_are_looked_at_one_by_one(monkeypatch):
    texts = ["some words, naïve Straße!!\nnext Line.", "some two  blanks", "tab\there", " at first", "Слова здесь", "at last\t", "", "<|endoftext|> x", "\u2028", "words\n\nwords"]
    encoder, seen, search = packing.Tokens(VOCABULARY).encoder, [], merges.APART.search
    want = [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    monkeypatch.setattr(merges, "APART", SimpleNamespace(search=lambda t: (seen.append(t), search(t))[1]))
    assert [i.tolist() for i in encoder(texts)] == want
    assert sorted(seen) == ["<|endoftext|>", "last\t", "tab\there", "\u2028"]
    seen.clear()
    assert len(encoder(texts[:1] * 50)) == 50 and not seen  # before: every text was searched


def test_merges_of_given_texts(spark):
    texts = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    tokens = packing.Tokens.of(VOCABULARY)
    want = tokens.encoder.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
    assert [ids_of(i) for i in tokens.encode(texts)] == [w.ids for w in want]


def test_small_table_of_parts(monkeypatch, reference):
    monkeypatch.setattr("sitewarden.llm.pieces.KNOWN_PARTS", 3)
    codec = byte_bpe.Codec(RANKS, P.PATTERN)
    for text in ["one two three four", "two five  six", "four one " + "long" * 40 + " two"]:
        assert ids_of(codec.encode([text])[0]) == reference.encode_ordinary(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=byte_bpe.SHORT) | st.text(alphabet="abetsh ", min_size=1, max_size=20).map(str.encode), min_size=1, max_size=30))
def test_matches_merged_together(pieces):
    codec = byte_bpe.Codec.of(RANKS, P.PATTERN)
    assert [ids_of(b) for b in codec.pairs.merged(pieces)] == [byte_bpe.merged(p, codec.ranks) for p in pieces]


def test_leftmost_lowest_pair_of_any_ranks():
    # "abcd" comes before "abc", so it is made from a fresh "abc" before the next "abc" is; "aa" overlaps with itself.
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"aa": 257, b"cd": 258, b"abcd": 259, b"abc": 260, b"da": 261, b"aaaa": 262}
    pieces = [b"abcabcd", b"abcdabc", b"aaaaa", b"aaabcda", b"dadab", b"x", b"aaaaaaabab"]
    assert [ids_of(b) for b in byte_bpe.Pairs(ranks).merged(pieces)] == [byte_bpe.merged(p, ranks) for p in pieces]


def test_words_of_many_texts_are_encoded_together():
    calls = []
    coder = PartCoder(lambda parts: (calls.append(len(parts)), [p.encode() for p in parts])[1])
    texts = [f"a w{n} v{n}  x{n % 7}" for n in range(50)]
    assert coder(texts) == [t.encode() for t in texts] and max(calls) > 100


def test_a_text_and_a_list_of_texts():
    tokens = packing.Tokens.of(VOCABULARY)
    assert tokens.encode("two words") == next(tokens.encode(["two words"])) and tokens.encode("") == b""


def test_encode_table(spark, reference):
    rows = [(1, None, "x"), (1, None, "x"), (None, "two words", "y"), (4, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, decoded string")
    coded = byte_bpe.encode(docs, RANKS, P.PATTERN)
    back = byte_bpe.decode(coded, RANKS, P.PATTERN).collect()
    assert [(r.doc_id, r.text, bytes(r.decoded).decode()) for r in back] == [(a, b, b or "") for a, b, _ in rows]
    assert byte_bpe.encode(docs.limit(0), RANKS, P.PATTERN).count() == 0


def packed(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, length string, class string")
    return packing.pack(docs, VOCABULARY).collect()


def test_pack(spark):
    texts = [None, "", "a b c", "a b c", "word " * 3000, *("t " * n for n in range(5, 900, 13))]
    out = packed(spark, [(i, t, "x", "y") for i, t in enumerate(texts)])
    tokenizer, rooms, docs = Tokenizer.from_file(VOCABULARY), defaultdict(list), defaultdict(list)
    for r in out:
        rooms[r.sequence_id].append((r.offset, r.length))
        docs[r.doc_id].append(r)
    assert sorted(rooms) == list(range(len(rooms)))
    for parts in rooms.values():
        assert [o for o, _ in sorted(parts)] == [sum(n for _, n in sorted(parts)[:i]) for i in range(len(parts))]
        assert sum(n for _, n in parts) <= 1024
    for i, text in enumerate(texts):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        pieces = sorted(docs[i], key=lambda r: r.start)
        assert [r.start for r in pieces] == [sum(p.length for p in pieces[:k]) for k in range(len(pieces))]
        assert sum(r.length for r in pieces) == len(ids) and {r.doc_tokens for r in pieces} == {len(ids)}
        for r in pieces:
            part = ids[r.start : r.start + r.length]
            assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{len(part)}I", *part))


def test_pack_nothing(spark):
    assert packed(spark, []) == []


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 256).map(lambda n: 4 * n), st.integers(1, 500), max_size=40))
def test_patterns_hold_every_piece_once(histogram):
    patterns = packing.solve(histogram)
    held = defaultdict(int)
    for p in patterns:
        assert sum(w * n for w, n in p.counts.items()) <= 1024 and p.times > 0
        for w, n in p.counts.items():
            held[w] += n * p.times
    assert dict(held) == histogram
    # Never more than first-fit alone, up to the rounding of the basis.
    assert sum(p.times for p in patterns) <= sum(p.times for p in packing.first_fit(histogram, 1024)) + len(histogram)


def test_column_generation_finds_perfect_patterns():
    patterns = packing.solve({600: 300, 424: 300, 512: 200, 340: 30, 684: 30})
    assert sum(p.times for p in patterns) == 300 + 100 + 30
