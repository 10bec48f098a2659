"""Byte-level BPE by a rank file: encoding of whole texts and decoding of ids.

Each match of the pattern is merged on its own. The distinct short matches of many texts take their next merge together: they
lie one after the other in one array, a round finds the leftmost pair of lowest rank of each and looks up the pairs that
changed. For a long match a segment tree over the byte positions holds, for every live neighbour pair, its rank and
position; the root is the leftmost pair of lowest rank. A merge writes three leaves (the pair that began, the one before,
the one that vanished), each with a logarithmic number of parents.

Input: a table with a text column. Null text counts as empty and gives no ids; other columns are passed on untouched,
except that an input column named like the output is replaced. Repeated rows are encoded each on their own. A batch is
worked off in parts, and what a task learned about words goes when it ends, so a waiting worker holds little.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from sitewarden.llm.pieces import PartCoder
from sitewarden.llm.tables import stretches, tidy

NONE = 1 << 62
#: Matches of at most so many bytes are merged together, if they are so many at least; the others one by one.
SHORT, MANY = 48, 16
#: Bytes of texts or ids of a batch that become Python objects at a time; a longer row is taken alone.
BATCH_BYTES = 1 << 21


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one match of the pattern."""
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    size = 1 << (n - 1).bit_length()
    rank_of = ranks.get
    after = list(range(1, n + 1))  # where the live part that begins here ends
    before = list(range(-1, n))
    tree = [NONE] * (2 * size)
    for i in range(n - 1):
        rank = rank_of(piece[i : i + 2])
        if rank is not None:
            tree[size + i] = rank * size + i
    for i in range(size - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b

    def put(i: int, value: int) -> None:
        i += size
        tree[i] = value
        while i > 1:
            other = tree[i ^ 1]
            if other < value:
                value = other
            i >>= 1
            if tree[i] == value:
                return
            tree[i] = value

    while (best := tree[1]) != NONE:
        at = best % size
        gone = after[at]
        end = after[at] = after[gone]
        put(gone, NONE)
        if end < n:
            before[end] = at
            rank = rank_of(piece[at : after[end]])
            put(at, NONE if rank is None else rank * size + at)
        else:
            put(at, NONE)
        if (left := before[at]) >= 0:
            rank = rank_of(piece[left:end])
            put(left, NONE if rank is None else rank * size + left)
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : after[i]]])
        i = after[i]
    return ids


class Pairs:
    """For each pair of ids the id of their joined bytes, which is its rank; any split of a token counts."""

    def __init__(self, ranks: dict[bytes, int]):
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        splits = ((ranks.get(token[:n]), ranks.get(token[n:]), i) for token, i in ranks.items() for n in range(1, len(token)))
        rows = np.array([s for s in splits if s[0] is not None and s[1] is not None], dtype=np.int64).reshape(-1, 3)
        keys = rows[:, 0] << 32 | rows[:, 1]
        order = np.argsort(keys)
        self.keys, self.ids = np.append(keys[order], NONE), np.append(rows[order, 2], NONE)

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left << 32 | right
        at = np.searchsorted(self.keys, keys)
        return np.where(self.keys[at] == keys, self.ids[at], NONE)

    def merged(self, pieces: list[bytes]) -> list[bytes]:
        """Little-endian ids of each of these matches; as :func:`merged`, one merge of every match in a round."""
        ids = self.byte_ids[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
        piece = np.repeat(np.arange(len(pieces)), [len(p) for p in pieces])
        rank = np.full(len(ids), NONE)  # of the pair that begins here
        inner = np.flatnonzero(piece[:-1] == piece[1:])
        rank[inner] = self.rank_of(ids[inner], ids[inner + 1])
        done_ids, done_pieces = [], []
        while len(ids):
            first = np.flatnonzero(np.concatenate([[True], piece[1:] != piece[:-1]]))
            least = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.append(first, len(ids))))
            ended = least == NONE
            done_ids.append(ids[ended])
            done_pieces.append(piece[ended])
            ids, piece, rank, least = ids[~ended], piece[~ended], rank[~ended], least[~ended]
            at = np.flatnonzero(rank == least)
            at = at[np.concatenate([[True], piece[at[1:]] != piece[at[:-1]]])] if len(at) else at
            ids[at] = rank[at]
            stays = np.ones(len(ids), dtype=bool)
            stays[at + 1] = False
            ids, piece, rank = ids[stays], piece[stays], rank[stays]
            new = at - np.arange(len(at))
            changed = np.concatenate([new, new[new > 0] - 1])
            rank[changed] = NONE
            inside = changed[changed < len(ids) - 1]
            inside = inside[piece[inside] == piece[inside + 1]]
            rank[inside] = self.rank_of(ids[inside], ids[inside + 1])
        ids, piece = np.concatenate(done_ids), np.concatenate(done_pieces)
        blob = ids[np.argsort(piece, kind="stable")].astype("<u4").tobytes()
        ends = (4 * np.cumsum(np.bincount(piece, minlength=len(pieces)))).tolist()
        return [blob[a:b] for a, b in zip([0, *ends], ends)]


class Codec:
    """Encoder and decoder of one rank file; workers keep theirs between tasks."""

    _kept: dict[tuple[str, str], Codec] = {}

    def __init__(self, path: str, pattern: str):
        import regex

        self.ranks = read_ranks(path)
        self.split = regex.compile(pattern).findall
        self.bytes_of = {i: b for b, i in self.ranks.items()}
        self.pairs = Pairs(self.ranks) if all(bytes([b]) in self.ranks for b in range(256)) else None
        self.coder = PartCoder(self._parts)

    @classmethod
    def of(cls, path: str, pattern: str) -> Codec:
        if (path, pattern) not in cls._kept:
            cls._kept[path, pattern] = cls(path, pattern)
        return cls._kept[path, pattern]

    def _parts(self, parts: Iterable[str]) -> Iterator[bytes]:
        cut = [[piece.encode() for piece in self.split(part)] for part in parts]
        distinct = {piece for pieces in cut for piece in pieces}
        short = [p for p in distinct if len(p) <= SHORT and p not in self.ranks]
        together = short if self.pairs and len(short) >= MANY else []
        ids = dict(zip(together, self.pairs.merged(together), strict=True)) if together else {}
        for piece in distinct:
            if piece not in ids:
                ids[piece] = b"".join([i.to_bytes(4, "little") for i in merged(piece, self.ranks)])
        for pieces in cut:
            yield b"".join([ids[piece] for piece in pieces])

    def encode(self, texts: list[str]) -> list[bytes]:
        return self.coder(texts)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, memoryview(ids).cast("I")))


def _appended(df: DataFrame, name: str, source: str, path: str, pattern: str, made, keep: list[str] | None) -> DataFrame:
    """The columns `keep` of `df` (none given: all) and a binary column made from another one, batch by batch; no shuffle."""
    kept = [c for c in (df.columns if keep is None else keep) if c != name]
    needed = kept if source in kept else [*kept, source]
    df = df.select(*[F.col(f"`{c}`") for c in needed])
    at, n = needed.index(source), len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(path, pattern)
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_pylist()
            for begin, end in stretches(sizes, BATCH_BYTES):
                part = batch.slice(begin, end - begin)
                column = pa.array(made(codec, part.column(at).to_pylist()), pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns[:n], column], [*kept, name])
        codec.coder.forget()

    return df.mapInArrow(tidy(run), StructType([*df.schema.fields[:n], StructField(name, BinaryType())]))


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """`docs`, or the columns `keep` of it, with the ids of each text as little-endian unsigned 32-bit integers."""
    return _appended(docs, ids, text, path, pattern, lambda codec, texts: codec.encode([t or "" for t in texts]), keep)


def decode(coded: DataFrame, path: str, pattern: str, ids: str = "ids", decoded: str = "decoded", keep: list[str] | None = None) -> DataFrame:
    """`coded`, or the columns `keep` of it, with the bytes that its ids stand for; null ids give no bytes."""
    return _appended(coded, decoded, ids, path, pattern, lambda codec, values: [codec.decode(v or b"") for v in values], keep)
