"""Jaccard join of shingle sets by a token-group matrix.

1. Every text becomes the set of its distinct word shingles, as 64-bit hashes. Equal sets are one class.
2. Shingles are ordered, rare ones first. Two sets of the asked similarity share a shingle within the first `n - need + 1`
   of each (prefix), whatever the order is; a text without a near copy has only shingles of its own there and is done.
   This is done twice: over all sets with the shingles in the lowest `counted` share of the hash space (by the number of
   sets that hold them, then the others by hash), and over the sets that are left with all of their shingles, which
   also leaves out texts that merely share passages.
3. The classes left are put into groups of similar ones, by their smallest shingle, of bounded size. A group stores the
   union of its members' shingles.
4. A member of one group can only reach the similarity with members of another if the union of that group holds enough of
   its shingles. Only groups that pass this bound are opened, and the members' sets compared.
5. Groups that share a prefix shingle are compared with that shingle's leading group first. What this links needs no
   further work; all pairs that still lie in different components are compared after that. So a large set of near copies
   costs about a comparison per group, and no pair is left out.

The result is one row per text; links travel as spanning forests. No list of the rows of a shingle is collected.

Null or empty texts have an empty set and link with nothing. Repeated rows are linked copies. Ids may be null or tied; the
smallest id of a component that is not null names it, and a row without any has null. Extra columns are not used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitewarden.llm.components import components, forest
from sitewarden.llm.tables import dropped, parts, run_folder, saved, tidy

WORDS, PERCENT = 5, 80
#: Share of the hash space whose shingles are counted; more prunes more and shuffles more. At least 0.2 is of use.
COUNTED = 0.3
#: A group holds about this many members and shingles at most.
MEMBERS, SHINGLES = 64, 40_000
KNOWN_WORDS = 500_000
#: Bits of the filter that keeps sets without a partner out of the second shuffle; a fixed bound of 2 MB, never a limit on rows.
FILTER_BITS = 1 << 24

SETS = "a bigint, b bigint, n int, counted int, low bigint, tokens array<bigint>"


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Distinct word shingles of texts as sorted 64-bit hashes."""

    def __init__(self, words: int = WORDS):
        self.words = words
        self.odd = np.random.default_rng(words).integers(1, 1 << 63, words, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.known: dict[bytes, int] = {}
        self.table = np.empty(1 << 12, dtype=np.uint64)

    def hashes(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        try:
            return self.table[np.fromiter(map(known.__getitem__, words), np.int64, len(words))]
        except KeyError:
            new = [w for w in set(words) if w not in known]
            if len(known) + len(new) > KNOWN_WORDS:
                known.clear()
                new = list(set(words))
            while len(known) + len(new) > len(self.table):
                self.table = np.concatenate([self.table, np.empty_like(self.table)])
            for w in new:
                self.table[len(known)] = xxhash.xxh3_64_intdigest(w)
                known[w] = len(known)
            return self.table[np.fromiter(map(known.__getitem__, words), np.int64, len(words))]

    def __call__(self, text: str) -> np.ndarray:
        words = text.encode().lower().split()  # bytes: A-Z only, and blanks of ASCII only
        if not words:
            return np.empty(0, dtype=np.uint64)
        h, k = self.hashes(words), self.words
        if len(h) < k:
            return mixed((h * self.odd[: len(h)]).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(h)))
        rows = len(h) - k + 1
        total = h[:rows] * self.odd[0]
        for i in range(1, k):
            total += h[i : i + rows] * self.odd[i]
        return np.unique(mixed(total))


def set_id(tokens: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set, as two signed numbers."""
    d = xxhash.xxh3_128_digest(tokens.tobytes())
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def _first_tokens(docs: DataFrame, text: str, words: int, percent: int, counted: float) -> DataFrame:
    """Columns of `docs` without the text, and SETS: the shingles that are counted, at least as many as the prefix has.

    A task leaves out the tokens of a set that it has seen; the first copy speaks for all of them.
    """
    at = docs.columns.index(text)
    kept = [f for f in docs.schema.fields if f.name != text]
    cut = np.uint64(min(int(counted * 2**64), 2**63 - 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, seen = Shingler(words), set()
        for batch in parts(batches):
            rows, lists = [], []
            for value in batch.column(at).to_pylist():
                tokens = shingler(value or "")
                n = len(tokens)
                if not n:
                    rows.append((None, None, 0, 0, None))
                    lists.append(None)
                    continue
                a, b = set_id(tokens)
                under = int(np.searchsorted(tokens, cut))
                rows.append((a, b, n, under, int(tokens[0].view(np.int64))))
                if a in seen:
                    lists.append(None)
                    continue
                if len(seen) > KNOWN_WORDS:
                    seen.clear()
                seen.add(a)
                lists.append(tokens[: max(under, prefix_length(n, percent))].view(np.int64))
            if rows:
                made = [pa.array(c, k) for c, k in zip(zip(*rows), [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64()], strict=True)]
                others = [c for i, c in enumerate(batch.columns) if i != at]
                names = [n for i, n in enumerate(batch.schema.names) if i != at] + [f.split()[0] for f in SETS.split(", ")]
                yield pa.RecordBatch.from_arrays([*others, *made, pa.array(lists, pa.list_(pa.int64()))], names)

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept) + SETS
    return docs.mapInArrow(tidy(run), schema)


def _prefixes(sets: DataFrame, classes: DataFrame, percent: int, counted: float) -> DataFrame:
    """(a, token): prefix shingles that at least two classes hold."""
    cut = min(int(counted * 2**64), 2**63 - 1)
    rows = sets.where("tokens IS NOT NULL").select("a", F.explode("tokens").alias("token"))
    same = Window.partitionBy("token")
    rows = rows.select("a", "token", F.min("a").over(same).alias("least"), F.max("a").over(same).alias("most"), F.count("*").over(same).alias("df"))
    shared = rows.where("least < most").select("a", "token", "df", F.col("token").between(0, cut - 1).alias("is_counted"))
    order = Window.partitionBy("a", "is_counted")
    shared = shared.withColumn("rank", F.dense_rank().over(order.orderBy("df", "token")))
    shared = shared.withColumn("many", F.max("rank").over(order))
    sizes = classes.groupBy("a").agg(F.max("n").alias("n"), F.max("counted").alias("counted"))
    need = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    # Counted shingles of one set alone come before the shared ones; others are there only if the prefix reaches them.
    inside = ~F.col("is_counted") | (F.col("counted") - F.col("many") + F.col("rank") <= need)
    return shared.join(sizes, "a").where(inside).select("a", "token")


def _ranked_prefixes(rows: DataFrame, percent: int) -> DataFrame:
    """(id, token): prefix shingles that at least two sets hold, from whole sets (id, n, tokens), rare shingles first."""
    rows = rows.select("id", "n", F.explode("tokens").alias("token"))
    rows = rows.withColumn("df", F.count("*").over(Window.partitionBy("token"))).where("df > 1")
    own = Window.partitionBy("id")
    rows = rows.withColumn("rank", F.row_number().over(own.orderBy("df", "token"))).withColumn("many", F.count("*").over(own))
    need = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    return rows.where(F.col("n") - F.col("many") + F.col("rank") <= need).select("id", "token")


def _filter_bits(keys: DataFrame, count: int, limit: int) -> tuple[int, bytes]:
    """A bit map that has the bits of every key `a`; its size is bounded by `limit`."""
    bits = 1 << min(max(16, (16 * count).bit_length()), limit.bit_length() - 1)
    places = keys.select(F.explode(F.array(F.pmod("a", F.lit(bits)), F.pmod(F.shiftright("a", 32), F.lit(bits)))).alias("p"))
    words = places.groupBy((F.col("p") / 32).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 32 AS int))")).alias("v"))
    out = np.zeros(bits // 32, dtype=np.uint32)
    for row in words.toLocalIterator():
        out[row["w"]] = row["v"]
    return bits, out.tobytes()


def _whole_sets(docs: DataFrame, text: str, words: int, bits: int, bitmap: bytes) -> DataFrame:
    """(a, b, tokens) of the sets whose bits are in the map, at most once per task."""
    held = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, seen, words_of = Shingler(words), set(), np.frombuffer(held.value, dtype=np.uint32)
        has = lambda p: int(words_of[p >> 5]) >> (p & 31) & 1
        for batch in parts(batches):
            rows = []
            for value in batch.column(0).to_pylist():
                tokens = shingler(value or "")
                if not len(tokens):
                    continue
                a, b = set_id(tokens)
                if a in seen or not (has(a % bits) and has((a >> 32) % bits)):
                    continue
                if len(seen) > KNOWN_WORDS:
                    seen.clear()
                seen.add(a)
                rows.append((a, b, tokens.view(np.int64)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), [pa.int64(), pa.int64(), pa.list_(pa.int64())], strict=True)], ["a", "b", "tokens"])

    return docs.select(text).mapInArrow(tidy(run), "a bigint, b bigint, tokens array<bigint>")


class Group:
    """Members of a group: class ids, and their sorted shingles one after the other."""

    def __init__(self, ids, sizes, tokens):
        self.ids, self.sizes, self.tokens = np.frombuffer(ids, "<i8"), np.frombuffer(sizes, "<i8"), np.frombuffer(tokens, "<u8")
        self.ends = np.cumsum(self.sizes)
        self.owner = np.repeat(np.arange(len(self.ids)), self.sizes)

    @classmethod
    def of(cls, members: pa.StructArray) -> Group:
        lists = members.field("tokens")
        sizes = np.diff(lists.offsets.to_numpy()).astype("<i8")
        return cls(members.field("id").to_numpy().tobytes(), sizes.tobytes(), lists.flatten().to_numpy().tobytes())

    def links(self, other: Group, percent: int) -> np.ndarray:
        """(place here, place there) of members whose sets are similar enough."""
        union = np.unique(other.tokens)
        at = np.minimum(np.searchsorted(union, self.tokens), len(union) - 1)
        hit = union[at] == self.tokens
        bound = np.bincount(self.owner[hit], minlength=len(self.ids))
        found = []
        wide = max(1, (1 << 26) // len(union))
        for first in range(0, len(other.ids), wide):
            matrix = None
            for q in np.flatnonzero(100 * bound >= percent * self.sizes):  # open the group
                if matrix is None:
                    columns = other.owner - first
                    own = (columns >= 0) & (columns < wide)
                    matrix = np.zeros((len(union), min(wide, len(other.ids) - first)), dtype=bool)
                    matrix[np.searchsorted(union, other.tokens[own]), columns[own]] = True
                part = slice(self.ends[q] - self.sizes[q], self.ends[q])
                both = matrix[at[part][hit[part]]].sum(axis=0, dtype=np.int64)
                sizes = other.sizes[first : first + wide]
                for r in np.flatnonzero(100 * both >= percent * (self.sizes[q] + sizes - both)):
                    found.append((q, first + r))
        return np.array(found, dtype=np.int64).reshape(-1, 2)


def _forest_edges(ids: np.ndarray, links: np.ndarray) -> list[dict]:
    top = forest(links, len(ids))
    child = np.flatnonzero(top != np.arange(len(ids)))
    return [{"a": a, "b": b} for a, b in zip(ids[child].tolist(), ids[top[child]].tolist(), strict=True)]


EDGES = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))


def _built(percent: int):
    """Groups from their members, with a spanning forest of the links inside."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for g, members in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                group = Group.of(members.values)
                edges = _forest_edges(group.ids, group.links(group, percent)) if len(group.ids) > 1 else []
                yield pa.RecordBatch.from_arrays(
                    [pa.array([g]), pa.array([group.ids.tobytes()]), pa.array([group.sizes.tobytes()]), pa.array([group.tokens.tobytes()], pa.binary()), pa.array([edges], EDGES)],
                    ["g", "ids", "sizes", "tokens", "edges"],
                )

    return run


def _compared(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            edges = []
            for pair in parts([batch], 1):  # a row holds two whole groups
                row = pair.to_pylist()[0]
                x, y = (Group(row["ids" + k], row["sizes" + k], row["tokens" + k]) for k in ("", "2"))
                links = x.links(y, percent)
                if len(links):
                    edges += _forest_edges(np.concatenate([x.ids, y.ids]), links + np.array([0, len(x.ids)]))
            yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in edges], pa.int64()) for k in ("a", "b")], ["a", "b"])

    return run


def _links_between(pairs: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    load = groups.select("g", "ids", "sizes", "tokens")
    rows = pairs.join(load, "g").join(load.select(*[F.col(c).alias(c + "2") for c in load.columns]), "g2")
    return rows.mapInArrow(tidy(_compared(percent)), "a bigint, b bigint")


def similar_components(docs: DataFrame, keys: list[str], text: str = "text", words: int = WORDS, percent: int = PERCENT, counted: float = COUNTED) -> DataFrame:
    """The key columns of every row, n_shingles, and component: a number per set of linked texts, null for empty sets.

    The keys are numbers.
    """
    spark = docs.sparkSession
    folder = run_folder(spark)
    docs = docs.select(*[F.col(k).cast("bigint").alias(k) for k in keys], F.col(text).alias("__text"))
    sets = saved(_first_tokens(docs, "__text", words, percent, counted), f"{folder}/sets")
    classes = sets.where("n > 0").groupBy("a", "b").agg(F.max("n").alias("n"), F.max("counted").alias("counted"), F.max("low").alias("low"))
    classes = saved(classes.withColumn("id", F.monotonically_increasing_id()), f"{folder}/classes")
    prefixes = saved(_prefixes(sets, classes, percent, counted), f"{folder}/prefixes")

    # Sets without a partner stay behind; the others are read once more in whole.
    first = saved(classes.join(prefixes.select("a").distinct(), "a", "left_semi").select("a", "b", "id", "n", "low"), f"{folder}/first")
    bits, bitmap = _filter_bits(first, first.count(), FILTER_BITS)
    whole = _whole_sets(docs, "__text", words, bits, bitmap).join(first, ["a", "b"]).dropDuplicates(["a", "b"])
    whole = saved(whole.select("id", "n", "low", "tokens"), f"{folder}/whole")
    prefixes = saved(_ranked_prefixes(whole, percent), f"{folder}/ranked")

    # Groups: classes of one smallest shingle, dealt to as many groups as their number and their sizes ask for.
    active = whole.select("id", "n", "low").join(prefixes.select("id").distinct(), "id", "left_semi")
    parts = active.groupBy("low").agg(F.greatest(F.ceil(F.count("*") / MEMBERS), F.ceil(F.sum("n") / SHINGLES)).alias("parts"))
    members = active.join(parts, "low").select("id", F.xxhash64("low", F.pmod(F.xxhash64("id"), "parts")).alias("g"))
    members = saved(members, f"{folder}/members")
    # About MEMBERS rows a group.
    groups = whole.select("id", "tokens").join(members, "id").groupBy("g").agg(F.collect_list(F.struct("id", "tokens")).alias("members"))
    groups = saved(groups.mapInArrow(tidy(_built(percent)), "g bigint, ids binary, sizes binary, tokens binary, edges array<struct<a: bigint, b: bigint>>"), f"{folder}/groups")
    inner = groups.select(F.explode("edges").alias("e")).select("e.a", "e.b")

    held = saved(prefixes.join(members, "id").select("token", "g").distinct(), f"{folder}/held")
    leaders = held.groupBy("token").agg(F.min("g").alias("g2"), F.max("g").alias("last")).where("g2 < last").drop("last")
    led = saved(held.join(leaders, "token").where("g <> g2").select("g", "g2").distinct(), f"{folder}/led")
    to_leaders = saved(_links_between(led, groups, percent), f"{folder}/leader-links")
    known = components(inner.unionByName(to_leaders), f"{folder}/known").withColumnRenamed("node", "id")

    # A group within one component needs no comparison with others of it.
    state = members.join(known, "id", "left").withColumn("component", F.coalesce("component", "id")).groupBy("g").agg(F.min("component").alias("c"), F.max("component").alias("d"))
    state = state.select("g", F.when(F.col("c") == F.col("d"), F.concat(F.lit("c"), F.col("c"))).otherwise(F.concat(F.lit("g"), F.col("g"))).alias("state"))
    state = saved(held.join(state, "g"), f"{folder}/states")
    open_tokens = state.groupBy("token").agg(F.min("state").alias("x"), F.max("state").alias("y")).where("x < y").select("token")
    left = state.join(open_tokens, "token")
    other = left.select("token", F.col("g").alias("g2"), F.col("state").alias("state2"))
    pairs = left.join(other, "token").where("g > g2 AND state <> state2").select("g", "g2").distinct()
    pairs = pairs.join(led, ["g", "g2"], "left_anti")
    rest = saved(_links_between(pairs, groups, percent), f"{folder}/rest-links")
    tops = components(inner.unionByName(to_leaders).unionByName(rest), f"{folder}/all").withColumnRenamed("node", "id")
    numbered = classes.select("a", "b", "id").join(tops, "id", "left").select("a", "b", F.coalesce("component", "id").alias("component"))
    done = saved(sets.drop("tokens", "counted", "low").join(numbered, ["a", "b"], "left").drop("a", "b"), f"{folder}/done")
    for used in ("sets", "prefixes", "whole", "ranked", "groups", "held", "states"):
        dropped(spark, f"{folder}/{used}")
    return done.withColumnRenamed("n", "n_shingles")


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """key, n_shingles, component_id of every row."""
    found = similar_components(docs, [key], text, **options)
    least = found.where("component IS NOT NULL").groupBy("component").agg(F.min(key).alias("component_id"))
    return found.join(least, "component", "left").select(
        key, F.col("n_shingles").cast("bigint").alias("n_shingles"), F.when(F.col("component").isNull(), F.col(key)).otherwise(F.col("component_id")).alias("component_id")
    )


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of `docs` that stay when one of every set of linked texts stays: the one with the smallest key.

    Rows that repeat both key and text count as one document. Rows without words link with nothing, and all of them stay,
    repeated ones too. Null keys come first.
    """
    wordless = ~F.coalesce(F.col(text), F.lit("")).rlike("[^\\x20\\x09-\\x0D]")
    place = F.coalesce(F.col(key).cast("bigint"), F.lit(0))
    rows = docs.withColumns({"__place": place, "__mark": F.xxhash64(F.coalesce(F.col(text), F.lit("")), F.col(key).isNull())})
    found = similar_components(rows, [key, "__place", "__mark"], text, **options)
    best: Column = F.min(F.struct(key, "__place", "__mark"))
    kept = found.where("component IS NOT NULL").groupBy("component").agg(best.alias("k")).select("k.__place", "k.__mark")
    # The join leaves the rows where the last step needs them, so texts are shuffled once.
    one = rows.where(~wordless).join(kept, ["__place", "__mark"], "left_semi").dropDuplicates(["__place", "__mark"])
    rows = one.unionByName(rows.where(wordless))
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns])
