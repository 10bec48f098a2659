"""SimHash fingerprints and search within a Hamming radius, with SQL functions only.

Each term of a text (a pair of neighbouring words; the word alone where there is just one) is hashed to 64 bits and
votes on every bit with its number of occurrences as weight. Votes are counted two bits to a sum, so a document needs
32 sums and one aggregation without its text. Fingerprints are searched by blocks of their bits: within the radius, at least
one block differs by at most its share of the bits, so a query looks up all values of a block that are as near as that.
Distinct fingerprints are paired; which documents have them is told by the fingerprints of the rows.

NEAR_RADIUS is what near copies need whose 5-word shingles have a Jaccard index of 0.8. Of pairs edited up to that limit it
holds 0.95 or more, whether words are replaced here and there, in one passage, or added at the end; see the README.

Null text counts as empty; a text without words has the fingerprint of no votes. Equal texts have equal fingerprints.
Rows may repeat and ids may be null or tied; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitewarden.llm.tables import run_folder, saved

LANE = 0x0000000100000001  # two counters of 32 bits in a sum
RADIUS, BLOCKS = 3, 4
NEAR_RADIUS = 14


def terms(text: Column) -> Column:
    """Pairs of neighbouring words of a text, or its only word."""
    words = F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    pairs = F.zip_with(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    return F.when(F.size(words) > 1, pairs).otherwise(words)


def fingerprints(rows: DataFrame, keys: list[str], texts: list[str]) -> DataFrame:
    """The keys, which tell rows apart, and a 64-bit fingerprint per text column, named after it.

    The keys travel with each term up to the partial sums of its own task; texts are not shuffled.
    """
    lists = F.array(*[F.struct(F.lit(n).alias("n"), terms(F.coalesce(F.col(t), F.lit(""))).alias("terms")) for n, t in enumerate(texts)])
    votes = rows.select(*keys, F.explode(lists).alias("x")).select(*keys, F.col("x.n").alias("n"), F.explode_outer("x.terms").alias("term"))
    votes = votes.select(*keys, "n", F.when(F.col("term").isNotNull(), F.xxhash64("term")).alias("h"))
    sums = [F.sum(F.shiftrightunsigned("h", k).bitwiseAND(F.lit(LANE))).alias(f"s{k}") for k in range(32)]
    counted = votes.groupBy(*keys, "n").agg(F.count("h").alias("terms"), *sums)

    def bit(k: int) -> Column:
        lane = F.col(f"s{k % 32}").bitwiseAND(F.lit(0xFFFFFFFF)) if k < 32 else F.shiftrightunsigned(f"s{k % 32}", 32)
        return F.when(2 * lane > F.col("terms"), F.lit(1 << k if k < 63 else -(1 << 63))).otherwise(F.lit(0).cast("bigint"))

    bits = [bit(k) for k in range(64)]
    while len(bits) > 1:
        bits = [a.bitwiseOR(b) for a, b in zip(bits[::2], bits[1::2], strict=True)]
    made = counted.select(*keys, "n", bits[0].alias("fingerprint"))
    return made.groupBy(*keys).agg(*[F.max(F.when(F.col("n") == n, F.col("fingerprint"))).alias(f"{t}_fingerprint") for n, t in enumerate(texts)])


def likeness(a: Column, b: Column) -> Column:
    return 1 - F.bit_count(a.bitwiseXOR(b)) / 64


def _place(key: str, cuts: list[int], block: int = 100) -> Column:
    """How many of the sorted cuts are at most the key, by blocks of cuts; 0 for null."""
    array = lambda values: F.lit(values).cast("array<bigint>")
    below = lambda values: F.size(F.filter(values, lambda c: c <= F.col(key)))
    if not cuts:
        return F.lit(0)
    whole = F.greatest(below(array(cuts[block - 1 :: block])), F.lit(0)) if len(cuts) >= block else F.lit(0)
    return whole * block + F.greatest(below(F.slice(array(cuts), whole * block + 1, F.lit(block))), F.lit(0))


def with_next(docs: DataFrame, key: str, text: str, rows_per_range: int = 2000, most_ranges: int = 10_000) -> DataFrame:
    """`docs` with `next_text`, the text of the row that follows by ascending key; the first one follows the last.

    Rows are dealt to ranges of the key; only the first row of each range travels to the range before it. Ties are
    ordered by a hash of the text, then the text; null keys come first.
    """
    spark = docs.sparkSession
    ranges = max(1, min(most_ranges, docs.count() // rows_per_range))
    shares = [n / ranges for n in range(1, ranges)]
    cuts = sorted(set(docs.agg(F.percentile_approx(key, shares, 20 * ranges)).first()[0] or [])) if shares else []
    rows = docs.withColumn("range", _place(key, cuts).cast("bigint"))
    body = F.coalesce(F.col(text), F.lit(""))
    order = [F.col(key).asc_nulls_first(), F.xxhash64(body), body]
    rows = rows.withColumn("next_in_range", F.lead(body).over(Window.partitionBy("range").orderBy(*order)))
    # One row per range, at most `most_ranges` of them; texts stay on the executors.
    first = F.min(F.struct(F.col(key).isNotNull().alias("a"), F.col(key).alias("b"), F.xxhash64(body).alias("c"), body.alias("text")))
    heads = docs.withColumn("range", _place(key, cuts).cast("bigint")).groupBy("range").agg(first.text.alias("head"))
    numbers = sorted(r[0] for r in docs.select(_place(key, cuts).cast("bigint")).distinct().collect())
    follow = spark.createDataFrame(list(zip(numbers, numbers[1:] + numbers[:1], strict=True)), "range long, next_range long")
    links = follow.join(heads.withColumnRenamed("range", "next_range"), "next_range").select("range", "head")
    return rows.join(links, "range").withColumn("next_text", F.coalesce("next_in_range", "head")).drop("range", "next_in_range", "head")


def edited(docs: DataFrame, text: str, share: int = 4) -> DataFrame:
    """`docs` (with next_text) plus edited_text: the last quarter replaced by as many characters of the next text."""
    cut = (F.length(text) / share).cast("int")
    return docs.withColumn("edited_text", F.concat(F.substring(text, F.lit(1), F.length(text) - cut), F.substring("next_text", F.lit(1), cut)))


def _probes(width: int, low: int, most: int) -> list[int]:
    """All masks of at most `most` of the `width` bits from bit `low`, as signed numbers."""
    masks = [sum(1 << low + b for b in bits) for n in range(most + 1) for bits in combinations(range(width), n)]
    return [_signed(m) for m in masks]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def within_radius(queries: DataFrame, all_rows: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """Distinct (query, found, distance) of fingerprints at most `radius` bits apart, from two tables with a column `fingerprint`.

    The shares of the blocks add up to radius - blocks + 1: if all blocks differed by more, more than `radius` bits would.
    Found fingerprints have one key a block. A pair counts in the first block that is within its share, so it comes once.
    """
    if not (0 <= radius < 64 and 1 <= blocks <= 64):
        raise ValueError("radius must be below 64, and there are 1 to 64 blocks")
    blocks = min(blocks, radius + 1)
    edges = [64 * n // blocks for n in range(blocks + 1)]
    masks = [F.lit(_signed((1 << edges[n + 1]) - (1 << edges[n]))) for n in range(blocks)]
    shares = [(radius + 1 - blocks) // blocks + (n < (radius + 1 - blocks) % blocks) for n in range(blocks)]

    def keys(df: DataFrame, name: str, of: Callable[[int], Column]) -> DataFrame:
        distinct = df.select(F.col("fingerprint").alias(name)).where(F.col(name).isNotNull()).distinct()
        return distinct.select(name, F.explode(F.concat(*map(of, range(blocks)))).alias("k")).select(name, "k.t", "k.block")

    def entry(n: int, value: Column) -> Column:
        return F.struct(F.lit(n).alias("t"), value.bitwiseAND(masks[n]).alias("block"))

    def probed(n: int) -> Column:
        # One literal in the plan, not one for each mask.
        flips = F.split(F.lit(",".join(map(str, _probes(edges[n + 1] - edges[n], edges[n], shares[n])))), ",").cast("array<bigint>")
        return F.transform(flips, lambda m: entry(n, F.col("query").bitwiseXOR(m)))

    # Merged: the few queries look small to the planner, which does not see how many keys they are exploded to.
    pairs = keys(queries, "query", probed).hint("merge").join(keys(all_rows, "found", lambda n: F.array(entry(n, F.col("found")))), ["t", "block"])
    differ = F.col("query").bitwiseXOR(F.col("found"))
    first = F.lit(True)
    for n in range(blocks - 1):
        first = first & ((F.col("t") <= n) | (F.bit_count(differ.bitwiseAND(masks[n])) > shares[n]))
    return pairs.where((F.bit_count(differ) <= radius) & first).select("query", "found", F.bit_count(differ).alias("distance"))


def text_id(text: Column) -> Column:
    """128 bits that stand for a text."""
    return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b"))


def fingerprint_table(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_chars, edited_sha256, and the fingerprints of its text, its edited text and the next row's text."""
    rows = docs.select(F.col(key).cast("bigint").alias("key"), F.coalesce(text, F.lit("")).alias("text"))
    rows = edited(with_next(rows, "key", "text"), "text")
    rows = rows.select(
        "key", "text", "edited_text", F.length("text").cast("bigint").alias("n_chars"), F.sha2("edited_text", 256).alias("edited_sha256"),
        text_id(F.col("text")).alias("text_id"), text_id(F.col("next_text")).alias("next_id"), F.monotonically_increasing_id().alias("row"),
    )
    keys = ["row", "key", "n_chars", "edited_sha256", "text_id", "next_id"]
    made = saved(fingerprints(rows, keys, ["text", "edited_text"]), f"{run_folder(docs.sparkSession)}/fingerprints")
    by_text = made.groupBy(F.col("text_id").alias("next_id")).agg(F.max("text_fingerprint").alias("next_fingerprint"))
    return made.join(by_text, "next_id").select("key", "n_chars", "edited_sha256", "text_fingerprint", "edited_text_fingerprint", "next_fingerprint")
