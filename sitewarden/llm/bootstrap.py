"""Personal data by patterns, and by contexts learned from them, with SQL functions only.

Four base kinds are found by pattern and checked (address parts, Luhn sum, number of digits). They seed a bootstrap: the
label in front of a find ("Phone:", "customer no. ="), the last one, two and three words in front of it ("call me at") and
the word behind it are lexical patterns; every identifier (a run of letters, digits and hyphens with a digit in it) in such a
place is an instance. Patterns and instances form a graph that is scored in
rounds: a pattern is as good as the mean of its distinct instances, an instance as good as at least one of its patterns;
seeds stay at 1. Identifiers behind patterns of high score become spans of kind `context`.

Positions come from cutting a text at the matches: the gaps and the matches, summed up in order, give all offsets.

Null text counts as empty and has no spans. Each row is handled on its own, repeated rows give repeated results. Empty
tables give no rows. Other columns are passed on; one named like the output is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewarden.llm.tables import run_folder, saved

KINDS = ("email", "ip", "card", "phone", "context")

#: Possessive forms of the four patterns: they match the same, without going back. `\G` lets an address begin where the
#: one before it ended.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])[0-9](?:[\x20-]?+[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IDENTIFIER = r"(?<![A-Za-z0-9-])[A-Za-z-]*+[0-9][A-Za-z0-9-]*+"
#: A label: words and a colon, equals or number sign, at the end of the gap before a match. Its last word alone and its last
#: three words are two patterns.
LABELS = [rf"([A-Za-z][A-Za-z._-]*(?:\x20[A-Za-z][A-Za-z._-]*){{0,{more}}}\x20?[:=#])[\x20\"']*$" for more in (0, 2)]
#: The last one, two and three words of the gap before a match, and the first word of the gap behind it.
WORD = r"[A-Za-z][A-Za-z'-]*+"
LEFT = [rf"(?<![A-Za-z'-])((?:{WORD}[,;.]?\x20){{{more}}}{WORD}[,;.]?)[\x20\"'(]+$" for more in (0, 1, 2)]
RIGHT = rf"^[\x20\"'),;.]*\x20[\"'(]*({WORD})"
LABEL_CHARS, LEAST_CHARS = 80, 5
_SPANS = "CAST(array() AS array<struct<start: bigint, end: bigint, value: string, left: string, right: string>>)"

ROUNDS, LEAST_SCORE, LEAST_SUPPORT = 3, 0.6, 3


def _octet(n: int) -> str:
    return r"0*(?:[0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])" + (r"\." if n < 3 else "")


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    digits = F.reverse(_digits(value))
    doubled = F.lit("0246813579")

    def add(total: Column, i: Column) -> Column:
        digit = F.substring(digits, i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, digit).otherwise(F.substring(doubled, digit + 1, F.lit(1)).cast("int"))

    n = F.length(digits)
    return n.between(14, 19) & (F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0)


def _cut(text: Column, pattern: str, keep) -> Column:
    """(start, end, value, left, right) of the matches of a pattern that `keep` accepts; the ends of the gaps beside it."""
    matches, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    empty = F.expr(_SPANS)

    def step(state: Column, pair: Column) -> Column:
        start = state.at + F.length(pair.gap)
        end = start + F.length(pair.value)
        span = F.struct(start.alias("start"), end.alias("end"), pair.value.alias("value"), F.right(pair.gap, F.lit(LABEL_CHARS)).alias("left"), F.left(pair.next, F.lit(LABEL_CHARS)).alias("right"))
        return F.struct(end.alias("at"), F.concat(state.spans, F.array(span)).alias("spans"))

    beside = F.zip_with(F.slice(gaps, F.lit(1), F.size(matches)), F.slice(gaps, F.lit(2), F.size(matches)), lambda g, n: F.struct(g.alias("gap"), n.alias("next")))
    pairs = F.zip_with(matches, beside, lambda m, b: F.struct(m.alias("value"), b.gap.alias("gap"), b.next.alias("next")))
    spans = F.aggregate(pairs, F.struct(F.lit(0).cast("bigint").alias("at"), empty.alias("spans")), step).spans
    return F.filter(spans, lambda s: keep(s.value))


def _when(condition: Column, spans: Column) -> Column:
    return F.when(condition, spans).otherwise(F.expr(_SPANS))


def _labels(left: Column, right: Column) -> Column:
    behind = F.regexp_extract(right, RIGHT, 1)
    found = F.array(*[F.lower(F.regexp_extract(left, p, 1)) for p in [*LABELS, *LEFT]], F.when(behind != "", F.concat(F.lit("> "), F.lower(behind))).otherwise(""))
    return F.array_distinct(F.filter(found, lambda x: x != ""))


def base_and_candidates(docs: DataFrame, text: str) -> DataFrame:
    """`docs` with `base` (kind, start, end, value, labels), in order, and `candidates` of the same form outside of them."""
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    digit = body.rlike("[0-9]")
    found = {
        "email": _when(F.contains(body, F.lit("@")), _cut(body, EMAIL, lambda v: F.lit(True))),
        "ip": _when(body.rlike(r"[0-9]\.[0-9]"), _cut(body, IP, lambda v: v.rlike("^" + "".join(map(_octet, range(4))) + "$"))),
        "card": _when(body.rlike(r"[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]"), _cut(body, CARD, _luhn)),
        "phone": _when(body.rlike(r"\+[0-9]"), _cut(body, PHONE, lambda v: F.length(_digits(v)).between(10, 15))),
        "context": _when(digit, _cut(body, IDENTIFIER, lambda v: F.length(v) >= LEAST_CHARS)),
    }

    def kind(n: int) -> Column:
        return F.transform(f"__{KINDS[n]}", lambda s: F.struct(s.start.alias("start"), F.lit(n).alias("n"), F.lit(KINDS[n]).alias("kind"), s.end.alias("end"), F.lower(s.value).alias("value"), _labels(s.left, s.right).alias("labels")))

    rows = docs.withColumns({f"__{k}": v for k, v in found.items()})
    rows = rows.withColumn("__base", F.array_sort(F.concat(*[kind(n) for n in range(4)])))
    rows = rows.withColumn("__candidates", F.filter(kind(4), lambda c: F.size(c.labels) > 0))
    outside = lambda c: ~F.exists("__base", lambda b: (b.start < c.end) & (c.start < b.end))
    return rows.withColumn("__candidates", F.filter("__candidates", outside)).drop(*[f"__{k}" for k in KINDS])


def scored_patterns(edges: DataFrame, folder: str, rounds: int = ROUNDS) -> DataFrame:
    """pattern, score, support from distinct (pattern, instance, seed); seeds are 1, other instances learn from patterns."""
    instances = edges.groupBy("instance").agg(F.max("seed").cast("double").alias("known"))
    instances = saved(instances.withColumn("trust", F.col("known")), f"{folder}/instances-0")
    for n in range(1, rounds + 1):
        # Partial sums by pattern and by instance; both sides are split by Spark when a label is very common.
        patterns = edges.join(instances, "instance").groupBy("pattern").agg(F.avg("trust").alias("score"), F.sum(F.when(F.col("trust") >= LEAST_SCORE, 1).otherwise(0)).alias("support"))
        patterns = saved(patterns.where("score > 0"), f"{folder}/patterns-{n}")
        if n < rounds:
            usable = patterns.where(F.col("support") >= LEAST_SUPPORT)
            learned = edges.join(usable, "pattern").groupBy("instance").agg((1 - F.exp(F.sum(F.log1p(-F.least("score", F.lit(0.999)))))).alias("learned"))
            instances = instances.join(learned, "instance", "left").select("instance", "known", F.greatest("known", F.coalesce("learned", F.lit(0.0))).alias("trust"))
            instances = saved(instances, f"{folder}/instances-{n}")
    return patterns


def find_personal(
    docs: DataFrame, text: str = "text", out: str = "personal", keep: list[str] | None = None,
    least_score: float = LEAST_SCORE, least_support: int = LEAST_SUPPORT, rounds: int = ROUNDS,
) -> DataFrame:
    """The columns in `keep` (all by default) with an array of (kind, start, end), in order; offsets are code points, the end exclusive."""
    folder = run_folder(docs.sparkSession)
    kept = [c for c in (keep if keep is not None else docs.columns) if c != out]
    rows = base_and_candidates(docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*kept, text])]), text)
    rows = rows.select(*[F.col(f"`{c}`") for c in kept], "__base", "__candidates", F.monotonically_increasing_id().alias("__row"))
    rows = saved(rows, f"{folder}/rows")
    seeds = rows.select(F.explode("__base").alias("s")).select(F.explode("s.labels").alias("pattern"), F.col("s.value").alias("instance"), F.lit(1).alias("seed"))
    others = rows.select(F.explode("__candidates").alias("s")).select(F.explode("s.labels").alias("pattern"), F.col("s.value").alias("instance"), F.lit(0).alias("seed"))
    edges = seeds.unionByName(others).groupBy("pattern", "instance").agg(F.max("seed").alias("seed"))
    edges = saved(edges, f"{folder}/edges")
    good = scored_patterns(edges, folder, rounds).where((F.col("score") >= least_score) & (F.col("support") >= least_support))
    # Only rows with candidates take part in the join; the others, and their texts, are not shuffled.
    with_candidates = rows.where(F.size("__candidates") > 0)
    discovered = with_candidates.select("__row", F.explode("__candidates").alias("s")).select("__row", "s", F.explode("s.labels").alias("pattern"))
    discovered = discovered.join(good.select("pattern"), "pattern").groupBy("__row").agg(F.collect_set("s").alias("__found"))
    none = F.slice("__candidates", 1, 0)
    joined = with_candidates.join(discovered, "__row", "left").withColumn("__found", F.coalesce("__found", none))
    joined = joined.unionByName(rows.where(F.size("__candidates") == 0).withColumn("__found", none))
    spans = F.array_sort(F.concat("__base", "__found"))
    simple = F.transform(spans, lambda s: F.struct(s.kind.alias("kind"), s.start.alias("start"), s.end.alias("end")))
    return joined.select(*[F.col(f"`{c}`") for c in kept], simple.alias(out))


def masked(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in angle brackets; spans that overlap count as one of the first kind."""
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("text"))

    def step(state: Column, s: Column) -> Column:
        gap = F.substring(text, (state.at + 1).cast("int"), F.greatest(s.start - state.at, F.lit(0)).cast("int"))
        new = s.start >= state.at
        return F.struct(F.greatest(state.at, s.end).alias("at"), F.when(new, F.concat(state.text, gap, F.lit("<"), s.kind, F.lit(">"))).otherwise(state.text).alias("text"))

    done = F.aggregate(spans, start, step)
    return F.when(F.size(spans) > 0, F.concat(done.text, F.substring(text, (done.at + 1).cast("int"), F.length(text)))).otherwise(text)
