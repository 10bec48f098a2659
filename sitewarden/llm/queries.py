"""The queries of this subpackage, each over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitewarden.llm import assignments, bootstrap, byte_bpe, crf, cross_entropy, group_matrix, line_quality, negatives, packing, projections, simhash, spans, variants, warc
from sitewarden.llm.tables import read, run_folder, saved

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_collision_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projections.near_duplicates(read(spark, sf_dir, "embeddings"))


@query
def op2_warc_reassembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = run_folder(spark)
    warc.write(read(spark, sf_dir, "pages"), f"{folder}/warc")
    narrow = warc.read_archives(spark, f"{folder}/warc").drop("payload", "uri", "digest", "intact")
    return warc.with_revisits(saved(narrow, f"{folder}/found")).withColumnRenamed("key", "page_id")


@query
def op3_toxic_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read(spark, sf_dir, "labels").where(~crf.held_out())
    return crf.score(docs, crf.train(docs, labels)).select(
        "doc_id",
        crf.held_out().alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        F.array_join(F.transform("toxic_spans", lambda s: F.concat_ws(":", s.start.cast("string"), s.end.cast("string"))), ",").alias("offsets"),
    )


@query
def op4_personal_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bootstrap.find_personal(read(spark, sf_dir, "documents"), keep=["doc_id"])
    counts = [spans.count_of("personal", k).alias(f"n_{k}") for k in bootstrap.KINDS]
    base = spans.joined("personal", bootstrap.KINDS[:4])
    return found.select("doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), spans.joined("personal").alias("spans"))


@query
def op5_assigned_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = assignments.find_secrets(read(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    counts = [spans.count_of("secrets", k).alias(f"n_{k}") for k in assignments.KINDS]
    base = spans.joined("secrets", assignments.KINDS[:3])
    return found.select("doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), spans.joined("secrets").alias("spans"))


@query
def op6_group_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_matrix.jaccard_components(read(spark, sf_dir, "documents"))


@query
def op7_cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target is what `labels` calls good text; the background is everything."""
    good = read(spark, sf_dir, "labels").where("quality = 1")
    return cross_entropy.score(read(spark, sf_dir, "documents"), good)


@query
def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with an id divisible by 50 are also searched: n_near counts the other documents within the radius, copies too.

    `near` has the fingerprints found and their distances, nearest first, once for a fingerprint: where its smallest id is.
    Which documents they stand for is told by `fingerprint`.
    """
    made = simhash.fingerprint_table(read(spark, sf_dir, "documents").select("doc_id", "text"))
    rows = saved(made.withColumnRenamed("text_fingerprint", "fingerprint"), f"{run_folder(spark)}/rows")
    text = lambda c: F.lower(F.lpad(F.hex(c), 16, "0"))
    searched = rows.where("key % 50 = 0")
    members = rows.groupBy(F.col("fingerprint").alias("found")).agg(F.count("*").alias("n"))
    pairs = simhash.within_radius(searched, rows, simhash.NEAR_RADIUS).join(members, "found")
    near = pairs.groupBy("query").agg((F.sum("n") - 1).alias("n_near"), F.array_sort(F.collect_list(F.when(F.col("query") != F.col("found"), F.struct("distance", text("found").alias("found"))))).alias("near"))
    near = near.join(searched.groupBy(F.col("fingerprint").alias("query")).agg(F.min("key").alias("at")), "query")
    rows = rows.withColumn("query", F.when(F.col("key") % 50 == 0, F.col("fingerprint"))).join(near, "query", "left")
    found = F.array_join(F.transform("near", lambda x: F.concat_ws(":", x.found, x.distance.cast("string"))), ",")
    return rows.select(
        F.col("key").alias("doc_id"),
        "n_chars",
        "edited_sha256",
        text("fingerprint").alias("fingerprint"),
        text("edited_text_fingerprint").alias("edited_fingerprint"),
        simhash.likeness(F.col("fingerprint"), F.col("edited_text_fingerprint")).alias("near_edited"),
        simhash.likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
        "n_near",
        F.when(F.col("key") == F.col("at"), found).alias("near"),
    )


@query
def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    coded = byte_bpe.encode(read(spark, sf_dir, "documents"), *ranks, keep=["doc_id"])
    return byte_bpe.decode(coded, *ranks).select(
        "doc_id",
        F.expr("octet_length(ids) div 4").cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op11_variant_grams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variants(variants.word_counts(read(spark, sf_dir, "documents")))


@query
def op12_slot_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors are the rows with an id divisible by 50; every seventh label is a wrong one."""
    wrong = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", "embedding", wrong.alias("label"))
    return negatives.hard_negatives(vectors, F.col("id") % 50 == 0)


ORACLE["op12_slot_negatives"] = """
WITH usable AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same,
         CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM usable a, usable b
  WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
),
positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT anchor_id, positive_id,
       CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank,
       id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""


@query
def op13_line_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read(spark, sf_dir, "labels").where(~line_quality.held_out())
    return line_quality.score(docs, line_quality.train(docs, labels)).select(
        "doc_id",
        line_quality.held_out().alias("held_out"),
        "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
        F.array_join(F.transform("good_lines", lambda p: F.format_number(p, 3)), ",").alias("lines"),
    )
