"""Memory of Python workers: what a step leaves behind, and how much of a batch it unpacks at a time."""

import re

import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sitewarden.llm import byte_bpe, crf, group_matrix, packing, queries
from sitewarden.llm.tables import parts, tidy, whole_numbers

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def own_mb():
    return int(re.search(r"RssAnon:\s+(\d+)", open("/proc/self/status").read())[1]) / 1024


def test_a_step_gives_its_memory_back():
    pins, most = [], []

    def run(batches):
        for batch in batches:
            rows = [b"x" * (1000 + n % 1000) for n in range(150_000)]
            pins.append(rows[-1])  # in the way of the heap's end
            most.append(own_mb())
            yield batch

    batch = pa.record_batch([pa.array([1])], ["x"])
    before = own_mb()
    assert list(tidy(run)(iter([batch]))) == [batch]
    assert most[0] - before < 150 or own_mb() - before < 100


def docs_of(spark, n=2500):
    texts = [None, "", "one two", "a b c d e f g"]
    return spark.createDataFrame([(i, texts[i % 4] if i % 5 else f"text number {i} of some words") for i in range(n)], "doc_id long, text string").coalesce(1)


@pytest.fixture
def steps(spark, monkeypatch):
    made, kind = [], type(spark.range(1))
    plain = kind.mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", lambda self, f, *a, **b: (made.append(f), plain(self, f, *a, **b))[1])
    return made


def test_steps_of_the_pipeline_unpack_parts_of_a_batch(spark, steps):
    docs = docs_of(spark)
    crf.score(docs, crf.Model())
    group_matrix._first_tokens(docs, "text", 5, 80, 0.3)
    batch = pa.record_batch([pa.array([r.doc_id for r in docs.collect()]), pa.array([r.text for r in docs.collect()])], ["doc_id", "text"])
    for step in steps:
        out = list(step(iter([batch])))
        assert [b.num_rows for b in out] == [1000, 1000, 500]
        assert pa.Table.from_batches(out).column("doc_id").to_pylist() == batch.column(0).to_pylist()
    packing.token_pieces(docs, VOCABULARY)
    assert len(steps) == 3 and all(s.__qualname__.startswith("tidy") for s in steps)


def test_steps_of_byte_bpe_unpack_parts_of_a_batch_and_forget_its_words(spark, steps, monkeypatch, tmp_path):
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    rows = [(i, t, "x") for i, t in enumerate(["one two three"] * 40 + [None, "", "long words " * 500] + [f"word{n} and word{n}" for n in range(40)])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, other string")
    coded = byte_bpe.encode(docs, *ranks, keep=["doc_id"])
    back = byte_bpe.decode(coded, *ranks, keep=["doc_id"])
    assert coded.columns == ["doc_id", "ids"] and back.columns == ["doc_id", "decoded"]
    assert {r.doc_id: bytes(r.decoded).decode() for r in back.collect()} == {i: t or "" for i, t, _ in rows}
    assert byte_bpe.encode(docs, *ranks).columns == ["doc_id", "text", "other", "ids"]
    monkeypatch.setattr(byte_bpe, "BATCH_BYTES", 300)
    batch = pa.record_batch([pa.array([i for i, _, _ in rows]), pa.array([t for _, t, _ in rows])], ["doc_id", "text"])
    for step in steps[:2]:
        assert step.__qualname__.startswith("tidy")
        out = list(step(iter([batch])))
        assert len(out) > 3 and max(b.num_rows for b in out) < 40 and [b.schema.names[0] for b in out] == ["doc_id"] * len(out)
        assert pa.Table.from_batches(out).column("doc_id").to_pylist() == list(range(len(rows)))
        assert not byte_bpe.Codec.of(*ranks).coder.known
        batch = pa.Table.from_batches(out).combine_chunks().to_batches()[0]
    assert batch.column(1).to_pylist() == [(t or "").encode() for _, t, _ in rows]
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    plan = queries.op10_byte_bpe(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall("MapInArrow", plan)) == 2 and not re.search(r"MapInArrow.*\[.*\btext#", plan)


def test_parts_and_stretches():
    batches = [pa.record_batch([pa.array(range(n))], ["x"]) for n in (0, 5, 3)]
    assert [p.column(0).to_pylist() for p in parts(batches, 3)] == [[0, 1, 2], [3, 4], [0, 1, 2]]
    assert list(packing.stretches([], 5)) == []
    assert list(packing.stretches([9, 0, 2, 3, 1, 7, 0], 5)) == [(0, 1), (1, 4), (4, 5), (5, 6), (6, 7)]
    assert list(packing.stretches([0, 0, 5, 0, 1], 5)) == [(0, 4), (4, 5)]


def test_few_rows_need_no_worker(spark):
    rows = [(1, 2**40), (-3, 0)]
    made = whole_numbers(spark, rows, "a int, b long")
    assert [tuple(r) for r in made.collect()] == rows and made.dtypes == [("a", "int"), ("b", "bigint")]
    assert whole_numbers(spark, [], "a int, b long").count() == 0
    packed = packing.pack(docs_of(spark, 40), VOCABULARY)
    plan = packed._jdf.queryExecution().optimizedPlan().toString()
    assert "LogicalRDD" not in plan and "LocalRelation" in plan


def test_pieces_of_slices(spark):
    docs = docs_of(spark, 300)
    assert {r.doc_id for r in packing.token_pieces(docs, VOCABULARY, 4).collect()} == set(range(300))
    one = packing.token_pieces(docs.withColumn("text", F.concat("text", F.lit(" tail"))), VOCABULARY)
    tokens = packing.Tokens.of(VOCABULARY)
    ids = {r.doc_id: tokens.encode(r.text + " tail" if r.text is not None else "") for r in docs.collect()}
    assert {r.doc_id: r.doc_tokens for r in one.collect()} == {k: len(v) // 4 + 1 for k, v in ids.items()}
