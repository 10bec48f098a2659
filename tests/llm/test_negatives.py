"""Hard negatives against brute force and SQL."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from checks.compare import connect, rows_of
from sitewarden.llm import negatives, queries
from tests.conftest import SMALL

ENDS = -(2**63), 2**63 - 1


def brute(rows, every):
    """Rows (id, label, vector) as they stand after `usable`."""
    seen = {}
    for i, y, v in rows:
        if i is None or y is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        row = (y, [float(x) for x in v])
        seen[i] = min(seen.get(i, row), row)
    whole = {i: [int(x) * 256 if abs(x) >= 2**53 else math.floor(256 * x) for x in v] for i, (_, v) in seen.items()}
    out = set()
    for a in sorted(seen):
        if a % every:
            continue
        score = {b: min(max(sum(x * y for x, y in zip(whole[a], whole[b], strict=False)), ENDS[0]), ENDS[1]) for b in seen if b != a}
        order = sorted(score, key=lambda b: (-score[b], b))
        for p in [b for b in order if seen[b][0] == seen[a][0]][:5]:
            inside = [b for b in order if seen[b][0] != seen[a][0] and 50 * score[p] <= 100 * score[b] <= 95 * score[p]][:3]
            out |= {(a, p, n + 1, b, score[p], score[b]) for n, b in enumerate(inside)}
    return out


def got(frame):
    rows = [tuple(r) for r in frame.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def table(seed, n=400, dims=6, labels=4):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(12, dims))
    rows = [(int(i), int(rng.integers(labels)), np.round(centre[rng.integers(12)] + rng.normal(size=dims) * 0.3, 1).tolist()) for i in range(n)]
    rows += [(1000 + i, 1, rows[0][2]) for i in range(30)] + [(2000 + i, 2, rows[0][2]) for i in range(30)]  # ties
    rows += rows[:20] + [(5, 3, [0.0] * dims), (7, 9, None), (None, 1, rows[0][2]), (3000, None, rows[0][2]), (3010, 1, None), (3020, 1, [None] * dims)]
    rows += [(3030, 1, [float("nan")] * dims), (3040, 1, [float("inf")] + [0.0] * (dims - 1)), (3050, 1, []), (3060, 2, []), (3070, 2, [1.0]), (3080, 77, [1.0, -0.0]), (3090, 2, [-0.0] * dims)]
    return rows


@pytest.mark.parametrize("anchor_block, row_block", [(512, 2048), (7, 16)])
def test_negatives(spark, anchor_block, row_block):
    rows = table(1)
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, label int, embedding array<double>, score string, limits int")
    mine = negatives.hard_negatives(frame.repartition(5), F.col("id") % 10 == 0, anchor_block=anchor_block, row_block=row_block)
    want = brute(rows, 10)
    assert len(want) > 300 and got(mine) == want


def test_very_large_components(spark):
    rows = [(i, i % 2, [s * x, 3.0]) for i, (s, x) in enumerate([(1, 1e300), (1, 1e17), (1, 9e16), (-1, 1e18), (1, 2.0**60), (1, 1.7e308), (1, 5e5), (1, 4e5), (1, 3.0), (1, 1e12), (1, 9e11)])]
    frame = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    assert got(negatives.hard_negatives(frame, F.col("id") % 1 == 0)) == brute(rows, 1)


def test_labels_of_other_types_and_empty_tables(spark):
    rows = [(i, str(i % 2) if i else "x", [1.0 + i % 3]) for i in range(12)]
    frame = spark.createDataFrame(rows, "vec_id long, label string, embedding array<double>")
    assert got(negatives.hard_negatives(frame, F.col("id") % 2 == 0)) == brute([(i, int(y) if y != "x" else None, v) for i, y, v in rows], 2)
    assert negatives.hard_negatives(frame.limit(0), F.col("id") % 2 == 0).count() == 0


def test_query_against_sql(spark):
    frame = queries.QUERIES["op12_slot_negatives"](spark, SMALL)
    cursor = connect(SMALL).execute(queries.ORACLE["op12_slot_negatives"])
    columns = [d[0] for d in cursor.description]
    assert columns == frame.columns
    want = rows_of(cursor.fetchall(), columns)
    assert want and rows_of(frame.collect(), frame.columns) == want
