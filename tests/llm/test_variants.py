"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sitewarden.llm import queries, variants


def edits(word, alphabet):
    out = {word[:i] + word[i + 1 :] for i in range(len(word))}
    out |= {word[:i] + c + word[i:] for i in range(len(word) + 1) for c in alphabet}
    out |= {word[:i] + c + word[i + 1 :] for i in range(len(word)) for c in alphabet}
    return out - {word}


def counted(rows):
    counts = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{low}".encode())
            if h % 199 == 0:
                low = low[: h % len(low)] + low[h % len(low) + 1 :]
            counts[low] += len(low) >= 6
    return {w: n for w, n in counts.items() if n >= 5}


def expected(counts):
    alphabet = {c for w in counts for c in w}
    near = {w: sorted(e for e in edits(w, alphabet) if e in counts) for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-counts[o], o), default=None)
        form[w] = best if best is not None and counts[best] >= 5 * counts[w] else None
    rows = set()
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        rows.add((w, form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None))
    return rows


def got(frame):
    rows = [(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in frame.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def vocabulary(size, seed):
    """Words of few syllables, so that grams are common, with edits of each other; also very long ones."""
    rng = random.Random(seed)
    parts = ["na", "tion", "er", "st", "ab", "él", "in", "g", "mo"]
    words = {"".join(rng.choice(parts) for _ in range(rng.randint(2, 6))) for _ in range(size)}
    words |= {e for w in rng.sample(sorted(words), min(80, size)) for e in rng.sample(sorted(edits(w, "aenoé")), 4)}
    words |= {"x" * 70, "x" * 71, "x" * 70 + "y", "ab" * 600, "ab" * 600 + "c", "ab" * 300 + "ba" + "ab" * 299, "z" * 64, "z" * 65, "z" * 66, "nation", "nation" * 11}
    return {w: rng.choice([5, 6, 30, 200, 1200]) for w in sorted(words) if len(w) >= 6}


@pytest.mark.parametrize("frequent, longest_list", [(100, 1000), (5, 12), (0, 0)])
def test_variants(spark, frequent, longest_list):
    counts = vocabulary(500, 1)
    table = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert got(variants.variants(table, frequent=frequent, longest_list=longest_list)) == expected(counts)


def test_other_length_limit(spark):
    counts = {w: n for w, n in vocabulary(300, 2).items()} | {"ab": 9, "abc": 7, "bc": 80, "abcd": 500, "éé": 5}
    table = spark.createDataFrame(list(counts.items()), "word string, n long")
    words = table.withColumn("id", F.monotonically_increasing_id())
    pairs = variants.near_pairs(words, variants.run_folder(spark), 10, 20, least_letters=2)
    named = {r.id: r.word for r in words.collect()}
    mine = {frozenset((named[r.a], named[r.b])) for r in pairs.collect()}
    alphabet = {c for w in counts for c in w}
    assert mine == {frozenset((w, e)) for w in counts for e in edits(w, alphabet) if e in counts}


def texts():
    rng = random.Random(3)
    words = [w for w in vocabulary(150, 4) if len(w) < 40] + ["Nation", "NATION", "na×tion", "short"]
    rows = [(i, " ".join(rng.choices(words, k=400))) for i in range(120)]
    return rows + rows[:3] + [(1000, None), (1001, ""), (None, "nation " * 6), (1002, "Straße-NÉGATIF nÉgatif. " * 9), (1003, "nation" * 5000 + " ")]


def test_query(spark, tmp_path):
    rows = texts()
    docs = spark.createDataFrame([(k, t, "w", 1) for k, t in rows], "doc_id long, text string, word string, n int")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    frame = queries.QUERIES["op11_variant_grams"](spark, str(tmp_path))
    assert got(frame) == expected(counted(rows))
    assert frame.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    docs.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert queries.QUERIES["op11_variant_grams"](spark, f"{tmp_path}/none").count() == 0
