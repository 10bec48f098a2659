"""Near duplicates of vectors, texts and fingerprints against brute force."""

import hashlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitewarden.llm import components, group_matrix, projections, queries, simhash


def smallest(nodes, links):
    top = {n: n for n in nodes}

    def find(n):
        while top[n] != n:
            top[n] = top[top[n]]
            n = top[n]
        return n

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        top[b] = a
    return {n: find(n) for n in nodes}


def test_components(spark, tmp_path):
    rng = np.random.default_rng(0)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(n, n + 1) for n in range(1000, 1060)] + [(5000, n) for n in range(5001, 5400)] + [(7, 7)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long"), str(tmp_path)).collect()}
    nodes = {n for a, b in links if a != b for n in (a, b)}
    assert got == smallest(nodes, [x for x in links if x[0] != x[1]])
    assert components.components(spark.createDataFrame([], "a long, b long"), str(tmp_path / "none")).count() == 0


def vectors_table():
    rng = np.random.default_rng(2)
    rows = []
    for i in range(300):
        base = rng.normal(size=16)
        rows.append((i, base.tolist(), int(i % 3)))
        if i % 5 == 0:
            rows.append((1000 + i, (base * 3 + rng.normal(size=16) * rng.uniform(0, 0.9)).tolist(), int(i % 3)))
    hub = rng.normal(size=16)
    rows += [(3000 + i, (hub + rng.normal(size=16) * 0.06).tolist(), 1) for i in range(200)]
    rows += [(4000, hub.tolist(), 1), (4001, hub.tolist(), 1), (4002, hub.tolist(), 2), (4003, hub.tolist(), None), (4004, (2 * hub).tolist(), 1)]
    rows += [(5000, None, 1), (5001, [0.0] * 16, 1), (5002, [None] + [1.0] * 15, 1), (5003, [float("nan")] + [1.0] * 15, 1), (5004, [float("inf")] + [1.0] * 15, 1), (5005, [], 1)]
    rows += [(5006, [1.0, 2.0], 1), (5007, [1.0, 2.0], 1), (5008, [1e300, -1e300], 1), (5009, [1e-200, 2e-200], 1), (None, hub.tolist(), 1)]
    return rows


def test_vectors(spark):
    rows = vectors_table()
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, label int, kept string, id int")
    out = projections.near_duplicates(table, block=64).collect()
    usable = [(i, v, y) for i, v, y in rows if v and y is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    unit = [np.array(v) / np.abs(v).max() for _, v, _ in usable]
    unit = [u / np.linalg.norm(u) for u in unit]
    links = [(a, b) for a in range(len(usable)) for b in range(a) if usable[a][2] == usable[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.98]
    count, tops = defaultdict(int), smallest(range(len(usable)), links)
    for a, b in links:
        count[a] += 1
        count[b] += 1
    least = {}
    for n, top in tops.items():
        if usable[n][0] is not None:
            least[top] = min(least.get(top, 1 << 60), usable[n][0])
    want = {usable[n][0]: (count[n], least[tops[n]]) for n in tops}
    got = {r.vec_id: (r.n_links, r.component_id) for r in out}
    assert len(out) == len(rows) and got == {i: want.get(i, (0, i)) for i, _, _ in rows}
    assert all(r.kept == (r.vec_id == r.component_id) for r in out if r.vec_id is not None)
    assert projections.near_duplicates(table.limit(0)).count() == 0


@pytest.mark.parametrize("labels, kind", [(("a, b", "ab", ""), "string"), ((0.5, 0.25, -1.0), "double"), ((True, False, None), "boolean")])
def test_labels_of_any_type(spark, labels, kind):
    near, far = [1.0, 2.0, 3.0], [3.0, -1.0, 0.0]
    rows = [(n, v, y) for n, (v, y) in enumerate((v, y) for y in labels for v in (near, [2.0, 4.0, 6.0], near, far))]
    got = {r.vec_id: (r.n_links, r.component_id) for r in projections.near_duplicates(spark.createDataFrame(rows, f"vec_id long, embedding array<double>, label {kind}")).collect()}
    assert got == {n: (2, n - n % 4) if y is not None and n % 4 < 3 else (0, n) for n, _, y in rows}


def test_count_is_calibrated():
    half, hit = projections.window(64, 0.98)
    need = projections.least_count(32, hit, 1e-7)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(4000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    off = rng.normal(size=x.shape)
    off -= (off * x).sum(1, keepdims=True) * x
    off /= np.linalg.norm(off, axis=1, keepdims=True)
    y = 0.9801 * x + np.sqrt(1 - 0.9801**2) * off
    way = projections.directions(64, 32)
    hits = (np.abs(x @ way - y @ way) <= half).sum(1)
    assert (hits >= need).all() and 0.94 < hits.mean() / 32 < 0.97
    assert (np.abs(x @ way - x[::-1] @ way) <= half).sum(1).max() < need


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def texts_table():
    rng = np.random.default_rng(6)
    words = ["".join(rng.choice(list("abcdeionrst"), 6)) for _ in range(3000)]
    passage = list(rng.choice(words, 70))
    texts = [None, "", " \n\t", "one", "ONE", "one two", "é É", "É é", "a b c d e", "A  b\nc d\x0be", "a b c d e f"]
    for i in range(150):
        text = list(rng.choice(words, rng.integers(20, 160)))
        if i % 3 == 0:
            text[10:10] = passage
        texts.append(" ".join(text))
        if i % 4 == 0:
            for _ in range(3):
                copy = list(text)
                for at in rng.integers(0, len(copy), rng.integers(0, 5)):
                    copy[at] = rng.choice(words)
                texts.append(" ".join(copy))
    hub = list(rng.choice(words, 120))
    for i in range(200):
        copy = list(hub)
        copy[rng.integers(0, 120)] = f"edit{i}"
        texts.append(" ".join(copy))
    texts += [" ".join(hub)] * 40 + [" ".join(passage)] * 3 + [" ".join(passage[:60])] + ["w" + " w" * 3000]
    return texts


def brute_components(rows):
    sets = [shingles(t) for _, t in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    return sets, smallest(range(len(rows)), links)


def test_texts(spark, monkeypatch):
    monkeypatch.setattr(group_matrix, "MEMBERS", 8)
    rows = [(3 * i % 1009, t) for i, t in enumerate(texts_table())]
    table = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n int, token string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in group_matrix.jaccard_components(table).collect()}
    sets, tops = brute_components(rows)
    least = {}
    for n, top in tops.items():
        least[top] = min(least.get(top, 1 << 60), rows[n][0])
    assert got == {rows[n][0]: (len(sets[n]), least[top]) for n, top in tops.items()}


def test_texts_without_ids_and_empty(spark):
    text = "a b c d e f g h"
    table = spark.createDataFrame([(None, text), (None, text), (5, text), (5, text), (4, ""), (None, None)], "doc_id long, text string")
    got = sorted((r.doc_id is None, r.doc_id, r.n_shingles, r.component_id) for r in group_matrix.jaccard_components(table).where("doc_id IS NOT NULL").collect())
    assert got == [(False, 4, 0, 4), (False, 5, 4, 5), (False, 5, 4, 5)]
    assert {(r.n_shingles, r.component_id) for r in group_matrix.jaccard_components(table).where("doc_id IS NULL").collect()} == {(4, 5), (0, None)}
    assert group_matrix.jaccard_components(table.limit(0)).count() == 0
    assert group_matrix.one_of_each(table.limit(0)).count() == 0


def test_one_of_each(spark):
    rows = [(i, t) for i, t in enumerate(texts_table())] + [(700, ""), (700, ""), (700, None), (700, " \t"), (700, "\x0b\x1c\xa0"), (None, None), (None, None), (None, ""), (12, "another text under an id that is taken"), (13, texts_table()[13])]
    table = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, source string")
    kept = group_matrix.one_of_each(table)
    assert kept.columns == table.columns
    sets, tops = brute_components(rows)
    groups = defaultdict(list)
    for n, top in tops.items():
        if sets[n]:
            groups[top].append(rows[n][0])
    want = sorted([min(g) for g in groups.values()] + [-1 if rows[n][0] is None else rows[n][0] for n in tops if not sets[n]])
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in kept.collect()) == want


def test_prefix_loses_no_pair():
    for n in range(1, 300):
        assert group_matrix.prefix_length(n, 80) == n - -(-80 * n // 100) + 1


def test_simhash(spark):
    texts = [None, "", "one", "one two three", "One  TWO\nthree", "é😀 x " * 9, *[" ".join(f"w{(7 * i + j) % 60}" for j in range(40)) for i in range(40)]]
    rows = [(2 * i, t) for i, t in enumerate(texts)] + [(4, "tied id"), (4, "tied id")]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, row int")
    out = simhash.fingerprint_table(docs).collect()
    order = sorted(rows, key=lambda r: r[0])
    assert len(out) == len(rows)
    print_of = {}
    for r in out:
        print_of.setdefault(r.key, set()).add((r.n_chars, r.edited_sha256, r.text_fingerprint, r.next_fingerprint))
    for k, (i, t) in enumerate(order):
        following = order[(k + 1) % len(order)]
        if i == 4 or following[0] == 4:
            continue
        t, cut = t or "", len(t or "") // 4
        want = hashlib.sha256((t[: len(t) - cut] + (following[1] or "")[:cut]).encode()).hexdigest()
        [(n, sha, own, near)] = print_of[i]
        assert (n, sha) == (len(t), want) and near in {p[2] for p in print_of[following[0]]}
    assert print_of[0].pop()[2] == print_of[2].pop()[2] == 0
    assert {p[2] for p in print_of[6]} == {p[2] for p in print_of[8]}
    assert simhash.fingerprint_table(docs.limit(0)).count() == 0


def test_votes_against_brute_force(spark):
    texts = ["a b c a b d e", "x", "a b " * 50 + "c", ""]
    table = spark.createDataFrame(list(enumerate(texts)), "k long, t string")
    got = {r.k: r.t_fingerprint for r in simhash.fingerprints(table, ["k"], ["t"]).collect()}
    for k, text in enumerate(texts):
        words = text.split()
        terms = [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)] or words
        hashes = [r[0] for r in spark.createDataFrame([(t,) for t in terms], "t string").select(F.xxhash64("t")).collect()] if terms else []
        votes = [sum(1 if h >> b & 1 else -1 for h in hashes) for b in range(64)]
        assert got[k] % (1 << 64) == sum(1 << b for b in range(64) if votes[b] > 0)


def test_ranges_of_keys(spark):
    docs = spark.range(0, 1000, 3).select((F.col("id") * F.col("id") % 997).alias("k"), F.col("id").cast("string").alias("t")).dropDuplicates(["k"])
    rows = {r.k: (r.t, r.next_text) for r in simhash.with_next(docs, "k", "t", rows_per_range=2).collect()}
    keys = sorted(rows)
    assert all(rows[k][1] == rows[n][0] for k, n in zip(keys, keys[1:] + keys[:1], strict=True))


def test_radius_search(spark):
    rng = np.random.default_rng(8)
    base = [int(x) for x in rng.integers(-(1 << 62), 1 << 62, 40)]
    near = []
    for x in base:
        for flips in range(6):
            y = x % (1 << 64)
            for b in rng.choice(64, flips, replace=False):
                y ^= 1 << int(b)
            near.append(y - (1 << 64) if y >> 63 else y)
    table = spark.createDataFrame([(x,) for x in near] + [(None,)], "fingerprint long")
    queries = spark.createDataFrame([(x,) for x in base], "fingerprint long")
    got = {(r.query, r.found) for r in simhash.within_radius(queries, table).collect()}
    assert got == {(q, f) for q in base for f in near if bin((q ^ f) % (1 << 64)).count("1") <= 3}


def test_radius_search_of_texts(spark):
    """Texts edited up to a Jaccard index of 0.8 of their 5-word shingles are found; brute force gives the same pairs."""
    rng = np.random.default_rng(2)
    shingles = lambda words: {tuple(words[i : i + 5]) for i in range(len(words) - 4)}
    texts, edits = {}, []
    for i in range(120):
        words = [f"w{n}" for n in rng.integers(0, 20_000, 200)]
        for kind, at in (("apart", range(20, 180, 40)), ("passage", range(60, 77)), ("added", range(200, 249))):
            edited = words + ["x"] * (len(at) if kind == "added" else 0)
            for k in at:
                edited[k] = f"new{rng.integers(10**9)}"
            a, b = shingles(words), shingles(edited)
            assert 0.8 <= len(a & b) / len(a | b) < 0.83
            edits.append((kind, 10 * i, 10 * i + len(edits) % 3 + 1))
            texts[edits[-1][2]] = " ".join(edited)
        texts[10 * i] = " ".join(words)
    table = spark.createDataFrame(list(texts.items()), "k long, t string").repartition(4)
    rows = simhash.fingerprints(table, ["k"], ["t"]).select("k", F.col("t_fingerprint").alias("fingerprint")).cache()
    print_of = {r.k: r.fingerprint for r in rows.collect()}
    got = {(r.query, r.found): r.distance for r in simhash.within_radius(rows.where("k % 10 = 0"), rows, simhash.NEAR_RADIUS).collect()}
    distance = lambda a, b: bin((a ^ b) % (1 << 64)).count("1")
    want = {(print_of[q], f): distance(print_of[q], f) for q in texts if q % 10 == 0 for f in print_of.values()}
    assert got == {pair: d for pair, d in want.items() if d <= simhash.NEAR_RADIUS}
    for kind, least in (("apart", 0.97), ("passage", 0.9), ("added", 0.9)):
        assert np.mean([(print_of[a], print_of[b]) in got for k, a, b in edits if k == kind]) >= least


def test_pairs_once_for_any_radius(spark):
    rng = np.random.default_rng(6)
    prints = [int(x) for x in rng.integers(-(1 << 63), 1 << 63, 30)] + [0, -1, 1, 7, 1 << 62, -(1 << 63)]
    table = spark.createDataFrame([(x,) for x in prints] * 2, "fingerprint long")
    for radius, blocks in ((0, 4), (2, 4), (5, 3), (9, 5), (11, 4)):
        got = sorted((r.query, r.found) for r in simhash.within_radius(table, table, radius, blocks).collect())
        assert got == sorted((a, b) for a in prints for b in prints if bin((a ^ b) % (1 << 64)).count("1") <= radius)


def test_near_copies_come_with_their_documents(spark, tmp_path):
    rng = np.random.default_rng(7)
    words = [f"w{n}" for n in rng.integers(0, 20_000, 200)]
    texts = {50: words, 1: words, 100: words, 2: [*words[:100], "other", *words[101:]], 3: [*words[:100], "other", *words[101:]], 150: [f"v{n}" for n in range(200)]}
    spark.createDataFrame([(k, " ".join(t)) for k, t in texts.items()], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = {r.doc_id: r for r in queries.op9_simhash(spark, str(tmp_path)).collect()}
    assert {k: r.n_near for k, r in rows.items()} == {50: 4, 100: 4, 150: 0, 1: None, 2: None, 3: None}
    [(found, distance)] = [x.split(":") for x in rows[50].near.split(",")]
    assert {k for k, r in rows.items() if r.fingerprint == found} == {2, 3} and 0 < int(distance) <= simhash.NEAR_RADIUS
    assert rows[100].near is None and rows[150].near == "" and rows[1].near is None
