"""Line quality against plain Python, enumeration and held-out labels."""

import itertools
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sitewarden.llm import line_quality, queries

LINES = line_quality.Lines()


def plain(text):
    """The features of one text's lines, one by one."""
    rows, chars, names = [], [], []
    for line in text.split("\n"):
        words = [w for w in "".join(" " if LINES.kinds[min(ord(c), 0xFFFF)] == line_quality.BLANK and ord(c) < 0x10000 else c for c in line).split(" ") if w]
        if not words:
            continue
        kind = lambda w, *k: sum((LINES.kinds[ord(c)] if ord(c) < 0x10000 else line_quality.SIGN) in k for c in w)
        L, C, D, P, S = line_quality.LETTER, line_quality.CAPITAL, line_quality.DIGIT, line_quality.STOP, line_quality.SIGN
        whole, n, w = "".join(words), sum(map(len, words)), len(words)
        rows.append([
            kind(whole, L, C) / n, kind(whole, C) / max(1, kind(whole, L, C)), kind(whole, D) / n, kind(whole, P) / n, kind(whole, S) / n,
            np.log1p(n), np.log1p(w), min(n / w, 40) / 10, len(set(words)) / w * np.sqrt(max(w, 30) / 30),
            sum(a == b for a, b in itertools.pairwise(words)) / w,
            sum(kind(x, S) > 0 and kind(x, L, C) > 0 for x in words) / w, sum(kind(x, S) > 0 and kind(x, L, C) == 0 for x in words) / w,
            sum(kind(x, P) > 1 for x in words) / w, sum(kind(x, C) == kind(x, L, C) > 1 for x in words) / w, 0,
        ])
        chars.append(n)
        names.append(tuple(words))
    for row, name in zip(rows, names, strict=True):
        row[-1] = names.count(name) > 1
    return np.array(rows).reshape(-1, line_quality.SIZE), np.array(chars)


PARTS = ["ab", "Ab", "AB", "é", "ß", "12", "%%%", "|", "ab", "!!", "...", "ab,", "x#y", "\t", " ", "\n", "\n", "\r", " ", "\x00", "😀", "漢字", "\ud800", "a" * 130]


@settings(max_examples=250, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*PARTS, " ", " "]), max_size=25).map("".join), max_size=5))
def test_features(texts):
    texts = [t.replace("\ud800", "?") for t in texts]
    rows, chars, lengths = LINES(texts)
    want = [plain(t) for t in texts]
    assert lengths.tolist() == [len(c) for _, c in want]
    if texts:
        assert np.allclose(rows, np.concatenate([r for r, _ in want]), atol=1e-12)
        assert np.array_equal(chars, np.concatenate([c for _, c in want]))


def test_long_texts_in_parts(monkeypatch):
    rng = random.Random(1)
    texts = ["\n".join(rng.choice(["one two", "THREE!! four", "", "a | b", "x " * 40]) for _ in range(60)) for _ in range(6)] + ["", "y " * 500, "one two"]
    whole = LINES(texts)
    monkeypatch.setattr(line_quality, "PART", 50)
    parts = LINES(texts)
    assert all(np.array_equal(a, b) for a, b in zip(whole, parts, strict=True))


def test_marginals_by_enumeration():
    rng = np.random.default_rng(0)
    model = line_quality.Model(weights=rng.normal(size=3 * line_quality.SIZE + 3), transitions=(0.4, -0.7, -0.2, 0.9))
    lengths = np.array([4, 0, 1, 6])
    rows = rng.normal(size=(11, line_quality.SIZE))
    p, at = model.bad(rows, lengths), 0
    for n in lengths:
        own = rows[at : at + n]
        none = np.zeros(line_quality.SIZE)
        odds = [
            np.concatenate([own[t], own[t - 1] if t else none, own[t + 1] if t < n - 1 else none, [t == 0, t == n - 1, 1]]) @ model.weights for t in range(n)
        ]
        total = np.zeros(n + 1)
        for path in itertools.product((0, 1), repeat=int(n)):
            weight = np.exp(sum(o for o, s in zip(odds, path, strict=True) if s) + sum(model.transitions[2 * a + b] for a, b in itertools.pairwise(path)))
            total += weight * np.array([*path, 1])
        assert np.allclose(p[at : at + n], total[:-1] / total[-1], atol=1e-9)
        at += n


def corpus(n, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["ta", "re", "mi", "son", "le", "ver", "en"]) for _ in range(rng.randint(1, 4)))
    common = ["All of this stands in many texts.", "Any reader may pass this on."]
    junk = [
        lambda: " ".join(w + rng.choice(["%%%", "&&&"]) for w in (word() for _ in range(12))), lambda: " | ".join(word() for _ in range(12)) + " |",
        lambda: " ".join(word().upper() + "!!" for _ in range(10)), lambda: " ".join([word()] * 15),
    ]
    rows = []
    for i in range(n):
        bad = rng.random() < 0.3
        lines = [(rng.choice(junk)() if bad and rng.random() < 0.8 else " ".join(word() for _ in range(14)).capitalize() + ".") for _ in range(rng.randint(2, 9))]
        if bad and not any(c in "".join(lines) for c in "%&|!"):
            lines.append(junk[0]())
        rows.append((i, "\n".join(rng.sample(common, rng.randint(0, 2)) + lines), int(not bad)))
    return rows


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path, rows = tmp_path_factory.mktemp("quality"), corpus(600, 5)
    extra = [(9000, None), (9001, ""), (9002, " \n\t\n"), (None, "Tare misonle verta enre lemita son revermi ta misonta le verenre mita sonle reta.\nRemita verson lere entami ta resonle ver mileta sonen rever tami le sonta remi."), (9003, "Ta re mi son le.\n" * 4000), (9003, "Ta re mi son le.\n" * 4000)]
    docs = spark.createDataFrame([(i, t, 1, [0.5]) for i, t, _ in rows] + [(i, t, 0, None) for i, t in extra], "doc_id long, text string, quality int, good_lines array<double>")
    docs.repartition(3).write.parquet(f"{path}/documents.parquet")
    labels = [(i, q, 0) for i, _, q in rows] + [(9003, 1, 0), (9000, None, 0), (None, 1, 0), (77777, 0, 0), (5, None, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path), rows, extra


def test_query(spark, folder):
    path, rows, extra = folder
    out = queries.QUERIES["op13_line_chain"](spark, path).collect()
    assert len(out) == len(rows) + len(extra)
    by_id = {r.doc_id: r for r in out}
    held = [(by_id[i], q) for i, _, q in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(held) > 100 and all(r.held_out for r, _ in held) and sum(r.held_out for r in out if r.doc_id is not None and r.doc_id < 9000) == len(held)
    assert np.mean([r.predicted == q for r, q in held]) >= 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in out)
    assert len({by_id[i].score for i in (9000, 9001, 9002)}) == 1 and by_id[9000].lines == ""
    assert len({r.score for r in out if r.doc_id == 9003}) == 1 and by_id[9003].lines.count(",") == 3999
    assert by_id[None].predicted == 1


def test_lines_name_the_bad_ones(spark, folder):
    docs, labels = (spark.read.parquet(f"{folder[0]}/{t}.parquet") for t in ("documents", "labels"))
    model = line_quality.train(docs, labels, rows_per_class=100)
    again = line_quality.train(docs.repartition(7), labels, rows_per_class=100)
    assert np.allclose(model.weights, again.weights) and model.transitions == pytest.approx(again.transitions)
    texts = [t for _, t, q in folder[1] if not q][100:160]
    bad = [any(c in line for c in "%&|!") or len(set(line.split())) == 1 for t in texts for line in t.split("\n")]
    found = [p < 0.5 for lines in line_quality.Scorer(model)(texts)[1] for p in lines]
    assert np.mean(np.array(bad) == np.array(found)) >= 0.9
    scored = line_quality.score(docs, model)
    assert scored.columns == ["doc_id", "text", "quality", "score", "good_lines"] and scored.count() == docs.count()


def test_stretches(spark):
    docs = spark.createDataFrame([(i, f"{i} Ta re mi.\n" * 50) for i in range(10)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(10)], "doc_id long, quality int")
    seen = []
    original, line_quality.fit = line_quality.fit, lambda texts, *_: seen.extend(texts)
    try:
        line_quality.train(docs, labels, stretch=100)
    finally:
        line_quality.fit = original
    assert sorted(map(len, seen)) == [100] * 10 and len({t.index("Ta") for t in seen}) > 1


def test_one_class_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "Ta re."), (2, ""), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, quality int")
    for chosen, want in [(labels, 3 / 4), (labels.limit(0), 1 / 2)]:
        scores = [r.score for r in line_quality.score(docs, line_quality.train(docs, chosen)).collect()]
        assert scores == pytest.approx([want] * 3, abs=0.1) and len(scores) == 3
    assert line_quality.score(docs.limit(0), line_quality.train(docs.limit(0), labels)).count() == 0
