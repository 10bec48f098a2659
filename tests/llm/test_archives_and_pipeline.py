"""WARC round trips, language models and the whole pipeline."""

import gzip
import hashlib
import math
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from sitewarden.llm import cross_entropy, packing, queries, warc
from tests.conftest import SMALL


def pages_table():
    rng = np.random.default_rng(1)
    texts = [None, "", "short", "short", "é😀" * 400, "x" * 999, "x" * 999, "y" * 1000, "y" * 1000, "y" * 1000, "WARC/1.1\r\n\r\nContent-Length: 5\r\n\r\n" * 60]
    texts += ["".join(rng.choice(list("ab\r\n😀é<"), 900)) for _ in range(4)]
    return [(i, f"http://a.b/{i}" if i % 3 else None, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("sizes", [{}, {"segment_chars": 100, "chunk_chars": 37}, {"segment_chars": 61, "chunk_chars": 500, "records_per_file": 2}])
def test_round_trip(spark, tmp_path, sizes):
    rows = pages_table()
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string").repartition(2)
    warc.write(pages, str(tmp_path / "w"), **sizes)
    whole = warc.read_archives(spark, str(tmp_path / "w"))
    payloads = {r.key: r for r in whole.collect()}
    last = {}
    for i, _, t in rows:
        if len((t or "").encode()) >= 1000:
            last[t] = i
    for i, url, t in rows:
        assert payloads[i].intact and payloads[i].uri == url
        if last.get(t, i) == i:
            assert payloads[i].kind == "response" and bytes(payloads[i].payload).decode() == (t or "")
        else:
            assert payloads[i].kind == "revisit" and payloads[i].payload is None
    got = {r.key: tuple(r)[1:] for r in warc.with_revisits(whole.drop("payload", "intact", "uri", "digest")).collect()}
    for i, _, t in rows:
        b, kept = (t or "").encode(), last.get(t, i)
        assert got[i] == (len(b), hashlib.sha1(b).hexdigest(), "response" if kept == i else "revisit", None if kept == i else kept)


def test_repeated_rows_and_missing_keys(spark, tmp_path):
    text = "z" * 2000
    pages = spark.createDataFrame([(7, "u", text), (7, "u", text), (None, "u", text), (3, None, text)], "page_id long, url string, html string")
    warc.write(pages, str(tmp_path / "w"), segment_chars=300)
    got = sorted(map(tuple, warc.with_revisits(warc.read_archives(spark, str(tmp_path / "w")).drop("payload")).collect()), key=str)
    sha = hashlib.sha1(text.encode()).hexdigest()
    assert got == sorted([(3, 2000, sha, "revisit", 7), (7, 2000, sha, "response", None), (7, 2000, sha, "response", None), (None, 2000, sha, "response", None)], key=str)
    warc.write(pages.limit(0), str(tmp_path / "none"))
    assert warc.with_revisits(warc.read_archives(spark, str(tmp_path / "none"))).count() == 0


def record(number, block, total=None, origin=None):
    lines = [f"WARC-Type: {'continuation' if origin else 'response'}", f"WARC-Record-ID: <{origin or 'urn:1'}-{number}>" if origin else "WARC-Record-ID: <urn:1>"]
    lines += [f"WARC-Segment-Number: {number}", *([f"WARC-Segment-Origin-ID: <{origin}>"] if origin else []), *([f"WARC-Segment-Total-Length: {total}"] if total else [])]
    return ("WARC/1.0\r\n" + "\r\n".join(lines) + f"\r\nContent-Length: {len(block)}\r\n\r\n").encode() + block + b"\r\n\r\n"


@pytest.mark.parametrize(("dropped", "total", "intact"), [(None, 0, True), (1, 0, False), (2, 0, False), (None, 5, False)])
def test_broken_segments(spark, tmp_path, dropped, total, intact):
    message = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n4;x=y\r\nab\r\n\r\n3\r\n\xff\x00c\r\n0\r\nTrailer: 1\r\n\r\n"
    cuts = [message[:30], message[30:52], message[52:]]
    parts = [record(1, cuts[0]), record(2, cuts[1], origin="urn:1"), record(3, cuts[2], len(message) + total, "urn:1")]
    (tmp_path / "b").mkdir()
    for n, part in enumerate(parts):  # members of several files, the last first, one of them twice
        if n != dropped:
            (tmp_path / "b" / f"{9 - n}.warc.gz").write_bytes(gzip.compress(part) * (2 if n == 1 else 1))
    [row] = warc.read_archives(spark, str(tmp_path / "b")).collect()
    assert row.intact == intact and (row.payload is None) == (not intact)
    if intact:
        assert bytes(row.payload) == b"ab\r\n\xff\x00c"


#: A gzip member whose data ends in the middle and is followed by other bytes.
GZ_BAD = gzip.compress(bytes(range(256)) * 4)[:30] + b"\xff" * 40


def single(n, extra=b""):
    body = f"HTTP/1.1 200 OK\r\n\r\nbody {n}".encode()
    return f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:{n}>\r\nSource-Key: {n}\r\n".encode() + extra + f"Content-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"


GOOD = single(1) + single(2)
BROKEN = {
    "header without end": gzip.compress(GOOD + b"WARC/1.1\r\nWARC-Type: response\r\nSource-K"),
    "no length": gzip.compress(GOOD + b"WARC/1.1\r\nWARC-Type: response\r\n\r\nx\r\n\r\n"),
    "bad length": gzip.compress(GOOD + b"WARC/1.1\r\nContent-Length: -5\r\n\r\nx\r\n\r\n"),
    "block cut off": gzip.compress(GOOD + single(3)[:-12]),
    "member cut off": gzip.compress(GOOD) + gzip.compress(single(3))[:-20],
    "bad member": gzip.compress(GOOD) + GZ_BAD,
    "junk behind": gzip.compress(GOOD) + b"junk",
    "text behind": gzip.compress(GOOD + b"junk"),
}


@pytest.mark.parametrize("case", BROKEN)
def test_broken_files(spark, tmp_path, case):
    """What precedes the broken place is kept, the rest is one broken record, and other files are read."""
    (tmp_path / "b.warc.gz").write_bytes(BROKEN[case])
    (tmp_path / "c.warc.gz").write_bytes(gzip.compress(single(9, b"WARC-Segment-Total-Length: many\r\n")))
    (tmp_path / "d.warc.gz").write_bytes(b"")
    (tmp_path / "e.warc.gz").write_bytes(gzip.compress(b""))
    rows = warc.read_archives(spark, str(tmp_path)).collect()
    assert sorted((r.key, bytes(r.payload)) for r in rows if r.intact) == [(n, f"body {n}".encode()) for n in (1, 2, 9)]
    assert [r.payload for r in rows if not r.intact] == [None]


def test_segments_without_their_first(spark, tmp_path):
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(record(2, b"xyz", 3, "urn:1")))
    [row] = warc.read_archives(spark, str(tmp_path)).collect()
    assert (row.record_id, row.key, row.intact, row.payload) == ("<urn:1>", None, False, None)


def test_query_of_archives(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet").select("page_id", "html").collect()
    last = {}
    for p in sorted(pages):
        if len((p.html or "").encode()) >= 1000:
            last[p.html] = p.page_id
    want = {}
    for p in pages:
        b, keeper = (p.html or "").encode(), last.get(p.html, p.page_id)
        want[p.page_id] = (len(b), hashlib.sha1(b).hexdigest(), "response" if keeper == p.page_id else "revisit", None if keeper == p.page_id else keeper)
    got = queries.QUERIES["op2_warc_reassembly"](spark, SMALL).collect()
    assert {r.page_id: tuple(r)[1:] for r in got} == want and len(got) == len(pages)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=20), max_size=6))
def test_dechunk(parts):
    framed = b"".join(f"{len(p):x}\r\n".encode() + p + b"\r\n" for p in parts) + b"0\r\n\r\n"
    assert warc.dechunk(framed) == b"".join(parts)
    assert warc.dechunk(framed[:-5]) is None
    assert warc.dechunk(b"zz\r\n") is None


def brute_scores(rows, chosen, size, backoff):
    words = {i: [w for w in (t or "").lower().split()] for i, t in rows}
    counts = Counter(w for v in words.values() for w in v)
    top = sorted((w for w in counts if len(w.encode()) <= cross_entropy.LONGEST_WORD), key=lambda w: (-counts[w], w))[:size]
    number = {w: n + 2 for n, w in enumerate(top)}
    pairs = {i: list(zip([0] + ids, ids, strict=False)) for i, ids in ((i, [number.get(w, 1) for w in v]) for i, v in words.items())}

    def model(of):
        both = Counter(p for i in of for p in pairs[i])
        first, word = Counter(), Counter()
        for (a, b), n in both.items():
            first[a] += n
            word[b] += n
        total = sum(word.values())
        return lambda a, b: -math.log((1 - backoff) * (both[a, b] / first[a] if first[a] else 0) + backoff * (word[b] + 1) / (total + len(top) + 2))

    target, background = model([i for i in pairs if i in chosen]), model(list(pairs))
    return {i: sum(target(*q) - background(*q) for q in p) / len(p) if p else 0.0 for i, p in pairs.items()}


@pytest.mark.parametrize("block_tokens", [30, 2_000_000])
def test_cross_entropy(spark, block_tokens):
    rng = np.random.default_rng(9)
    words = [f"w{n}" for n in range(50)] + ["L" * 100]
    rows = [(i, " ".join(rng.choice(words[: 25 if i % 2 else 51], rng.integers(1, 40)))) for i in range(60)] + [(100, None), (101, ""), (102, "w1 W1 w1"), (103, "w1 W1 w1")]
    docs = spark.createDataFrame([(i, t, 1.0, 2) for i, t in rows], "doc_id long, text string, score double, block int").repartition(3)
    chosen = {i for i, _ in rows if i % 2}
    target = spark.createDataFrame([(i, "x") for i in chosen] * 2 + [(None, "x")], "doc_id long, text string")
    got = {r.doc_id: r.score for r in cross_entropy.score(docs, target, vocabulary=40, block_tokens=block_tokens).collect()}
    want = brute_scores(rows, chosen, 40, cross_entropy.BACKOFF)
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-5 for i in want)
    assert np.mean([got[i] for i, _ in rows[:60] if i % 2]) < np.mean([got[i] for i, _ in rows[:60] if not i % 2])


@pytest.mark.parametrize("block_tokens", [400, 2_000_000])
def test_all_words_are_known(spark, block_tokens):
    """More words than any bound that was set before; rare words tell the target apart."""
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(f"common{rng.integers(5)} rare{i % 2}x{rng.integers(4000)}" for _ in range(150))) for i in range(80)] + [(90, "L" * 100 + " end"), (91, None)]
    chosen = {i for i, _ in rows if i % 2}
    counts = Counter(w for _, t in rows for w in (t or "").lower().split())
    words = {i: (t or "").lower().split() for i, t in rows}
    assert len(counts) > 5000

    def model(of):
        both = Counter(p for i in of for p in zip(["", *words[i]], words[i], strict=False))
        first, word = Counter(), Counter()
        for (a, b), n in both.items():
            first[a] += n
            word[b] += n
        total, backoff = sum(word.values()), cross_entropy.BACKOFF
        return lambda a, b: -math.log((1 - backoff) * (both[a, b] / first[a] if first[a] else 0) + backoff * (word[b] + 1) / (total + len(counts)))

    target, background = model(chosen), model(set(words))
    want = {i: sum(target(*p) - background(*p) for p in zip(["", *w], w, strict=False)) / max(len(w), 1) for i, w in words.items()}
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.score for r in cross_entropy.score(docs, docs.where("doc_id % 2 = 1"), block_tokens=block_tokens).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-6 for i in want)
    assert max(got[i] for i in range(1, 80, 2)) < min(got[i] for i in range(0, 80, 2))


def test_cross_entropy_of_nothing(spark):
    docs = spark.createDataFrame([(1, "a b"), (None, "c")], "doc_id long, text string")
    assert cross_entropy.score(docs.limit(0), docs).count() == 0
    assert all(math.isfinite(r.score) for r in cross_entropy.score(docs, docs.limit(0)).collect())


def test_every_query_runs(spark):
    assert sorted(int(n.split("_")[0][2:]) for n in queries.QUERIES) == list(range(1, 14))
    ids = {r[0] for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id").collect()}
    for name in ("op3_toxic_spans", "op7_cross_entropy"):
        rows = queries.QUERIES[name](spark, SMALL).collect()
        assert sorted(r.doc_id for r in rows) == sorted(ids)


def test_pipeline(spark, tmp_path):
    text = " ".join(f"word{n}" for n in range(60))
    rows = [(1, text), (2, text + " tail"), (2, text + " tail"), (3, "write to me@example.org please"), (4, None), (5, ""), (None, "no id at all, 10.0.0.1"), (6, "clean words only")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, __score2 string, component int")
    labels = [(i, 1, int(i % 2)) for i in range(100, 140)]
    rng = np.random.default_rng(3)
    words = [f"{a}{b}" for a in ("ran", "tol", "mir", "sep", "dun") for b in ("ka", "lo", "vi", "ne", "su", "ta", "re", "mo")]
    texts = {i: list(rng.choice(words, 30)) for i, _, _ in labels}
    for i, _, y in labels:
        for at in rng.integers(0, 30, 3 * y):
            texts[i].insert(at, rng.choice(["vile", "nasty"]))
    more = [(i, " ".join(t), "en", "s", 1, "x", 1) for i, t in texts.items()]
    docs = docs.unionByName(spark.createDataFrame(more, docs.schema))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    left = spark.read.parquet(str(tmp_path / "documents.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_copies", "personal_data", "packing"]
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES[:3]):
        out = stage(spark, left, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        left = spark.read.parquet(str(tmp_path / name))
    kept = {r.doc_id: r for r in left.collect()}
    assert set(kept) == {1, 3, 4, 5, None, 6} | {i for i, _, y in labels if not y}
    assert kept[3].text == "write to <email> please" and kept[3].n_chars == len("write to <email> please")
    assert kept[None].text == "no id at all, <ip>" and kept[4].text is None and kept[6].text == "clean words only"
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    tokens = packing.Tokens.of(public_tokenizers.path("byte_bpe_50k.json"))
    assert Counter({r.doc_id: r.doc_tokens for r in pieces}) == Counter({i: len(tokens.encode(r.text or "")) // 4 + 1 for i, r in kept.items()})


def test_pipeline_of_nothing(spark, tmp_path):
    for table in ("documents", "labels"):
        spark.read.parquet(f"{SMALL}/{table}.parquet").limit(0).write.parquet(str(tmp_path / f"{table}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
