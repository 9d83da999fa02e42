"""WARC archives, ranked lexical search and whitening, against plain recomputations and in odd cases."""

import gzip
import hashlib
import math
import re
import uuid
from collections import Counter

import numpy as np
import pytest
from pyarrow import fs
from pyspark.sql import functions as F

from showerlake.llm import lexical, warc, whiten
from showerlake.llm.common import shared_dir

LONG = "<p>" + "long text ünd " * 400_000
PAGES = [
    (5, "http://a/x y\r\n", "<p>" + "a" * 100), (3, "http://b", "<p>" + "a" * 100), (9, None, "<p>" + "a" * 100), (None, "http://c", "<p>" + "a" * 100),
    (None, None, "z" * 99), (7, "u", "z" * 99), (7, "u", "z" * 99), (8, "u", None), (10, "u", ""), (11, "u1", "é" * 60), (11, "u0", "é" * 60), (11, "u0", "é" * 60),
    (None, "n", "only null " * 20), (None, "n", "only null " * 20), (2, "long", LONG), (1, "long", LONG + "!"),
]


def plain_pages(rows):
    """(page_id, bytes, digest, type, refers_to) of every row."""
    by = {}
    key = lambda r: (r[0] is None, r[0] or 0)
    for r in rows:
        by.setdefault(r[2] or "", []).append(r)
    out = []
    for html, group in by.items():
        raw = html.encode()
        digest = hashlib.sha256(raw).hexdigest()
        group.sort(key=key)
        for i, r in enumerate(group):
            revisit = i > 0 and len(raw) >= 100
            out.append((r[0], len(raw), digest, "revisit" if revisit else "response", group[0][0] if revisit else None))
    return Counter(out)


def archive(spark, rows, parts=3, extra=True, **how):
    root = f"{shared_dir(spark)}/files/warc-test-{uuid.uuid4().hex}"
    pages = spark.createDataFrame(rows, "page_id int, url string, html string").repartition(parts)
    if extra:
        pages = pages.withColumn("shard", F.lit("x")).withColumn("digest", F.lit(1)).withColumn("payload", F.lit(None)).withColumn("mark", F.lit(2))
    files = warc.write_warc(pages, root, **how).orderBy("name").collect()
    return root, files, warc.read_warc(spark, root)


@pytest.mark.parametrize("how", [{}, {"shard_bytes": 100_000, "roll_bytes": 4000}, {"shard_bytes": 800_000, "roll_bytes": 1 << 20, "flood": 50}])
def test_warc_round_trip(spark, how, monkeypatch):
    monkeypatch.setattr(warc, "COPIES_AT_ONCE", 100)
    rows = PAGES + [(20 + i // 3, "flood", "<b>" + "f" * (30 if i % 2 else 300)) for i in range(60)] + [(4, "same", "<b>same" * 50)] * 900 + [(4, "same", "small")] * 200 + [(None, None, None)] * 100
    root, files, back = archive(spark, rows, **how)
    found = back.collect()
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in found) == plain_pages(rows)
    assert all(r["payload"] is None if r["record_type"] == "revisit" else hashlib.sha256(r["payload"]).hexdigest() == r["payload_digest"] for r in found)
    store, top = fs.FileSystem.from_uri(root)
    on_disk = {i.base_name for i in store.get_file_info(fs.FileSelector(top)) if i.base_name.endswith(".gz")}
    assert on_disk == {f["name"] for f in files} and sum(f["records"] for f in files) == len(rows) and store.get_file_info(f"{top}/_temporary").type == fs.FileType.NotFound
    ids, refers, urls = [], set(), set()
    for f in files:
        with store.open_input_stream(f"{top}/{f['name']}", compression=None) as s:
            data = s.read()
        assert len(data) == f["bytes"] and hashlib.sha256(data).hexdigest() == f["sha256"]
        with store.open_input_stream(f"{top}/{f['name']}", compression=None) as s:
            all_records = list(warc.records(s))
        assert all_records[0][0]["WARC-Type"] == "warcinfo"
        for fields, _ in all_records:
            ids.append(fields["WARC-Record-ID"])
            refers.add(fields.get("WARC-Refers-To"))
            urls.add(fields.get("WARC-Target-URI"))
    assert len(ids) == len(set(ids)) and refers - {None} <= set(ids) and "http://a/x%20y%0D%0A" in urls
    if how.get("roll_bytes", 0) == 4000:
        assert len({f["shard"] for f in files}) > 3 and len(files) > len({f["shard"] for f in files})
        order = []
        for f in files:
            with store.open_input_stream(f"{top}/{f['name']}", compression=None) as s:
                order += [(x.get("X-Page-Id") is None, int(x.get("X-Page-Id", 0))) for x, _ in warc.records(s) if x["WARC-Type"] != "warcinfo"]
        assert order == sorted(order)
    with pytest.raises(FileExistsError):
        warc.write_warc(spark.createDataFrame(rows, "page_id int, url string, html string"), root)


def test_warc_files_depend_on_rows_alone(spark):
    how = {"shard_bytes": 3000, "roll_bytes": 900, "extra": False}
    rows = [r for r in PAGES if len(r[2] or "") < 1000] + [(100 + i, f"u{i % 7}", f"text {i % 40} " * 30) for i in range(300)]
    names = [[(f["name"], f["sha256"], f["records"]) for f in archive(spark, rows[::step], parts, **how)[1]] for step, parts in ((1, 1), (-1, 7), (1, 3))]
    assert names[0] == names[1] == names[2] and len(names[0]) > 10


def test_warc_ignores_files_outside_the_manifest_and_sees_damage(spark):
    root, files, back = archive(spark, PAGES[:5])
    store, top = fs.FileSystem.from_uri(root)
    with store.open_output_stream(f"{top}/part-999999-0000.warc.gz", compression=None) as out:  # as a lost attempt may leave
        out.write(b"junk")
    assert back.count() == 5
    name = f"{top}/{files[0]['name']}"
    with store.open_input_stream(name, compression=None) as s:
        data = gzip.decompress(s.read())
    with store.open_output_stream(name, compression=None) as out:
        out.write(gzip.compress(data.replace(b"<p>aaa", b"<p>aab")))
    with pytest.raises(Exception, match="differs from its digest"):
        back.collect()


def test_warc_moves_can_be_repeated(spark):
    root, files, _ = archive(spark, PAGES[:5])
    again = spark.createDataFrame(files, warc.MANIFEST).mapInArrow(warc._moved(root), warc.MANIFEST)
    assert again.count() == len(files)
    with pytest.raises(Exception, match="neither under"):
        spark.createDataFrame([f.asDict() | {"name": "no.gz"} for f in files], warc.MANIFEST).mapInArrow(warc._moved(root), warc.MANIFEST).collect()


def test_warc_empty(spark):
    _, files, back = archive(spark, [])
    assert not files and back.count() == 0


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DOCS = [
    (1, "Alpha beta, gamma! alpha"), (2, "alpha"), (3, ""), (4, None), (5, "beta\x00BETA_beta\tÄpfel äpfel"), (5, "gamma"), (5, "gamma"), (None, "gamma"), (-6, "gamma"), (7, "-- !! __ \x7f"),
    (8, "delta " * 50_000 + "alpha"), (9, "中文 alpha中文 beta9 9beta"), (10, "x" * 3_000_000 + " gamma beta"),
]


def plain_ranks(docs, items, k):
    lower = lambda s: "".join(c.lower() if "A" <= c <= "Z" else c for c in s or "")
    counts = [(d, Counter(TERM.findall(lower(t)))) for d, t in docs]
    counts = [(d, c) for d, c in counts if c]
    n_docs, n_terms = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scores = []
        for d, c in counts:
            n, score = sum(c.values()), 0
            m = 100 - 25 + ((25 * n * n_docs) // n_terms)
            for t in TERM.findall(lower(text)):
                if c[t]:
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m))
            if score > 0:
                scores.append((-score, d is None, d or 0))
        out += [(item, i, None if null else d, -s) for i, (s, null, d) in enumerate(sorted(scores)[:k], 1)]
    return Counter(out)


ITEMS = [(1, "alpha gamma"), (2, "nothing here"), (3, None), (4, "ÄPFEL Äpfel äpfel"), (5, "beta beta beta gamma"), (5, "delta"), (None, "alpha"), (6, ""), (7, "中文 9beta gamma")]


@pytest.mark.parametrize("block_docs, most_terms, parts", [(8192, 1 << 20, 1), (2, 1 << 20, 3), (3, 4, 2)])
def test_search_odd(spark, block_docs, most_terms, parts):
    docs = spark.createDataFrame(DOCS, "doc_id int, text string").repartition(parts).withColumn("n", F.lit("x")).withColumn("block", F.lit(1)).withColumn("item_id", F.lit(2))
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("doc_id", F.lit(0)).withColumn("term", F.lit("t"))
    for k in (2, 20):
        got = lexical.ranked(docs, items, k, block_docs, most_terms)
        assert got.columns == ["item_id", "rank", "doc_id", "score"]
        assert Counter(map(tuple, got.collect())) == plain_ranks(DOCS, ITEMS, k)


def test_search_drawn(spark):
    """Blocks with far more documents than ranks, so that accumulators are left out on the way."""
    rng = np.random.default_rng(3)
    words = np.array([f"w{i}" for i in range(400)])
    draw = lambda n: " ".join(words[np.minimum(rng.zipf(1.3, n) - 1, 399)])
    docs = [(i, draw(int(rng.integers(1, 60)))) for i in range(1500)]
    items = [(i, draw(25)) for i in range(30)] + [(30 + i, docs[i][1]) for i in range(5)]
    got = lexical.ranked(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string"), 5, 300)
    assert Counter(map(tuple, got.collect())) == plain_ranks(docs, items, 5)


def test_search_empty(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert lexical.ranked(docs, items).count() == 0 and lexical.ranked(items.select(F.col("item_id").alias("doc_id"), "text"), items.limit(0)).count() == 0


def test_eigenvectors():
    rng = np.random.default_rng(1)
    for t in range(200):
        m = int(rng.integers(1, 40))
        b = rng.standard_normal((m, int(rng.integers(1, m + 1)))) * 10.0 ** rng.integers(-8, 8)
        a = b @ b.T
        if t % 5 == 0:  # clusters of equal values
            q = np.linalg.qr(rng.standard_normal((m, m)))[0]
            a = (q * np.round(rng.uniform(0, 3, m))) @ q.T
            a = (a + a.T) / 2
        if t % 7 == 0:
            a = np.diag(rng.integers(0, 3, m)).astype(float)
        values, vectors = whiten.leading_components(a, 4)
        size = max(np.abs(a).max(), 1e-300) * m
        assert np.abs(values - np.linalg.eigvalsh(a)[::-1][:4]).max() < 1e-12 * size
        assert np.abs(a @ vectors.T - vectors.T * values).max() < 1e-11 * size
        assert np.abs(vectors @ vectors.T - np.eye(len(vectors))).max() < 1e-10


def plain_whitened(x, k=4):
    u = np.unique(x, axis=0)
    n, sums = len(u), u.sum(0)
    values, vectors = np.linalg.eigh(np.atleast_2d(np.cov(u.T.astype(float), bias=True)))
    values, vectors = values[::-1][:k], vectors[:, ::-1].T[:k]
    with np.errstate(divide="ignore", invalid="ignore"):
        return n, ((n * x - sums) ** 2).sum(1), (x - sums / n) @ vectors.T / np.sqrt(values), values


def test_whitening(spark):
    rng = np.random.default_rng(4)
    good = rng.standard_normal((300, 6)) * np.array([3, 2, 1.5, 1, 0.5, 0.1]) + 5
    rows = [(i, v.tolist()) for i, v in enumerate(good)] + [(i, good[7].tolist()) for i in range(300, 420)] + [(0, [0.0] * 6), (None, good[3].tolist())]
    bad = [(-1, None), (-2, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (-3, [float("nan")] * 6), (-4, [float("inf")] + [0.0] * 5), (-5, [])]
    pairs = [(1000 + i, [float(i), float(i)]) for i in range(5)] + [(2000, [1.0, 2.0, 3.0])]
    frame = spark.createDataFrame(rows + bad + pairs, "vec_id int, embedding array<double>").repartition(5).withColumn("x", F.lit(1)).withColumn("component", F.lit("c"))
    found = whiten.whitened(frame).collect()
    six = [r for r in found if r["vec_id"] is None or 0 <= r["vec_id"] < 1000]
    x = np.floor(256 * np.array([v for _, v in rows])).astype(int)
    n, deviation, white, values = plain_whitened(x)
    assert len(six) == 4 * len(rows) and {r["n"] for r in six} == {n} and len({r["identity_error"] for r in six}) == 1 and six[0]["identity_error"] < 1e-9
    signs = {}
    order = lambda i: (rows[i][0] is None, rows[i][0] or 0, int(deviation[i]))
    for c in range(4):
        mine = sorted((r for r in six if r["component"] == c + 1), key=lambda r: (r["vec_id"] is None, r["vec_id"] or 0, r["deviation"]))
        for r, i in zip(mine, sorted(range(len(rows)), key=order), strict=True):
            sign = signs.setdefault(c, np.sign(white[i, c]) * np.sign(r["whitened"]))
            assert r["deviation"] == deviation[i] and abs(r["whitened"] - sign * white[i, c]) < 1e-8
            assert abs(r["explained"] - values[c] / np.trace(np.cov(np.unique(x, axis=0).T, bias=True))) < 1e-10
    line = [r for r in found if r["vec_id"] is not None and 1000 <= r["vec_id"] < 2000]
    assert len(line) == 10 and all((r["whitened"] is None) == (r["component"] == 2) for r in line) and line[0]["identity_error"] < 1e-9
    single = [r for r in found if r["vec_id"] == 2000]
    assert len(single) == 3 and all(r["whitened"] is None and r["deviation"] == 0 and r["identity_error"] is None and r["explained"] == 0 for r in single)
    assert len(found) == len(six) + 13


def test_whitening_large_values_and_empty(spark):
    rows = [(1, [1e12, 0.0]), (2, [-1e12, 1.0]), (3, [1e300, 2.0])]
    found = whiten.whitened(spark.createDataFrame(rows[:2], "vec_id long, embedding array<double>")).collect()
    assert {r["deviation"] for r in found} == {None} and len(found) == 4
    assert len(whiten.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()) == 6
    assert whiten.whitened(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
