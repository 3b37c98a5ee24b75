"""Loaders, manifests, journals, settings, vector tables and plans at sizes that take the other way."""

import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.functions import keys
from tidemill.functions import text as X
from tidemill.functions import vector as V
from tidemill.operators import bm25, comparison, datasets, memory, retrieval, training
from tidemill.plans import retrieval as plan
from tidemill.settings import Settings
from tidemill.sources import files, records


def test_loaders_by_kind(spark, tmp_path):
    (tmp_path / "a.txt").write_text(" hello ")
    (tmp_path / "b.PDF").write_bytes(b"one|  |three")
    (tmp_path / "i.png").write_bytes(b"x")
    (tmp_path / "v.mp4").write_bytes(b"100,10")
    (tmp_path / "w.webm").write_bytes(b"60,0")

    def frames(content):
        n, fps = map(int, content.decode().split(","))
        return n, float(fps), lambda i: str(i).encode()

    got = files.load(spark, str(tmp_path), pages=lambda b: b.decode().split("|"), ocr=lambda b: "", frames=frames).collect()
    by = {}
    for r in got:
        by.setdefault(r.source.rsplit("/", 1)[1], []).append(r)
    assert by["a.txt"][0].text == "hello" and by["b.PDF"][0].text == "one\n\nthree" and by["i.png"][0].text == "Image source: i.png" and by["i.png"][0].modality == "image"
    assert [(r.chunk_id, r.time_sec, r.image_path) for r in sorted(by["v.mp4"], key=lambda r: r.chunk_id)] == [(i, 2.0 * i, f"v/frame_{i:05d}.jpg") for i in range(5)]
    assert [r.text for r in sorted(by["w.webm"], key=lambda r: r.chunk_id)] == ["Video frame at 0.00s from w.webm", "Video frame at 2.00s from w.webm"]
    with pytest.raises(ValueError, match="no decoder"):
        files.load(spark, str(tmp_path))
    (tmp_path / "z.exe").write_bytes(b"x")
    with pytest.raises(ValueError, match="unsupported file type"):
        files.load(spark, str(tmp_path))
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "empty.md").write_text(" ")
    with pytest.raises(Exception, match="empty file"):
        files.load_text(spark, str(tmp_path / "t"), strict=True).collect()


def test_workspace_files(spark):
    big = b"a" * 1_000_001
    df = spark.createDataFrame([("a.txt", b"hello world"), ("b.bin", b"a\x00b"), ("c.txt", big)], "path string, content binary")
    one = lambda p, **k: files.read_file(df, p, **k).first()
    assert one("a.txt").content == "a.txt:\nhello world" and one("b.bin").error == "binary files are not supported" and not one("b.bin").ok
    cut = one("c.txt", most_chars=100).content
    assert len(cut) == 100 and cut.endswith("... file truncated") and one("c.txt", most_chars=2_000_000).content.endswith("... file truncated")
    for bad in ("/etc/passwd", "../x", "", ".git/config", "a\x00"):
        with pytest.raises(ValueError):
            files.read_file(df, bad)
    named = spark.createDataFrame([("x/.git/a.py",), ("x/b.py",), ("node_modules/c.py",)], "path string")
    assert [r.path for r in files.glob(named, "**/*.py").collect()] == ["x/b.py"]
    lines = spark.createDataFrame([(1, 0, "abc"), (1, 1, "defg"), (1, 2, "h"), (2, 0, "x")], "q long, i int, text string")
    got = {r.q: (r.text, r.truncated) for r in files.capped(lines, "q", "i", most=6).collect()}
    assert got == {1: ("abc\nde", True), 2: ("x", False)}


def test_manifests_and_tables(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "b").write_bytes(b"22")
    (tmp_path / "d" / "a").write_bytes(b"1")
    assert files.write_manifest(spark, str(tmp_path / "d"), str(tmp_path / "m"), str(tmp_path / "d")) == 3
    got = {r.path: r.sha256 for r in files.read_manifest(spark, str(tmp_path / "m")).collect()}
    assert got == {"a": hashlib.sha256(b"1").hexdigest(), "b": hashlib.sha256(b"22").hexdigest()}
    declared = files.read_manifest(spark, str(tmp_path / "m")).withColumn("sha256", F.when(F.col("path") == "a", "x").otherwise(F.col("sha256")))
    assert [r.path for r in files.compare_manifest(declared, files.read_manifest(spark, str(tmp_path / "m"))).collect()] == ["a"]
    records.write_csv(spark.createDataFrame([(1, "a")], "n long, s string"), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).first().s == "a"
    (tmp_path / "o.json").write_text('{\n "a": 1\n}')
    row, digest = records.read_object(spark, str(tmp_path / "o.json"))
    assert row.first().a == 1 and digest == hashlib.sha256(b'{\n "a": 1\n}').hexdigest()
    (tmp_path / "l.json").write_text("[1]")
    with pytest.raises(ValueError):
        records.read_object(spark, str(tmp_path / "l.json"))


def test_pages_end_at_the_first_short_one(spark):
    def fetch(offset, size):
        return [json.dumps({"row": i}) for i in range(offset, min(offset + size, 23))]

    got = [r.ord for r in records.paged_until_short(spark, fetch, 100, 5, 10).orderBy("ord").collect()]
    assert got == list(range(5, 23))
    assert records.paged_until_short(spark, fetch, 7, 0, 10).count() == 7

    def gap(offset, size):
        return [str(i) for i in range(offset, offset + (size if offset != 10 else 3))]

    assert records.paged_until_short(spark, gap, 40, 0, 10).count() == 13


def test_journals(spark):
    rows = spark.createDataFrame([(0, '{"b": 1, "a": {"d": 1, "c": 2}}'), (1, "{}"), (3, "{}")], "sequence long, payload string")
    sealed = records.seal(rows)
    assert sealed.filter("sequence = 0").first().sha256 == hashlib.sha256(b'{"a":{"c":2,"d":1},"b":1}').hexdigest()
    assert [tuple(r) for r in records.broken(sealed).collect()] == [(3, "non-contiguous")]
    seeds = spark.range(3).select(records.candidate_seed(1, F.col("id"), F.lit(0)).alias("s")).distinct()
    assert seeds.count() == 3


def test_settings():
    s = Settings.read({"LLM_MODEL": " m ", "LOCAL_EMBED_NORMALIZE": "No", "LOCAL_EMBED_TRUST_REMOTE_CODE": "yes", "OPENAI_COMPAT_API_KEY": "k", "OPENAI_COMPAT_BASE_URL": "u"})
    assert s.llm_model == "m" and not s.local_embed_normalize and s.local_embed_trust_remote_code and s.provider().base_url == "u"
    assert Settings.read({"LOCAL_EMBED_NORMALIZE": "anything"}).local_embed_normalize and not Settings.read({"LOCAL_EMBED_TRUST_REMOTE_CODE": "anything"}).local_embed_trust_remote_code
    with pytest.raises(ValueError):
        Settings.read({}).provider()
    with pytest.raises(ValueError):
        s.provider("other")


def test_clock_and_metadata(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()[0]
    clock = F.to_timestamp(F.lit("2026-01-02 03:04:05"))
    assert one(keys.now_iso(clock)) == "2026-01-02T03:04:05+00:00" and one(keys.today(clock)) == "2026-01-02"
    assert one(keys.metadata_of(F.lit("[1]"), F.lit("s"), F.lit("t"))) == '{"source":"s","text":"t"}' and one(keys.metadata_of(F.lit('{"a": 1}'), F.lit("s"), F.lit("t"))) == '{"a": 1}'
    assert one(V.valid(F.array(F.lit(1.0), F.lit(float("nan"))), 2)) is None and one(V.valid(F.array(F.lit(1.0), F.lit(2.0)), 2)) == [1.0, 2.0]
    assert one(X.fold_title(F.lit("  Straße Ⅷ "))) == "strasse viii"


def test_vector_index(spark):
    rows = lambda *x: spark.createDataFrame(list(x), "id long, vector array<float>")
    index = memory.VectorIndex(rows((1, [1.0, 0.0]), (2, [0.0, 1.0]))).add(rows((2, [1.0, 0.1]), (3, [1.0, 0.0])))
    q = spark.createDataFrame([(9, [1.0, 0.0])], "query_id long, vector array<float>")
    assert [r.doc_id for r in index.search(q, 5).orderBy("rank").collect()] == [1, 3, 2]
    assert [r.doc_id for r in index.remove(rows((1, None))).search(q, 1).collect()] == [3] and index.clear().search(q, 1).count() == 0


def test_extraction_asks_only_for_texts(spark):
    turns = spark.createDataFrame([(1, "I like tea"), (2, " "), (3, "broken")], "query_id long, message string")
    seen = F.udf(lambda s, u: None if "broken" in u else json.dumps({"facts": [{"fact_content": u, "fact_object": "", "visibility": 2}]}))
    got = memory.extract(turns, seen, time=F.lit("2026-01-02")).collect()
    assert [(r.query_id, r.fact_content, r.visibility) for r in got] == [(1, "MESSAGE TIME: 2026-01-02\n\nSOURCE: chat\n\nCONTENT:\nI like tea", "PRIVATE")]


def test_nearest_in_blocks_equals_one_block(spark, monkeypatch):
    r = np.random.default_rng(1)
    rows = [(i, r.integers(0, 3, 6).astype(float).tolist()) for i in range(300)]
    corpus = spark.createDataFrame(rows, "doc_id long, vector array<float>")
    queries = spark.createDataFrame(rows[:40], "query_id long, vector array<float>")
    said = lambda m: sorted((x.query_id, x.rank, x.doc_id) for x in retrieval.nearest(queries, corpus, 7, m).collect())
    want = {m: said(m) for m in ("l2", "cosine")}
    v = np.array([x for _, x in rows])
    for q in range(40):
        brute = sorted(range(300), key=lambda d: (round(((v[q] - v[d]) ** 2).sum(), 9), d))[:7]
        assert [d for i, _, d in want["l2"] if i == q] == brute
    monkeypatch.setattr(retrieval, "BLOCK", 16)
    monkeypatch.setattr(retrieval, "ROWS", 10)
    assert {m: said(m) for m in ("l2", "cosine")} == want


def test_bm25_has_no_cross_join_and_no_token_shuffle(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{chr(97 + j)}" for j in range(i % 7))) for i in range(40)], "doc_id long, text string")
    tok = X.simple_tokens(F.col("text"))
    plan = bm25.postings(docs, tok)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    got = {(r.doc_id, r.tok): (r.tf, r.dl) for r in bm25.postings(spark.createDataFrame([(1, "aa bb aa cc aa"), (2, "")], "doc_id long, text string"), tok).collect()}
    assert got == {(1, "aa"): (3, 5), (1, "bb"): (1, 5), (1, "cc"): (1, 5)}
    q = spark.createDataFrame([(1, "wa wb"), (2, "zz"), (3, "wf")], "query_id long, text string")
    found = bm25.search(q, tok, docs, tok, 10)
    assert not any(x in found._jdf.queryExecution().executedPlan().toString() for x in ("CartesianProduct", "BroadcastNestedLoopJoin"))
    by = {}
    for r in found.orderBy("query_id", "rank").collect():
        by.setdefault(r.query_id, []).append((r.doc_id, r.score > 0))
    live = [i for i in range(40) if i % 7]
    assert [len(x) for x in by.values()] == [10, 10, 10] and [d for d, _ in by[2]] == live[:10]
    some = [d for d, hit in by[3] if hit]
    assert [d for d, hit in by[3] if not hit] == [d for d in live if d not in some][: 10 - len(some)] and some == [i for i in range(40) if i % 7 == 6][:10]


def test_quantile_picks_and_windows(spark, monkeypatch):
    r = np.random.default_rng(2)
    values = [float(x) for x in r.integers(0, 50, 400)] + [1e300, -1e300, 0.1, None, float("nan")]
    df = spark.createDataFrame([(x,) for x in values], "v double")
    real = sorted(x for x in values if x is not None and x == x)
    for bins in (1000, 5):
        monkeypatch.setattr(comparison, "BINS", bins)
        for q in (0.0, 0.5, 0.9, 1.0):
            row = comparison.index_quantile(df, "v", q).first()
            assert row.picked == real[min(int(len(real) * q), len(real) - 1)] and row.n == len(real)
    assert comparison.index_quantile(df.limit(0), "v", 0.5).count() == 0
    rows = spark.range(100).withColumn("x", F.reverse(F.col("id").cast("string")))
    want = [x.id for x in rows.orderBy("x", "id").offset(30).limit(9).collect()]
    monkeypatch.setattr(records, "SMALL_WINDOW", 5)
    got = [x.id for x in records.window(rows.orderBy("id"), "x", 30, 9).collect()]
    assert sorted(rows.filter(F.col("id").isin(got)).toPandas().x) == sorted(rows.filter(F.col("id").isin(want)).toPandas().x)
    assert [x.ord for x in training.numbered(rows, "id").orderBy("id").collect()] == list(range(100))


def test_bootstrap_runs_equal_numpy(spark):
    r = np.random.default_rng(3)
    rows = [(i, m, p, float(r.random()), float(r.random())) for i in range(30) for m in ("a", "b") for p in ("x-y", "x-z")]
    got = comparison.bootstrap_runs(spark.createDataFrame(rows, "task long, metric string, pair string, base double, other double"), 250, 5).collect()
    assert len(got) == 4
    for x in got:
        g = np.array([o - b for i, m, p, b, o in rows if (m, p) == (x.metric, x.pair)])
        est = [g[np.random.default_rng([5, s]).integers(0, 30, 30)].mean() for s in range(250)]
        assert np.allclose([x.difference, x.low, x.high], [g.mean(), *np.quantile(est, [0.025, 0.975])])


def test_partitions_hash_a_components_documents(spark):
    rows = [(t, f"k{d}") for t, ds in {"a": (1, 2), "b": (2, 3), "c": (9,), "d": (10,)}.items() for d in ds] + [("e", None)]
    got = {r.task_id: (r.component, r.partition) for r in datasets.disjoint_partitions(spark.createDataFrame(rows, "task_id string, document_key string")).collect()}

    def part(key):
        b = int(hashlib.sha256(key.encode()).hexdigest()[:8], 16) % 10
        return "train" if b < 8 else "validation" if b == 8 else "test"

    assert got == {"a": ("a", part("k1|k2|k3")), "b": ("a", part("k1|k2|k3")), "c": ("c", part("k9")), "d": ("d", part("k10")), "e": ("e", part(""))}


def test_preparation_is_strict_or_skips(spark):
    schema = "id string, question string, answer string, type string, supporting_facts struct<title:array<string>,sent_id:array<int>>, context struct<title:array<string>,sentences:array<array<string>>>"
    row = lambda i, q="Q?", title="Ⅷ Straße": (i, q, "A", "bridge", ([title], [0]), ([title], [["s one"]]))
    df = spark.createDataFrame([row("1"), row("2", " ")], schema)
    with pytest.raises(ValueError, match="invalid row 2"):
        datasets.prepare(df)
    tasks, sentences, rejected = datasets.prepare(df, partition="test", skip_invalid=True, compat=True)
    assert tasks.first().partition == "test" and rejected.count() == 1
    digest = hashlib.sha1("VIII Straße\ns one".encode()).hexdigest()[:10]
    assert sentences.first().doc_id == f"documents/viii_strasse-{digest}#0"
    with pytest.raises(ValueError, match="duplicate task id"):
        datasets.prepare(spark.createDataFrame([row("1"), row("1")], schema))
    with pytest.raises(ValueError):
        datasets.single_partition(tasks, "other")


def test_records_with_pages_and_pictures(spark):
    docs = spark.createDataFrame([("d.pdf", "alpha beta gamma\n\ndelta epsilon zeta")], "source string, text string")
    pages = spark.createDataFrame([("d.pdf", 1, 0), ("d.pdf", 2, 18)], "source string, page int, start int")
    entries = spark.createDataFrame([("v.mp4", "image", 3, "Video frame", "v/f.jpg", 2.0)], "source string, modality string, chunk_id int, text string, image_path string, time_sec double")
    rows = plan.build_records(docs, size=3, overlap=0, pages=pages, entries=entries).orderBy("source", "chunk_id").collect()
    assert [(r.source, r.page_start, r.page_end) for r in rows] == [("d.pdf", 1, 1), ("d.pdf", 2, 2), ("v.mp4", None, None)] and rows[2].parent_id == "v.mp4#p1"
    built = plan.build_records(docs, entries=entries)
    assert plan.text_records(built).count() == 1 and plan.image_records(built).first().image_path == "v/f.jpg"
