"""Sources, sinks, streams, plans and the driver contract."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tidemill import registry
from tidemill.functions import text as X
from tidemill.plans import agent
from tidemill.plans import retrieval as plan
from tidemill.sources import files, records
from tidemill.streaming import memory as stream


def test_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_text("  hello \n")
    (tmp_path / "sub" / "b.MD").write_text("# T\n\nbody")
    (tmp_path / "empty.txt").write_text(" \n")
    (tmp_path / "c.bin").write_bytes(b"\x00")
    (tmp_path / "p.pdf").write_bytes(b"one|  |three")
    (tmp_path / "i.png").write_bytes(b"x")
    found = {r.path.rsplit("/", 1)[1]: r.file_type for r in files.discover(spark, str(tmp_path)).collect()}
    assert found == {"a.txt": "txt", "b.MD": "md", "empty.txt": "txt", "p.pdf": "pdf", "i.png": "png"}
    assert {r.text for r in files.load_text(spark, str(tmp_path)).collect()} == {"hello", "# T\n\nbody"}
    docs, offsets = files.load_paged(spark, str(tmp_path / "p.pdf"), lambda b: b.decode().split("|"))
    assert docs.first().text == "one\n\nthree" and [(r.page, r.start) for r in offsets.orderBy("page").collect()] == [(1, 0), (3, 5)]
    assert files.load_images(spark, str(tmp_path / "i.png")).first().text == "Image source: i.png"
    sums = {r.path.rsplit("/", 1)[1]: r.sha256 for r in files.checksums(spark, str(tmp_path)).collect()}
    assert sums["i.png"] == hashlib.sha256(b"x").hexdigest()
    videos = spark.createDataFrame([("v", 100, 10.0), ("w", 60, None), ("z", 0, 5.0)], "source string, n_frames int, fps double")
    got = {}
    for r in files.frame_schedule(videos).collect():
        got.setdefault(r.source, []).append((r.frame, r.time_sec))
    assert got["v"] == [(0, 0.0), (20, 2.0), (40, 4.0), (60, 6.0), (80, 8.0)] and got["w"] == [(0, 0.0), (50, 2.0)]


def test_workspace(spark):
    df = spark.createDataFrame([("a/b/x.py", "one\nTwo foo"), ("x.py", "FOO\x00"), ("a/y.md", "foo" * 300)], "path string, text string")
    assert [r.path for r in files.glob(df, "**/*.py").collect()] == ["a/b/x.py", "x.py"]
    assert [r.path for r in files.glob(df, "a/*.md").collect()] == ["a/y.md"]
    with pytest.raises(ValueError):
        files.glob(df, "../x")
    assert {(r.path, r.line, len(r.text)) for r in files.grep(df, "foo").collect()} == {("a/b/x.py", 2, 7), ("a/y.md", 1, 500)}


def test_records(spark, tmp_path):
    (tmp_path / "q.jsonl").write_text('{"query_id": "1", "query": "x"}\n\n{"query_id": "2", "query": "y"}\n')
    assert records.read_jsonl(spark, str(tmp_path / "q.jsonl"), "query_id string, query string").filter("query_id IS NOT NULL").count() == 2
    (tmp_path / "bad.jsonl").write_text('{"a": 1}\n[1]\nno\n')
    assert {r.text for r in records.bad_lines(spark, str(tmp_path / "bad.jsonl")).collect()} == {"[1]", "no"}
    df = spark.createDataFrame([(2, "b", "train"), (1, "a", "test")], "z long, a string, part string")
    records.write_jsonl(df, str(tmp_path / "out"), by="part")
    lines = [json.loads(x) for p in (tmp_path / "out").rglob("part-*.txt") for x in p.read_text().splitlines()]
    assert sorted(map(str, lines)) == sorted(map(str, [{"a": "b", "z": 2}, {"a": "a", "z": 1}])) and list(lines[0]) == ["a", "z"]
    with pytest.raises(Exception, match="(?i)already exists"):
        records.write_jsonl(df, str(tmp_path / "out"))
    j = lambda rows: spark.createDataFrame(rows, "task_index long, candidate_index long")
    records.append_journal(j([(0, 0), (0, 1)]), str(tmp_path / "j"))
    records.append_journal(j([(1, 0), (1, 2)]), str(tmp_path / "j"))
    with pytest.raises(ValueError):
        records.append_journal(j([(0, 2)]), str(tmp_path / "j"))
    journal = spark.read.parquet(str(tmp_path / "j"))
    assert [(r.task_index, r.candidate_index) for r in records.journal_gaps(journal).collect()] == [(1, 2)]
    assert records.remaining(spark.range(4).withColumnRenamed("id", "task_index"), journal).count() == 2


def test_paged_source(spark):
    def fetch(offset, size):
        return [json.dumps({"row": i}) for i in range(offset, min(offset + size, 23))]

    df = records.paged(spark, fetch, total=30, page_size=10)
    assert df.rdd.getNumPartitions() == 3 and df.count() == 23 and df.agg(F.max("ord")).first()[0] == 22


def test_memory_stream(spark, tmp_path):
    schema = "fact_id string, seq long, op string, content string"
    rows = [[("1", 0, "add", "a"), ("2", 1, "add", "b")], [("1", 2, "supersede", None), ("2", 3, "update", "c"), ("1", 4, "update", "z")]]
    seen = {}

    def take(df, _):
        seen.update({r.fact_id: (r.content, r.state, r.updated_seq) for r in df.collect()})

    for i, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = stream.latest_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.outputMode("update").foreachBatch(take).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert seen == {"1": ("a", "SUPERSEDED", 2), "2": ("c", "ACTIVE", 3)}


def test_index_and_prompts(spark):
    docs = spark.createDataFrame([("d.md", "# Top\n" + "alpha beta gamma. " * 30 + "\n## Two\n" + "delta epsilon. " * 30)], "source string, text string")
    built = plan.build_records(docs, size=40, overlap=5)
    assert built.filter("heading IS NULL").count() == 0 and built.filter("parent_id LIKE 'd.md::Top%'").count() == built.count()
    chunks = built.select((F.col("chunk_id") + 0).cast("long").alias("doc_id"), "text")
    vectors = chunks.select("doc_id", F.array(F.col("doc_id").cast("float"), F.lit(1.0).cast("float")).alias("vector"))
    q = spark.createDataFrame([(1, "delta epsilon", [1.0, 1.0])], "query_id long, text string, vector array<float>")
    hits = plan.hybrid(q, chunks, vectors, X.simple_tokens, top=3)
    assert [r.rank for r in hits.orderBy("rank").collect()] == [1, 2, 3]
    found = hits.join(built.withColumn("doc_id", F.col("chunk_id").cast("long")), "doc_id").select("query_id", "rank", "source", "chunk_id", "text", "modality")
    memory = spark.createDataFrame([(1, "- likes tea")], "query_id long, memory string")
    said = plan.prompts(q, plan.contexts(found), memory=memory).first().prompt
    assert said.startswith("User question:\ndelta epsilon\n\nRetrieved context:\n[Chunk ") and said.endswith("\n\nAbout the user (personal background, not evidence):\n- likes tea") and said.count("(modality=text)") == 3
    heard = agent.observation(found).first().observation
    assert heard.startswith("retrieved chunks:\n[d.md#") and len(heard.splitlines()) == 4


def test_citations(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()[0]
    n = F.lit
    assert one(X.citation(n("a/b.md"), n(3))) == "Chunk 3, b.md" and one(X.citation(n("b.pdf"), n(0), n(2), n(2))) == "Chunk 0, b.pdf, p.2"
    assert one(X.citation(n("b.pdf"), n(0), n(2), n(4))) == "Chunk 0, b.pdf, p.2-4" and one(X.citation(n(None).cast("string"), n(None).cast("int"))) == "Chunk NA, unknown"
    assert one(X.citation(n("v/m.mp4"), n(1), modality=n("image"), seconds=n(1.5))) == "Frame 1, m.mp4, t=1.50s" and one(X.citation(n("i.png"), n(1), modality=n("image"))) == "Image 1, i.png"


@pytest.mark.parametrize(
    "question,text,want",
    [
        ("Badr Hari was a member of which promotion?", "retrieved chunks:\n[documents/badr_hari-0123456789#0] Badr Hari was a member of Global Fighting Championship.", "Global Fighting Championship"),
        ("What is zinc soluble in", "[a#0] it is soluble in water, acid and oil", "oil"),
        ("Where is it", "[x#0] some lowercase payload only", "x"),
        ("Who", "no lines at all", "Who supporting evidence"),
        (None, None, "supporting evidence"),
    ],
)
def test_follow_up(spark, question, text, want):
    row = spark.createDataFrame([(question, text)], "q string, t string").select(agent.follow_up_query(F.col("q"), F.col("t")).alias("x"))
    assert row.first().x.strip() == want


def test_agent_loop(spark):
    tasks = spark.createDataFrame([("a", "Where was Badr Hari born in"), ("b", "all lower case")], "task_id string, question string")
    retrieve = lambda calls: calls.select("task_id", F.array(F.concat(F.lit("e:"), F.col("query"))).alias("found"))
    steps, ends = agent.run(tasks, agent.scripted(), retrieve, max_steps=4)
    got = {r.task_id: (r.stop_reason, r.n_steps, len(r.evidence)) for r in ends.collect()}
    assert got == {"a": ("final_answer", 3, 2), "b": ("final_answer", 2, 1)} and steps.count() == 5
    stuck = lambda live: live.withColumns({"query": F.lit("same"), "tool": F.lit("retrieve_docs"), "final": F.lit(False), "parse_error": F.lit(False)})
    assert {r.stop_reason for r in agent.run(tasks, stuck, retrieve, max_steps=9)[1].collect()} == {"loop_abort"}
    broken = lambda live: live.withColumns({"query": F.lit(None).cast("string"), "tool": F.lit(None).cast("string"), "final": F.lit(False), "parse_error": F.lit(True)})
    assert {r.stop_reason for r in agent.run(tasks, broken, retrieve, max_steps=9)[1].collect()} == {"parse_abort"}
    assert {r.stop_reason for r in agent.run(tasks, broken, retrieve, max_steps=2)[1].collect()} == {"budget"}


def test_contract():
    import __spark_entry__ as e

    names = e.queries()
    assert set(e.oracle_sql()) <= set(names) and set(registry.queries()) <= set(names) and "dense_topk" in names


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, sf_dir, name):
    import duckdb

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    con.execute(registry.oracle_sql()[name])
    columns = [d[0] for d in con.description]
    want = con.fetchall()
    df = registry.queries()[name](spark, sf_dir)
    assert sorted(df.columns) == sorted(columns)
    flat = lambda row: tuple(round(x, 5) + 0.0 if isinstance(x, float) else x for x in row)
    got = sorted((flat(r) for r in df.select(columns).collect()), key=repr)
    assert got == sorted(map(flat, want), key=repr)


def test_stores(spark, tmp_path):
    from tidemill.sources import stores

    chunks = spark.createDataFrame([(0, "s", 0, "red fox"), (1, "s", 1, "blue dog")], "doc_id long, source string, chunk_id int, text string")
    folder = str(tmp_path / "index")
    assert not stores.exists(spark, folder)
    stores.save(folder, chunks, X.simple_tokens(F.col("text")))
    assert stores.exists(spark, folder) and stores.load(spark, folder, "postings").count() == 4
    with pytest.raises(Exception, match="(?i)already exists"):
        stores.save(folder, chunks, X.simple_tokens(F.col("text")))
    assert stores.stale(chunks.limit(1), stores.load(spark, folder, "postings")).count() == 1
    named = chunks.withColumn("doc_id", F.concat("source", F.lit("#"), F.col("chunk_id")))
    assert stores.misnamed(named).count() == 0 and stores.misnamed(named.withColumn("doc_id", F.lit("x"))).count() == 2
