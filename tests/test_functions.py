"""Column functions against known values."""

import pytest
from pyspark.sql import functions as F

from tidemill.functions import calculator
from tidemill.functions import text as X
from tidemill.functions import vector as V


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def lit(values):
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


@pytest.mark.parametrize("text,want", [("The Arthur's Magazine!", "arthurs magazine"), (None, ""), ("A  man, a plan", "man plan"), ("theatre an", "theatre")])
def test_normalise_answer(spark, text, want):
    assert one(spark, X.normalise_answer(F.lit(text).cast("string"))) == want


@pytest.mark.parametrize(
    "prediction,gold,f1",
    [("President Nixon", ["President Richard Nixon"], 0.8), ("yes maybe", ["yes"], 0.0), ("yes", ["yes"], 1.0), ("", ["x"], 0.0), ("a b c", ["x", "b c"], 1.0), ("w w", ["w"], 2 / 3), ("x", [], 0.0)],
)
def test_answer_f1(spark, prediction, gold, f1):
    assert one(spark, X.answer_scores(F.lit(prediction), lit(gold))["f1"]) == pytest.approx(f1)


def test_exact_match(spark):
    assert one(spark, X.exact_match(F.lit("The cat."), lit(["dog", "CAT"]))) == 1.0
    assert one(spark, X.exact_match(F.lit("the"), lit(["an"]))) == 0.0


@pytest.mark.parametrize("p,g,want", [([], [], (1, 1, 1, 1)), (["a"], [], (0, 0, 0, 0)), ([], ["a"], (0, 0, 0, 0)), (["a#0", "b#9"], ["a#0", "b#1"], (0.5, 0.5, 0.5, 0)), (["a", "a"], ["a"], (1, 1, 1, 1))])
def test_set_scores(spark, p, g, want):
    assert tuple(one(spark, X.set_scores(lit(p), lit(g)))) == pytest.approx(want)


def test_numbers(spark):
    assert one(spark, X.numbers(F.lit("增长了 50.5%，从 -3 到 47"))) == [50.5, -3.0, 47.0]
    assert one(spark, X.numeric_hit(F.lit("about 99.95"), F.lit(100.0))) is True
    assert one(spark, X.numeric_hit(F.lit(None).cast("string"), F.lit(100.0))) is False


def test_reward_and_compat_normalisers(spark):
    assert one(spark, X.normalise_reward(F.lit("The Café, 中!"))) == "café中"
    assert one(spark, X.normalise_compat(F.lit("Ａ b\tＣ"))) == "abc"


def test_tokens(spark):
    assert one(spark, X.latin_tokens(F.lit("GPT-4 uses app/main.py v1.2 don't I 42"))) == ["gpt-4", "uses", "app/main.py", "v1.2", "don't", "42"]
    assert one(spark, X.retrieval_tokens(F.lit("BM25 检索 好"))) == ["bm25", "检", "索", "好", "检索", "好"]


def test_documents_slugs_and_fences(spark):
    assert one(spark, X.document_of(F.lit("a#b#12"))) == "a#b" and one(spark, X.document_of(F.lit("a#x"))) == "a#x"
    assert one(spark, X.slug(F.lit("  Hello, World! "))) == "hello_world" and one(spark, X.slug(F.lit("!!"))) == "untitled"
    assert one(spark, X.strip_fences(F.lit("```json\n{}\n```"))) == "{}"


@pytest.mark.parametrize(
    "raw,kind",
    [
        ('{"tool": "retrieve_docs", "args": {"q": 1}}', "tool"),
        ('{"tool": "x"}', "tool"),
        ('{"final_answer": true}', "final"),
        ('{"final_answer": 1}', "invalid"),
        ('{"final_answer": true, "args": {}}', "final"),
        ('{"final_answer": true, "args": {"q": 1}}', "invalid"),
        ('{"tool": "x", "final_answer": false}', "tool"),
        ('{"tool": "x", "args": {"tool": 3, "final_answer": true}}', "tool"),
        ('{"tool": " ", "final_answer": true}', "final"),
        ('{"tool": "x", "args": null}', "invalid"),
        ('{"tool": "x", "final_answer": true}', "invalid"),
        ('{"tool": "x", "args": [1]}', "invalid"),
        ('{"tool": "x", "more": 1}', "invalid"),
        ("[1]", "invalid"),
        ("no json", "invalid"),
        ('{"tool": 3}', "invalid"),
        (None, "invalid"),
    ],
)
def test_action_kind(spark, raw, kind):
    assert one(spark, X.action_kind(F.lit(raw).cast("string"))) == kind


@pytest.mark.parametrize(
    "text,want",
    [("(120 - 80) / 80 * 100", (True, "50.0", None)), ("7 // 2", (True, "3", None)), ("-7 % 2", (True, "1", None)), ("-7 // 2", (True, "-4", None)), ("2 ** 10", (True, "1024", None)), ("1 / 0", (False, None, "division by zero")), ("__import__('os')", (False, None, "unsupported expression")), ("True + 1", (False, None, "unsupported expression")), ("9**9**9", (False, None, "result too large")), ("", (False, None, "empty expression")), (None, (False, None, "empty expression"))],
)
def test_calculator(spark, text, want):
    assert calculator.evaluate(text) == want
    assert tuple(spark.createDataFrame([(text,)], "t string").select(calculator.calculate("t").alias("x")).first()[0]) == want


def test_vectors(spark):
    a, b, zero = lit([3.0, 4.0]), lit([4.0, 3.0]), lit([0.0, 0.0])
    assert one(spark, V.norm(a)) == 5.0 and one(spark, V.squared_l2(a, b)) == 2.0
    assert one(spark, V.safe_cosine(a, b)) == pytest.approx(0.96) and one(spark, V.safe_cosine(a, zero)) == 0.0
    assert one(spark, V.normalise(a)) == pytest.approx([0.6, 0.8])


def test_buckets(spark):
    import hashlib

    for key in ("0", "abc", "é"):
        assert one(spark, X.bucket10(F.lit(key))) == int(hashlib.sha256(key.encode()).hexdigest()[:8], 16) % 10


def test_keys(spark, tmp_path):
    from tidemill.functions import keys

    assert one(spark, keys.parse_ks(F.lit("5, 1,,3,1"))) == [1, 3, 5] and keys.positive_ks("3,1") == [1, 3]
    with pytest.raises(ValueError):
        keys.positive_ks("0,1")
    rows = spark.createDataFrame([(" ", "t1", "Q ", ["a", " "], None), ("t2", None, "Q", None, ["e"])], "task_id string, id string, question string, answers array<string>, gold_chunk_ids array<string>")
    got = {r.task_id: r for r in keys.task_fields(rows).collect()}
    assert got["t1"].gold_answers == ["a"] and got["t1"].gold_evidence_ids == [] and got["t2"].gold_evidence_ids == ["e"] and got["t2"].task_type == "multihop"
    assert one(spark, keys.finite(F.lit(float("nan")))) is None and one(spark, keys.finite(F.lit("1.5"))) == 1.5 and one(spark, keys.finite(F.lit("inf"))) is None
    df = spark.createDataFrame([(1, None)], "b long, a string").select(keys.canonical_sha256(["b", "a"]).alias("x"))
    import hashlib

    assert df.first().x == hashlib.sha256(b'{"a":null,"b":1}').hexdigest()
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "b").write_bytes(b"2")
    (tmp_path / "a").write_bytes(b"1")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(str(tmp_path))
    want = hashlib.sha256(b"".join(len(n).to_bytes(8, "big") + n + c for n, c in ((b"a", b"1"), (b"s/b", b"2")))).hexdigest()
    assert keys.tree_digest(files, str(tmp_path)) == want


def test_grown_arrays_keep_all_members_in_order(spark):
    from tidemill.functions import arrays

    for n in (0, 1, arrays.ROW, arrays.ROW + 1, 5 * arrays.ROW + 3):
        whole = F.sequence(F.lit(1), F.lit(n)) if n else F.array().cast("array<int>")
        odd = F.aggregate(whole, F.struct(*arrays.none_yet("int")), lambda a, x: F.struct(*arrays.grown(a, x, x % 2 == 1)), arrays.members)
        assert one(spark, odd) == list(range(1, n + 1, 2))
