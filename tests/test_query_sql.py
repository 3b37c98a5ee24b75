"""Queries against their SQL on rows that the shared tables lack or have few of."""

import duckdb

from tidemill import registry


def differences(spark, folder, name, **tables):
    """Rows that only the query gives, and rows that only its SQL gives."""
    con = duckdb.connect()
    for table, df in tables.items():
        df.write.parquet(f"{folder}/{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet/*.parquet')")
    got = [tuple(r) for r in registry.queries()[name](spark, str(folder)).collect()]
    want = con.execute(registry.oracle_sql()[name]).fetchall()
    return sorted(set(got) - set(want), key=repr), sorted(set(want) - set(got), key=repr), len(got) - len(want)


def test_decimal_multisets_of_odd_values(spark, tmp_path):
    values = [1.0, 2.5, 0.0, -0.0, -1.0, 1e-4, 1e8, 1e300, float("nan"), float("inf"), None]
    rows = [(4 * j + i, v) for j, v in enumerate(values) for i in range(4)]
    events = spark.createDataFrame(rows, "event_id long, value double")
    assert differences(spark, tmp_path, "decimal_multisets", events=events) == ([], [], 0)


def test_corpus_dedup_keeps_a_text_of_each_language(spark, tmp_path):
    rows = [("a b", "en"), ("a b", "en"), ("a b", "de"), ("a b", None), (None, "en"), (None, "de"), (None, "de"), ("", None)]
    documents = spark.createDataFrame(rows, "text string, lang string")
    assert differences(spark, tmp_path, "corpus_dedup", documents=documents) == ([], [], 0)


def test_text_functions_of_neighbouring_articles(spark, tmp_path):
    texts = ["say the\nthe cat", "The-a-an-the end", "a/the", "the the the", "an,a b", "a", "the_the a.theatre", "", None]
    documents = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert differences(spark, tmp_path, "text_functions", documents=documents) == ([], [], 0)
