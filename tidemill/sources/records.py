"""JSON lines, bounded windows, paged HTTP sources, and the writers that go with them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tidemill.functions.keys import canonical_json
from tidemill.operators.datasets import checkpoint
from tidemill.operators.training import numbered

#: Rows up to which a window is a plain top-k.
SMALL_WINDOW = 10_000


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str, strict: bool = True) -> DataFrame:
    """Objects of a JSON lines file; a line that is no object fails the scan, or comes as a row of nulls if not strict."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "PERMISSIVE").json(path)


def bad_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, text of each line that is not blank and no JSON object."""
    lines = spark.read.text(path).select(F.input_file_name().alias("file"), F.col("value").alias("text"))
    return lines.filter((F.trim("text") != "") & (F.json_object_keys("text").isNull()))


def read_object(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> tuple[DataFrame, str]:
    """A file that is one JSON object, as a row, and the SHA-256 of its bytes."""
    raw = spark.read.format("binaryFile").load(path).select(F.sha2("content", 256).alias("h"), F.json_object_keys(F.decode("content", "UTF-8")).alias("k")).collect()
    if len(raw) != 1 or raw[0].k is None:
        raise ValueError(f"{path} must be one JSON object")
    reader = spark.read.option("multiLine", True).option("mode", "FAILFAST")
    return (reader.schema(schema) if schema else reader).json(path), raw[0].h


def window(df: DataFrame, order: str, offset: int, limit: int) -> DataFrame:
    """Rows offset to offset + limit in a stated order.

    Rows are dealt by ranges and counted, so a large offset skips whole ranges and no task holds the rows before it.
    """
    if offset < 0 or limit <= 0:
        raise ValueError("offset >= 0 and limit > 0")
    if offset + limit <= SMALL_WINDOW:
        return df.orderBy(order).offset(offset).limit(limit)
    return numbered(df, order, name="_at").filter((F.col("_at") >= offset) & (F.col("_at") < offset + limit)).drop("_at").orderBy(order)


class _Page(InputPartition):
    def __init__(self, offset: int, size: int):
        self.offset, self.size = offset, size


class PagedRows(DataSource):
    """Pages of a remote table as JSON strings. Options: total, page_size (1 to 100), retries; `fetch(offset, size) -> list[str]` is set by paged()."""

    fetch: Callable[[int, int], list[str]] | None = None

    @classmethod
    def name(cls) -> str:
        return "paged_rows"

    def schema(self) -> str:
        return "ord long, json string"

    def reader(self, schema) -> DataSourceReader:
        return _PagedReader(self.options, type(self).fetch)


class _PagedReader(DataSourceReader):
    def __init__(self, options, fetch):
        self.total, self.size = int(options["total"]), int(options.get("page_size", 100))
        self.retries, self.fetch = int(options.get("retries", 3)), fetch
        if not 1 <= self.size <= 100:
            raise ValueError("page_size is 1 to 100")

    def partitions(self):
        return [_Page(o, min(self.size, self.total - o)) for o in range(0, self.total, self.size)]

    def read(self, page):
        for attempt in range(self.retries):
            try:
                rows = self.fetch(page.offset, page.size)
                break
            except OSError:
                if attempt + 1 == self.retries:
                    raise
        yield from ((page.offset + i, r) for i, r in enumerate(rows))


def paged(spark: SparkSession, fetch: Callable[[int, int], list[str]], total: int, page_size: int = 100) -> DataFrame:
    """One partition a page; what a short page lacks is simply absent."""
    kind = type("PagedRows", (PagedRows,), {"fetch": staticmethod(fetch)})
    spark.dataSource.register(kind)
    return spark.read.format("paged_rows").options(total=str(total), page_size=str(page_size)).load()


def paged_until_short(spark: SparkSession, fetch: Callable[[int, int], list[str]], limit: int, offset: int = 0, page_size: int = 100) -> DataFrame:
    """ord and json of at most `limit` rows from offset of a table of unknown size: what comes after the first short page is not taken."""
    if limit <= 0 or offset < 0:
        raise ValueError("limit > 0 and offset >= 0")
    rows = checkpoint(paged(spark, lambda at, size: fetch(offset + at, size), limit, page_size))
    sizes = {r[0]: r[1] for r in rows.groupBy(F.floor(F.col("ord") / page_size).alias("page")).count().collect()}  # one row a page
    end, at = 0, 0
    while at < limit:
        got = sizes.get(at // page_size, 0)
        end = at + got
        if got < min(page_size, limit - at):
            break
        at += page_size
    return rows.filter(F.col("ord") < end).withColumn("ord", F.col("ord") + offset)


def write_csv(df: DataFrame, path: str, overwrite: bool = False) -> None:
    df.write.mode("overwrite" if overwrite else "errorifexists").option("header", True).csv(path)


def percentages(df: DataFrame, *by: str) -> DataFrame:
    """by, n and percentage of all rows: the data of a figure."""
    counts = df.groupBy(*by).agg(F.count("*").alias("n"))
    total = df.count()
    return counts.withColumn("percentage", F.lit(100.0) * F.col("n") / F.lit(max(total, 1)))


def seal(journal: DataFrame, payload: str = "payload") -> DataFrame:
    """journal with the SHA-256 of each payload (JSON text, its keys brought into order)."""
    return journal.withColumn("sha256", F.sha2(canonical_json(F.col(payload)), 256))


def broken(journal: DataFrame, payload: str = "payload", seq: str = "sequence") -> DataFrame:
    """seq and reason of the rows of a sealed journal whose hash is not their payload's, or whose number does not follow the one before, from 0."""
    hashed = journal.select(seq, (~F.col("sha256").eqNullSafe(F.sha2(canonical_json(F.col(payload)), 256))).alias("bad"))
    counts = hashed.groupBy(seq).agg(F.max("bad").alias("bad"), F.count("*").alias("n"))
    # numbers from 0 without a gap: each but the first has the one before it
    before = counts.select((F.col(seq) + 1).alias(seq), F.lit(True).alias("follows"))
    out = counts.join(before, seq, "left")
    gap = (F.col("n") > 1) | ((F.col(seq) != 0) & F.col("follows").isNull())
    return out.withColumn("reason", F.when(F.col("bad"), "hash mismatch").when(gap, "non-contiguous")).filter("reason IS NOT NULL").select(seq, "reason")


def candidate_seed(seed: int, task: Column, candidate: Column) -> Column:
    """A seed of its own for each candidate of each task, so that a resumed run draws what an unbroken one would have drawn."""
    return F.xxhash64(F.lit(seed), task, candidate)


def write_jsonl(df: DataFrame, path: str, overwrite: bool = False, by: str | None = None) -> None:
    """Objects with keys in sorted order, one a line; refuses to replace unless told to."""
    keys = sorted(c for c in df.columns if c != by)
    rows = df.select(F.to_json(F.struct(*keys)).alias("value"), *([by] if by else []))
    out = rows.write.mode("overwrite" if overwrite else "errorifexists")
    (out.partitionBy(by) if by else out).text(path)


def write_table(df: DataFrame, path: str, overwrite: bool = False) -> None:
    df.write.mode("overwrite" if overwrite else "errorifexists").parquet(path)


def append_journal(df: DataFrame, path: str, key: str = "task_index", order: str = "candidate_index") -> None:
    """Appends rows of later tasks than any in the journal; refuses earlier ones."""
    spark = df.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        last = spark.read.parquet(path).agg(F.max(F.struct(key, order))).first()[0]
        earlier = (F.col(key) < last[0]) | ((F.col(key) == last[0]) & (F.col(order) <= last[1])) if last is not None else F.lit(False)
        if df.filter(earlier).limit(1).count():
            raise ValueError("the journal is past these rows")
    df.write.mode("append").parquet(path)


def journal_gaps(journal: DataFrame, key: str = "task_index", order: str = "candidate_index") -> DataFrame:
    before = F.lag(order).over(Window.partitionBy(key).orderBy(order))
    return journal.filter(F.lit(False) | (F.col(order) >= 0)).withColumn("expected", F.coalesce(before + 1, F.lit(0))).filter(F.col(order) != F.col("expected"))


def remaining(tasks: DataFrame, journal: DataFrame, key: str = "task_index") -> DataFrame:
    """Tasks that the journal does not have."""
    return tasks.join(journal.select(key).distinct(), key, "left_anti")
