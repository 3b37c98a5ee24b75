"""Parameters, aliases and digests."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def parse_ks(text: Column) -> Column:
    """Distinct whole numbers of a comma-separated list, sorted."""
    parts = F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.array_sort(F.array_distinct(F.transform(parts, lambda x: x.cast("int"))))


def positive_ks(text: str) -> list[int]:
    """The same of a parameter; none, or one below 1, is an error."""
    ks = sorted({int(x) for x in text.split(",") if x.strip()})
    if not ks or ks[0] <= 0:
        raise ValueError("ks are whole numbers above 0")
    return ks


def first_filled(*names: Column) -> Column:
    """The first value that is not blank, trimmed."""
    return F.coalesce(F.lit(None).cast("string"), *[F.when(F.trim(c.cast("string")) != "", F.trim(c.cast("string"))) for c in names])


def filled(values: Column) -> Column:
    """The trimmed values of array<string> that are not blank."""
    return F.filter(F.transform(values, lambda x: F.trim(x)), lambda x: F.coalesce(x, F.lit("")) != "")


def task_fields(rows: DataFrame) -> DataFrame:
    """task_id, question, task_type, gold_answers and gold_evidence_ids of rows under any of their names."""
    has = lambda *names: [F.col(n) for n in names if n in rows.columns]
    listed = lambda *names: F.coalesce(*[filled(c) for c in has(*names)], F.array().cast("array<string>"))
    return rows.select(
        first_filled(*has("task_id", "id")).alias("task_id"),
        first_filled(*has("question")).alias("question"),
        F.coalesce(first_filled(*has("task_type", "type")), F.lit("multihop")).alias("task_type"),
        listed("gold_answers", "answers").alias("gold_answers"),
        listed("gold_evidence_ids", "gold_chunk_ids").alias("gold_evidence_ids"),
    )


def finite(value: Column) -> Column:
    """The value as double, null unless finite."""
    x = value.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def canonical_sha256(names: list[str]) -> Column:
    """SHA-256 of columns as JSON with keys in order."""
    return F.sha2(F.to_json(F.struct(*sorted(names)), {"ignoreNullFields": "false"}), 256)


@F.pandas_udf(T.StringType())
def canonical_json(text: pd.Series) -> pd.Series:
    """JSON text with the keys of all its objects in order, compact; null where the text is no JSON. Built-in functions keep the order that they read."""

    def one(s: str | None) -> str | None:
        try:
            return json.dumps(json.loads(s), ensure_ascii=False, sort_keys=True, separators=(",", ":"))
        except (TypeError, ValueError):
            return None

    return text.map(one)


def finite_number(value: Column) -> Column:
    """Whether a JSON-like text is a finite number: no boolean, no word, no infinity."""
    x = value.try_cast("double")
    return F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)) & ~F.lower(F.trim(value.cast("string"))).isin("true", "false")


def as_float(value: Column) -> Column:
    """A number for a gate: true and false count as 1 and 0, what is not finite is null."""
    word = F.lower(F.trim(value.cast("string")))
    return F.when(word == "true", 1.0).when(word == "false", 0.0).otherwise(finite(value))


def now_iso(clock: Column | None = None) -> Column:
    """UTC time as ISO text with seconds; a clock may stand in for the present."""
    return F.date_format(F.to_utc_timestamp(clock if clock is not None else F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def today(clock: Column | None = None) -> Column:
    return F.substring(now_iso(clock), 1, 10)


def metadata_of(json_text: Column, source: Column, text: Column) -> Column:
    """Stored metadata as JSON text; where it is no object, one of source and text."""
    plain = F.to_json(F.struct(F.coalesce(source, F.lit("")).alias("source"), F.coalesce(text, F.lit("")).alias("text")))
    return F.when(F.json_object_keys(json_text).isNotNull(), json_text).otherwise(plain)


def tree_digest(files: DataFrame, root: str) -> str:
    """One digest of a folder (path, content): for files by path, the path's length in eight bytes, the path, the content.

    Each file passes through the driver once, in order; folders of artefacts, not of data, are meant.
    """
    total = hashlib.sha256()
    for path, content in files.select("path", "content").orderBy("path").toLocalIterator():
        name = path.split(root.rstrip("/") + "/", 1)[-1].encode()
        total.update(len(name).to_bytes(8, "big") + name + bytes(content))
    return total.hexdigest()
