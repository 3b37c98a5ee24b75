"""What chunks inherit from their document: pages, headings, block types and parents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def page_offsets(pages: DataFrame, doc: str = "doc_id", page: str = "page", text: str = "text", gap: int = 2) -> DataFrame:
    """doc, page and start of each page that is not blank, when pages are joined with `gap` characters between."""
    rows = pages.filter(F.trim(F.coalesce(text, F.lit(""))) != "")
    w = Window.partitionBy(doc).orderBy(page).rowsBetween(Window.unboundedPreceding, -1)
    return rows.select(doc, page, F.coalesce(F.sum(F.length(text) + gap).over(w), F.lit(0)).cast("long").alias("start"))


def page_at(pages: Column, offset: Column) -> Column:
    """Page of the last entry (start, page) of an array sorted by start that is not beyond the offset; the first page before all, null without pages."""
    last = F.try_element_at(F.filter(pages, lambda p: p["start"] <= offset), F.lit(-1))
    return F.coalesce(last["page"], F.try_element_at(pages, F.lit(1))["page"])


def assign_pages(chunks: DataFrame, offsets: DataFrame, doc: str = "doc_id") -> DataFrame:
    """chunks (doc, start, stop) with page_start and page_end; one array of offsets a document meets its chunks in an equi-join."""
    listed = offsets.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct("start", "page"))).alias("_pages"))
    out = chunks.join(listed, doc, "left")
    end = F.greatest(F.col("start"), F.col("stop") - 1)
    return out.withColumns({"page_start": page_at(F.col("_pages"), F.col("start")), "page_end": page_at(F.col("_pages"), end)}).drop("_pages")


def headings(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc, at (offset of the line), level and title of each heading line.

    A mark before each heading line cuts the text into pieces, one a heading and one before the first; a piece's offset is the sum
    of those before it, by a window over a document's pieces. Only documents with a heading are cut.
    """
    mark = "\ue000"
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc), body.alias("_b")).filter(F.col("_b").rlike(r"(?m)^#{1,6}\s+\S"))
    cut = F.split(F.regexp_replace(F.translate("_b", mark, "\x01"), r"(?m)^(#{1,6}[^\S\n]+\S)", mark + "$1"), mark)
    rows = rows.withColumn("_row", F.monotonically_increasing_id()).select(doc, "_row", F.posexplode(cut).alias("_i", "_piece"))
    w = Window.partitionBy(doc, "_row").orderBy("_i").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("at", F.coalesce(F.sum(F.length("_piece")).over(w), F.lit(0)).cast("int")).filter("_i > 0")
    line = F.substring_index("_piece", "\n", 1)
    return rows.select(doc, "at", F.length(F.regexp_extract(line, "^(#+)", 1)).alias("level"), F.trim(F.regexp_replace(line, r"^#+\s+", "")).alias("title"))


def heading_paths(chunks: DataFrame, found: DataFrame, doc: str = "doc_id", start: str = "start") -> DataFrame:
    """chunks with heading_path and heading (joined by ` > `), null without headings.

    A heading stands over an offset unless a later one before it has the same level or a higher one. A document's headings
    come as one array in an equi-join, not as pairs.
    """
    listed = found.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct("at", "level", "title"))).alias("_h"))
    out = chunks.join(listed, doc, "left")
    before = F.filter(F.col("_h"), lambda h: h["at"] <= F.col(start))
    kept = F.filter(before, lambda h: ~F.exists(before, lambda g: (g["at"] > h["at"]) & (g["level"] <= h["level"])))
    path = F.transform(kept, lambda h: h["title"])
    path = F.when(F.size(path) > 0, path)
    return out.withColumn("heading_path", path).withColumn("heading", F.array_join("heading_path", " > ")).drop("_h")


def block_type(text: Column) -> Column:
    """heading, code, list, table or paragraph by a text's lines; of code, list and table the largest wins if no smaller than plain text."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\r\n|[\n\r]"), lambda x: F.trim(x)), lambda x: x != "")
    zero = F.struct(*[F.lit(0).alias(k) for k in ("code", "heading", "list", "table", "text")], F.lit(False).alias("inside"))

    def step(s: Column, line: Column) -> Column:
        fence = line.startswith("```")
        kind = (
            F.when(fence | s["inside"], "code")
            .when(line.rlike(r"^#{1,6}\s"), "heading")
            .when(line.rlike(r"^(?:[-*+]|\d+\.)\s"), "list")
            .when(line.startswith("|") & line.endswith("|"), "table")
            .otherwise("text")
        )
        return F.struct(*[(s[k] + (kind == k).cast("int")).alias(k) for k in ("code", "heading", "list", "table", "text")], F.when(fence, ~s["inside"]).otherwise(s["inside"]).alias("inside"))

    def name(s: Column) -> Column:
        most = F.greatest(s["code"], s["list"], s["table"])
        wins = (most > 0) & (most >= s["text"])
        return F.when(wins & (s["code"] == most), "code").when(wins & (s["list"] == most), "list").when(wins, "table").when((s["text"] == 0) & (s["heading"] > 0), "heading").otherwise("paragraph")

    return F.aggregate(lines, zero, step, name)
