"""Files of a folder as documents: discovery, text, pages, pictures and film frames.

What needs a decoder (PDF, OCR, video) takes it as a function of a file's bytes and runs it in mapInPandas; the arithmetic around
it is column expressions.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill.operators.enrich import page_offsets

# Fixed values.
TEXT, PAGED = ("txt", "md"), ("pdf",)
IMAGES = ("png", "jpg", "jpeg", "webp", "bmp")
VIDEOS = ("mp4", "mov", "avi", "mkv", "webm")
IGNORED = (".git", ".venv", "__pycache__", "node_modules")


def discover(spark: SparkSession, folder: str, kinds: tuple[str, ...] = TEXT + PAGED + IMAGES + VIDEOS) -> DataFrame:
    """path, length and file_type of each file of the known kinds below a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length")
    kind = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return files.withColumn("file_type", kind).filter(F.col("file_type").isin(*kinds))


def load_text(spark: SparkSession, paths: str | list[str], strict: bool = False) -> DataFrame:
    """source, file_type and text (UTF-8, stripped) of text and Markdown files; empty ones are left out, or fail the scan if strict."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths)
    kind = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    text = F.regexp_replace(F.decode("content", "UTF-8"), r"^\s+|\s+$", "")
    if strict:
        text = F.when(kind.isin(*TEXT) & (text == ""), F.raise_error(F.concat(F.lit("empty file: "), F.col("path"))).cast("string")).otherwise(text)
    return df.select(F.col("path").alias("source"), kind.alias("file_type"), text.alias("text")).filter(F.col("file_type").isin(*TEXT) & (F.col("text") != ""))


def load(spark: SparkSession, folder: str, pages: Callable | None = None, ocr: Callable | None = None, frames: Callable | None = None, strict: bool = False) -> DataFrame:
    """source, file_type, modality, chunk_id, text, image_path and time_sec of all files of a folder, each kind by its own loader.

    A file of an unknown kind, or of a kind whose decoder is missing, is an error; files without a byte are not scanned. Pictures and frames have a row each; texts and
    paged files one.
    """
    kinds = {r[0] for r in spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))).distinct().collect()}
    if unknown := sorted(kinds - {*TEXT, *PAGED, *IMAGES, *VIDEOS}):
        raise ValueError(f"unsupported file type: .{unknown[0]}")
    for kind in sorted(kinds):
        if (kind in PAGED and pages is None) or (kind in VIDEOS and frames is None):
            raise ValueError(f"no decoder for .{kind}")
    none = lambda k: F.lit(None).cast(k)
    only = lambda known: "*.{" + ",".join(sorted(known & kinds | {k.upper() for k in known & kinds})) + "}"
    out = load_text(spark, folder, strict).select("source", "file_type", F.lit("text").alias("modality"), none("int").alias("chunk_id"), "text", none("string").alias("image_path"), none("double").alias("time_sec"))
    if kinds & set(PAGED):
        docs, _ = load_paged(spark, folder, pages, only(set(PAGED)))
        out = out.union(docs.select("source", F.lit("pdf"), F.lit("text"), none("int"), "text", none("string"), none("double")))
    if kinds & set(IMAGES):
        pictures = load_images(spark, folder, ocr, only(set(IMAGES)))
        out = out.union(pictures.select("source", F.lower(F.regexp_extract("source", r"\.([^./]+)$", 1)), "modality", none("int"), "text", "image_path", none("double")))
    if kinds & set(VIDEOS):
        shots = load_videos(spark, folder, frames, only(set(VIDEOS)))
        out = out.union(shots.select("source", "file_type", "modality", "chunk_id", "text", "image_path", "time_sec"))
    return out


def load_paged(spark: SparkSession, paths: str | list[str], pages: Callable[[bytes], list[str]], only: str = "*") -> tuple[DataFrame, DataFrame]:
    """Documents (source, text) whose pages, blank ones left out, are joined by an empty line, and their page offsets (source, page, start)."""

    def run(frames):
        for frame in frames:
            rows = [(p, i + 1, t) for p, c in zip(frame["path"], frame["content"], strict=True) for i, t in enumerate(pages(bytes(c)))]
            yield pd.DataFrame(rows, columns=["source", "page", "text"])

    df = _binary(spark, paths, only).select("path", "content").mapInPandas(run, "source string, page int, text string")
    full = df.filter(F.trim("text") != "")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda x: x["text"]), "\n\n")
    return full.groupBy("source").agg(joined.alias("text")), page_offsets(df, "source")


def _binary(spark: SparkSession, paths: str | list[str], only: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", only).load(paths)


def load_images(spark: SparkSession, paths: str | list[str], ocr: Callable[[bytes], str] | None = None, only: str = "*") -> DataFrame:
    """source, image_path and ocr_text of pictures; `Image source: name` where nothing was read."""

    def run(frames):
        for frame in frames:
            texts = []
            for content in frame["content"]:
                try:
                    texts.append((ocr(bytes(content)) or "").strip() if ocr else "")
                except Exception:  # a picture that the injected reader can't read keeps its name
                    texts.append("")
            yield pd.DataFrame({"image_path": frame["path"], "ocr_text": texts})

    df = _binary(spark, paths, only).select("path", "content").mapInPandas(run, "image_path string, ocr_text string")
    name = F.regexp_extract("image_path", r"([^/]+)$", 1)
    return df.select(F.col("image_path").alias("source"), "image_path", F.when(F.col("ocr_text") != "", F.col("ocr_text")).otherwise(F.concat(F.lit("Image source: "), name)).alias("text"), F.lit("image").alias("modality"))


def load_videos(spark: SparkSession, paths: str | list[str], frames: Callable[[bytes], tuple[int, float, Callable[[int], bytes]]], only: str = "*", seconds: float = 2.0, most: int = 120) -> DataFrame:
    """source, file_type, modality, chunk_id, image_path (a name for the frame), time_sec, text and content of the sampled frames of films.

    frames: of a file's bytes the number of frames, the frames a second (25 if not above 0) and a function from a frame's number to its
    picture. A film without frames fails the scan.
    """

    def run(tables):
        for table in tables:
            rows = []
            for path, content in zip(table["path"], table["content"], strict=True):
                n, fps, picture = frames(bytes(content))
                fps = fps if fps and fps > 0 else 25.0
                if n <= 0:
                    raise ValueError(f"no frames in {path}")
                name = path.rsplit("/", 1)[-1]
                for i, frame in enumerate(list(range(0, n, max(int(fps * seconds), 1)))[:most]):
                    at = frame / fps
                    rows.append((path, i, f"{name.rsplit('.', 1)[0]}/frame_{i:05d}.jpg", at, f"Video frame at {at:.2f}s from {name}", picture(frame)))
            yield pd.DataFrame(rows, columns=["source", "chunk_id", "image_path", "time_sec", "text", "content"])

    df = _binary(spark, paths, only).select("path", "content").mapInPandas(run, "source string, chunk_id int, image_path string, time_sec double, text string, content binary")
    return df.select("source", F.lit("video").alias("file_type"), F.lit("image").alias("modality"), "chunk_id", "image_path", "time_sec", "text", "content")


def frame_schedule(videos: DataFrame, seconds: float = 2.0, most: int = 120) -> DataFrame:
    """frame and time_sec of the frames to take from each video (source, n_frames, fps; fps defaults to 25)."""
    fps = F.when(F.coalesce(F.col("fps"), F.lit(0.0)) > 0, F.col("fps")).otherwise(25.0)
    step = F.greatest((fps * seconds).cast("int"), F.lit(1))
    frames = F.slice(F.sequence(F.lit(0), F.greatest(F.col("n_frames") - 1, F.lit(0)), step), 1, most)
    return videos.filter("n_frames > 0").select("source", F.explode(frames).alias("frame"), fps.alias("_fps")).select("source", "frame", (F.col("frame") / F.col("_fps")).alias("time_sec"))


def checksums(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path, bytes and sha256 of files."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths)
    return df.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def write_manifest(spark: SparkSession, paths: str | list[str], target: str, root: str = "") -> int:
    """Writes a line `sha256  path` for each file, by path, relative to root; returns the files' bytes together."""
    sums = checksums(spark, paths)
    name = F.substring_index("path", root.rstrip("/") + "/", -1) if root else F.col("path")
    sums.select(F.concat("sha256", F.lit("  "), name).alias("value"), name.alias("n")).orderBy("n").select("value").write.mode("errorifexists").text(target)
    return sums.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """path and sha256 of a manifest's lines."""
    return spark.read.text(path).select(F.regexp_extract("value", r"^\S+  (.*)$", 1).alias("path"), F.regexp_extract("value", r"^(\S+)  ", 1).alias("sha256"))


def compare_manifest(declared: DataFrame, actual: DataFrame, key: str = "path") -> DataFrame:
    """Files whose declared and actual hash differ, or that one side lacks."""
    both = declared.select(key, F.col("sha256").alias("declared")).join(actual.select(key, F.col("sha256").alias("actual")), key, "full")
    return both.filter(~F.col("declared").eqNullSafe(F.col("actual")))


# -- a workspace of text files ----------------------------------------------------------------------


def glob_pattern(pattern: str) -> str:
    """A glob (`*` and `?` within a path part, `**` over parts) as a regular expression."""
    if pattern.startswith("/") or ".." in pattern.split("/"):
        raise ValueError("the pattern leaves the workspace")
    out = []
    for part in pattern.split("/"):
        out.append("(?:[^/]+/)*" if part == "**" else "".join({"*": "[^/]*", "?": "[^/]"}.get(c, "\\" + c if not c.isalnum() else c) for c in part) + "/")
    return "^" + "".join(out).removesuffix("/") + "$"


def confined(path: str, ignored: tuple[str, ...] = IGNORED) -> str:
    """A path or pattern inside a workspace, or an error."""
    said = (path or "").strip()
    parts = said.split("/")
    if not said or "\x00" in said or len(said) > 1024:
        raise ValueError("empty or invalid path")
    if said.startswith("/") or ".." in parts:
        raise ValueError("the path must stay inside the workspace")
    if any(p in ignored for p in parts):
        raise ValueError("the path is excluded from the workspace")
    return said


def glob(files: DataFrame, pattern: str, limit: int = 200, path: str = "path", ignored: tuple[str, ...] = IGNORED) -> DataFrame:
    """The first files by path that fit a pattern and stand in no ignored folder."""
    folders = F.split(F.regexp_extract(path, r"^(.*)/[^/]*$", 1), "/")
    fits = F.col(path).rlike(glob_pattern(confined(pattern, ignored))) & ~F.arrays_overlap(folders, F.array(*map(F.lit, ignored)))
    return files.filter(fits).orderBy(path).limit(limit)


def grep(files: DataFrame, query: str, path: str = "path", text: str = "text", most_chars: int = 500, most_bytes: int = 1_000_000) -> DataFrame:
    """path, line (from 1) and text (cut) of lines that hold the query, without regard to case; large and binary files are passed over."""
    ok = (F.octet_length(text) <= most_bytes) & (F.instr(F.col(text), "\x00") == 0)
    lines = files.filter(ok).select(path, F.posexplode(F.split(text, "\n")).alias("i", "_line"))
    return lines.filter(F.instr(F.lower("_line"), query.lower()) > 0).select(path, (F.col("i") + 1).alias("line"), F.substring("_line", 1, most_chars).alias("text"))


def bounded(text: Column, most: int = 12_000, notice: str = "\n... file truncated", more: Column | None = None) -> Column:
    """A text cut so that, with the notice, it has `most` characters at most; more: whether something was left out before."""
    long = F.length(text) > most
    long = long if more is None else long | more
    room = most - len(notice)
    return F.when(long, F.concat(F.substring(text, 1, room), F.lit(notice)) if room > 0 else F.substring(text, 1, most)).otherwise(text)


def read_file(files: DataFrame, path: str, most_chars: int = 12_000, most_bytes: int = 1_000_000) -> DataFrame:
    """path, ok, content and error of one file (path, content as bytes) of a workspace: its first megabyte as text under its name, or why not."""
    raw = F.substring("content", 1, most_bytes + 1)
    binary = F.contains(raw, F.lit(bytearray(b"\x00")))
    head = f"{confined(path)}:\n"
    text = bounded(F.decode(F.substring("content", 1, most_bytes), "UTF-8"), max(most_chars - len(head), 0), more=F.octet_length("content") > most_bytes)
    rows = files.filter(F.col("path") == path)
    return rows.select("path", (~binary).alias("ok"), F.when(~binary, F.substring(F.concat(F.lit(head), text), 1, most_chars)).alias("content"), F.when(binary, "binary files are not supported").alias("error"))


def capped(lines: DataFrame, by: str, order: str, line: str = "text", most: int = 12_000) -> DataFrame:
    """by, text and truncated: lines joined in order until `most` characters, the last one cut."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.length(line) + 1).over(w), F.lit(0))
    rows = lines.withColumn("_before", before)
    room = F.lit(most) - F.col("_before")
    kept = rows.select(by, order, F.when(room > 0, F.substring(F.col(line), F.lit(1), room.cast("int"))).alias("_t"), (room < F.length(line)).alias("_cut"))
    pieces = F.array_sort(F.collect_list(F.when(F.coalesce(F.col("_t"), F.lit("")) != "", F.struct(order, "_t"))))
    out = kept.groupBy(by).agg(F.array_join(F.transform(pieces, lambda x: x["_t"]), "\n").alias("text"), F.max("_cut").alias("truncated"))
    return out
