"""Shared by the operators: tables, checkpoints, word splitting and word hashing."""

from __future__ import annotations

import inspect
import re
import tempfile
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of a text are the maximal runs without these bytes.
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
ODD = np.uint64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of an Arrow batch, beyond which the next row goes into another one.
ARROW_BYTES = 4 << 20


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Arrow batches of few rows and bytes, since texts may be very long; a session that asks for fewer keeps its own values."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)):
        said = spark.conf.get(key).rstrip("b")
        if not said.lstrip("-").isdigit() or not 0 < int(said) <= most:
            spark.conf.set(key, str(most))


def settle(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint in the folder the session names; a run on one machine may do without naming one."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not re.fullmatch(r"local(\[[^\[\]]*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tidemill-"))
    return df.checkpoint()


def size_of(df: DataFrame, *columns: str) -> int:
    """Bytes of the named string columns; one pass over their lengths."""
    return sum(x or 0 for x in df.agg(*[F.sum(F.octet_length(c)).alias(f"n{i}") for i, c in enumerate(columns)]).first())


def groups(size: int, unit: int) -> int:
    """How many groups of about `unit` bytes `size` bytes make."""
    return max(1, -(-size // unit))


#: Groups that a task gets, beyond as many tasks as the session runs at once.
GROUPS_A_TASK = 4


def spread(df: DataFrame, count: int, key: str, each: int = GROUPS_A_TASK) -> DataFrame:
    """df dealt evenly by a key from 0 to count - 1, `each` of them a task, so that a task's share stays as it is when count grows."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    tasks = max(1, min(count, max(cores, -(-count // each))))
    return df.withColumn(key, F.col(key).cast("int")).repartitionById(tasks, key)


_KEPT: dict = {}


def kept(key, make: Callable):
    """What a worker has made for a key; it holds one such thing at a time."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]


def release() -> None:
    """Gives memory that is free in this process back to the system."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def trimmed(f: Callable, keeps: bool = False) -> Callable:
    """For functions of an iterator of batches: drops what other operators left in the worker, unless f keeps something itself, and gives
    freed memory back after the last batch."""

    def run(batches):
        if not keeps:
            _KEPT.clear()
        try:
            yield from f(batches)
        finally:
            release()

    return run


def lean(f: Callable) -> Callable:
    """For functions of one or two tables of a group: drops what other operators left in the worker, and gives freed memory back."""

    def tidy(*tables):
        _KEPT.clear()
        try:
            return f(*tables)
        finally:
            release()

    def one(table):
        return tidy(table)

    def two(left, right):
        return tidy(left, right)

    return one if len(inspect.signature(f).parameters) == 1 else two


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits all depend on all input bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class Words:
    """The words of many texts at once: where each starts and ends in one buffer, its 64-bit hash and its text.

    A hash is a polynomial in the word's bytes over the integers modulo 2**64, found as a difference of running
    sums, then mixed with the word's length; equal words have equal hashes wherever they stand.
    """

    #: Bytes that are hashed at once, up to the end of a word.
    PIECE = 1 << 19
    _powers = np.ones(1, np.uint64)
    _inverse = np.ones(1, np.uint64)

    def __init__(self, texts: list[bytes], lower: bool):
        joined = b"\n".join(texts)
        self.buffer = joined.lower() if lower else joined  # bytes.lower() touches A-Z only
        raw = np.frombuffer(self.buffer, np.uint8)
        found, lo = [], 0
        while lo < len(raw):
            space = GAP.search(self.buffer, lo + self.PIECE) if lo + self.PIECE < len(raw) else None
            hi = space.start() if space else len(raw)
            found.append(self._piece(raw[lo:hi], lo))
            lo = hi
        none = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)]
        self.start, self.end, self.hash = map(np.concatenate, zip(*found, strict=True)) if found else none
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
        #: Words of text i: bounds[i] to bounds[i + 1].
        self.bounds = np.concatenate([[0], np.searchsorted(self.start, ends)])

    @classmethod
    def _piece(cls, raw: np.ndarray, at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and hash of the words of a piece that stands at `at` and cuts no word."""
        edge = np.diff(IS_WORD[raw].view(np.int8), prepend=np.int8(0), append=np.int8(0))
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        power, inverse = cls._tables(len(raw) + 1)
        sums = np.zeros(len(raw) + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[: len(raw)], out=sums[1:])
            h = (sums[end] - sums[start]) * inverse[start]
            return start + at, end + at, mix(h + ODD * (end - start).astype(np.uint64))

    @classmethod
    def _tables(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        size = 1 << (n - 1).bit_length()
        base = 0xD6E8FEB86659FD93
        if size > 4 * cls.PIECE:  # one very long word: not kept
            return cls._running(base, size), cls._running(pow(base, -1, 1 << 64), size)
        if len(cls._powers) < n:
            cls._powers, cls._inverse = (cls._running(b, size) for b in (base, pow(base, -1, 1 << 64)))
        return cls._powers, cls._inverse

    @staticmethod
    def _running(base: int, size: int) -> np.ndarray:
        out = np.full(size, base, np.uint64)
        out[0] = 1
        with np.errstate(over="ignore"):
            return np.cumprod(out, dtype=np.uint64)

    def texts(self) -> list[bytes]:
        return self.buffer.split()


GAP = re.compile(rb"[\x20\x09-\x0D]")
#: By byte.
IS_WORD = np.array([b not in SPACES for b in range(256)])


def groups_of(lengths: list[int], most: int) -> list[slice]:
    """Consecutive runs of items of about `most` in sum; an item is never split."""
    out, lo, total = [], 0, 0
    for i, n in enumerate(lengths):
        if total and total + n > most:
            out.append(slice(lo, i))
            lo, total = i, 0
        total += n
    if lo < len(lengths):
        out.append(slice(lo, len(lengths)))
    return out


def windows(h: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """The hash of each run of k neighbours in h, in order; empty where h has fewer."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        mul = ODD + np.uint64(2 * seed)
        out = np.full(n, seed + 1, np.uint64)
        for j in range(k):
            out = out * mul + h[j : j + n]
    return mix(out)


def deal(docs: DataFrame, text: str, batches: int, **more: Column) -> DataFrame:
    """doc_id, packed (the text's UTF-8, compressed, so that a shuffle moves less; null as empty), the columns of `more`, and batch, by a hash of id and text.

    The text takes part so that rows without an id, or of one id, do not all meet in one batch.
    """
    small_batches(docs.sparkSession)

    def run(rows):
        import pyarrow as pa
        import zstandard

        pack = zstandard.ZstdCompressor(level=5).compress
        for b in rows:
            packed = [pack(t) if t else b"" for t in b.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(packed, pa.binary()), *b.columns[2:]], names=names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("packed"), *[c.alias(n) for n, c in more.items()])
    names = rows.columns
    schema = ", ".join(f"{f.name} {'binary' if f.name == 'packed' else f.dataType.simpleString()}" for f in rows.schema.fields)
    rows = rows.mapInArrow(trimmed(run), schema).withColumn("batch", F.pmod(F.xxhash64("doc_id", "packed", F.lit("batch")), F.lit(batches)))
    return spread(rows, batches, "batch")


def unpack(table) -> list[bytes]:
    """The texts of dealt rows."""
    import zstandard

    whole = zstandard.ZstdDecompressor().decompress
    return [whole(t) if t else b"" for t in table.column("packed").to_pylist()]
