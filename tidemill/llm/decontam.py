"""Benchmark decontamination: one Aho-Corasick automaton over the normalised windows of all items scans
each normalised text once; hits are mapped back to character offsets of the original text.

Normalising lower-cases A-Z and keeps words, joined by single spaces. A pattern has a space before and
after it, so that it only fits whole words. Null, blank and empty texts have no words and no hits; blank items, and
items without an id, have no windows. Items with equal windows are all named. Very long texts are scanned whole, in
linear time. Repeated rows stay; an empty table gives an empty result. Columns of docs by the new names, whatever
their case, are replaced, all others pass through.

The automaton is built in each worker from windows that the driver reads, some hundred times the items' text. Items
of more than ITEM_BYTES are dealt by id into automata of that size, and the documents are scanned once with each, from a
written table to the next, so that a worker builds each automaton once and holds one at a time; hits are united by row.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import groups, kept, settle, size_of, small_batches, trimmed

WINDOW = 10
#: Item text of one automaton.
ITEM_BYTES = 2_000_000
#: Upper to lower letters; every other ASCII byte that is neither digit nor letter to a space.
TO_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))

SPANS = "n_words long, hit_starts array<int>, hit_ends array<int>, n_hit long, item_ids array<long>"


def normalise(text: bytes) -> bytes:
    return b" ".join(text.translate(TO_WORDS).split())


def item_windows(items: list[tuple[int, str | None]], size: int = WINDOW) -> dict[bytes, list[int]]:
    """Window (its words joined by spaces) to the ids of the items that have it."""
    out: dict[bytes, set[int]] = {}
    for item, text in items:
        if item is None:
            continue
        words = (text or "").encode().translate(TO_WORDS).split()
        for i in range(max(1, len(words) - size + 1)) if words else ():
            out.setdefault(b" ".join(words[i : i + size]), set()).add(item)
    return {k: sorted(v) for k, v in out.items()}


class Scanner:
    def __init__(self, found: dict[bytes, list[int]]):
        import ahocorasick

        self.auto = ahocorasick.Automaton()
        for window, items in found.items():
            self.auto.add_word(f" {window.decode('latin-1')} ", (len(window), window.count(b" ") + 1, items))
        self.empty = not found
        if found:
            self.auto.make_automaton()

    def hits(self, clean: bytes) -> tuple[list[tuple[int, int]], set[int]]:
        """(first word's offset in clean, words) of each hit, and the ids of their items."""
        spans, items = [], set()
        if not self.empty and clean:
            for end, (length, words, ids) in self.auto.iter(f" {clean.decode('latin-1')} "):
                spans.append((end - length - 1, words))
                items.update(ids)
        return spans, items


def runs_of(flags: np.ndarray) -> np.ndarray:
    """First and one-past-last index of each run of true flags, one row a run."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    return edge.reshape(-1, 2)


def original_offsets(text: str, first: np.ndarray, last: np.ndarray) -> tuple[list[int], list[int]]:
    """Code point offsets in the original text of runs of words, by the words' numbers."""
    import re

    words = [m.span() for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)]
    return [words[i][0] for i in first], [words[i - 1][1] for i in last]


#: Hits so far: runs of word numbers, and items.
FOUND = "found_starts array<int>, found_ends array<int>, found_items array<long>"


def _covered(words: int, runs: list[tuple[int, int]]) -> np.ndarray:
    """Whether each word is in one of the runs."""
    step = np.zeros(words + 1, np.int64)
    for ends, by in zip(np.array(runs, np.int64).reshape(-1, 2).T, (1, -1), strict=True):
        np.add.at(step, ends, by)
    return np.cumsum(step[:-1]) > 0


def _look(clean: bytes, scanner: Scanner, before: tuple[list[int], list[int], list[int]]) -> tuple[int, np.ndarray, list[int]]:
    """Words, runs of hit words and items of a normalised text, with those found before."""
    words = clean.count(b" ") + 1 if clean else 0
    spans, items = scanner.hits(clean)
    if not spans:
        return words, np.array(before[:2], np.int64).reshape(2, -1).T, before[2]
    starts = np.concatenate([[0], np.flatnonzero(np.frombuffer(clean, np.uint8) == 32) + 1])
    offset, length = np.array(sorted(set(spans))).T
    first = np.searchsorted(starts, offset)
    runs = [*zip(first.tolist(), (first + length).tolist(), strict=True), *zip(*before[:2], strict=True)]
    return words, runs_of(_covered(words, runs)), sorted(items.union(before[2]))


def scan(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", window: int = WINDOW, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """docs with columns n_words, hit_starts, hit_ends (code points of the hit runs in the text), n_hit (words) and item_ids."""
    spark = docs.sparkSession
    small_batches(spark)
    parts = groups(size_of(benchmark, "text"), item_bytes)
    dealt = benchmark.select(F.col(item).alias("item"), "text").withColumn("part", F.pmod(F.xxhash64("item"), F.lit(parts)))
    new = [c.split()[0] for c in SPANS.split(", ")]
    names = [c for c in docs.columns if c.lower() not in new]
    own = [f"c{i}" for i in range(len(names))]  # names of their own, which clash with none
    none = [F.array().cast(c.split()[1]).alias(c.split()[0]) for c in FOUND.split(", ")]
    rows = docs.select(*[F.col(f"`{n}`").alias(c) for n, c in zip(names, own, strict=True)], *none)
    for part in range(parts):
        of_part = dealt.filter(F.col("part") == part).select("item", "text")
        windows = item_windows([tuple(r) for r in of_part.toLocalIterator()], window)  # within ITEM_BYTES of items
        rows = _scan_part(rows, own, names.index(text), windows, last=part == parts - 1)
        rows = rows if part == parts - 1 else settle(rows)
    return rows.select(*[F.col(c).alias(n) for n, c in zip(names, own, strict=True)], *new)


def _scan_part(rows: DataFrame, own: list[str], at: int, found: dict[bytes, list[int]], last: bool) -> DataFrame:
    """rows (own columns, then FOUND) with the hits of one automaton added; at last with SPANS for FOUND. at: the text's place."""
    key = hashlib.sha256(b"\n".join(k + b"|%d" % len(v) + str(v).encode() for k, v in sorted(found.items()))).hexdigest()
    sent = rows.sparkSession.sparkContext.broadcast(found)
    new = SPANS if last else FOUND
    schema = ", ".join([f"{c} {rows.schema[c].dataType.simpleString()}" for c in own] + [new])
    names = [*own, *(c.split()[0] for c in new.split(", "))]

    def run(batches):
        scanner = kept(key, lambda: Scanner(sent.value))
        for batch in batches:
            raw = [t or b"" for t in batch.column(at).cast(pa.binary()).to_pylist()]
            before = zip(*(batch.column(len(own) + i).to_pylist() for i in range(3)), strict=True)
            out = []
            for t, b in zip(raw, before, strict=True):
                words, runs, items = _look(normalise(t), scanner, b)
                if last:
                    places = original_offsets(t.decode(), runs[:, 0], runs[:, 1]) if len(runs) else ([], [])
                    out.append((words, *places, int((runs[:, 1] - runs[:, 0]).sum()), items))
                else:
                    out.append((runs[:, 0].tolist(), runs[:, 1].tolist(), items))
            kinds = [pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int64(), pa.list_(pa.int64())] if last else [pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64())]
            extra = [pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(own)], *extra], names=names)

    return rows.mapInArrow(trimmed(run, keeps=True), schema)


def report(scanned: DataFrame) -> DataFrame:
    return scanned.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(F.col("item_ids").cast("array<string>")), ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


ORACLE = """
WITH i AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x{00}-\\x{2F}\\x{3A}-\\x{60}\\x{7B}-\\x{7F}]+') AS w FROM benchmark WHERE text IS NOT NULL),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x{00}-\\x{2F}\\x{3A}-\\x{60}\\x{7B}-\\x{7F}]+') AS w FROM documents),
iw AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[k:k + 9], ' ') AS s FROM i, unnest(range(1, greatest(2, len(w) - 8))) AS u(k) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT doc_id, k, n, array_to_string(w[k:k + n - 1], ' ') AS s FROM d, sizes, unnest(range(1, greatest(1, len(w) - n + 2))) AS u(k)),
h AS (SELECT dw.doc_id, dw.k, dw.n, iw.item_id FROM dw JOIN iw ON dw.s = iw.s AND dw.n = iw.n),
hit AS (SELECT doc_id, count(DISTINCT k + x) AS n_hit FROM h, unnest(range(0, n)) AS u(x) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
sha256(coalesce(its.s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""
