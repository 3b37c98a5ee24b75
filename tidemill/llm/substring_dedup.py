"""Substring dedup: words covered by a window of k words that also starts in a document with a smaller id go.

Windows are counted by super-k-mers. A window's minimiser is the least among its m-word runs, by hash; consecutive
windows that share one travel as a single packed string to the minimiser's bucket, so equal windows meet there,
wherever they come from. The bucket sorts its windows by a 128-bit hash and finds each one's smallest document.
A run whose strings would fill HOT_SHARE of a bucket is hot and comes after all others in the order, so that the windows
around it go by their other runs to many buckets. A first pass over all texts, PASS_BYTES of them at a time and without a shuffle
of texts, adds up the strings' bytes by minimiser; the hot ones are at most the text's bytes over that share, eight bytes each.

Documents are dealt into batches of about BATCH_BYTES by a hash of id and text. A string that many documents of a
batch share is sent once with its smallest and largest document, so a passage in a third of all documents costs a
bucket one entry a batch; a bucket answers each batch only for windows that take something from it. Both ends of
that exchange read one shuffle of the texts.

Null and empty texts, and texts of fewer than k words, lose nothing; a text longer than a batch lies in one batch. An empty
table gives an empty result. Rows with a null doc_id take part in
nothing and keep all words. Rows that repeat a doc_id do not remove each other's words. Windows are judged on the
input. Columns of docs other than doc_id and the text are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, deal, groups, groups_of, lean, mix, size_of, small_batches, spread, trimmed, unpack, windows

WINDOW = 13
MINIMISER = 3
BATCH_BYTES = 3_000_000
#: Text bytes of a bucket's windows before they overlap.
BUCKET_BYTES = 4_000_000
CHUNK = 1_000_000
#: Text that the first pass looks at together, and bytes of its strings at one minimiser that it tells; the share of a bucket that makes one hot.
PASS_BYTES = 3_000_000
LEAST_BYTES = 1_000
HOT_SHARE = 0.25
TOP = np.uint64(1 << 63)

REQUEST = "bucket long, batch long, strings binary, lens binary, entry binary, least binary, most binary"
REPLY = "batch long, entry binary, at binary, least binary"


def slide_min(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each run of w neighbours."""
    out, size = x, 1
    while size < w:
        step = min(size, w - size)
        out = np.minimum(out[:-step], out[step:])
        size += step
    return out


class Supers:
    """The super-k-mers of a batch's texts: first and last window, document, minimiser and 128-bit key, in text order."""

    def __init__(self, texts: list[bytes], k: int, m: int, hot: np.ndarray | None = None):
        self.words = w = Words(texts, lower=False)
        n = len(w.hash)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(w.bounds))
        if n < k:
            self.first = self.last = self.low = np.empty(0, np.int64)
            self.key = np.empty((2, 0), np.uint64)
            return
        runs = windows(w.hash, m) & ~TOP
        if hot is not None and len(hot):
            runs[hot[np.minimum(np.searchsorted(hot, runs), len(hot) - 1)] == runs] |= TOP
        low = slide_min(runs, k - m + 1)
        inside = self.doc[: n - k + 1] == self.doc[k - 1 :]
        start = inside.copy()
        start[1:] &= ~inside[:-1] | (low[1:] != low[:-1]) | (self.doc[1 : n - k + 1] != self.doc[: n - k])
        self.first = np.flatnonzero(start)
        end = inside.copy()
        end[:-1] &= ~inside[1:] | start[1:]
        self.last = np.flatnonzero(end)
        self.low = low[self.first] & ~TOP
        self.key = np.stack([self._sums(windows(w.hash, k, seed)) for seed in (1, 2)])

    def _sums(self, whole: np.ndarray) -> np.ndarray:
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(whole, dtype=np.uint64)])
        with np.errstate(over="ignore"):
            return mix(sums[self.last + 1] - sums[self.first] + whole[self.first] * np.uint64(3) + (self.last - self.first).astype(np.uint64))

    def entries(self) -> tuple[np.ndarray, np.ndarray]:
        """One super-k-mer of each distinct string, and the number of each one's string; in the order of the keys."""
        order = np.lexsort((self.key[1], self.key[0]))
        fresh = np.ones(len(order), bool)
        fresh[1:] = np.any(np.diff(self.key[:, order], axis=1) != 0, axis=0)
        entry = np.empty(len(order), np.int64)
        entry[order] = np.cumsum(fresh) - 1
        return order[fresh], entry

    def spans(self, one: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """First and one past the last byte of super-k-mers in the words' buffer."""
        return self.words.start[self.first[one]], self.words.end[self.last[one] + k - 1]


def _rows(table: pa.Table) -> tuple[list, list[bytes], list]:
    ids = table.column("doc_id").to_pylist()
    raw = unpack(table)
    return ids, raw, [raw[i] if ids[i] is not None else b"" for i in range(len(ids))]


def _weights(texts: list[bytes], k: int, m: int) -> pa.RecordBatch:
    """Bytes of distinct strings by minimiser, where they are many."""
    s = Supers(texts, k, m)
    one = s.entries()[0]
    a, b = s.spans(one, k)
    low, back = np.unique(s.low[one], return_inverse=True)
    size = np.bincount(back, weights=b - a, minlength=len(low)).astype(np.int64)
    many = size >= LEAST_BYTES
    return pa.RecordBatch.from_arrays([pa.array(low[many].astype(np.int64)), pa.array(size[many])], names=["low", "size"])


def hot_runs(docs: DataFrame, text: str, k: int, m: int, least: float) -> np.ndarray:
    """The minimisers, in order, whose strings have more than `least` bytes."""

    def run(batches):
        held, size = [], 0
        for b in batches:
            for t in b.column(0).cast(pa.binary()).to_pylist():
                held.append(t or b"")
                size += len(held[-1])
                if size >= PASS_BYTES:
                    yield _weights(held, k, m)
                    held, size = [], 0
        if held:
            yield _weights(held, k, m)

    small_batches(docs.sparkSession)
    by = docs.filter("doc_id IS NOT NULL").select(text).mapInArrow(trimmed(run), "low long, size long").groupBy("low").agg(F.sum("size").alias("size"))
    found = by.filter(F.col("size") > least).select("low").toLocalIterator()
    return np.sort(np.fromiter((r[0] for r in found), np.int64).astype(np.uint64))


def _request(table: pa.Table, buckets: int, k: int, m: int, hot: np.ndarray) -> pa.Table:
    import zstandard

    batch = table.column("batch")[0].as_py()
    ids, _, used = _rows(table)
    s = Supers(used, k, m, hot)
    out = []
    if len(s.first):
        docs = np.array([-1 if i is None else i for i in ids], np.int64)[s.doc[s.first]]
        one, entry = s.entries()
        least, most = np.full(len(one), np.iinfo(np.int64).max), np.full(len(one), np.iinfo(np.int64).min)
        np.minimum.at(least, entry, docs)
        np.maximum.at(most, entry, docs)
        bucket = (s.low[one] % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        a, b = s.spans(one, k)
        cuts = np.flatnonzero(np.diff(bucket[order])) + 1
        packer = zstandard.ZstdCompressor(level=3)
        for part in np.split(order, cuts):
            strings = b"".join([s.words.buffer[x:y] for x, y in zip(a[part].tolist(), b[part].tolist(), strict=True)])
            wide = np.flatnonzero(most[part] > least[part]).astype(np.int32)
            far = np.concatenate([[len(wide)], most[part][wide]]).astype(np.int64).tobytes() + wide.tobytes()
            out.append((int(bucket[part[0]]), batch, *map(packer.compress, (strings, (b[part] - a[part]).astype(np.int32).tobytes(), np.diff(part, prepend=0).astype(np.int32).tobytes(), least[part].tobytes(), far))))
    kinds = [pa.int64(), pa.int64(), *[pa.binary()] * 5]
    return pa.table([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=[x.split()[0] for x in REQUEST.split(", ")])


def _answer(table: pa.Table, k: int) -> pa.Table:
    import zstandard

    unpack = zstandard.ZstdDecompressor()
    h1, h2, least, most, at, entry, batch = ([] for _ in range(7))
    for row in table.select(["batch", "strings", "lens", "entry", "least", "most"]).to_pylist():
        strings, lens, ids, low, far = (unpack.decompress(row[c]) for c in ("strings", "lens", "entry", "least", "most"))
        lens, low = np.frombuffer(lens, np.int32), np.frombuffer(low, np.int64)
        ids = np.cumsum(np.frombuffer(ids, np.int32), dtype=np.int32)
        n = int(np.frombuffer(far[:8], np.int64)[0])
        high = low.copy()
        high[np.frombuffer(far[8 + 8 * n :], np.int32)] = np.frombuffer(far[8 : 8 + 8 * n], np.int64)
        ends = np.cumsum(lens)
        for part in groups_of(lens.tolist(), CHUNK):
            texts = [strings[e - n : e] for e, n in zip(ends[part].tolist(), lens[part].tolist(), strict=True)]
            w = Words(texts, lower=False)
            size = np.diff(w.bounds) - k + 1
            of = np.repeat(np.arange(len(texts)), size)
            offset = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)
            spot = w.bounds[:-1][of] + offset
            for into, seed in ((h1, 1), (h2, 2)):
                into.append(windows(w.hash, k, seed)[spot])
            least.append(low[part][of])
            most.append(high[part][of])
            at.append(offset.astype(np.int32))
            entry.append(ids[part][of])
            batch.append(np.full(len(of), row["batch"], np.int64))
    h1, h2, least, most, at, entry, batch = map(np.concatenate, (h1, h2, least, most, at, entry, batch))
    order = np.argsort(h1, kind="stable")
    same1 = h1[order][1:] == h1[order][:-1]
    if np.any(same1 & (h2[order][1:] != h2[order][:-1])):
        order = np.lexsort((h2, h1))
        same1 = (h1[order][1:] == h1[order][:-1]) & (h2[order][1:] == h2[order][:-1])
    runs = np.concatenate([[0], np.flatnonzero(~same1) + 1])
    lowest = np.repeat(np.minimum.reduceat(least[order], runs), np.diff(np.append(runs, len(order))))
    hit = np.flatnonzero(lowest < most[order])
    where, lowest = order[hit], lowest[hit]
    by = np.argsort(batch[where], kind="stable")
    where, lowest = where[by], lowest[by]
    cuts = np.flatnonzero(np.diff(batch[where])) + 1
    out = [(int(batch[p[0]]), entry[p].tobytes(), at[p].tobytes(), q.tobytes()) for p, q in zip(np.split(where, cuts), np.split(lowest, cuts), strict=True) if len(p)]
    kinds = [pa.int64(), *[pa.binary()] * 3]
    return pa.table([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=["batch", "entry", "at", "least"])


def _cut(table: pa.Table, replies: pa.Table, k: int, m: int, hot: np.ndarray) -> pa.Table:
    ids, raw, used = _rows(table)
    s = Supers(used, k, m, hot)
    covered = np.zeros(len(s.words.hash) + 1, np.int64)
    if replies.num_rows and len(s.first):
        entry, at = (np.concatenate([np.frombuffer(x, np.int32) for x in replies.column(c).to_pylist()]) for c in ("entry", "at"))
        least = np.concatenate([np.frombuffer(x, np.int64) for x in replies.column("least").to_pylist()])
        docs = np.array([-1 if i is None else i for i in ids], np.int64)[s.doc[s.first]]
        mine = s.entries()[1]
        order = np.argsort(mine, kind="stable")  # the places of an entry stand together
        begin = np.searchsorted(mine[order], np.arange(mine.max() + 2))
        size = begin[entry + 1] - begin[entry]
        of = np.repeat(np.arange(len(entry)), size)
        place = order[np.repeat(begin[entry], size) + np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)]
        gone = least[of] < docs[place]
        first = s.first[place[gone]] + at[of[gone]]
        np.add.at(covered, first, 1)
        np.add.at(covered, first + k, -1)
    keep = np.cumsum(covered[:-1]) == 0
    n_words, kept, n_kept = [], [], []
    for i, t in enumerate(raw):
        lo, hi = s.words.bounds[i], s.words.bounds[i + 1]
        words = t.split()
        n_words.append(len(words))
        if ids[i] is not None and not keep[lo:hi].all():
            words = [words[j] for j in np.flatnonzero(keep[lo:hi])]
        n_kept.append(len(words))
        kept.append(b" ".join(words))
    removed = [a - b for a, b in zip(n_words, n_kept, strict=True)]
    return pa.table([table.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])


def remove_repeats(docs: DataFrame, text: str = "text", k: int = WINDOW, m: int = MINIMISER, batch_bytes: int = BATCH_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc_id, n_words, n_removed and the kept words of each row of docs, joined by single spaces."""
    size = size_of(docs, text)
    batches, buckets = groups(size, batch_bytes), groups(size, bucket_bytes)
    dealt = deal(docs, text, batches)
    hot = hot_runs(docs, text, k, m, HOT_SHARE * bucket_bytes) if buckets > 1 else np.empty(0, np.uint64)
    sent = docs.sparkSession.sparkContext.broadcast(hot)
    requests = dealt.groupBy("batch").applyInArrow(lean(lambda t: _request(t, buckets, k, m, sent.value)), REQUEST)
    replies = spread(requests, buckets, "bucket").groupBy("bucket").applyInArrow(lean(lambda t: _answer(t, k)), REPLY)
    both = dealt.groupBy("batch").cogroup(spread(replies, batches, "batch").groupBy("batch"))
    return both.applyInArrow(lean(lambda a, b: _cut(a, b, k, m, sent.value)), "doc_id long, n_words long, n_removed long, kept string")


def report(cut: DataFrame) -> DataFrame:
    return cut.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


ORACLE = """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, k, array_to_string(w[k:k + 12], ' ') AS s FROM d, unnest(range(1, greatest(1, len(w) - 11))) AS u(k)),
f AS (SELECT doc_id, k, min(doc_id) OVER (PARTITION BY s) AS least FROM s),
g AS (SELECT DISTINCT doc_id, k + x AS i FROM f, unnest(range(0, 13)) AS u(x) WHERE least < doc_id),
r AS (SELECT doc_id, count(*) AS n, list(i) AS gone FROM g GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
sha256(array_to_string(CASE WHEN n IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(gone, i)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id)
"""
