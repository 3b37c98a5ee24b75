"""Language-model scoring with a log-frequency Bloom filter.

Words and word pairs of the training texts are counted over the whole corpus. A count c is quantised to
q = 1 + floor(log_BASE c), and its n-gram is put into the filter once for each level 1..q; a reader probes the
levels upwards until one is missing and takes BASE ** (q - 1 / 2) for the count (1 at level 1). The filter is a row of segments: an
n-gram's hash chooses the segment and PROBES bits in it, so each segment is filled and probed by the one task that counts
its n-grams, and neither bit positions nor segments are moved. A segment has BITS bits for each level of each of its n-grams, so
false positives stay as they are however many n-grams there are, and no n-gram is left out.

The score is the sum over tokens of log10 of WEIGHT * c(v w) / c(v) + (1 - WEIGHT) * (c(w) + 1) / (N + V + 1),
with quantised counts; the first word's v is the start of a text. The base score has exact counts of words,
which are looked up by a 64-bit hash; pairs keep the bits that low_bits leaves. Texts go in batches, whose distinct
words and pairs go to their segments and back in two hops (see exchange.py), so a frequent one costs an entry a batch.

Null and empty texts are the end token alone. A text longer than a batch lies in one batch, hashed piece by piece. Rows with a null doc_id are
scored and not learnt from, and held_out is null. An empty table gives an empty result. With no training text N and V are 0 and every token has probability 1. Repeated rows count as often
as they occur.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ODD, Words, deal, groups, lean, mix, size_of, unpack
from .exchange import Counted, Routes, count, low_bits

BATCH_BYTES = 4_000_000
BUCKET_BYTES = 6_000_000
MODULUS, REMAINDER = 7, 2
BASE = 2.0
PROBES = 3
WEIGHT = 0.7
#: Bits of the filter for each level of an n-gram: about one probe in a hundred for an absent one is answered by chance.
BITS = 12
END = np.uint64(0x5BD1E9955BD1E995)
START = np.uint64(0xC6A4A7935BD1E995)

class Tokens:
    """Hashes of a batch's tokens, each text's words and its end; pairs[i] is the n-gram of token i and what stands before it."""

    def __init__(self, texts: list[bytes]):
        w = Words(texts, lower=True)
        n = len(texts)
        self.size = np.diff(w.bounds) + 1
        last = np.cumsum(self.size) - 1
        self.hash = np.empty(int(self.size.sum()), np.uint64)
        at_end = np.zeros(len(self.hash), bool)
        at_end[last] = True
        self.hash[at_end], self.hash[~at_end] = END, w.hash
        before = np.empty_like(self.hash)
        before[1:] = self.hash[:-1]
        before[last + 1 - self.size] = START
        with np.errstate(over="ignore"):
            self.pairs = mix(before * ODD + self.hash)
        self.text = np.repeat(np.arange(n), self.size)
        self.before = before


def spots(h: np.ndarray, level: int, probe: int, bits: int) -> np.ndarray:
    """The bit of a segment that an n-gram has for a level and probe."""
    with np.errstate(over="ignore"):
        return (mix(h + np.uint64(PROBES * level + probe) * ODD) % np.uint64(bits)).astype(np.int64)


#: The level of the largest 64-bit count.
MOST_LEVEL = 63


def levels_of(c: np.ndarray) -> np.ndarray:
    """q by count; exact at powers of BASE."""
    return 1 + np.floor(np.log(np.maximum(c, 1)) / math.log(BASE) + 1e-9).astype(np.int64)


class Filter:
    """A segment of so many bits; no level above `top` was put in."""

    def __init__(self, packed: bytes, bits: int, top: int = MOST_LEVEL):
        self.bytes, self.bits, self.top = np.frombuffer(packed, np.uint8), bits, top

    def level(self, h: np.ndarray) -> np.ndarray:
        """The highest level up to which the filter has each n-gram, 0 where it lacks it."""
        level, live = np.zeros(len(h), np.int64), np.arange(len(h))
        for step in range(1, self.top + 1):
            for probe in range(PROBES):
                at = spots(h[live], step, probe, self.bits)
                live = live[(self.bytes[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1]
            level[live] = step
        return level

    def count(self, h: np.ndarray) -> np.ndarray:
        """The quantised count of each n-gram, 0 where the filter lacks it."""
        return quantised(self.level(h))


def quantised(level: np.ndarray) -> np.ndarray:
    return np.where(level <= 1, level, BASE ** (level - 0.5))


def fill(ngrams: list[tuple[np.ndarray, np.ndarray]]) -> Filter:
    """One segment with n-grams, by hash, and their counts."""
    ngrams = [(h, levels_of(c)) for h, c in ngrams]
    bits = max(64, -(-BITS * sum(int(q.sum()) for _, q in ngrams) // 8) * 8)
    top = max(int(q.max(initial=0)) for _, q in ngrams)
    segment = np.zeros(bits, bool)
    for h, q in ngrams:
        for level in range(1, int(q.max(initial=0)) + 1):
            for probe in range(PROBES):
                segment[spots(h[q >= level], level, probe, bits)] = True
    return Filter(np.packbits(segment, bitorder="little").tobytes(), bits, top)


def _asked(t: Tokens, learn: np.ndarray, drop: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Distinct words, and distinct pairs with the start of a text, how often each is learnt, and where each token's are."""
    ngrams = np.concatenate([t.pairs, np.full(len(learn), START)]) >> np.uint64(drop) << np.uint64(drop)
    return [count(t.hash, learn[t.text]), count(ngrams, np.concatenate([learn[t.text], learn]))]


def _say(counted: list[Counted]) -> tuple[list[np.ndarray], list[int]]:
    """A word's count and level, a pair's level, as the segment has them; the bucket's training tokens and distinct ones."""
    (words, n), (pairs, m) = counted
    filt = fill([(words[n > 0], n[n > 0]), (pairs[m > 0], m[m > 0])])
    return [n * (MOST_LEVEL + 1) + filt.level(words), filt.level(pairs)], [int(n.sum()), int((n > 0).sum())]


def _learn(table: pa.Table) -> np.ndarray:
    return np.array(table.column("learn").to_pylist(), bool)


def _score(table: pa.Table, replies: pa.Table, routes: Routes) -> pa.Table:
    t = Tokens(unpack(table))
    (_, _, back), (_, _, of_pair) = _asked(t, _learn(table), routes.drop[1])
    (words, pairs), (n_all, kinds) = routes.read(replies)
    words = words.astype(np.int64)
    exact, guess = words // (MOST_LEVEL + 1), quantised(words % (MOST_LEVEL + 1))
    pair = quantised(pairs.astype(np.int64))[of_pair]
    docs = table.num_rows
    pair, start = pair[:-docs], pair[-1]
    base = np.log10((exact + 1.0) / (n_all + kinds + 1.0))[back]
    before = np.empty(len(t.hash))
    before[1:] = guess[back[:-1]]
    head = t.before == START
    before[head] = start
    share = np.where(before > 0, np.minimum(1.0, pair / np.maximum(before, 1.0)), 0.0)
    p = WEIGHT * share + (1 - WEIGHT) * (np.minimum(guess[back], n_all) + 1.0) / (n_all + kinds + 1.0)
    add = lambda x: np.bincount(t.text, weights=x, minlength=docs)
    columns = [table.column("doc_id"), table.column("held_out"), pa.array(t.size.astype(np.int64)), pa.array(add(exact[back] > 0).astype(np.int64)), pa.array(np.full(docs, n_all, np.int64)), pa.array(add(base)), pa.array(add(np.log10(p)))]
    return pa.table(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])


def score(docs: DataFrame, text: str = "text", batch_bytes: int = BATCH_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row of docs."""
    size = size_of(docs, text)
    routes = Routes(groups(size, batch_bytes), groups(size, bucket_bytes), (0, low_bits(size)), 2)
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(MODULUS)) == REMAINDER
    dealt = deal(docs, text, routes.batches, held_out=held, learn=F.coalesce(~held, F.lit(False)))

    def ask(table: pa.Table) -> pa.Table:
        asked = _asked(Tokens(unpack(table)), _learn(table), routes.drop[1])
        return routes.ask(table.column("batch")[0].as_py(), [x[:2] for x in asked])

    replies = routes.run(dealt, ask, _say)
    both = dealt.groupBy("batch").cogroup(replies.groupBy("batch"))
    return both.applyInArrow(lean(lambda t, r: _score(t, r, routes)), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
