"""Request and reply between batches of texts and buckets of hashed keys, in two hops each way.

A batch knows its distinct 64-bit keys in order, with a count of each; a bucket is an interval of keys and answers each
of its keys with a number. If every batch asked every bucket, rows would grow with the square of the input. Buckets
stand in about sqrt(buckets) zones, and as many batches make a team. A batch sends one row to each zone; a
team's rows for a zone meet in one group, their cross, which adds up equal keys and sends one row to each bucket of the zone.
Answers go back the same way. A task's group holds about as many keys as one batch or one bucket, whatever the input.

Keys go as differences in byte planes, compressed, so that what the order already says is not sent. A frequent key costs
one entry a batch, and one a team on the second hop.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import lean, spread

#: Sorted distinct keys and how often each occurs.
Counted = tuple[np.ndarray, np.ndarray]
#: A bucket's counted keys of each kind to a number for each of them, and the bucket's facts.
Say = Callable[[list[Counted]], tuple[list[np.ndarray], list[int]]]


def pack(x: np.ndarray) -> bytes:
    """Numbers from 0 on, as byte planes without the empty ones."""
    import zstandard

    raw = np.ascontiguousarray(x, "<u8").view(np.uint8).reshape(-1, 8)
    planes = 8 - next((i for i in range(8) if raw[:, 7 - i].any()), 8)
    return len(raw).to_bytes(7, "little") + bytes([planes]) + zstandard.ZstdCompressor(level=1).compress(raw[:, :planes].T.tobytes())


def unpack(b: bytes) -> np.ndarray:
    import zstandard

    n, planes = int.from_bytes(b[:7], "little"), b[7]
    out = np.zeros((n, 8), np.uint8)
    if n and planes:
        out[:, :planes] = np.frombuffer(zstandard.ZstdDecompressor().decompress(b[8:]), np.uint8).reshape(planes, n).T
    return out.view("<u8").ravel()


def pack_keys(keys: np.ndarray, drop: int = 0) -> bytes:
    """Sorted keys whose lowest `drop` bits are 0."""
    return pack(np.diff(keys >> np.uint64(drop), prepend=np.uint64(0)))


def unpack_keys(b: bytes, drop: int = 0) -> np.ndarray:
    return np.cumsum(unpack(b), dtype=np.uint64) << np.uint64(drop)


def low_bits(size: int) -> int:
    """How many low bits of a 64-bit key `size` bytes of text can do without: of n keys one in 500 meets another then."""
    return 64 - min(60, max(40, size.bit_length() + 8))


def count(h: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, the sum of the weights of each, and the place of each of h among them."""
    keys, back = np.unique(h, return_inverse=True)
    return keys, np.bincount(back, weights=weight, minlength=len(keys)).astype(np.int64), back


def add(counted: list[Counted]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Distinct keys of all lists, their sums, and the place of each list's keys among them."""
    keys, back = np.unique(np.concatenate([k for k, _ in counted]), return_inverse=True)
    total = np.bincount(back, weights=np.concatenate([c for _, c in counted]), minlength=len(keys)).astype(np.int64)
    return keys, total, np.split(back, np.cumsum([len(k) for k, _ in counted])[:-1])


def _rows(columns: dict[str, list], longs: int) -> pa.Table:
    kinds = [*[pa.int64()] * longs, *[pa.binary()] * (len(columns) - longs)]
    return pa.table([pa.array(c, k) for c, k in zip(columns.values(), kinds, strict=True)], names=list(columns))


@dataclass(frozen=True)
class Routes:
    """The way of kinds of keys from `batches` batches to `buckets` buckets and back; drop: the low bits that are 0, by
    kind; facts: how many numbers each bucket tells all batches, who add them up."""

    batches: int
    buckets: int
    drop: tuple[int, ...] = (0,)
    facts: int = 0

    @property
    def kinds(self) -> int:
        return len(self.drop)

    @property
    def zones(self) -> int:
        return math.ceil(math.sqrt(self.buckets))

    @property
    def width(self) -> int:
        return -(-self.buckets // self.zones)

    @property
    def teams(self) -> int:
        return -(-self.batches // self.zones)

    def edges(self) -> np.ndarray:
        """The first key of each bucket but the first."""
        return np.array([-(-(i << 64) // self.buckets) for i in range(1, self.buckets)], np.uint64)

    def cuts(self, keys: np.ndarray) -> np.ndarray:
        """Where each bucket's keys begin and end."""
        return np.concatenate([[0], np.searchsorted(keys, self.edges()), [len(keys)]]).astype(np.int64)

    def schema(self, *longs: str, pairs: bool) -> str:
        sent = [f"{x}{k}" for k in range(self.kinds) for x in ("keys", "counts")] if pairs else [f"values{k}" for k in range(self.kinds)]
        told = [] if pairs else [f"fact{i}" for i in range(self.facts)]
        return ", ".join([f"{x} long" for x in (*longs, *told)] + [f"{x} binary" for x in sent])

    def _sent(self, counted: list[Counted], places: list[tuple[dict, int, int]]) -> pa.Table:
        """A row for each place: its long columns, its first and one past its last bucket. Rows without keys go too, for the answer's facts."""
        cuts = [self.cuts(k) for k, _ in counted]
        rows = []
        for at, lo, hi in places:
            row = dict(at)
            for k, (cut, (keys, counts)) in enumerate(zip(cuts, counted, strict=True)):
                mine = slice(cut[lo], cut[hi])
                row |= {f"keys{k}": pack_keys(keys[mine], self.drop[k]), f"counts{k}": pack(counts[mine])}
            rows.append(row)
        return _rows({name: [r[name] for r in rows] for name in rows[0]}, len(places[0][0]))

    def ask(self, batch: int, counted: list[Counted]) -> pa.Table:
        """A batch's rows: one for each zone."""
        zones = [z for z in range(self.zones) if z * self.width < self.buckets]
        return self._sent(counted, [({"cross": z * self.teams + batch % self.teams, "zone": z, "batch": batch}, z * self.width, min(self.buckets, (z + 1) * self.width)) for z in zones])

    def _read(self, table: pa.Table, kind: int) -> list[Counted]:
        return [(unpack_keys(x, self.drop[kind]), unpack(c)) for x, c in zip(table.column(f"keys{kind}").to_pylist(), table.column(f"counts{kind}").to_pylist(), strict=True)]

    def merge(self, table: pa.Table) -> pa.Table:
        """A team's rows of a zone, added up: one row for each bucket."""
        zone, cross = table.column("zone")[0].as_py(), table.column("cross")[0].as_py()
        counted = [add(self._read(table, k))[:2] for k in range(self.kinds)]
        lo = zone * self.width
        return self._sent(counted, [({"bucket": b, "cross": cross}, b, b + 1) for b in range(lo, min(self.buckets, lo + self.width))])

    def answer(self, table: pa.Table, say: Say) -> pa.Table:
        """A bucket's rows, answered: a number for each key of each row."""
        added = [add(self._read(table, k)) for k in range(self.kinds)]
        values, facts = say([(keys, total) for keys, total, _ in added])
        out = {c: table.column(c).to_pylist() for c in ("cross", "bucket")}
        out |= {f"fact{i}": [int(x)] * table.num_rows for i, x in enumerate(facts)}
        out |= {f"values{k}": [pack(values[k][at]) for at in places] for k, (_, _, places) in enumerate(added)}
        return _rows(out, 2 + self.facts)

    def back(self, asked: pa.Table, answered: pa.Table) -> pa.Table:
        """A team's answers of a zone, dealt to its batches."""
        order = np.argsort(answered.column("bucket").to_numpy())
        out = {c: asked.column(c).to_pylist() for c in ("batch", "zone")}
        out |= {f"fact{i}": [sum(answered.column(f"fact{i}").to_pylist())] * asked.num_rows for i in range(self.facts)}
        for k in range(self.kinds):
            values = np.concatenate([unpack(answered.column(f"values{k}")[int(i)].as_py()) for i in order])
            out[f"values{k}"] = [pack(values[at]) for at in add(self._read(asked, k))[2]]
        return _rows(out, 2 + self.facts)

    def read(self, replies: pa.Table) -> tuple[list[np.ndarray], list[int]]:
        """The answers to a batch's keys of each kind, in the keys' order, and the sums of all buckets' facts."""
        order = np.argsort(replies.column("zone").to_numpy())
        values = [np.concatenate([np.empty(0, np.uint64), *(unpack(replies.column(f"values{k}")[int(i)].as_py()) for i in order)]) for k in range(self.kinds)]
        return values, [sum(replies.column(f"fact{i}").to_pylist()) for i in range(self.facts)]

    def run(self, dealt: DataFrame, ask: Callable[[pa.Table], pa.Table], say: Say) -> DataFrame:
        """batch, zone, facts and values for each batch of `dealt`; `ask` makes a batch's rows with Routes.ask."""
        crosses = self.zones * self.teams
        asked = spread(dealt.groupBy("batch").applyInArrow(lean(ask), self.schema("cross", "zone", "batch", pairs=True)), crosses, "cross")
        merged = asked.groupBy("cross").applyInArrow(lean(lambda t: self.merge(t)), self.schema("bucket", "cross", pairs=True))
        answered = spread(merged, self.buckets, "bucket").groupBy("bucket").applyInArrow(lean(lambda t: self.answer(t, say)), self.schema("cross", "bucket", pairs=False))
        both = asked.groupBy("cross").cogroup(spread(answered, crosses, "cross").groupBy("cross"))
        replies = both.applyInArrow(lean(lambda a, b: self.back(a, b)), self.schema("batch", "zone", pairs=False))
        return spread(replies, self.batches, "batch")
