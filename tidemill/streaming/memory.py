"""The fact memory as a stream of operations: per fact, state is kept and each batch emits what changed."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "fact_id string, content string, state string, updated_seq long"
STATE = "content string, state string, seq long"


def _apply(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    content, status, at = state.get if state.exists else (None, None, -1)
    ops = pd.concat(list(frames)).sort_values("seq")
    for op, said, seq in zip(ops["op"], ops["content"], ops["seq"], strict=True):
        if op == "add" and status in (None, "ACTIVE"):
            content, status, at = said, "ACTIVE", int(seq)
        elif status == "ACTIVE" and op == "update":
            content, at = said, int(seq)
        elif status == "ACTIVE" and op in ("delete", "supersede"):
            status, at = ("DELETED" if op == "delete" else "SUPERSEDED"), int(seq)
    if status is not None:
        state.update((content, status, at))
        yield pd.DataFrame([(key[0], content, status, at)], columns=["fact_id", "content", "state", "updated_seq"])


def latest_stream(ops: DataFrame) -> DataFrame:
    """Streaming fact_id, content, state and updated_seq from operations (fact_id, seq, op, content), in update mode."""
    return ops.groupBy("fact_id").applyInPandasWithState(_apply, OUT, STATE, "update", GroupStateTimeout.NoTimeout)


def windowed_actions(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts and sums by event type in tumbling windows, closed by a watermark."""
    from pyspark.sql import functions as F

    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("window.start", "event_type", "n", "total")
