"""Arrays that an aggregate grows, in time that does not rise with the square of their length."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Members up to which a row is extended; then it is put aside whole, and the next one begun.
ROW = 256


def none_yet(kind: str) -> list[Column]:
    """The fields of an accumulator that holds no members of a kind (a type's name)."""
    return [F.array().cast(f"array<{kind}>").alias("row"), F.array().cast(f"array<array<{kind}>>").alias("rows")]


def grown(acc: Column, member: Column, when: Column) -> list[Column]:
    """Those fields with a member more, where the condition holds: what is copied is one short row, now and then the list of rows."""
    room = F.size(acc["row"]) < ROW
    row = F.when(when, F.when(room, F.array_append(acc["row"], member)).otherwise(F.array(member))).otherwise(acc["row"])
    rows = F.when(when & ~room, F.array_append(acc["rows"], acc["row"])).otherwise(acc["rows"])
    return [row.alias("row"), rows.alias("rows")]


def members(acc: Column) -> Column:
    """All members, in order."""
    return F.flatten(F.array_append(acc["rows"], acc["row"]))
