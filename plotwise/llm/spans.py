"""Spans found in a text: a sorted array of (kind, start, end, score), positions in code points."""

from __future__ import annotations

from pyspark.sql import Column, functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

SPAN = StructType([
    StructField("kind", StringType()), StructField("start", IntegerType()),
    StructField("end", IntegerType()), StructField("score", DoubleType()),
])
SPANS = ArrayType(SPAN)


def in_order(found: list[tuple[str, int, int, float]], kinds: tuple[str, ...]) -> list[dict]:
    """Spans by start, then by the place of their kind in ``kinds``."""
    place = {k: i for i, k in enumerate(kinds)}
    ordered = sorted(found, key=lambda s: (s[1], place[s[0]], s[2]))
    return [{"kind": k, "start": a, "end": b, "score": s} for k, a, b, s in ordered]


def free_of(taken: list[tuple[str, int, int, float]], start: int, end: int) -> bool:
    return all(end <= a or b <= start for _, a, b, _ in taken)


def of_kinds(spans: Column, kinds: tuple[str, ...]) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*kinds))


def count_of(spans: Column, kind: str) -> Column:
    return F.size(of_kinds(spans, (kind,))).cast("long")


def as_text(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
