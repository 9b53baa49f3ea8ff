"""Spans found in texts: (kind, start, end, score) in code points, end exclusive."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Span = tuple[str, int, int, float]


def in_order(spans: Iterable[Span], kinds: list[str]) -> list[Span]:
    """By start, then by kind in the order of kinds."""
    rank = {k: i for i, k in enumerate(kinds)}
    return sorted(spans, key=lambda s: (s[1], rank[s[0]], s[2]))


def replaced(text: str, spans: Iterable[Span]) -> str:
    """text with each span as its kind in brackets; overlapping spans become one, named by the first."""
    out, at = [], 0
    for kind, start, end, _ in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def digest_columns(found: DataFrame, id_col: str, kinds: list[str]) -> DataFrame:
    """id, n_<kind> for the base kinds, base_sha256 of the base spans and all spans written out, from a column found."""

    def of(names: list[str]) -> Column:
        return F.filter("found", lambda s: s["kind"].isin(names))

    def text(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    counts = [F.size(of([k])).cast("long").alias(f"n_{k}") for k in kinds]
    return found.select(id_col, *counts, F.sha2(text(of(kinds)).cast("binary"), 256).alias("base_sha256"), text(F.col("found")).alias("spans"))
