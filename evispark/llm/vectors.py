"""Vectors of whole numbers in Arrow batches, blocks of query vectors, and the best rows of many groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evispark.shared import materialize

#: Scores are longs; one beyond counts as the nearest of these.
LEAST, MOST = -(1 << 63), (1 << 63) - 1
#: Bytes of queries, with what a task keeps of each, that are sent to all tasks at once.
BLOCK_BYTES = 16 << 20
#: Products that are held at once, in rows times queries.
CELLS = 1 << 20


def usable(rows: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector is not null and holds neither a null nor a component that is not finite."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return rows.where(F.col(vector).isNotNull() & ~odd)


def whole_numbers(column: pa.Array, scale: int) -> np.ndarray:
    """floor(scale * x) of all components, a row for each vector; shorter ones end in zeros. Python's integers where 62 bits don't hold them."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = np.floor(scale * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    width = int(sizes.max(initial=0))
    if len(sizes) * width == len(flat):
        out = flat.reshape(len(sizes), width)
    else:
        out = np.zeros((len(sizes), width))
        out[np.arange(width) < sizes[:, None]] = flat
    if np.isfinite(out).all() and np.abs(out).max(initial=0) < 1 << 62:
        return out.astype(np.int64)
    # Finite components overflow a double only when they are scaled.
    exact = [[int(x) * scale if abs(x) >= 1 << 60 else int(np.floor(scale * x)) for x in v] + [0] * (width - len(v)) for v in column.to_pylist()]
    return np.array(exact, object).reshape(out.shape)


def largest(numbers: np.ndarray) -> int:
    return max(int(numbers.max()), -int(numbers.min())) if numbers.size else 0


def held(scores: np.ndarray) -> np.ndarray:
    """Python's integers as longs."""
    return np.array([min(max(int(x), LEAST), MOST) for x in scores.ravel()], np.int64).reshape(scores.shape)


def query_blocks(queries: DataFrame, bytes_each: int, vector: str, name: str, most_bytes: int = BLOCK_BYTES) -> Iterator[pa.Table]:
    """Distinct queries in blocks of about most_bytes, by their measured size and bytes_each for what goes with each."""
    own = materialize(queries.distinct(), name)
    size = own.agg(F.sum(8 * F.size(vector) + bytes_each)).first()[0] or 0
    n = 1 + size // most_bytes
    for i in range(n):
        yield (own if n == 1 else own.where(F.pmod(F.xxhash64(*own.columns), F.lit(n)) == i)).toArrow()


def id_array(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids as longs, null as the greatest one, and which are not null."""
    return column.cast(pa.int64()).fill_null(MOST).to_numpy(zero_copy_only=False), column.is_valid().to_numpy(zero_copy_only=False)


class Best:
    """The k best (score, id) of each group that a task has seen: higher scores first, then smaller ids."""

    def __init__(self, k: int, limit: int = 1 << 18) -> None:
        self.k, self.limit, self.n = k, limit, 0
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, group: np.ndarray, score: np.ndarray, ident: np.ndarray) -> bool:
        """True if the rows were cut to the best ones."""
        self.parts.append((group, score, ident))
        self.n += len(group)
        if self.n <= self.limit:
            return False
        self.cut()
        self.limit = max(self.limit, 2 * self.n)
        return True

    def cut(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        group, score, ident = (np.concatenate(x) for x in zip(*self.parts, strict=True)) if self.parts else (np.zeros(0, np.int64),) * 3
        # ~score falls as score rises, without overflow.
        order = np.lexsort((ident, ~score, group))
        group, score, ident = group[order], score[order], ident[order]
        starts = np.flatnonzero(np.diff(group, prepend=group[:1] - 1)) if len(group) else group
        place = np.arange(len(group)) - np.repeat(starts, np.diff(np.append(starts, len(group))))
        kept = place < self.k
        self.parts, self.n = [(group[kept], score[kept], ident[kept])], int(kept.sum())
        return self.parts[0]

    def floors(self, groups: int) -> np.ndarray:
        """Each group's kth score, below which no row can be among the best; the least long where there are fewer."""
        group, score, _ = self.cut()
        out = np.full(groups, LEAST, np.int64)
        if len(group):
            last = np.flatnonzero(np.append(np.diff(group) != 0, True))
            full = np.bincount(group, minlength=groups)[group[last]] == self.k
            out[group[last[full]]] = score[last[full]]
        return out


def best_rows(rows: DataFrame, by: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group with their rank from 1. Slices of a group are cut first, so that no task gets what all tasks have sent."""
    slices = rows.withColumn("_slice", F.spark_partition_id() % 64)
    place = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    cut = slices.withColumn(rank, place(*by, "_slice")).where(F.col(rank) <= k).drop("_slice", rank)
    return cut.withColumn(rank, place(*by)).where(F.col(rank) <= k)
