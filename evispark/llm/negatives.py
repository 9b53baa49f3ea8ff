"""Hard-negative mining with Kronecker-packed products.

The components of all candidates of a batch, biased so that none is negative, are packed into one wide
integer for each dimension, a field for each candidate, wide enough for a whole score. One
multiplication for each component of an anchor and their sum then hold the scores of all candidates,
which are unpacked and freed from the biases: exact integer inner products.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from operator import mul

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evispark.llm.vectors import MOST, Best, best_rows, held, id_array, largest, query_blocks, usable, whole_numbers

#: Bytes of a field that numpy unpacks by itself.
PLAIN = {4: "<u4", 8: "<u8"}


@dataclass(frozen=True)
class Packed:
    """Candidates' components in fields of one integer for each dimension: c + bias, width bytes apart."""

    dims: list[int]
    rows: int
    width: int
    bias: int
    sums: np.ndarray


def pack(rows: np.ndarray, anchors: np.ndarray) -> Packed:
    """Packs rows for products with any of the anchors: a field holds dims times the largest biased product."""
    size = min(rows.shape[1], anchors.shape[1])
    rows, anchors = rows[:, :size], anchors[:, :size]
    # Twice the largest component bounds a biased one; the spare factor also bounds what unpacking subtracts.
    bits = (16 * max(1, size) * max(1, largest(rows)) * max(1, largest(anchors))).bit_length()
    width = next((w for w in PLAIN if bits < 8 * w), -(-bits // 8))
    bias = max(0, -int(rows.min())) if rows.size else 0
    if width in PLAIN:
        fields = np.ascontiguousarray((rows + bias).T.astype(PLAIN[width]))
        dims = [int.from_bytes(d.tobytes(), "little") for d in fields]
        return Packed(dims, len(rows), width, bias, rows.sum(1))
    dims = [int.from_bytes(b"".join((int(x) + bias).to_bytes(width, "little") for x in d), "little") for d in rows.T]
    return Packed(dims, len(rows), width, bias, rows.astype(object).sum(1))


def packed_scores(packed: Packed, anchor: np.ndarray) -> np.ndarray:
    """Inner products of all packed rows with an anchor, as longs: one multiplication for each of the anchor's components."""
    own = [int(x) for x in anchor[: len(packed.dims)]]
    if not own:
        return np.zeros(packed.rows, np.int64)
    lift = max(0, -min(own))
    total = sum(map(mul, packed.dims, [x + lift for x in own]))
    fields = total.to_bytes(packed.rows * packed.width, "little")
    less = packed.bias * sum(own) + len(own) * lift * packed.bias
    if packed.width in PLAIN:
        return np.frombuffer(fields, PLAIN[packed.width]).astype(np.int64) - lift * packed.sums - less
    exact = [int.from_bytes(fields[i : i + packed.width], "little") for i in range(0, len(fields), packed.width)]
    return held(np.array(exact, object) - lift * packed.sums - less)


@dataclass(frozen=True)
class Anchors:
    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray


def _first(score: np.ndarray, ident: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Of the places at, those of the n highest scores, equal ones by smaller id."""
    if len(at) > n:
        at = at[score[at] >= np.partition(score[at], len(at) - n)[len(at) - n]]
    return at[np.lexsort((ident[at], ~score[at]))[:n]]


def _mined(rows: DataFrame, known, scale: int, pick) -> DataFrame:
    """(group, id, score) of what pick(number of anchor, scores, ids, same label) gives as (group, places) for every anchor and batch; of each task the best of a group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, state, n = known.value
        best = Best(n)
        for batch in batches:
            ids, _ = id_array(batch.column(0))
            labels = batch.column(1).cast(pa.int64()).to_numpy(zero_copy_only=False)
            packed = pack(numbers := whole_numbers(batch.column(2), scale), anchors.vectors)
            if not len(numbers):
                continue
            for a in range(len(anchors.ids)):
                score = packed_scores(packed, anchors.vectors[a])
                for group, at in pick(state, a, score, ids, labels == anchors.labels[a], ids == anchors.ids[a], n):
                    best.add(np.full(len(at), group), score[at], ids[at])
        group, score, ident = best.cut()
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (group, ident, score)], ["group", "id", "score"])

    return rows.mapInArrow(run, "group long, id long, score long")


def _positives(state, a, score, ids, same, own, n):
    yield a, _first(score, ids, np.flatnonzero(same & ~own), n)


def _negatives(state, a, score, ids, same, own, n):
    """For each positive of the anchor, other labels' rows from 80 % of its score to all of it. state: (first positive of each anchor, all positives' scores, 80 % of them)."""
    starts, most, least = state
    groups = np.arange(starts[a], starts[a + 1])
    if not len(groups):
        return
    near = np.flatnonzero(~same & (score >= least[groups].min()) & (score <= most[groups].max()))
    if len(near):
        for g in groups:
            yield g, _first(score, ids, near[(score[near] >= least[g]) & (score[near] <= most[g])], n)


def hard_negatives(rows: DataFrame, anchors: Column, scale: int, positives: int = 5, negatives: int = 5, id_col: str = "vec_id", label: str | Column = "label", vector: str = "embedding") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows for which anchors is true.

    An anchor's positives are its best other rows of the same integer label; a positive's negatives are
    the anchor's best rows of other labels whose score is at most the positive's and at least 80 % of it.
    Components count as floor(scale * x). Equal scores go by smaller id, null ids last (returned as null).
    Rows with a null label or vector, or a component that is null or not finite, take no part; of vectors
    of unequal length the shorter one ends in zeros; scores beyond 64 bits count as the nearest long.
    Rows of the anchor's own id are none of its positives. Equal anchor rows count once, an anchor
    without id is none; other repeated rows count each. Empty tables give no rows; other columns are ignored.
    """
    of = F.col(label) if isinstance(label, str) else label
    kept = usable(rows, vector).withColumn("_label", of.cast("long")).where("_label IS NOT NULL")
    own = kept.select(F.col(id_col).cast("long").alias("vec_id"), F.col("_label").alias("label"), F.col(vector).alias("v"))
    asked = kept.where(anchors & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), F.col("_label").alias("label"), F.col(vector).alias("v"))
    found = [_of_block(own, table, scale, positives, negatives) for table in query_blocks(asked, 64 * positives * negatives, "v", "anchors") if table.num_rows]
    return reduce(DataFrame.union, found) if found else own.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")


def _of_block(rows: DataFrame, table: pa.Table, scale: int, positives: int, negatives: int) -> DataFrame:
    """Two passes over all rows for a block of anchors; between them their few positives are known to the driver."""
    spark = rows.sparkSession
    block = Anchors(table.column("vec_id").to_numpy(), table.column("label").to_numpy(), whole_numbers(table.column("v").combine_chunks(), scale))
    order = [F.desc("score"), F.asc("id")]
    near = best_rows(_mined(rows, spark.sparkContext.broadcast((block, None, positives)), scale, _positives), ["group"], order, positives).toPandas().sort_values(["group", "rank"])
    a, score = near["group"].to_numpy(np.int64), near["score"].to_numpy(np.int64)
    # 80 p <= 100 n exactly where n >= p - floor(p / 5).
    state = (np.searchsorted(a, np.arange(len(block.ids) + 1)), score, score - score // 5)
    far = best_rows(_mined(rows, spark.sparkContext.broadcast((block, state, negatives)), scale, _negatives), ["group"], order, negatives)
    names = pa.table({"group": np.arange(len(a)), "anchor_id": block.ids[a], "positive_id": near["id"].to_numpy(np.int64), "positive_score": score}).to_pandas()
    known = spark.createDataFrame(names, "group long, anchor_id long, positive_id long, positive_score long")
    real = lambda c: F.nullif(F.col(c), F.lit(MOST)).alias(c)
    out = far.join(F.broadcast(known), "group").withColumnRenamed("id", "negative_id").withColumnRenamed("score", "negative_score")
    return out.select("anchor_id", real("positive_id"), "rank", real("negative_id"), "positive_score", "negative_score")
