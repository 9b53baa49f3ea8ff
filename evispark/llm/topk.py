"""Exact top-k search by distributed histogram selection.

All rows are scored against a block of queries in every round, and no score is kept: a round counts the
scores of each query in the bins of its present range, from the top until the tasks' own k are reached.
The summed counts tell in which bin the kth score lies, and the next round divides that bin. Where more
rows share the kth score than are wanted, the rounds go on over their ids. A last pass then returns the
rows from the located (score, id) on: k for each query, however many rows are equal.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evispark.llm.vectors import CELLS, LEAST, MOST, best_rows, held, id_array, largest, query_blocks, usable, whole_numbers

#: Bins into which a round cuts a range.
BINS = 256


@dataclass(frozen=True)
class Block:
    """Queries and what is known of each one's kth row. Its key lies in [lo, hi], with need rows from there on; exact: lo is the limit.

    The key is the score, or ~id where by_id is set: then the score is equal to score, and better ones are already counted.
    """

    ids: np.ndarray
    vectors: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    need: np.ndarray
    exact: np.ndarray
    by_id: np.ndarray
    score: np.ndarray


def products(rows: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """All inner products as longs; where lengths differ, missing components count as 0."""
    width = min(rows.shape[1], queries.shape[1])
    rows, queries = rows[:, :width], queries[:, :width]
    bound = largest(rows) * largest(queries) * width
    if bound < 1 << 53:  # doubles are exact up to there
        return (rows.astype(np.float64) @ queries.astype(np.float64).T).astype(np.int64)
    if bound <= MOST:
        return rows.astype(np.int64) @ queries.astype(np.int64).T
    return held(rows.astype(object) @ queries.astype(object).T)


def scored(batch: pa.RecordBatch, block: Block, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Pieces of the block of bounded size: (their queries' numbers, ids of rows, scores by row and query, candidates by row and query)."""
    ids, _ = id_array(batch.column(0))
    rows = whole_numbers(batch.column(1), scale)
    step = max(1, CELLS // max(1, len(ids)))
    for start in range(0, len(block.ids), step):
        at = np.arange(start, min(start + step, len(block.ids)))
        yield at, ids, products(rows, block.vectors[at]), ids[:, None] != block.ids[at]


def histograms(rows: DataFrame, block: Block, scale: int) -> DataFrame:
    """(query, need, bin, n): candidates with keys in each bin of the queries' ranges, bins from the highest on until need rows are in one task's."""
    known = rows.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = known.value
        counts = np.zeros((len(b.ids), BINS), np.int64)
        steps = _steps(b)
        for batch in batches:
            for at, ids, scores, other in scored(batch, b, scale):
                at_bins = np.flatnonzero(~b.exact[at])
                if not len(at_bins):
                    continue
                q = at[at_bins]
                own = scores[:, at_bins]
                key = np.where(b.by_id[q], ~ids[:, None], own)
                inside = other[:, at_bins] & (key >= b.lo[q]) & (key <= b.hi[q]) & (~b.by_id[q] | (own == b.score[q]))
                # Unsigned, so that a range of any width has its places.
                place = (key.astype(np.uint64) - b.lo[q].astype(np.uint64)) // steps[q]
                flat = (np.arange(len(q)) * BINS + place.astype(np.int64))[inside]
                counts[q] += np.bincount(flat, minlength=len(q) * BINS).reshape(len(q), BINS)
        better = np.cumsum(counts[:, ::-1], axis=1)[:, ::-1] - counts
        q, places = np.nonzero((counts > 0) & (better < b.need[:, None]))
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (q, b.need[q], places, counts[q, places])], ["query", "need", "bin", "n"])

    found = rows.mapInArrow(run, "query long, need long, bin long, n long")
    return found.groupBy("query", "need", "bin").agg(F.sum("n").alias("n"))


def _steps(b: Block) -> np.ndarray:
    width = b.hi.astype(np.uint64) - b.lo.astype(np.uint64)
    return width // np.uint64(BINS) + np.uint64(1)


def kth_bins(counts: DataFrame) -> DataFrame:
    """(query, bin, better, n): the bin of each query that holds the row wanted last, how many rows are in better ones and in it."""
    from pyspark.sql import Window

    upto = F.sum("n").over(Window.partitionBy("query").orderBy(F.desc("bin")))
    return counts.withColumn("upto", upto).where((F.col("upto") >= F.col("need")) & (F.col("upto") - F.col("n") < F.col("need"))).select("query", "bin", (F.col("upto") - F.col("n")).alias("better"), "n")


def refined(block: Block, found: pa.Table, ids: tuple[int, int]) -> Block:
    """The block after a round. Queries with fewer candidates than wanted are not among those found: all from lo on are theirs."""
    steps = _steps(block)
    q, place, better, n = (found.column(c).to_numpy() for c in ("query", "bin", "better", "n"))
    lo, hi, need, exact, by_id, score = (x.copy() for x in (block.lo, block.hi, block.need, block.exact, block.by_id, block.score))
    open_ = ~block.exact
    exact[open_] = True
    low = block.lo[q].astype(np.uint64) + place.astype(np.uint64) * steps[q]
    high = np.minimum(steps[q] - np.uint64(1), block.hi[q].astype(np.uint64) - low) + low
    lo[q], hi[q], need[q] = low.astype(np.int64), high.astype(np.int64), block.need[q] - better
    exact[q] = n == need[q]
    tied = q[~exact[q] & (lo[q] == hi[q])]
    ends, more = tied[by_id[tied]], tied[~by_id[tied]]
    exact[ends] = True  # rows that repeat an id
    score[more], by_id[more], lo[more], hi[more] = lo[more], True, ~ids[1], ~ids[0]
    return replace(block, lo=lo, hi=hi, need=need, exact=exact, by_id=by_id, score=score)


def selected(rows: DataFrame, block: Block, k: int, scale: int) -> DataFrame:
    """(query_id, rank, vec_id, score): the candidates from each query's located limit on, ranked."""
    known = rows.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = known.value
        least = np.where(b.by_id, b.score, b.lo)
        last = np.where(b.by_id, ~b.lo, MOST)
        for batch in batches:
            for at, ids, scores, other in scored(batch, b, scale):
                r, q = np.nonzero(other & ((scores > least[at]) | ((scores == least[at]) & (ids[:, None] <= last[at]))))
                vec_id = batch.column(0).cast(pa.int64()).take(pa.array(r))
                yield pa.RecordBatch.from_arrays([pa.array(at[q], pa.int64()), pa.array(b.ids[at[q]]), vec_id, pa.array(scores[r, q])], ["query", "query_id", "vec_id", "score"])

    found = rows.mapInArrow(run, "query long, query_id long, vec_id long, score long")
    return best_rows(found, ["query"], [F.desc("score"), F.asc_nulls_last("vec_id")], k).select("query_id", "rank", "vec_id", "score")


def top_k(rows: DataFrame, queries: DataFrame, k: int, scale: int, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of highest inner product for each query, among all rows of another id.

    Components count as floor(scale * x). Equal scores go by smaller id, null ids last. Vectors that are
    null, or hold a null or a component that is not finite, take no part; of vectors of unequal length the
    shorter one ends in zeros, an empty one scores 0; a score beyond 64 bits counts as the nearest long.
    A query without id is none. Equal query rows ask once; rows that repeat an id with another vector
    ask for themselves; repeated candidates count each. Empty tables give no rows; other columns are ignored.
    """
    own = usable(rows, vector).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector).alias("v"))
    asked = usable(queries, vector).where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("query_id"), F.col(vector).alias("v"))
    size = F.aggregate("v", F.lit(0.0), lambda most, x: F.greatest(most, F.abs(x.cast("double"))))
    top, low, high = own.agg(F.max(size), F.min("vec_id"), F.max(F.coalesce("vec_id", F.lit(MOST)))).first()
    answers = [_answered(own, table, k, scale, top or 0.0, (low or 0, high or 0)) for table in query_blocks(asked, 8 * BINS, "v", "queries") if table.num_rows]
    return reduce(DataFrame.union, answers) if answers else own.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")


def _answered(rows: DataFrame, queries: pa.Table, k: int, scale: int, top: float, ids: tuple[int, int]) -> DataFrame:
    vectors = whole_numbers(queries.column("v").combine_chunks(), scale)
    # No component of a row exceeds the largest one, so no score the sum of a query's components times it.
    bounds = [min(MOST, int(sum(abs(int(x)) for x in v)) * (int(top) * scale + scale + 1)) for v in vectors]
    n, hi = len(bounds), np.array(bounds, np.int64)
    block = Block(queries.column("query_id").to_numpy(), vectors, -hi, hi, np.full(n, k), np.zeros(n, bool), np.zeros(n, bool), np.full(n, LEAST))
    block = replace(block, lo=np.where(hi == MOST, LEAST, -hi))
    while not block.exact.all():
        block = refined(block, kth_bins(histograms(rows, block, scale)).toArrow(), ids)
    return selected(rows, block, k, scale)
