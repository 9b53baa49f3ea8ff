"""Streams whose results need state: averages in order of time (O15), calls of the trailing hour (O20), first chunks.

Rows may come out of order, up to the delay of the watermark. What a later row could still change is kept
as rows; what none can is folded away. Every batch gives the results as they are with all rows so far, so
a result replaces an earlier one of its key: append_batches() writes them and latest() reads the last.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import IntegerType, StructField, StructType

from evispark.operators.ops import estimate_confidence, estimate_ratios
from evispark.operators.text import chunk_fingerprint

HOUR = 3_600_000_000


def estimate_factors_stream(estimates: DataFrame, delay: str, alpha: float = 0.1, least: int = 5) -> DataFrame:
    """O15 on a stream of estimates: (category, n, cost_factor, time_factor, cost_error, time_error, confidence) in update mode.

    Averages move in order of created_at and id, as in the batch form, though rows come in any order within the delay.
    """

    def move(now: tuple, c: np.ndarray, t: np.ndarray) -> tuple:
        n, *averages = now
        for x, y in zip(c.tolist(), t.tolist()):
            averages = [a * (1 - alpha) + alpha * b for a, b in zip(averages, (x, y, abs(x - 1), abs(y - 1)))]
        return (n + len(c), *averages)

    def fold(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        names = ["at", "id", "c", "t"]
        *done, at, ids, c, t = state.get if state.exists else (0, 1.0, 1.0, 0.0, 0.0, [], [], [], [])
        rows = pd.DataFrame({"at": np.array(at, np.int64), "id": np.array(ids, np.int64), "c": np.array(c, float), "t": np.array(t, float)})
        rows = pd.concat([rows, *(p[names] for p in pdfs)], ignore_index=True).sort_values(["at", "id"], kind="stable", ignore_index=True)
        mark = state.getCurrentWatermarkMs() * 1000
        settled = rows["at"] <= mark
        done = move(tuple(done), rows["c"][settled].to_numpy(), rows["t"][settled].to_numpy())
        rest = rows[~settled]
        state.update((*done, *(rest[n].tolist() for n in names)))
        if len(rest):
            state.setTimeoutTimestamp(int(rest["at"].max()) // 1000 + 1)
        yield pd.DataFrame([(key[0], *move(done, rest["c"].to_numpy(), rest["t"].to_numpy()))], columns=["category", "n", "cost_factor", "time_factor", "cost_error", "time_error"])

    timed = estimates.withColumn("created_at", F.col("created_at").cast("timestamp")).withWatermark("created_at", delay)
    own = estimate_ratios(timed).select("created_at", "category", F.unix_micros("created_at").alias("at"), F.col("id").cast("long").alias("id"), "c", "t")
    numbers = "n long, cost_factor double, time_factor double, cost_error double, time_error double"
    out = own.groupBy("category").applyInPandasWithState(fold, f"category string, {numbers}", f"{numbers}, at array<long>, id array<long>, c array<double>, t array<double>", "update", GroupStateTimeout.EventTimeTimeout)
    return estimate_confidence(out, least)


def calls_in_hour_stream(calls: DataFrame, delay: str, by: str = "model") -> DataFrame:
    """O20 on a stream of calls (id, created_at): (model, id, n_last_hour), a call again when earlier ones have come late, in update mode.

    A task has one hour of the clock of a model: its state is the calls of that hour and of the one before, until the watermark has passed the hour.
    """

    def count(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at, ids, told = state.get if state.exists else ([], [], [])
        old = pd.DataFrame({"at": np.array(at, np.int64), "id": np.array(ids, np.int64), "told": np.array(told, np.int64)})
        rows = pd.concat([old, *(p[["at", "id"]].assign(told=0) for p in pdfs)], ignore_index=True).sort_values(["at", "id"], kind="stable", ignore_index=True)
        mark, times, start = state.getCurrentWatermarkMs() * 1000, rows["at"].to_numpy(), int(key[1]) * HOUR
        n = np.searchsorted(times, times, "right") - np.searchsorted(times, times - HOUR, "left")
        # Calls of the hour before are counted here and told by the task of their own hour.
        fresh = (times >= start) & (times > mark) & (n != rows["told"].to_numpy())
        rows["told"] = np.where(fresh, n, rows["told"])
        kept = rows[times > mark - HOUR]
        if len(kept) and start + HOUR > mark:
            state.update((kept["at"].tolist(), kept["id"].tolist(), kept["told"].tolist()))
            state.setTimeoutTimestamp((start + HOUR) // 1000 + 1)
        elif state.exists:
            state.remove()
        yield pd.DataFrame({by: key[0], "id": rows["id"][fresh], "n_last_hour": n[fresh]})

    timed = calls.withColumn("created_at", F.col("created_at").cast("timestamp")).withWatermark("created_at", delay)
    own = timed.select("created_at", by, F.unix_micros("created_at").alias("at"), F.col("id").cast("long").alias("id")).where("at IS NOT NULL")
    hour = F.expr(f"CAST(floor(at / {HOUR}) AS BIGINT)")
    dealt = own.withColumn("hour", F.explode(F.array(hour, hour + 1)))
    return dealt.groupBy(by, "hour").applyInPandasWithState(count, f"{by} string, id long, n_last_hour long", "at array<long>, id array<long>, told array<long>", "update", GroupStateTimeout.EventTimeTimeout)


def first_chunks_stream(chunks: DataFrame, scope: str, time: str, delay: str) -> DataFrame:
    """T10 on a stream: chunks whose fingerprint did not come before in the scope (off, paper or global), within the delay of the watermark over time."""
    if scope == "off":
        return chunks
    keyed = chunks.withColumns({"_key": chunk_fingerprint(F.col("content")), time: F.col(time).cast("timestamp")}).withWatermark(time, delay)
    return keyed.dropDuplicatesWithinWatermark([*(["paper_id"] if scope == "paper" else []), "_key"]).drop("_key")


def append_batches(stream: DataFrame, path: str, checkpoint: str, mode: str = "update", available_now: bool = True) -> StreamingQuery:
    """Writes each batch as path/batch=<n>; one that is run again after a failure writes its folder anew."""

    def batch(df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = stream.writeStream.foreachBatch(batch).outputMode(mode).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")).start()


def latest(spark: SparkSession, path: str, like: DataFrame, keys: list[str]) -> DataFrame:
    """The last result of each key that append_batches() wrote; like has the columns."""
    rows = spark.read.schema(StructType([*like.schema.fields, StructField("batch", IntegerType())])).parquet(path)
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*like.columns), "batch").alias("row")).select("row.*")
