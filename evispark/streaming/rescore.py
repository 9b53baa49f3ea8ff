"""A stream of fact changes that keeps scores up to date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from evispark.operators.score import rescore

EVENT_SCHEMA = "fact_id string, subject_id string, old_confidence double, new_confidence double, created_at timestamp"


def needs_rescoring(least: float = 0.05) -> Column:
    """Whether a change is large enough; a new fact changes from 0."""
    return F.abs(F.coalesce("new_confidence", F.lit(0.0)) - F.coalesce("old_confidence", F.lit(0.0))) > least + 1e-12


def changed_subjects(events: DataFrame, least: float = 0.05) -> DataFrame:
    """(gene_id) of the events that need rescoring; works on a stream or a table."""
    return events.where(needs_rescoring(least)).select(F.col("subject_id").alias("gene_id"))


def start(events: DataFrame, facts_path: str, out_path: str, checkpoint: str, least: float = 0.05, available_now: bool = True) -> StreamingQuery:
    """For each batch of a stream of events, the scores of the changed subjects from the fact table as it is then, as out_path/batch=<n>.

    A batch that is run again after a failure writes its folder anew, so each batch counts once.
    """

    def batch(df: DataFrame, number: int) -> None:
        facts = df.sparkSession.read.parquet(facts_path)
        rescore(facts, changed_subjects(df, least)).write.mode("overwrite").parquet(f"{out_path}/batch={number}")

    writer = events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")).start()


def spend_windows(calls: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """O20 as a stream: calls and cost of each model in sliding hours; rows later than the delay are left out."""
    return calls.withWatermark("created_at", delay).groupBy(F.window("created_at", "1 hour", "5 minutes"), "model").agg(F.count("*").alias("n_calls"), F.sum("cost").alias("cost"))
