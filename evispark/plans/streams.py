"""Queries that run as streams over files: slices of a table land one after the other, not quite in order of time."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evispark.plans import adapters as A
from evispark.plans import operations, scoring
from evispark.plans import texts as Q
from evispark.shared import materialize, work_dir
from evispark.streaming import rescore, stateful

R = 6
#: Slices of a table, files of a slice (a batch reads one slice), and by how much rows are late at most.
SLICES, FILES, LATE = 3, 2, 1800


def landed(s: SparkSession, df: DataFrame, time: str) -> tuple[DataFrame, str]:
    """df as a stream and a folder for what becomes of it. Rows are dealt to slices by a time that is up to LATE seconds off."""
    folder = f"{work_dir(s)}/stream-{uuid.uuid4().hex}"
    when = F.unix_seconds(F.col(time).cast("timestamp")) + F.pmod(F.xxhash64(*df.columns), F.lit(LATE))
    own = materialize(df.withColumn("_when", when), "arrivals")
    low, high = own.agg(F.coalesce(F.min("_when"), F.lit(0)), F.coalesce(F.max("_when"), F.lit(0))).first()
    slice_ = F.floor((F.col("_when") - low) * SLICES / (high - low + 1))
    for i in range(SLICES):
        own.where(slice_ == i).drop("_when").repartition(FILES).write.mode("append").parquet(f"{folder}/in")
    return s.readStream.schema(df.schema).option("maxFilesPerTrigger", FILES).parquet(f"{folder}/in"), folder


def streamed(s: SparkSession, df: DataFrame, time: str, work: Callable[[DataFrame], DataFrame], mode: str = "update", keys: tuple[str, ...] = ()) -> DataFrame:
    """What work makes of df as a stream, when all that has landed is read: the last result of each key, or all rows."""
    rows, folder = landed(s, df, time)
    out = work(rows)
    stateful.append_batches(out, f"{folder}/out", f"{folder}/checkpoint", mode).awaitTermination()
    if keys:
        return stateful.latest(s, f"{folder}/out", out, list(keys))
    return s.read.schema(out.schema).parquet(f"{folder}/out")


def _factors(s, d):
    return streamed(s, A.estimates(s, d), "created_at", lambda rows: stateful.estimate_factors_stream(rows, "1 hour"), keys=("category",))


def _calls(s, d):
    return streamed(s, A.calls(s, d).select("id", "model", "created_at"), "created_at", lambda rows: stateful.calls_in_hour_stream(rows, "1 hour"), keys=("id",))


def _first(scope):
    def query(s, d):
        rows = Q._docs(s, d).select(F.col("source").alias("paper_id"), F.col("text").alias("content"), F.timestamp_seconds(F.lit(1577836800) + F.col("doc_id")).alias("loaded_at"))
        return streamed(s, rows, "loaded_at", lambda r: stateful.first_chunks_stream(r, scope, "loaded_at", "3650 days"), "append").select(*(["paper_id"] if scope == "paper" else []), F.sha2(F.substring(F.col("content").cast("binary"), 1, 512), 256).alias("fingerprint"))

    return query


def _rescored(s, d):
    """Genes of which a fact changed: their scores as the last batch that touched them left them."""
    events, folder = landed(s, operations._events(s, d), "created_at")
    A.kg_facts(s, d).write.parquet(f"{folder}/facts")
    out = rescore.start(events, f"{folder}/facts", f"{folder}/out", f"{folder}/checkpoint")
    out.awaitTermination()
    return stateful.latest(s, f"{folder}/out", rescore.rescore(s.read.parquet(f"{folder}/facts").limit(0), s.createDataFrame([], "gene_id string")), ["gene_id"])


QUERIES = {
    "o15_factors_stream": lambda s, d: operations._round(_factors(s, d), "cost_factor", "time_factor", "cost_error", "time_error", "confidence"),
    "o20_calls_in_hour_stream": lambda s, d: _calls(s, d).select("id", "n_last_hour"),
    "o17_rescored_stream": lambda s, d: scoring._round(_rescored(s, d), "adjusted_score").select("gene", "total_evidence", "adjusted_score"),
    "t10_first_chunks_stream": _first("global"),
    "t10_first_chunks_of_paper_stream": _first("paper"),
}

_PRINTS = "SELECT DISTINCT {}sha256(CASE WHEN octet_length(encode(text)) <= 512 THEN encode(text) ELSE unhex(to_hex(encode(text))[1:1024]) END) AS fingerprint FROM documents"

ORACLE = {
    "o15_factors_stream": operations.ORACLE["o15_factors"],
    "o20_calls_in_hour_stream": operations.ORACLE["o20_calls_in_hour"],
    "o17_rescored_stream": f"WITH {scoring._EVIDENCE_SCORE} SELECT gene, total_evidence, round(adjusted_score, 6) AS adjusted_score FROM scored WHERE gene IN (SELECT concat('G', user_id) FROM events WHERE abs(user_id % 20 - event_id % 20) > 1)",
    "t10_first_chunks_stream": _PRINTS.format(""),
    "t10_first_chunks_of_paper_stream": _PRINTS.format("source AS paper_id, "),
}
