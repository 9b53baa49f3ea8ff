"""Streams over files that land one after the other, also after a restart, against the batch forms."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from evispark.operators import ops, text
from evispark.streaming import stateful

START = datetime(2024, 1, 1)


def rows_of(seed, n, late):
    """(id, seconds, number, key) in the order in which they arrive, up to late seconds out of order; times repeat."""
    r = random.Random(seed)
    own = [(i, r.randrange(20_000), r.randrange(1, 50), r.choice(["a", "a", "a", "b", "c"])) for i in range(n)]
    return sorted(own, key=lambda x: x[1] + r.randrange(late))


def run_in_parts(spark, tmp_path, rows, make, work, parts=5, mode="update"):
    """The stream stops after three parts have landed, and a new one goes on from the checkpoint."""
    folder, size = str(tmp_path), -(-len(rows) // parts)
    out = None
    for part in range(parts):
        make(rows[part * size : (part + 1) * size]).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        if part in (2, parts - 1):
            stream = spark.readStream.schema(make(rows[:1]).schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
            out = work(stream)
            stateful.append_batches(out, f"{folder}/out", f"{folder}/checkpoint", mode).awaitTermination(120)
    return out, f"{folder}/out"


@pytest.mark.parametrize("delay", ["1 hour", "30 minutes"])
def test_factors(spark, tmp_path, delay):
    rows = rows_of(1, 300, 1200)

    def make(part):
        return spark.createDataFrame([(i, k, float(n), n * 1.5 if i % 7 else None, n, n + i % 5, START + timedelta(seconds=s)) for i, s, n, k in part], "id long, category string, estimated_cost double, actual_cost double, estimated_time_secs int, actual_time_secs int, created_at timestamp")

    out, path = run_in_parts(spark, tmp_path, rows, make, lambda s: stateful.estimate_factors_stream(s, delay))
    got = {x["category"]: x.asDict() for x in stateful.latest(spark, path, out, ["category"]).collect()}
    want = {x["category"]: x.asDict() for x in ops.estimate_factors(make(rows)).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_calls_of_the_trailing_hour(spark, tmp_path):
    rows = rows_of(2, 400, 1500)

    def make(part):
        return spark.createDataFrame([(i, k, START + timedelta(seconds=s)) for i, s, _, k in part], "id long, model string, created_at timestamp")

    out, path = run_in_parts(spark, tmp_path, rows, make, lambda s: stateful.calls_in_hour_stream(s, "30 minutes"))
    got = {x["id"]: x["n_last_hour"] for x in stateful.latest(spark, path, out, ["id"]).collect()}
    assert got == {x["id"]: x["n_last_hour"] for x in ops.calls_in_hour(make(rows)).collect()} and len(got) == 400


def test_a_task_has_two_hours_of_calls(spark, tmp_path):
    """A model's calls of 10 hours: no state holds more than those of an hour and the one before."""
    def make(part):
        return spark.createDataFrame([(i, "a", START + timedelta(seconds=s)) for i, s in part], "id long, model string, created_at timestamp")

    rows = [(i, i * 36) for i in range(1000)]
    out, path = run_in_parts(spark, tmp_path, rows, make, lambda s: stateful.calls_in_hour_stream(s, "30 minutes"))
    got = {x["id"]: x["n_last_hour"] for x in stateful.latest(spark, path, out, ["id"]).collect()}
    assert got == {i: min(i, 100) + 1 for i in range(1000)}
    held = spark.read.format("statestore").load(f"{tmp_path}/checkpoint").select(F.size("value.groupState.at").alias("n")).collect()
    assert held and max(x["n"] for x in held) <= 200


@pytest.mark.parametrize("scope", ["off", "paper", "global"])
def test_first_chunks(spark, tmp_path, scope):
    r = random.Random(3)
    texts = [str(r.randrange(30)) * 600 + str(i % 3) for i in range(120)] + ["", "x", "x", "é" * 300, "é" * 256 + "z"]
    rows = list(enumerate(texts))

    def make(part):
        return spark.createDataFrame([(i, i % 2, i, t, START + timedelta(seconds=i)) for i, t in part], "id int, paper_id int, chunk_index int, content string, loaded_at timestamp")

    out, path = run_in_parts(spark, tmp_path, rows, make, lambda s: stateful.first_chunks_stream(s, scope, "loaded_at", "1 hour"), 5, "append")
    kept = spark.read.schema(out.schema).parquet(path).drop("batch")
    want = text.first_chunks(make(rows), scope, ("chunk_index",))
    keys = ["paper_id", "print"] if scope == "paper" else ["print"]
    prints = lambda df: sorted(tuple(x) for x in df.select("paper_id", text.chunk_fingerprint(F.col("content")).alias("print")).select(*keys).collect())
    assert prints(kept) == prints(want) and kept.columns == want.columns
