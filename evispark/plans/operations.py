"""Queries over logs, usage and files (O)."""

from __future__ import annotations

from pyspark.sql import functions as F

from evispark.operators import ops as O
from evispark.plans import adapters as A
from evispark.streaming import rescore

R = 6


def _round(df, *columns, n=R):
    return df.withColumns({c: F.round(c, n) for c in columns})


def _cycles(s, d):
    e = A.table(s, d, "events")
    own = e.groupBy((F.col("user_id") % 20).alias("run_id"), F.dayofmonth("ts").alias("cycle")).agg(F.count("*").alias("found"), F.count_if(F.col("event_type") == "purchase").alias("inserted"), F.count_if(F.col("event_type") == "view").alias("duplicate"), F.count_if(F.col("event_type") == "click").alias("chunks"), F.count_if(F.col("event_type") == "signup").alias("typed"))
    return own.withColumn("score_gain", F.col("typed") / F.col("found"))


def _latest(s, d):
    return _cycles(s, d).groupBy("run_id").agg(F.sum("found").alias("n_results"), (F.sum("inserted") / F.sum("found")).alias("novelty_ratio"), (F.sum("duplicate") / F.sum("found")).alias("duplicate_pressure"), F.sum("chunks").alias("evidence_gain"), F.lit(40).alias("max_results"))


def _runlog(s, d):
    e = A.table(s, d, "events")
    i = F.col("event_id")
    return e.select(F.col("ts").alias("recorded_at"), i.cast("string").alias("query"), F.round(F.col("value") * 100).cast("long").alias("duration_ms"), (i % 9).alias("inserted"), (i % 30).alias("chunks"), (i % 5).alias("cache_hits"), (i % 3).alias("cache_misses"), (i % 7 == 0).alias("flagged"))


def _events(s, d):
    e = A.table(s, d, "events")
    return e.select(F.col("event_id").cast("string").alias("fact_id"), F.concat(F.lit("G"), "user_id").alias("subject_id"), (F.col("event_id") % 20 / 20).alias("old_confidence"), (F.col("user_id") % 20 / 20).alias("new_confidence"), F.col("ts").alias("created_at"))


def _rates(s, d):
    return A.table(s, d, "events").select(F.col("event_type").alias("model")).distinct().select("model", (F.length("model") / 1000).cast("decimal(38,18)").alias("input_rate"), (F.length("model") / 500).cast("decimal(38,18)").alias("output_rate"))


def _snapshots(s, d, m):
    return A.table(s, d, "orders").where(f"o_orderkey % {m} = 0").select(F.col("o_orderkey").cast("string").alias("snapshot_id"))


QUERIES = {
    "o01_run_summary": lambda s, d: _round(O.run_summary(_runlog(s, d)), "mean_duration_ms", "papers_per_minute", "chunks_per_minute", "cache_hit_rate"),
    "o02_latest_runs": lambda s, d: O.latest_runs(A.runs(s, d), 3).select("provider", "finished_at", "n"),
    "o03_refresh_decisions": lambda s, d: _round(O.refresh_decisions(A.runs(s, d), A.runs(s, d), A.AS_OF), "error_rate"),
    "o04_refresh_report": lambda s, d: O.refresh_report(A.table(s, d, "events").select((F.col("user_id") % 10).alias("provider"), F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "view", "skipped").otherwise("success").alias("outcome"))),
    "o05_source_telemetry": lambda s, d: O.source_telemetry(A.table(s, d, "documents").select("source", F.md5("text").alias("identity_key"), F.when(F.col("doc_id") % 11 == 0, "error").when(F.col("doc_id") % 3 == 0, "duplicate").otherwise("inserted").alias("status"))),
    "o06_cycle_analytics": lambda s, d: _round(O.cycle_analytics(_cycles(s, d)), "novelty_ratio", "evidence_gain", "max_evidence_gain", "pressure_score").select("run_id", "cycle", "novelty_ratio", "evidence_gain", "max_evidence_gain", "stagnating", "streak", "patience", "pressure_score", "pressure_triggered", "stop"),
    "o07_next_step": lambda s, d: O.next_step(_latest(s, d)).join(O.next_budget(_latest(s, d)), "run_id"),
    "o08_quality_summary": lambda s, d: _round(O.quality_summary(A.papers(s, d), A.kg_facts(s, d)), "parse_success_rate", "duplicate_doi_rate", "generic_share"),
    "o10_sync_plan": lambda s, d: O.sync_plan(_snapshots(s, d, 4), _snapshots(s, d, 6)),
    "o11_admit": lambda s, d: O.admit(A.table(s, d, "orders").select(F.col("o_custkey").cast("string").alias("snapshot_id"), F.col("o_orderdate").alias("submitted_at"), (F.col("o_orderstatus") != "F").alias("valid")), _snapshots(s, d, 5)),
    "o12_latency": lambda s, d: _round(O.latency_percentiles(A.actions(s, d), "tool_name", "duration_ms"), "median"),
    "o13_tools": lambda s, d: _round(O.tool_statistics(A.actions(s, d)).withColumn("total_cost", F.col("total_cost").cast("double")), "success_rate", "mean_ms", "total_cost"),
    "o13_errors": lambda s, d: O.error_summary(A.actions(s, d)),
    "o14_accuracy": lambda s, d: _round(O.estimation_accuracy(A.estimates(s, d)), "cost_error", "time_error"),
    "o15_factors": lambda s, d: _round(O.estimate_factors(A.estimates(s, d)), "cost_factor", "time_factor", "cost_error", "time_error", "confidence"),
    "o16_recent_leaks": lambda s, d: O.recent_leaks(A.table(s, d, "events").select(F.col("event_type").alias("name"), "ts"), "2024-01-20 12:00:00").select("name", "n"),
    "o17_changed_subjects": lambda s, d: rescore.changed_subjects(_events(s, d)).groupBy("gene_id").agg(F.count("*").alias("n")),
    "o18_conversations": lambda s, d: O.conversation_summary(A.table(s, d, "conversations")),
    "o19_job_counts": lambda s, d: O.job_counts(A.table(s, d, "orders"), ("o_orderstatus", "o_orderpriority")),
    "o20_daily_spend": lambda s, d: _round(O.daily_spend(O.call_costs(A.calls(s, d), _rates(s, d)), 100.0), "spend", n=9).withColumn("day", F.col("day").cast("string")),
    "o20_calls_in_hour": lambda s, d: O.calls_in_hour(A.calls(s, d)).select("id", "n_last_hour"),
    "o20_tokens": lambda s, d: O.tokens_by_model(A.calls(s, d)),
    "o21_expired": lambda s, d: O.expired(A.path_documents(s, d), "src1", 7, A.AS_OF, ("30", "31")).select("id"),
    "o22_children": lambda s, d: O.list_children(A.path_documents(s, d), "src1/").select("child", "is_directory", "n", "updated_at", F.md5("preview").alias("preview")),
}

_CYCLES = """c0 AS (SELECT user_id % 20 AS run_id, day(ts)::INT AS cycle, count(*) AS found, count(*) FILTER (event_type = 'purchase') AS inserted, count(*) FILTER (event_type = 'view') AS duplicate, count(*) FILTER (event_type = 'click') AS chunks, count(*) FILTER (event_type = 'signup') AS typed FROM events GROUP BY 1, 2),
c1 AS (SELECT *, typed / found AS score_gain, inserted / found AS novelty_ratio, duplicate / found AS duplicate_pressure, inserted + chunks * 0.20::DOUBLE + typed * 0.05::DOUBLE AS evidence_gain FROM c0),
c2 AS (SELECT *, max(score_gain) OVER w AS ms, max(novelty_ratio) OVER w AS mn, max(evidence_gain) OVER w AS max_evidence_gain FROM c1 WINDOW w AS (PARTITION BY run_id ORDER BY cycle)),
c3 AS (SELECT *, cycle > 1 AND score_gain <= ms * 0.15::DOUBLE AND evidence_gain <= max_evidence_gain * 0.20::DOUBLE AND novelty_ratio <= mn * 0.20::DOUBLE AS stagnating, least(greatest(duplicate_pressure * 1.25::DOUBLE - novelty_ratio, 0.0), 1.0) AS pressure_score FROM c2),
c4 AS (SELECT *, sum((NOT stagnating)::INT) OVER (PARTITION BY run_id ORDER BY cycle) AS island FROM c3),
c5 AS (SELECT *, sum(stagnating::INT) OVER (PARTITION BY run_id, island ORDER BY cycle) AS streak, CASE WHEN mn > 0.30 OR max_evidence_gain > 8 THEN 3 ELSE 2 END AS patience FROM c4)"""
_LATEST = f"{_CYCLES}, latest AS (SELECT run_id, sum(found) AS n_results, sum(inserted) / sum(found) AS nr, sum(duplicate) / sum(found) AS dp, sum(chunks) AS eg FROM c0 GROUP BY 1)"

ORACLE = {
    "o01_run_summary": "WITH n AS (SELECT * FROM events ORDER BY ts DESC, event_id::VARCHAR LIMIT 24) SELECT count(*) AS n_runs, round(avg(round(value * 100)), 6) AS mean_duration_ms, round(sum(event_id % 9) / (sum(round(value * 100)) / 60000.0), 6) AS papers_per_minute, round(sum(event_id % 30) / (sum(round(value * 100)) / 60000.0), 6) AS chunks_per_minute, round(sum(event_id % 5) / sum(event_id % 5 + event_id % 3), 6) AS cache_hit_rate, count(*) FILTER (event_id % 7 = 0) AS n_flagged FROM n",
    "o02_latest_runs": f"WITH {A.RUNS}, r AS (SELECT provider, finished_at, row_number() OVER (PARTITION BY provider ORDER BY finished_at DESC)::INT AS n FROM runs) SELECT * FROM r WHERE n <= 3",
    "o03_refresh_decisions": f"WITH {A.RUNS}, r AS (SELECT *, row_number() OVER (PARTITION BY provider ORDER BY finished_at DESC) AS n FROM runs), g AS (SELECT provider, CASE WHEN sum(attempted) > 0 THEN sum(failed) / sum(attempted) WHEN sum(success) > 0 THEN 0 ELSE 1 END AS e, epoch(TIMESTAMP '2024-02-01')::BIGINT - floor(epoch(max(finished_at)))::BIGINT AS el FROM r WHERE n <= 8 GROUP BY 1), i AS (SELECT *, least(greatest(CASE WHEN e >= 0.5 THEN 3600 WHEN e >= 0.25 THEN 1800 WHEN e <= 0.1 THEN 450 ELSE 900 END, 180), 21600)::BIGINT AS v FROM g) SELECT provider, round(e, 6) AS error_rate, v AS interval_secs, el AS elapsed_secs, CASE WHEN el >= 86400 THEN 'stale_force' WHEN el >= v THEN 'due' ELSE 'deferred' END AS decision FROM i",
    "o04_refresh_report": "SELECT user_id % 10 AS provider, count(*) FILTER (event_type <> 'view') AS attempted, count(*) FILTER (event_type NOT IN ('view', 'error')) AS success, count(*) FILTER (event_type = 'error') AS failed, count(*) FILTER (event_type = 'view') AS skipped FROM events GROUP BY 1",
    "o05_source_telemetry": 'SELECT source, count(*) AS fetched, count(*) FILTER (doc_id % 11 = 0) AS errors, count(text) AS raw, count(DISTINCT text) AS "unique", count(*) FILTER (doc_id % 11 <> 0 AND doc_id % 3 <> 0) AS inserted, count(*) FILTER (doc_id % 11 <> 0 AND doc_id % 3 = 0) AS duplicate FROM documents GROUP BY 1',
    "o06_cycle_analytics": f"WITH {_CYCLES} SELECT run_id, cycle, round(novelty_ratio, 6) AS novelty_ratio, round(evidence_gain, 6) AS evidence_gain, round(max_evidence_gain, 6) AS max_evidence_gain, stagnating, streak::BIGINT AS streak, patience, round(pressure_score, 6) AS pressure_score, duplicate_pressure >= 0.65 AND novelty_ratio <= 0.25 AND pressure_score >= 0.3 AS pressure_triggered, streak >= patience AS stop FROM c5",
    "o07_next_step": f"WITH {_LATEST} SELECT run_id, CASE WHEN n_results = 0 THEN 'retrieve' WHEN dp >= 0.65 THEN 'replan' WHEN eg <= 0 AND nr <= 0.05 THEN 'replan' ELSE 'continue' END AS step, least(greatest(round(CASE WHEN nr >= 0.5 THEN 50 WHEN dp >= 0.65 THEN 24 WHEN nr <= 0.15 THEN 32 ELSE 40 END), 10), 200)::INT AS max_results FROM latest",
    "o08_quality_summary": f"WITH {A.PAPERS}, {A.FACTS}, f AS (SELECT count(*) AS n_facts, round(count(*) FILTER (predicate IN ('mentions', 'associated_with')) / count(*), 6) AS generic_share FROM facts) SELECT count(*) AS n_papers, round(count(*) FILTER (parse_status = 'parsed') / count(*), 6) AS parse_success_rate, round((count(doi) - count(DISTINCT lower(trim(doi)))) / count(doi), 6) AS duplicate_doi_rate, any_value(n_facts) AS n_facts, any_value(generic_share) AS generic_share FROM papers, f",
    "o10_sync_plan": "SELECT o_orderkey::VARCHAR AS snapshot_id, 'push' AS action FROM orders WHERE o_orderkey % 4 = 0 AND o_orderkey % 6 <> 0 UNION ALL SELECT o_orderkey::VARCHAR, 'pull' FROM orders WHERE o_orderkey % 6 = 0 AND o_orderkey % 4 <> 0",
    "o11_admit": "SELECT o_custkey::VARCHAR AS snapshot_id, min(o_orderdate) AS submitted_at, 'pending' AS status FROM orders WHERE o_orderstatus <> 'F' AND o_custkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 5 = 0) GROUP BY 1",
    "o12_latency": f"WITH {A.ACTIONS}, r AS (SELECT tool_name, duration_ms AS v, row_number() OVER (PARTITION BY tool_name ORDER BY duration_ms) - 1 AS i, count(*) OVER (PARTITION BY tool_name) AS n FROM actions) SELECT tool_name, max(n) AS n, max(v) FILTER (i = round((n - 1) * 0.5)) AS p50, max(v) FILTER (i = round((n - 1) * 0.95)) AS p95, round(median(v), 6) AS median FROM r GROUP BY 1",
    "o13_tools": f"WITH {A.ACTIONS} SELECT tool_name, count(*) AS n_calls, count(*) FILTER (success) AS n_success, round(count(*) FILTER (success) / count(*), 6) AS success_rate, round(avg(duration_ms), 6) AS mean_ms, max(duration_ms) AS max_ms, round(sum(cost), 6) AS total_cost FROM actions GROUP BY 1",
    "o13_errors": f"WITH {A.ACTIONS} SELECT CASE WHEN contains(error, 'timed out') THEN 'timeout' ELSE 'not_found' END AS category, count(*) AS n FROM actions WHERE NOT success GROUP BY 1",
    "o14_accuracy": f"WITH {A.ESTIMATES} SELECT category, count(*) AS n, round(avg(abs(actual_cost - estimated_cost) / estimated_cost), 6) AS cost_error, round(avg(abs(actual_time_secs - estimated_time_secs) / estimated_time_secs), 6) AS time_error FROM estimates GROUP BY 1",
    "o15_factors": f"WITH {A.ESTIMATES}, r AS (SELECT category, actual_cost / estimated_cost AS c, actual_time_secs / estimated_time_secs AS t, 0.1::DOUBLE * 0.9::DOUBLE ** (row_number() OVER (PARTITION BY category ORDER BY created_at DESC, id DESC) - 1) AS w FROM estimates WHERE actual_time_secs IS NOT NULL), g AS (SELECT category, count(*) AS n, 0.9::DOUBLE ** count(*) AS z, sum(w * c) AS c, sum(w * t) AS t, sum(w * abs(c - 1)) AS ce, sum(w * abs(t - 1)) AS te FROM r GROUP BY 1) SELECT category, n, round(z + c, 6) AS cost_factor, round(z + t, 6) AS time_factor, round(ce, 6) AS cost_error, round(te, 6) AS time_error, round(CASE WHEN n >= 5 THEN 0.5 + 0.3 * least(n / 100, 1) + 0.2 * (1 - least((ce + te) / 2, 1)) ELSE 0.3 END, 6) AS confidence FROM g",
    "o16_recent_leaks": "SELECT event_type AS name, count(*) AS n FROM events WHERE ts > TIMESTAMP '2024-01-19 12:00:00' AND ts <= TIMESTAMP '2024-01-20 12:00:00' GROUP BY 1",
    "o17_changed_subjects": "SELECT concat('G', user_id) AS gene_id, count(*) AS n FROM events WHERE abs(user_id % 20 - event_id % 20) > 1 GROUP BY 1",
    "o18_conversations": "SELECT conv_id, count(*) FILTER (role = 'user') AS n_user, arg_min(substring(text, 1, 100), (turn, substring(text, 1, 100))) FILTER (role = 'user') AS title, max(turn) AS last_turn FROM conversations GROUP BY 1",
    "o19_job_counts": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2",
    "o20_daily_spend": f"WITH {A.CALLS}, c AS (SELECT created_at::DATE AS day, length(model) / 1000 AS i, length(model) / 500 AS o, * FROM calls), p AS (SELECT day, greatest(input_tokens - cache_read_tokens - cache_write_tokens, 0) * i + cache_read_tokens * i / 10 + cache_write_tokens * i * 1.25 + output_tokens * o AS cost FROM c) SELECT day::VARCHAR AS day, round(sum(cost), 9) AS spend, count(*) AS n_calls, sum(cost) >= 80 AS warn, sum(cost) >= 100 AS exceeded FROM p GROUP BY 1",
    "o20_calls_in_hour": f"WITH {A.CALLS} SELECT id, count(*) OVER (PARTITION BY model ORDER BY created_at RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS n_last_hour FROM calls",
    "o20_tokens": f"WITH {A.CALLS} SELECT model, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens, count(*) AS n_calls FROM calls GROUP BY 1",
    "o21_expired": f"WITH {A.PATHS} SELECT id FROM paths WHERE starts_with(path, 'src1') AND updated_at < TIMESTAMP '2024-01-25' AND id NOT IN ('30', '31')",
    "o22_children": f"WITH {A.PATHS}, k AS (SELECT *, substring(path, 6) AS rest FROM paths WHERE starts_with(path, 'src1/')) SELECT split_part(rest, '/', 1) AS child, bool_or(contains(rest, '/')) AS is_directory, count(*) AS n, max(updated_at) AS updated_at, md5(arg_max(substring(content, 1, 200), (updated_at, path))) AS preview FROM k GROUP BY 1",
}
