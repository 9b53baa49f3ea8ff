"""Run logs, refresh policy, usage, quality and retention (O). Every "now" is the argument as_of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evispark.functions.rules import clamp
from evispark.operators.ranks import row_numbers

ZERO = 0.0


def _ratio(a, b) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(ZERO))


def run_summary(runs: DataFrame, n: int = 24) -> DataFrame:
    """One row over the n newest runs: mean_duration_ms, papers and chunks per minute, cache_hit_rate, n_flagged."""
    newest = runs.orderBy(F.desc("recorded_at"), "query").limit(n)
    minutes = F.sum("duration_ms") / 60000.0
    return newest.agg(F.count("*").alias("n_runs"), F.avg("duration_ms").alias("mean_duration_ms"), _ratio(F.sum("inserted"), minutes).alias("papers_per_minute"), _ratio(F.sum("chunks"), minutes).alias("chunks_per_minute"), _ratio(F.sum("cache_hits"), F.sum(F.col("cache_hits") + F.col("cache_misses"))).alias("cache_hit_rate"), F.count_if("flagged").alias("n_flagged"))


def latest_runs(runs: DataFrame, n: int = 1) -> DataFrame:
    """The n newest runs of each provider, newest first."""
    w = Window.partitionBy("provider").orderBy(F.desc("finished_at"), F.desc("started_at"))
    return runs.withColumn("n", F.row_number().over(w)).where(F.col("n") <= n)


def refresh_decisions(runs: DataFrame, providers: DataFrame, as_of, n: int = 8, base: int = 900, least: int = 180, most: int = 21600, high: float = 0.25, severe: float = 0.5, backoff: int = 2, divisor: int = 2, stale_after: int = 86400) -> DataFrame:
    """(provider, error_rate, interval_secs, elapsed_secs, decision): cold_start, stale_force, due or deferred, from the n last runs."""
    recent = latest_runs(runs, n).groupBy("provider").agg(F.sum(F.greatest("attempted", F.lit(0))).alias("a"), F.sum(F.greatest("failed", F.lit(0))).alias("f"), F.sum(F.greatest("success", F.lit(0))).alias("s"), F.max("finished_at").alias("last"))
    error = F.when(F.col("a") > 0, F.col("f") / F.col("a")).when(F.col("s") > 0, 0.0).otherwise(1.0)
    out = providers.select("provider").distinct().join(recent, "provider", "left").withColumn("error_rate", F.when(F.col("last").isNotNull(), error))
    interval = F.when(F.col("error_rate") >= severe, base * backoff * 2).when(F.col("error_rate") >= high, base * backoff).when(F.col("error_rate") <= 0.10, base // divisor).otherwise(base)
    out = out.withColumn("interval_secs", clamp(interval, least, most).cast("long"))
    elapsed = F.greatest(F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp("last"), F.lit(0))
    out = out.withColumn("elapsed_secs", elapsed)
    decision = F.when(F.col("last").isNull(), "cold_start").when(F.col("elapsed_secs") >= stale_after, "stale_force").when(F.col("elapsed_secs") >= F.col("interval_secs"), "due").otherwise("deferred")
    return out.select("provider", "error_rate", "interval_secs", "elapsed_secs", decision.alias("decision"))


def refresh_report(attempts: DataFrame) -> DataFrame:
    """(provider, attempted, success, failed, skipped) of rows (provider, outcome)."""
    count = lambda s: F.count_if(F.col("outcome") == s).alias(s)
    return attempts.groupBy("provider").agg(F.count_if(F.col("outcome") != "skipped").alias("attempted"), count("success"), count("failed"), count("skipped"))


def source_telemetry(rows: DataFrame) -> DataFrame:
    """(source, fetched, errors, raw, unique, inserted, duplicate) of rows (source, identity_key, status)."""
    status = lambda s, n: F.count_if(F.col("status") == s).alias(n)
    return rows.groupBy("source").agg(F.count("*").alias("fetched"), status("error", "errors"), F.count("identity_key").alias("raw"), F.count_distinct("identity_key").alias("unique"), status("inserted", "inserted"), status("duplicate", "duplicate"))


def cycle_analytics(cycles: DataFrame, patience: int = 2) -> DataFrame:
    """Cycles (run_id, cycle, found, inserted, duplicate, chunks, typed, score_gain) with ratios, running maxima, floors, stagnant streak, pressure and stop."""
    run = Window.partitionBy("run_id").orderBy("cycle")
    so_far = run.rowsBetween(Window.unboundedPreceding, 0)
    out = cycles.withColumn("novelty_ratio", _ratio("inserted", "found")).withColumn("duplicate_pressure", _ratio("duplicate", "found"))
    out = out.withColumn("evidence_gain", F.col("inserted") + F.col("chunks") * 0.20 + F.col("typed") * 0.05)
    for c in ("novelty_ratio", "evidence_gain", "score_gain"):
        out = out.withColumn(f"max_{c}", F.greatest(F.max(c).over(so_far), F.lit(0.0)))
    stagnating = (F.col("cycle") > 1) & (F.col("score_gain") <= F.col("max_score_gain") * 0.15) & (F.col("evidence_gain") <= F.col("max_evidence_gain") * 0.20) & (F.col("novelty_ratio") <= F.col("max_novelty_ratio") * 0.20)
    out = out.withColumn("stagnating", stagnating).withColumn("_island", F.sum((~F.col("stagnating")).cast("int")).over(so_far))
    streak = F.sum(F.col("stagnating").cast("int")).over(Window.partitionBy("run_id", "_island").orderBy("cycle").rowsBetween(Window.unboundedPreceding, 0))
    out = out.withColumn("streak", streak).withColumn("patience", F.when((F.col("max_novelty_ratio") > 0.30) | (F.col("max_evidence_gain") > 8.0), patience + 1).otherwise(patience))
    pressure = clamp(F.col("duplicate_pressure") * 1.25 - F.col("novelty_ratio"), 0.0, 1.0)
    out = out.withColumn("pressure_score", pressure).withColumn("pressure_triggered", (F.col("duplicate_pressure") >= 0.65) & (F.col("novelty_ratio") <= 0.25) & (pressure >= 0.30))
    return out.withColumn("stop", F.col("streak") >= F.col("patience")).drop("_island")


def next_step(latest: DataFrame) -> DataFrame:
    """(run_id, step) of the latest row of each run (n_results, novelty_ratio, duplicate_pressure, evidence_gain)."""
    step = F.when(F.col("n_results") == 0, "retrieve").when(F.col("duplicate_pressure") >= 0.65, "replan").when((F.col("evidence_gain") <= 0) & (F.col("novelty_ratio") <= 0.05), "replan").otherwise("continue")
    return latest.select("run_id", step.alias("step"))


def next_budget(latest: DataFrame, least: int = 10, most: int = 200) -> DataFrame:
    """(run_id, max_results) for the next retrieval: more when much was new, less when most were duplicates."""
    n = F.col("max_results")
    tuned = F.when(F.col("novelty_ratio") >= 0.50, n * 1.25).when(F.col("duplicate_pressure") >= 0.65, n * 0.60).when(F.col("novelty_ratio") <= 0.15, n * 0.80).otherwise(n)
    return latest.select("run_id", clamp(F.round(tuned), least, most).cast("int").alias("max_results"))


def quality_summary(papers: DataFrame, facts: DataFrame) -> DataFrame:
    """One row: n_papers, parse_success_rate, duplicate_doi_rate, n_facts, generic_share."""
    from evispark.operators.dedup import duplicate_doi_rate

    p = papers.agg(F.count("*").alias("n_papers"), _ratio(F.count_if(F.col("parse_status").isin("parsed", "parsed_light")), F.count("*")).alias("parse_success_rate"))
    f = facts.agg(F.count("*").alias("n_facts"), _ratio(F.count_if(F.lower("predicate").isin("mentions", "associated_with")), F.count("*")).alias("generic_share"))
    return p.crossJoin(duplicate_doi_rate(papers).select(F.col("rate").alias("duplicate_doi_rate"))).crossJoin(f)


def manifest_issues(artifacts: DataFrame, required: DataFrame) -> DataFrame:
    """(snapshot_id, severity, code, detail) of artifact rows (snapshot_id, name, rows, bytes, sha256); required is a short list of names."""
    bad = lambda c, severity, code: artifacts.where(c).select("snapshot_id", F.lit(severity).alias("severity"), F.lit(code).alias("code"), F.col("name").alias("detail"))
    found = bad(F.coalesce(F.trim("name"), F.lit("")) == "", "error", "blank_name").union(bad(~F.coalesce(F.col("sha256").rlike("^[0-9a-f]{64}$"), F.lit(False)), "error", "bad_sha256"))
    found = found.union(bad(F.coalesce(F.col("bytes"), F.lit(-1)) < 0, "error", "bad_bytes")).union(bad(F.col("rows") == 0, "warning", "empty_artifact"))
    twice = artifacts.groupBy("snapshot_id", "name").count().where("count > 1").select("snapshot_id", F.lit("error"), F.lit("duplicate_name"), "name")
    wanted = artifacts.select("snapshot_id").distinct().crossJoin(F.broadcast(required.toDF("name"))).join(artifacts.select("snapshot_id", "name"), ["snapshot_id", "name"], "left_anti")
    return found.union(twice).union(wanted.select("snapshot_id", F.lit("error"), F.lit("missing_artifact"), "name"))


def sync_plan(local: DataFrame, remote: DataFrame) -> DataFrame:
    """(snapshot_id, action): push what the other side lacks, pull what this one lacks."""
    push = local.join(remote, "snapshot_id", "left_anti").select("snapshot_id", F.lit("push").alias("action"))
    return push.union(remote.join(local, "snapshot_id", "left_anti").select("snapshot_id", F.lit("pull"))).distinct()


def admit(submissions: DataFrame, queue: DataFrame) -> DataFrame:
    """The first submission (snapshot_id, submitted_at, valid) of each snapshot that is valid and not queued."""
    fresh = submissions.where("valid").join(queue.select("snapshot_id"), "snapshot_id", "left_anti")
    return fresh.groupBy("snapshot_id").agg(F.min("submitted_at").alias("submitted_at")).withColumn("status", F.lit("pending"))


def decide(queue: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(queue with the latest decision, lineage rows of what was approved); decisions (snapshot_id, decision, decided_at); of those of one time the last by name."""
    last = decisions.groupBy("snapshot_id").agg(F.max_by("decision", F.struct("decided_at", "decision")).alias("_decision"), F.max("decided_at").alias("decided_at"))
    out = queue.join(last, "snapshot_id", "left").withColumn("status", F.when(F.col("status") == "pending", F.coalesce("_decision", "status")).otherwise(F.col("status")))
    lineage = out.where((F.col("status") == "approved") & F.col("_decision").isNotNull()).select("snapshot_id", F.col("decided_at").alias("merged_at"))
    return out.select(*queue.columns), lineage


def latency_percentiles(rows: DataFrame, by: str, value: str) -> DataFrame:
    """(by, n, p50, p95, median): nearest rank of the sorted values, nulls first; the median is of those that are not null.

    A group's values are ranked in ranges of their order, so that no task sorts or holds a whole group.
    """
    none = "\x00none"
    own = rows.select(F.coalesce(F.col(by).cast("string"), F.lit(none)).alias("g"), F.col(value).alias("v"))
    ranked = row_numbers(own, ["v"], ("g",))
    sizes = ranked.groupBy("g").agg(F.count("*").alias("n"), F.count("v").alias("full"))
    placed = ranked.join(F.broadcast(sizes), "g").withColumn("i", F.col("rank") - 1)
    at = lambda p: F.max(F.when(F.col("i") == F.round((F.col("n") - 1) * p), F.col("v")))
    place = F.col("i") - (F.col("n") - F.col("full"))
    middle = F.avg(F.when((2 * place >= F.col("full") - 2) & (2 * place <= F.col("full")) & (place >= 0), F.col("v")))
    found = placed.groupBy("g").agg(F.max("n").alias("n"), at(0.50).alias("p50"), at(0.95).alias("p95"), middle.cast("double").alias("median"))
    kind = rows.schema[by].dataType
    return found.select(F.nullif("g", F.lit(none)).cast(kind).alias(by), "n", "p50", "p95", "median")


def tool_statistics(actions: DataFrame) -> DataFrame:
    """(tool_name, n_calls, n_success, success_rate, mean_ms, max_ms, total_cost) of actions."""
    return actions.groupBy("tool_name").agg(F.count("*").alias("n_calls"), F.count_if("success").alias("n_success"), _ratio(F.count_if("success"), F.count("*")).alias("success_rate"), F.avg("duration_ms").alias("mean_ms"), F.max("duration_ms").alias("max_ms"), F.sum("cost").alias("total_cost"))


def error_category(error: Column) -> Column:
    """O13."""
    e = F.lower(error)
    return F.when(e.rlike("timeout|timed out"), "timeout").when(e.rlike("rate limit|429"), "rate_limit").when(e.rlike("auth|unauthorized|forbidden"), "auth").when(e.rlike("not found|404"), "not_found").when(e.rlike("network|connection"), "network").when(e.rlike("invalid|parse|format"), "invalid_input").when(error.isNotNull(), "unknown")


def error_summary(actions: DataFrame) -> DataFrame:
    """Failures by category."""
    return actions.where("NOT success").groupBy(F.coalesce(error_category(F.col("error")), F.lit("unknown")).alias("category")).agg(F.count("*").alias("n"))


def estimation_accuracy(estimates: DataFrame) -> DataFrame:
    """(category, n, cost_error, time_error): mean size of the relative error, over rows with actual values."""
    error = lambda a, e: F.avg(F.abs(F.col(a).cast("double") - F.col(e).cast("double")) / F.nullif(F.col(e).cast("double"), F.lit(0.0)))
    return estimates.where("actual_cost IS NOT NULL").groupBy("category").agg(F.count("*").alias("n"), error("actual_cost", "estimated_cost").alias("cost_error"), error("actual_time_secs", "estimated_time_secs").alias("time_error"))


def category_history(estimates: DataFrame, category: str, n: int = 20) -> DataFrame:
    """The newest n estimates of a category."""
    return estimates.where(F.col("category") == category).orderBy(F.desc("created_at")).limit(n)


def estimate_factors(estimates: DataFrame, alpha: float = 0.1, least: int = 5) -> DataFrame:
    """(category, n, cost_factor, time_factor, cost_error, time_error, confidence), averages that move by alpha in order of time.

    An average that starts at x0 and takes x1 to xn is x0 (1-a)^n plus the sum of a (1-a)^(n-i) xi, so
    a category's rows are summed with their rank and never gathered.
    """
    own = estimate_ratios(estimates)
    back = F.row_number().over(Window.partitionBy("category").orderBy(F.desc("created_at"), F.desc("id"))) - 1
    own = own.select("category", "c", "t", (alpha * F.pow(F.lit(1 - alpha), back)).alias("w"))
    left = F.pow(F.lit(1 - alpha), F.count("*"))
    out = own.groupBy("category").agg(F.count("*").alias("n"), (left + F.sum(F.col("w") * F.col("c"))).alias("cost_factor"), (left + F.sum(F.col("w") * F.col("t"))).alias("time_factor"), F.sum(F.col("w") * F.abs(F.col("c") - 1)).alias("cost_error"), F.sum(F.col("w") * F.abs(F.col("t") - 1)).alias("time_error"))
    return estimate_confidence(out, least)


def estimate_ratios(estimates: DataFrame) -> DataFrame:
    """Estimates with actual values, and c and t: actual over estimated cost and time, 1 where nothing was estimated."""
    ratio = lambda a, e: F.coalesce(F.try_divide(F.col(a).cast("double"), F.nullif(F.col(e).cast("double"), F.lit(0.0))), F.lit(1.0))
    own = estimates.where("actual_cost IS NOT NULL AND actual_time_secs IS NOT NULL")
    return own.withColumns({"c": ratio("actual_cost", "estimated_cost"), "t": ratio("actual_time_secs", "estimated_time_secs")})


def estimate_confidence(out: DataFrame, least: int = 5) -> DataFrame:
    """Factors with confidence, by how many estimates there were and how far off."""
    confidence = 0.5 + 0.3 * F.least(F.col("n") / 100.0, F.lit(1.0)) + 0.2 * (1 - F.least((F.col("cost_error") + F.col("time_error")) / 2, F.lit(1.0)))
    return out.withColumn("confidence", F.when(F.col("n") >= least, confidence).otherwise(0.3))


def recent_leaks(leaks: DataFrame, as_of, hours: int = 24) -> DataFrame:
    """Leak events (name, ts) of the last hours before as_of, counted by name."""
    now = F.lit(as_of).cast("timestamp")
    return leaks.where((F.col("ts") > now - F.expr(f"INTERVAL {hours} HOURS")) & (F.col("ts") <= now)).groupBy("name").agg(F.count("*").alias("n"), F.max("ts").alias("latest"))


def document_summary(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """(id, n_chunks, n_embedded) of documents."""
    own = chunks.groupBy("document_id").agg(F.count("*").alias("n_chunks"), F.count("embedding").alias("n_embedded"))
    out = documents.select("id").join(own, F.col("id") == F.col("document_id"), "left")
    return out.select("id", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"), F.coalesce("n_embedded", F.lit(0)).alias("n_embedded"))


def conversation_summary(turns: DataFrame, length: int = 100) -> DataFrame:
    """(conv_id, n_user, title, last_turn): user messages, and the first one's beginning."""
    user = F.col("role") == "user"
    return turns.groupBy("conv_id").agg(F.count_if(user).alias("n_user"), F.min(F.when(user, F.struct("turn", F.substring("text", 1, length).alias("title"))))["title"].alias("title"), F.max("turn").alias("last_turn"))


def job_counts(jobs: DataFrame, by: tuple[str, ...] = ("status",)) -> DataFrame:
    """O19."""
    return jobs.groupBy(*by).agg(F.count("*").alias("n"))


def call_costs(calls: DataFrame, rates: DataFrame, read_discount: float = 10.0, write_multiplier: float = 1.25, default=(0.0, 0.0)) -> DataFrame:
    """Calls with cost: cache reads at a part of the input rate, cache writes at a multiple, the rest in full. rates has a row for each model."""
    dec = lambda x: F.lit(x).cast("decimal(38,18)").cast("double")
    out = calls.join(rates, "model", "left")
    i, o = F.coalesce(F.col("input_rate").cast("double"), dec(default[0])), F.coalesce(F.col("output_rate").cast("double"), dec(default[1]))
    plain = F.greatest(F.col("input_tokens") - F.col("cache_read_tokens") - F.col("cache_write_tokens"), F.lit(0))
    return out.withColumn("cost", plain * i + F.col("cache_read_tokens") * i / read_discount + F.col("cache_write_tokens") * i * write_multiplier + F.col("output_tokens") * o).drop("input_rate", "output_rate")


def daily_spend(costs: DataFrame, limit: float) -> DataFrame:
    """(day, spend, n_calls, warn, exceeded): 80 % and 100 % of a day's limit."""
    out = costs.groupBy(F.to_date("created_at").alias("day")).agg(F.sum("cost").alias("spend"), F.count("*").alias("n_calls"))
    return out.withColumn("warn", F.col("spend") >= 0.8 * limit).withColumn("exceeded", F.col("spend") >= limit)


HOUR = 3_600_000_000


def calls_in_hour(calls: DataFrame, by: str = "model") -> DataFrame:
    """Calls with n_last_hour, how many of their model's were made in the hour up to them.

    A call counts from its time on, and no more from an hour after it, so a running sum gives the number.
    It also counts in the next hour of the clock; a task sums one hour of a model by itself.
    """
    hour, at = F.expr(f"(_at - pmod(_at, {HOUR}L)) div {HOUR}L"), F.col("_at")
    place = lambda h, t, n, own: F.struct(h.alias("_hour"), t.alias("_when"), F.lit(n).alias("_n"), F.lit(own).alias("_own"))
    own = place(hour, at, 1, True)
    places = F.when(at.isNull(), F.array(own)).otherwise(F.array(own, place(hour + 1, at, 1, False), place(hour + 1, at + HOUR + 1, -1, False)))
    dealt = calls.withColumn("_at", F.unix_micros(F.col("created_at").cast("timestamp"))).withColumn("_place", F.explode(places)).select(*calls.columns, "_place.*")
    w = Window.partitionBy(by, "_hour").orderBy("_when").rangeBetween(Window.unboundedPreceding, 0)
    return dealt.withColumn("n_last_hour", F.sum("_n").over(w)).where("_own").drop("_hour", "_when", "_n", "_own")


def tokens_by_model(calls: DataFrame) -> DataFrame:
    """O20."""
    return calls.groupBy("model").agg(F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.count("*").alias("n_calls"))


def expired(documents: DataFrame, prefix: str, days: int, as_of, protected: tuple[str, ...] = ()) -> DataFrame:
    """Documents under a path prefix not updated for more than so many days, without protected file names."""
    name = F.element_at(F.split("path", "/"), -1)
    old = F.col("updated_at") < F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {days} DAYS")
    return documents.where(F.col("path").startswith(prefix) & old & ~name.isin(*protected or ("",)))


def list_children(documents: DataFrame, prefix: str = "", length: int = 200) -> DataFrame:
    """(child, is_directory, n, updated_at, preview) directly under a path prefix; the preview is the newest file's."""
    own = documents.where(F.col("path").startswith(prefix)).withColumn("rest", F.expr(f"substring(path, {len(prefix) + 1})"))
    child = F.split_part("rest", F.lit("/"), F.lit(1))
    return own.groupBy(child.alias("child")).agg(F.max(F.col("rest").contains("/")).alias("is_directory"), F.count("*").alias("n"), F.max("updated_at").alias("updated_at"), F.max_by(F.substring("content", 1, length), F.struct("updated_at", "path")).alias("preview"))
