"""The driver's tables under the logical schemas of the operators, as DataFrames and as SQL of the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evispark.shared import spread

AS_OF = "2024-02-01 00:00:00"


#: Tables of long rows, of which few files hold many; the work on a row is worth moving it.
LONG_ROWS = ("documents", "pages")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(rows) if name in LONG_ROWS else rows


PREDICATES = {"RF": "inhibits", "AF": "activates", "NO": "has_mutation", "NF": "upregulated_in", "AO": "associated_with", "RO": "prognostic_for_poor_outcome"}


def kg_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts from order lines: a part acts on a supplier's nation. The supplier side is small against the lines; the planner chooses the join."""
    lines, suppliers = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    own = lines.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
    key = F.concat("l_returnflag", "l_linestatus")
    predicate = F.lit("mentions")
    for k, p in PREDICATES.items():
        predicate = F.when(key == k, p).otherwise(predicate)
    n = F.col("l_linenumber")
    gene, cancer = F.concat(F.lit("G"), "l_partkey"), F.concat(F.lit("C"), "s_nationkey")
    return own.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"), F.col("l_orderkey").cast("string").alias("paper_id"), gene.alias("subject_id"), gene.alias("subject_name"), predicate.alias("predicate"),
        cancer.alias("object_id"), cancer.alias("object_name"), (1 - 5 * F.col("l_discount")).alias("confidence"), F.when(n % 3 == 0, "improved survival in normal tissue").when(n % 3 == 1, "worse outcome").alias("evidence"),
        F.when(n == 1, "provider_signal").when(n == 2, "mention").otherwise("text_mined").alias("evidence_type"), F.col("l_quantity").cast("int").alias("sample_size"),
        F.col("l_shipdate").alias("valid_from"), F.when(n == 7, F.col("l_shipdate") + F.expr("INTERVAL 30 DAYS")).alias("valid_until"), F.col("l_shipdate").alias("created_at"),
    )


_CASE = " ".join(f"WHEN '{k}' THEN '{p}'" for k, p in PREDICATES.items())
FACTS = f"""facts AS (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS id, l_orderkey::VARCHAR AS paper_id, concat('G', l_partkey) AS subject_id, concat('G', l_partkey) AS subject_name,
  CASE l_returnflag || l_linestatus {_CASE} ELSE 'mentions' END AS predicate, concat('C', s_nationkey) AS object_id, concat('C', s_nationkey) AS object_name, 1 - 5 * l_discount AS confidence,
  CASE l_linenumber % 3 WHEN 0 THEN 'improved survival in normal tissue' WHEN 1 THEN 'worse outcome' END AS evidence, CASE l_linenumber WHEN 1 THEN 'provider_signal' WHEN 2 THEN 'mention' ELSE 'text_mined' END AS evidence_type,
  l_quantity::INT AS sample_size, l_shipdate AS valid_from, CASE WHEN l_linenumber = 7 THEN l_shipdate + INTERVAL 30 DAY END AS valid_until, l_shipdate AS created_at
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)"""
#: Facts with provenance p, tier t and weight w.
SIGNAL = f"""{FACTS},
prov AS (SELECT *, CASE WHEN contains(evidence_type, 'provider') THEN 'provider' WHEN contains(evidence_type, 'mention') OR predicate IN ('mentions', 'associated_with') THEN 'generic' ELSE 'extracted' END AS provenance FROM facts),
tiered AS (SELECT *, CASE provenance WHEN 'provider' THEN CASE WHEN confidence >= 0.62 THEN 'high' ELSE 'medium' END WHEN 'generic' THEN CASE WHEN confidence >= 0.8 AND predicate <> 'mentions' THEN 'medium' ELSE 'low' END
  ELSE CASE WHEN confidence >= 0.78 THEN 'high' WHEN confidence >= 0.52 THEN 'medium' ELSE 'low' END END AS tier FROM prov),
signal AS (SELECT *, least(greatest(CASE provenance WHEN 'provider' THEN 1.28::DOUBLE WHEN 'generic' THEN 0.68 ELSE 1.0 END * CASE tier WHEN 'high' THEN 1.18::DOUBLE WHEN 'low' THEN 0.74 ELSE 1.0 END
  * CASE predicate WHEN 'mentions' THEN 0.52::DOUBLE WHEN 'associated_with' THEN 0.74 ELSE 1.0 END, 0.18), 2.2) AS signal_weight FROM tiered)"""


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    return d.select(
        i.cast("string").alias("id"), F.when(i % 3 == 0, F.concat(F.lit("https://doi.org/10.1/"), (i % 400).cast("string"))).alias("doi"), F.when(i % 3 == 1, F.concat(F.lit("PMID:"), (i % 500).cast("string"))).alias("pmid"), F.lit(None).cast("string").alias("pmcid"),
        F.substring("text", 1, 80).alias("title"), F.col("text").alias("abstract_text"), F.array(F.concat(F.lit("Jane Doe"), (i % 7).cast("string"))).alias("authors"), F.lit("J").alias("journal"), "source",
        F.timestamp_seconds(F.lit(1577836800) + i % 1400 * 86400).alias("published_at"), F.when(i % 5 == 0, "failed").otherwise("parsed").alias("parse_status"),
    )


PAPERS = """papers AS (SELECT doc_id::VARCHAR AS id, CASE WHEN doc_id % 3 = 0 THEN concat('https://doi.org/10.1/', doc_id % 400) END AS doi, CASE WHEN doc_id % 3 = 1 THEN concat('PMID:', doc_id % 500) END AS pmid,
  substring(text, 1, 80) AS title, text AS abstract_text, source, CASE WHEN doc_id % 5 = 0 THEN 'failed' ELSE 'parsed' END AS parse_status, TIMESTAMP '2020-01-01' + to_days((doc_id % 1400)::INT) AS published_at FROM documents)"""


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order line mentions a part in an order."""
    n = table(spark, sf_dir, "lineitem")
    return n.select(F.col("l_partkey").cast("string").alias("entity_id"), F.col("l_orderkey").cast("string").alias("chunk_id"), F.col("l_orderkey").cast("string").alias("paper_id"))


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A market segment's orders in a nation: finished ones are mutated samples."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    own = o.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_mktsegment").alias("gene_symbol"), F.concat(F.lit("C"), "c_nationkey").alias("cancer_code"))
    return own.agg(F.count("*").alias("profiled"), F.count_if(F.col("o_orderstatus") == "F").alias("mutated"), F.max("o_orderdate").alias("fetched_at")).withColumn("value", F.col("mutated") / F.col("profiled"))


SIGNALS = """signals AS (SELECT c_mktsegment AS gene_symbol, concat('C', c_nationkey) AS cancer_code, count(*) AS profiled, count(*) FILTER (o_orderstatus = 'F') AS mutated, max(o_orderdate) AS fetched_at,
  count(*) FILTER (o_orderstatus = 'F') / count(*) AS value FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"""


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").cast("string").alias("job_id"), F.col("event_type").alias("tool_name"), (F.col("event_type") != "error").alias("success"), F.round(F.col("value") * 1000).cast("long").alias("duration_ms"), F.col("value").cast("decimal(38,18)").alias("cost"), F.when(F.col("event_type") == "error", F.when(F.col("event_id") % 2 == 0, "Request timed out").otherwise("404 not found")).alias("error"), "ts")


ACTIONS = """actions AS (SELECT user_id::VARCHAR AS job_id, event_type AS tool_name, event_type <> 'error' AS success, round(value * 1000)::BIGINT AS duration_ms, value AS cost,
  CASE WHEN event_type = 'error' THEN CASE WHEN event_id % 2 = 0 THEN 'Request timed out' ELSE '404 not found' END END AS error, ts FROM events)"""


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    t = F.round(F.col("value") * 10).cast("long")
    return e.select(F.col("event_id").alias("id"), F.col("event_type").alias("model"), t.alias("input_tokens"), (F.col("user_id") % 50).alias("output_tokens"), F.floor(t / 4).alias("cache_read_tokens"), F.floor(t / 8).alias("cache_write_tokens"), F.col("ts").alias("created_at"))


CALLS = """calls AS (SELECT event_id AS id, event_type AS model, round(value * 10)::BIGINT AS input_tokens, user_id % 50 AS output_tokens, floor(round(value * 10)::BIGINT / 4)::BIGINT AS cache_read_tokens, floor(round(value * 10)::BIGINT / 8)::BIGINT AS cache_write_tokens, ts AS created_at FROM events)"""


def estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("id"), F.col("event_type").alias("category"), (F.col("value") + 1).alias("estimated_cost"), (F.col("value") + F.col("user_id") % 7).alias("actual_cost"), (F.col("user_id") % 90 + 10).cast("int").alias("estimated_time_secs"), F.when(F.col("event_id") % 4 > 0, (F.col("user_id") % 60 + 5).cast("int")).alias("actual_time_secs"), F.col("ts").alias("created_at"))


ESTIMATES = """estimates AS (SELECT event_id AS id, event_type AS category, value + 1 AS estimated_cost, value + user_id % 7 AS actual_cost, (user_id % 90 + 10)::INT AS estimated_time_secs, CASE WHEN event_id % 4 > 0 THEN (user_id % 60 + 5)::INT END AS actual_time_secs, ts AS created_at FROM events)"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Refresh runs of providers from events."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_type").alias("provider"), F.col("ts").alias("started_at"), F.col("ts").alias("finished_at"), (F.col("event_id") % 10).alias("attempted"), (F.col("event_id") % 10 - F.col("event_id") % 4).alias("success"), (F.col("event_id") % 4).alias("failed"), F.lit(0).cast("long").alias("skipped"))


RUNS = "runs AS (SELECT event_type AS provider, ts AS started_at, ts AS finished_at, event_id % 10 AS attempted, event_id % 10 - event_id % 4 AS success, event_id % 4 AS failed FROM events)"


def path_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").cast("string").alias("id"), F.concat("source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string")).alias("path"), F.col("text").alias("content"), F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") % 40 * 86400).alias("updated_at"))


PATHS = "paths AS (SELECT doc_id::VARCHAR AS id, source || '/' || lang || '/' || doc_id AS path, text AS content, TIMESTAMP '2024-01-01' + to_days((doc_id % 40)::INT) AS updated_at FROM documents)"


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in chunks of words, each with a vector of the embeddings by id."""
    from evispark.operators.text import chunk_words

    d, e = table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    own = chunk_words(d, "doc_id", "text").select(F.concat_ws("-", "doc_id", "chunk_index").alias("id"), F.col("doc_id").cast("string").alias("paper_id"), "chunk_index", "content", F.col("doc_id").alias("vec_id"))
    return own.join(e, "vec_id", "left").drop("vec_id")


def dependency(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(scores (gene, cell_line, score), cell_lines (cell_line, cancer_code))."""
    lines = table(spark, sf_dir, "lineitem")
    scores = lines.groupBy(F.concat(F.lit("G"), (F.col("l_partkey") % 200).cast("string")).alias("gene"), F.concat(F.lit("L"), "l_suppkey").alias("cell_line")).agg((-2 * F.avg("l_discount") / 0.1).alias("score"))
    return scores, table(spark, sf_dir, "supplier").select(F.concat(F.lit("L"), "s_suppkey").alias("cell_line"), F.concat(F.lit("C"), "s_nationkey").alias("cancer_code"))


DEPENDENCY = """scores AS (SELECT concat('G', l_partkey % 200) AS gene, concat('L', l_suppkey) AS cell_line, -2 * avg(l_discount) / 0.1 AS score FROM lineitem GROUP BY 1, 2),
cell_lines AS (SELECT concat('L', s_suppkey) AS cell_line, concat('C', s_nationkey) AS cancer_code FROM supplier)"""
