"""Queries that score and rank (P)."""

from __future__ import annotations

from pyspark.sql import functions as F

from evispark.operators import score as P
from evispark.plans import adapters as A
from evispark.sources import tables as S

R = 6


def _round(df, *columns, n=R):
    return df.withColumns({c: F.round(c, n) for c in columns})


def _facts(s, d):
    return A.kg_facts(s, d)


def _conflicts(s, d):
    """Every fact of two nations disputed with itself at differing strength, so that the gate has both outcomes."""
    f = _facts(s, d).where("object_id IN ('C1', 'C2')")
    return f.select(F.col("id").alias("fact_a_id"), F.col("id").alias("fact_b_id"), F.when(F.col("sample_size") % 3 == 0, 0.2).when(F.col("sample_size") % 3 == 1, 0.5).otherwise(0.9).alias("net_confidence"))


def _candidates(s, d):
    return P.candidates(_facts(s, d), _conflicts(s, d))


_EVIDENCE = f"""{A.FACTS},
side AS (SELECT subject_id AS gene_id, subject_name AS gene, confidence, CASE WHEN contains(predicate, 'mutation') THEN 1 ELSE 0 END AS mutation, object_name AS other, created_at, id FROM facts
  UNION ALL SELECT object_id, object_name, confidence, 0, subject_name, created_at, id FROM facts),
evidence AS (SELECT gene_id, gene, count(*) AS total_evidence, sum(mutation)::BIGINT AS mutation_evidence, count(*) FILTER (regexp_matches(other, '^[A-Z0-9]{{1,8}}$')) AS cancer_evidence, sum(confidence) AS confidence_sum,
  arg_max(other, (created_at, id, other)) AS cancer_code FROM side GROUP BY 1, 2)"""
_CLAMP = "least(greatest({}, {}), {})".format
_EVIDENCE_SCORE = f"""{_EVIDENCE},
n AS (SELECT *, {_CLAMP('ln(1 + total_evidence) / ln(31)', 0.0, 1.0)} AS lit, {_CLAMP('ln(1 + mutation_evidence) / ln(13)', 0.0, 1.0)} AS mut, {_CLAMP('ln(1 + cancer_evidence) / ln(17)', 0.0, 1.0)} AS can, {_CLAMP('confidence_sum / total_evidence', 0.0, 1.0)} AS mean FROM evidence),
c AS (SELECT *, {_CLAMP('(1 - exp(-1.8 * (0.5 * lit + 0.3 * mut + 0.2 * can))) * least(1.0, 0.7 + 0.1 * ((lit >= 0.12)::INT + (mut >= 0.12)::INT + (can >= 0.12)::INT))', 0.0, 0.98)} AS composite_score FROM n),
scored AS (SELECT *, {_CLAMP('composite_score * (0.5 + 0.5 * mean)', 0.0, 0.95)} AS adjusted_score FROM c)"""

_CONFLICTS = "conflicts AS (SELECT id, CASE sample_size % 3 WHEN 0 THEN 0.2 WHEN 1 THEN 0.5 ELSE 0.9 END AS net FROM facts WHERE object_id IN ('C1', 'C2'))"
#: A fact that conflicts with itself counts at both ends, so it is disputed twice.
_CANDIDATES = f"""{A.SIGNAL}, {_CONFLICTS},
gate AS (SELECT id, min(net) AS least, 2 * count(*) FILTER (net <= 0.6) AS disputes FROM conflicts GROUP BY 1),
own AS (SELECT s.*, coalesce(disputes, 0) AS disputes, least(greatest(confidence * 0.7 ** coalesce(disputes, 0), 0.0), 1.0) AS c, signal_weight AS w, lower(coalesce(evidence, '')) AS t FROM signal s LEFT JOIN gate USING (id) WHERE coalesce(least, 1) >= 0.3),
kinds AS (SELECT *, contains(predicate, 'mutation') AS is_mut, contains(predicate, 'prognosis') AS is_surv, contains(predicate, 'upregulat') AS is_expr, contains(predicate, 'inhibit') AS is_inh, regexp_matches(t, 'poor|worse|decreased|shorter|reduced') AS poor, regexp_matches(t, 'improved|better|longer|favorable|increased') AS better,
  regexp_matches(t, 'normal|healthy|non-tumor|adjacent') AS normal FROM own),
cand AS (SELECT subject_id, min(subject_name) AS gene, count(*) AS fact_count, round(sum(w), 9) AS evidence_w, round(sum(c), 9) AS confidence_sum, round(sum(least(greatest(c * w, 0.0), 1.0)), 9) AS confidence_w, count(*) FILTER (provenance = 'provider') AS provider_facts, count(*) FILTER (tier = 'high') AS high_facts,
  count(DISTINCT paper_id) AS n_papers, bool_or(disputes > 0) AS disputed, sum(sample_size) FILTER (sample_size > 0) AS sample_sum, count(*) FILTER (sample_size > 0) AS sample_obs,
  round(coalesce(sum(w) FILTER (is_mut), 0), 9) AS mutation_w, round(coalesce(sum(w) FILTER (is_surv), 0), 9) AS survival_w, round(coalesce(sum(w) FILTER (is_inh), 0), 9) AS inhibitor_w, round(coalesce(sum(w) FILTER (is_surv AND poor), 0), 9) AS survival_negative_w, round(coalesce(sum(w) FILTER (is_surv AND NOT poor AND better), 0), 9) AS survival_positive_w,
  round(coalesce(sum(w) FILTER (is_expr AND normal), 0), 9) AS expression_normal_w, round(coalesce(sum(w) FILTER (is_expr AND NOT normal), 0), 9) AS expression_tumor_w, round(sum(w), 9) AS cancer_w FROM kinds GROUP BY 1),
codes AS (SELECT subject_id, upper(object_name) AS code, count(*) AS n FROM own GROUP BY 1, 2),
mode AS (SELECT subject_id, arg_min(code, (-n, code)) AS cancer_code FROM codes GROUP BY 1),
candidates AS (SELECT * FROM cand LEFT JOIN mode USING (subject_id))"""
_METRICS = f"""{_CANDIDATES},
m0 AS (SELECT *, least(greatest(least(greatest(confidence_w / evidence_w, 0.0), 1.0) + CASE WHEN provider_facts > 0 THEN 0.02 ELSE 0 END + CASE WHEN high_facts > 0 THEN 0.02 ELSE 0 END, 0.0), 1.0) AS mean_confidence, greatest(evidence_w, 1.0) AS ev FROM candidates),
metrics AS (SELECT *, least(greatest(mutation_w / ev, 0.0), 1.0) AS mutation_freq, greatest(-2.0 * mean_confidence, -2.0) AS crispr_dependency,
  CASE WHEN survival_w > 0 THEN least(greatest(((survival_positive_w - survival_negative_w) / survival_w + 1) / 2, 0.0), 1.0) WHEN sample_obs > 0 THEN least(ln(1 + sample_sum / sample_obs), 10.0) / 10 ELSE mean_confidence END AS survival_correlation,
  CASE WHEN expression_tumor_w + expression_normal_w > 0 THEN least(greatest((expression_tumor_w + 1) / (expression_normal_w + 1), 0.5), 5.0) ELSE least(greatest(1 + 4 * cancer_w / ev, 0.5), 5.0) END AS expression_specificity,
  0 AS pdb_structure_count, 45 + 20 * mean_confidence AS af_plddt_mean, 0.2::DOUBLE AS fpocket_best_score, round(inhibitor_w)::BIGINT AS chembl_inhibitor_count, 0 AS reactome_escape_pathway_count, 1 / (1 + ln(1 + ev)) AS literature_novelty_velocity FROM m0)"""
_COHORT = f"""{_METRICS},
r AS (SELECT *, row_number() OVER (ORDER BY round(mutation_freq, 9), gene) / count(*) OVER () AS n1, 1 - (crispr_dependency + 2) / 2 AS n2, row_number() OVER (ORDER BY round(survival_correlation, 9), gene) / count(*) OVER () AS n3,
  row_number() OVER (ORDER BY round(expression_specificity, 9), gene) / count(*) OVER () AS n4, 0.35 * af_plddt_mean / 100 + 0.25 * fpocket_best_score AS n5, fpocket_best_score AS n6, 1 / (1 + chembl_inhibitor_count) AS n7, 1.0 AS n8, row_number() OVER (ORDER BY round(literature_novelty_velocity, 9), gene) / count(*) OVER () AS n9,
  CASE WHEN chembl_inhibitor_count > 50 THEN 0.15 ELSE 0 END::DOUBLE + CASE WHEN expression_specificity < 1.5 THEN 0.10 ELSE 0 END + CASE WHEN af_plddt_mean < 50 THEN 0.08 ELSE 0 END AS penalty FROM metrics),
s0 AS (SELECT *, least(greatest(0.20 * n1 + 0.18 * n2 + 0.15 * n3 + 0.12 * n4 + 0.12 * n5 + 0.08 * n6 + 0.07 * n7 + 0.05 * n8 + 0.03 * n9 - penalty, 0.0), 1.0) AS base, (n1 >= 0.15)::INT + (n2 >= 0.15)::INT + (n3 >= 0.15)::INT + (n4 >= 0.15)::INT + (n5 >= 0.15)::INT + (n6 >= 0.15)::INT + (n7 >= 0.15)::INT + (n8 >= 0.15)::INT + (n9 >= 0.15)::INT AS k FROM r),
s1 AS (SELECT *, least((1 - exp(-1.6 * base)) * least(0.72 + 0.03 * k, 1.0), 0.98) AS composite_score FROM s0),
s2 AS (SELECT *, least(composite_score * (0.55 + 0.45 * mean_confidence), 0.95) AS adjusted_score FROM s1),
ranked AS (SELECT *, row_number() OVER (ORDER BY round(composite_score, 9) DESC, round(adjusted_score, 9) DESC, gene) AS rank, count(*) OVER () AS total FROM s2)"""

_NUMBERS = ["evidence_w", "confidence_sum", "confidence_w", "mutation_w", "survival_w", "inhibitor_w", "survival_negative_w", "survival_positive_w", "expression_normal_w", "expression_tumor_w", "cancer_w"]


def _genes(s, d):
    return A.table(s, d, "part").select(F.concat(F.lit("G"), "p_partkey").alias("symbol"))


def _scores(s, d):
    """A score table of two versions for customers' nations."""
    o = A.table(s, d, "orders").join(A.table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    own = o.groupBy(F.col("c_mktsegment").alias("gene_id"), F.concat(F.lit("C"), "c_nationkey").alias("cancer_id")).agg((F.avg("o_totalprice") / 600000).alias("composite_score"), F.count("*").alias("n"))
    return own.select("gene_id", "cancer_id", F.lit(1).cast("long").alias("score_version"), F.lit(True).alias("is_current"), "composite_score", (F.col("composite_score") * 0.9).alias("confidence_adjusted_score"), "n")


def _upserted(s, d):
    table = _scores(s, d)
    fresh = table.where("n % 2 = 0").withColumn("composite_score", F.col("composite_score") + 0.1)
    return P.upsert_scores(table, fresh)


_SCORES = "scores AS (SELECT c_mktsegment AS gene_id, concat('C', c_nationkey) AS cancer_id, avg(o_totalprice) / 600000 AS composite_score, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"


def _molecules(s, d):
    p = A.table(s, d, "part")
    return p.select(F.col("p_partkey").cast("string").alias("id"), (F.col("p_retailprice") / 3).alias("mw"), (F.col("p_size") / 8.0).alias("logp"), (F.col("p_size") % 9).alias("hbd"), (F.col("p_size") % 14).alias("hba"), (-F.col("p_retailprice") / 200).alias("docking_score"))


def _resolved(s, d):
    a = A.signals(s, d)
    exact = a.where("profiled % 3 > 0").withColumn("fetched_at", F.when(F.col("profiled") % 3 == 1, F.lit("2024-01-25").cast("timestamp")).otherwise(F.lit("2023-01-01").cast("timestamp")))
    other = a.where("profiled % 2 = 0").withColumn("value", F.col("value") / 2)
    return P.resolve_signal(a.select(F.col("gene_symbol").alias("gene"), "cancer_code"), exact, other.withColumn("fetched_at", F.lit("2024-01-25").cast("timestamp")), A.AS_OF)


def _novelty(s, d):
    papers = A.papers(s, d).withColumn("citation_count", F.when(F.col("id").cast("int") % 2 == 0, F.col("id").cast("long")))
    pairs = papers.select(F.col("source").alias("gene"), F.col("id").alias("paper_id"))
    return P.literature_novelty(pairs, papers, A.AS_OF)


QUERIES = {
    "p_top_targets": lambda s, d: P.final_ranking(_round(P.evidence_score(P.gene_evidence(_facts(s, d))), "composite_score", "adjusted_score"), "adjusted_score", "composite_score", n=100).select("rank", "gene", "cancer_code", "total_evidence", "composite_score", "adjusted_score", "shortlist_tier", F.round("percentile", R).alias("percentile")),
    "p01_gene_evidence": lambda s, d: _round(P.gene_evidence(_facts(s, d)), "confidence_sum", n=4),
    "p02_evidence_score": lambda s, d: _round(P.evidence_score(P.gene_evidence(_facts(s, d))), "composite_score", "adjusted_score").select("gene", "composite_score", "adjusted_score", "shortlist_tier"),
    "p03_rescore": lambda s, d: _round(P.rescore(_facts(s, d), A.table(s, d, "part").where("p_size = 7").select(F.concat(F.lit("G"), "p_partkey"))), "adjusted_score").select("gene", "total_evidence", "adjusted_score"),
    "p04_candidates": lambda s, d: _round(_candidates(s, d), *_NUMBERS, n=9).select("gene", "cancer_code", "fact_count", "provider_facts", "high_facts", "n_papers", "disputed", "sample_obs", *_NUMBERS),
    "p05_proxy_metrics": lambda s, d: _round(P.proxy_metrics(_candidates(s, d)), "mean_confidence", "mutation_freq", "survival_correlation", "expression_specificity", "literature_novelty_velocity").select("gene", "mean_confidence", "mutation_freq", "survival_correlation", "expression_specificity", "literature_novelty_velocity", "chembl_inhibitor_count"),
    "p06_enrich": lambda s, d: _round(P.enrich(_genes(s, d), {"n_orders": (_lines(s, d), F.count_distinct("l_orderkey")), "best_price": (_lines(s, d), F.max("l_extendedprice"))}), "best_price"),
    "p07_resolve_signal": lambda s, d: _round(_resolved(s, d), "value"),
    "p08_literature_novelty": lambda s, d: _round(_novelty(s, d), "novelty"),
    "p09_dependency": lambda s, d: _round(P.dependency_statistics(*A.dependency(s, d)), "mean", "median", "min", "max"),
    "p09_top_dependencies": lambda s, d: P.top_dependencies(P.dependency_statistics(*A.dependency(s, d)), 5).select("cancer_code", "gene", "rank"),
    "p10_normalise": lambda s, d: _round(P.minmax_normalise(P.rank_normalise(A.table(s, d, "customer").select("c_custkey", "c_acctbal", F.floor(F.col("c_acctbal") / 100).alias("b"), "c_nationkey"), "b", "r", by=["c_nationkey"]), "c_acctbal", "m", by=["c_nationkey"]), "r", "m").select("c_custkey", "r", "m"),
    "p11_cohort_scores": lambda s, d: _round(P.cohort_scores(P.proxy_metrics(_candidates(s, d))), "n1", "n2", "n3", "n4", "n5", "n7", "n9", "penalty", "composite_score").select("gene", "n1", "n2", "n3", "n4", "n5", "n7", "n9", "penalty", "composite_score"),
    "p12_p16_ranked_targets": lambda s, d: _round(P.ranked_targets(_facts(s, d), _conflicts(s, d), n=200), "composite_score", "adjusted_score", "percentile").select("rank", "gene", "cancer_code", "composite_score", "adjusted_score", "percentile", "shortlist_tier", F.array_join("flags", ",").alias("flags")),
    "p18_upsert_scores": lambda s, d: _round(_upserted(s, d), "composite_score", "confidence_adjusted_score").drop("n"),
    "p18_current_scores": lambda s, d: _round(P.current_scores(_upserted(s, d)), "composite_score").select("gene_id", "cancer_id", "score_version", "composite_score"),
    "p19_tier_counts": lambda s, d: P.tier_counts(P.ranked_targets(_facts(s, d), _conflicts(s, d))),
    "p20_recalibrate": lambda s, d: _round(P.recalibrate(_scores(s, d).withColumn("confidence_adjusted_score", F.when(F.col("n") % 2 == 0, 0.95).otherwise(0.4)), _scores(s, d).groupBy("gene_id").agg(F.sum("n").alias("n_facts"))), "confidence_adjusted_score").select("gene_id", "cancer_id", "confidence_adjusted_score"),
    "p22_cache_report": lambda s, d: _round(P.cache_report(A.signals(s, d).select(F.col("gene_symbol").alias("gene")), A.signals(s, d).select("gene_symbol", F.col("cancer_code").alias("source"), "value", "fetched_at"), A.table(s, d, "nation").select(F.concat(F.lit("C"), "n_nationkey")), A.AS_OF), "value"),
    "p23_mutation_frequency": lambda s, d: _round(P.mutation_frequency(A.table(s, d, "lineitem").join(A.table(s, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select(F.concat(F.lit("G"), F.col("l_partkey") % 100).alias("gene"), F.concat(F.lit("C"), "s_nationkey").alias("cancer_code"), F.col("l_orderkey").alias("sample")), A.signals(s, d).groupBy("cancer_code").agg(F.sum("profiled").alias("profiled"))), "frequency"),
    "p24_molecules": lambda s, d: _round(P.score_molecules(_molecules(s, d)), "qed", "composite").select("id", "violations", "qed", "composite", F.col("rank").cast("int").alias("rank")),
    "p25_system_metrics": lambda s, d: _round(P.system_metrics(P.ranked_targets(_facts(s, d), _conflicts(s, d)), _facts(s, d)), "value", n=5),
    "s03_delete_by_key": lambda s, d: S.delete_by_key(A.table(s, d, "orders"), A.table(s, d, "customer").where("c_acctbal < 0").select("c_custkey"), "o_custkey").groupBy("o_orderstatus").agg(F.count("*").alias("n")),
    "s04_upsert": lambda s, d: _round(S.upsert(A.signals(s, d), A.signals(s, d).withColumn("value", F.lit(0.5)).withColumn("gene_symbol", F.when(F.col("profiled") % 3 == 0, F.concat("gene_symbol", F.lit("-new"))).otherwise(F.col("gene_symbol"))), ["gene_symbol", "cancer_code"]), "value").select("gene_symbol", "cancer_code", "value"),
    "s14_newest_runs": lambda s, d: S.retain_newest(A.table(s, d, "events").select(F.col("ts").alias("recorded_at"), F.col("event_id").cast("string").alias("query")), 400).select("query"),
}


def _lines(s, d):
    return A.table(s, d, "lineitem").withColumn("symbol", F.concat(F.lit("G"), "l_partkey"))


_TIER = "CASE WHEN chembl_inhibitor_count > 50 AND n7 < 0.2 THEN 'excluded' WHEN adjusted_score >= 0.65 AND mutation_freq > 0.05 AND n5 > 0.4 THEN 'primary' WHEN adjusted_score >= 0.5 THEN 'secondary' ELSE 'excluded' END"
ORACLE = {
    "p_top_targets": f"WITH {_EVIDENCE_SCORE}, r AS (SELECT *, row_number() OVER (ORDER BY round(adjusted_score, 6) DESC, round(composite_score, 6) DESC, gene) AS rank, count(*) OVER () AS total FROM scored) SELECT rank::INT AS rank, gene, cancer_code, total_evidence, round(composite_score, 6) AS composite_score, round(adjusted_score, 6) AS adjusted_score, CASE WHEN adjusted_score >= 0.65 THEN 'primary' WHEN adjusted_score >= 0.5 THEN 'secondary' ELSE 'excluded' END AS shortlist_tier, round(100.0 * (1 - (rank - 1) / total), 6) AS percentile FROM r WHERE rank <= 100",
    "p01_gene_evidence": f"WITH {_EVIDENCE} SELECT gene_id, gene, total_evidence, mutation_evidence, cancer_evidence, round(confidence_sum, 4) AS confidence_sum, cancer_code FROM evidence",
    "p02_evidence_score": f"WITH {_EVIDENCE_SCORE} SELECT gene, round(composite_score, 6) AS composite_score, round(adjusted_score, 6) AS adjusted_score, CASE WHEN adjusted_score >= 0.65 THEN 'primary' WHEN adjusted_score >= 0.5 THEN 'secondary' ELSE 'excluded' END AS shortlist_tier FROM scored",
    "p03_rescore": f"WITH {_EVIDENCE_SCORE} SELECT gene, total_evidence, round(adjusted_score, 6) AS adjusted_score FROM scored WHERE gene IN (SELECT concat('G', p_partkey) FROM part WHERE p_size = 7)",
    "p04_candidates": f"WITH {_CANDIDATES} SELECT gene, cancer_code, fact_count, provider_facts, high_facts, n_papers, disputed, sample_obs, {', '.join(f'round({c}, 9) AS {c}' for c in _NUMBERS)} FROM candidates",
    "p05_proxy_metrics": f"WITH {_METRICS} SELECT gene, {', '.join(f'round({c}, 6) AS {c}' for c in ('mean_confidence', 'mutation_freq', 'survival_correlation', 'expression_specificity', 'literature_novelty_velocity'))}, chembl_inhibitor_count FROM metrics",
    "p06_enrich": "SELECT concat('G', p_partkey) AS symbol, count(DISTINCT l_orderkey) AS n_orders, round(coalesce(max(l_extendedprice), 0), 6) AS best_price FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY 1",
    "p07_resolve_signal": f"WITH {A.SIGNALS}, e AS (SELECT * FROM signals WHERE profiled % 3 > 0), o AS (SELECT gene_symbol, cancer_code, value / 2 AS value, profiled FROM signals WHERE profiled % 2 = 0), ea AS (SELECT gene_symbol, arg_max((value, profiled % 3 = 1), (profiled, value)) AS b FROM e GROUP BY 1) SELECT s.gene_symbol AS gene, s.cancer_code, round(CASE WHEN e.profiled % 3 = 1 THEN e.value WHEN o.value IS NOT NULL THEN o.value WHEN e.value IS NOT NULL THEN e.value ELSE b[1] END, 6) AS value, CASE WHEN e.profiled % 3 = 1 THEN 'exact_a_fresh' WHEN o.value IS NOT NULL THEN 'exact_b_fresh' WHEN e.value IS NOT NULL THEN 'exact_a_stale' WHEN b[2] THEN 'any_a_fresh' ELSE 'any_a_stale' END AS origin FROM signals s LEFT JOIN e ON e.gene_symbol = s.gene_symbol AND e.cancer_code = s.cancer_code LEFT JOIN o ON o.gene_symbol = s.gene_symbol AND o.cancer_code = s.cancer_code LEFT JOIN ea ON ea.gene_symbol = s.gene_symbol",
    "p08_literature_novelty": f"WITH {A.PAPERS}, x AS (SELECT source AS gene, CASE WHEN id::INT % 2 = 0 THEN id::BIGINT END AS c, 1 / (1 + greatest(date_diff('day', published_at, TIMESTAMP '2024-02-01'), 0) / 365.0::DOUBLE) AS r FROM papers) SELECT gene, round(avg(0.55 * coalesce(1 / (1 + ln(1 + c)), r) + 0.45 * r), 6) AS novelty, bool_or(c IS NOT NULL) AS used_citations FROM x GROUP BY 1",
    "p09_dependency": f"WITH {A.DEPENDENCY} SELECT gene, cancer_code, count(*) AS n, round(avg(score), 6) AS mean, round(median(score), 6) AS median, round(min(score), 6) AS min, round(max(score), 6) AS max, count(*) FILTER (score < -1) AS strong, count(*) FILTER (score >= -1 AND score < -0.5) AS moderate, count(*) FILTER (score >= -0.5) AS weak FROM scores JOIN cell_lines USING (cell_line) GROUP BY 1, 2",
    "p09_top_dependencies": f"WITH {A.DEPENDENCY}, m AS (SELECT gene, cancer_code, avg(score) AS mean FROM scores JOIN cell_lines USING (cell_line) GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY cancer_code ORDER BY round(mean, 9), gene) AS rank FROM m) SELECT cancer_code, gene, rank::INT AS rank FROM r WHERE rank <= 5",
    "p10_normalise": "WITH x AS (SELECT c_custkey, c_nationkey AS k, c_acctbal AS v, floor(c_acctbal / 100) AS b FROM customer) SELECT c_custkey, round((2 * rank() OVER (PARTITION BY k ORDER BY b DESC) + count(*) OVER (PARTITION BY k, b) - 1) / 2 / count(*) OVER (PARTITION BY k), 6) AS r, round(CASE WHEN max(v) OVER w - min(v) OVER w < 1e-10 THEN 0.5 ELSE (v - min(v) OVER w) / (max(v) OVER w - min(v) OVER w) END, 6) AS m FROM x WINDOW w AS (PARTITION BY k)",
    "p11_cohort_scores": f"WITH {_COHORT} SELECT gene, {', '.join(f'round({c}, 6)::DOUBLE AS {c}' for c in ('n1', 'n2', 'n3', 'n4', 'n5', 'n7', 'n9', 'penalty', 'composite_score'))} FROM s1",
    "p12_p16_ranked_targets": f"WITH {_COHORT} SELECT rank::INT AS rank, gene, cancer_code, round(composite_score, 6) AS composite_score, round(adjusted_score, 6) AS adjusted_score, round(100.0 * (1 - (rank - 1) / total), 6) AS percentile, {_TIER} AS shortlist_tier, array_to_string(list_filter([CASE WHEN disputed THEN 'DISPUTED' END, CASE WHEN expression_specificity < 1.2 THEN 'WARNING_LOW_TUMOR_SPECIFICITY' END, CASE WHEN af_plddt_mean < 50 THEN 'WARNING_STRUCTURALLY_UNRESOLVED' END, CASE WHEN chembl_inhibitor_count > 50 AND n7 < 0.2 THEN 'HARD_EXCLUSION_SATURATED_TARGET' END], lambda x: x IS NOT NULL), ',') AS flags FROM ranked WHERE rank <= 200",
    "p18_upsert_scores": f"WITH {_SCORES} SELECT gene_id, cancer_id, 1::BIGINT AS score_version, n % 2 = 1 AS is_current, round(composite_score, 6) AS composite_score, round(composite_score * 0.9, 6) AS confidence_adjusted_score FROM scores UNION ALL SELECT gene_id, cancer_id, 2, true, round(composite_score + 0.1, 6), round(composite_score * 0.9, 6) FROM scores WHERE n % 2 = 0",
    "p18_current_scores": f"WITH {_SCORES} SELECT gene_id, cancer_id, CASE WHEN n % 2 = 0 THEN 2 ELSE 1 END::BIGINT AS score_version, round(CASE WHEN n % 2 = 0 THEN composite_score + 0.1 ELSE composite_score END, 6) AS composite_score FROM scores",
    "p19_tier_counts": f"WITH {_COHORT} SELECT {_TIER} AS shortlist_tier, count(*) AS n FROM ranked GROUP BY 1",
    "p20_recalibrate": f"WITH {_SCORES}, g AS (SELECT gene_id, sum(n) AS k FROM scores GROUP BY 1) SELECT gene_id, cancer_id, round(CASE WHEN n % 2 = 0 THEN 0.95 * (0.82 + 0.18 * k / (k + 12)) ELSE 0.4 END, 6)::DOUBLE AS confidence_adjusted_score FROM scores JOIN g USING (gene_id)",
    "p22_cache_report": f"WITH {A.SIGNALS}, e AS (SELECT gene, source FROM (SELECT DISTINCT gene_symbol AS gene FROM signals), (SELECT DISTINCT concat('C', n_nationkey) AS source FROM nation)) SELECT e.gene, e.source, round(value, 6) AS value, date_diff('day', fetched_at::DATE, DATE '2024-02-01')::INT AS age_days, CASE WHEN value IS NULL THEN 'missing' WHEN date_diff('day', fetched_at::DATE, DATE '2024-02-01') <= 14 THEN 'fresh' ELSE 'stale' END AS status FROM e LEFT JOIN signals ON gene_symbol = e.gene AND cancer_code = e.source",
    "p23_mutation_frequency": f"WITH {A.SIGNALS}, p AS (SELECT cancer_code, sum(profiled)::BIGINT AS profiled FROM signals GROUP BY 1) SELECT concat('G', l_partkey % 100) AS gene, concat('C', s_nationkey) AS cancer_code, count(DISTINCT l_orderkey) AS mutated, any_value(profiled) AS profiled, round(count(DISTINCT l_orderkey) / any_value(profiled), 6) AS frequency FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN p ON p.cancer_code = concat('C', s_nationkey) GROUP BY 1, 2",
    "p24_molecules": "WITH v AS (SELECT p_partkey::VARCHAR AS id, (p_retailprice / 3 > 500)::INT + (p_size / 8.0 > 5)::INT + (p_size % 9 > 5)::INT + (p_size % 14 > 10)::INT AS violations, -p_retailprice / 200 AS d FROM part), q AS (SELECT *, greatest(1 - 0.25::DOUBLE * violations, 0.0) AS qed FROM v), c AS (SELECT *, -d * qed - 2.5::DOUBLE * violations AS composite FROM q) SELECT id, violations, round(qed, 6) AS qed, round(composite, 6) AS composite, row_number() OVER (ORDER BY round(composite, 9) DESC, id)::INT AS rank FROM c",
    "p25_system_metrics": f"WITH {_COHORT}, x AS (SELECT count(*) AS t, avg(adjusted_score) AS a, (count(*) FILTER (({_TIER}) = 'primary') + 2.0) / (count(*) + 8) AS p, (SELECT count(*) FROM facts) AS f FROM ranked) SELECT 'n_targets' AS metric, round(t::DOUBLE, 5) AS value FROM x UNION ALL SELECT 'mean_adjusted', round(a, 5) FROM x UNION ALL SELECT 'primary_rate', round(p, 5) FROM x UNION ALL SELECT 'evidence_density', round(f / t, 5) FROM x",
    "s03_delete_by_key": "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) GROUP BY 1",
    "s04_upsert": f"WITH {A.SIGNALS} SELECT gene_symbol, cancer_code, round(CASE WHEN profiled % 3 = 0 THEN value ELSE 0.5 END, 6)::DOUBLE AS value FROM signals UNION ALL SELECT gene_symbol || '-new', cancer_code, 0.5::DOUBLE FROM signals WHERE profiled % 3 = 0",
    "s14_newest_runs": "SELECT event_id::VARCHAR AS query FROM events ORDER BY ts DESC, event_id::VARCHAR DESC LIMIT 400",
}
