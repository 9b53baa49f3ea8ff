"""Queries of genes in contexts: topics, profiles, features, links, and a ranking by a scorer of its own."""

from __future__ import annotations

from pyspark.sql import functions as F

from evispark.operators import genes as G
from evispark.operators import score as P
from evispark.plans import adapters as A
from evispark.plans import scoring
from evispark.plans import texts as Q

R = 6
#: Orders of the last years of the table count as recent.
RECENT = 10_000


def _documents(s, d):
    """Every document as a context with two genes."""
    gene = lambda name, n: F.concat(F.lit(name), F.col("doc_id") % n)
    when = F.timestamp_seconds(F.lit(1577836800) + F.col("doc_id") % 1400 * 86400)
    return Q._contexts(s, d).select(F.col("doc_id").alias("id"), "section", "terms", "score", F.array(gene("G", 50), gene("H", 7)).alias("genes"), when.alias("published_at"), F.when(F.col("doc_id") % 3 == 0, F.col("doc_id") % 10).alias("dedup_group"))


def _topics(s, d):
    found = G.topics(_documents(s, d), 12)
    return found.select("topic", "label", "size", F.round("mean_score", R).alias("mean_score"), F.array_join("terms", ",").alias("terms"), F.array_join("genes", ",").alias("genes"))


def _profiles(s, d):
    own = _documents(s, d)
    return G.gene_profiles(G.with_topics(own, G.topics(own, 12)), A.AS_OF)


def _lines(s, d):
    return A.table(s, d, "lineitem").join(A.table(s, d, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey")).withColumn("gene", F.concat(F.lit("G"), "l_partkey"))


def _features(s, d):
    """Genes as ranked, with orders as contexts of the parts in them."""
    own = _lines(s, d).groupBy("l_orderkey").agg(F.collect_set("gene").alias("genes"), F.max("l_shipdate").cast("timestamp").alias("published_at"), F.min("s_nationkey").alias("topic"))
    contexts = own.select(F.col("l_orderkey").alias("id"), "genes", "published_at", F.when(F.col("l_orderkey") % 4 == 0, F.col("l_orderkey")).alias("dedup_group"), "topic")
    ranked = P.ranked_targets(scoring._facts(s, d), scoring._conflicts(s, d))
    return G.gene_features(ranked, G.gene_profiles(contexts, A.AS_OF, RECENT))


def _links(s, d):
    sets = _lines(s, d).groupBy("gene").agg(F.collect_set("l_orderkey").alias("chunks"), F.collect_set("s_nationkey").alias("topics"))
    return G.gene_links(_features(s, d).join(sets, "gene", "left"), n=50)


def _by_novelty(cohort):
    return 0.7 * F.col("n9") + 0.3 * F.col("n7") - F.col("penalty")


P.register_scorer("novelty_first", _by_novelty)

QUERIES = {
    "r12_topics": _topics,
    "r14_profiles_with_topics": _profiles,
    "r17_gene_features": lambda s, d: _features(s, d).select("gene", F.posexplode(F.arrays_zip("features", "scaled")).alias("place", "v")).select("gene", "place", F.round("v.features", R).alias("value"), F.round("v.scaled", R).alias("scaled")),
    "r18_links_of_all_genes": lambda s, d: _links(s, d).withColumn("score", F.round("score", R)),
    "u02_ranking_by_scorer": lambda s, d: P.ranked_targets(scoring._facts(s, d), scoring._conflicts(s, d), scorer="novelty_first").select("gene", F.col("rank").cast("int").alias("rank"), F.round("composite_score", R).alias("composite_score")),
}

_DOCUMENTS = f"""k AS (SELECT doc_id, CASE WHEN trim(coalesce(source, '')) <> '' THEN lower(trim(source)) || '/' ELSE '' END || array_to_string({Q._FIRST_TERMS}, '/') AS label, n_chars / 1000 AS score,
  list_distinct(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda w: length(w) >= 3 AND w <> 'the' AND w NOT IN ({", ".join(f"'{w}'" for w in Q.T.CONTEXT_STOP_WORDS)}))) AS terms FROM documents),
contexts AS (SELECT * REPLACE (coalesce(nullif(rtrim(label, '/'), ''), 'mixed') AS label), [concat('G', doc_id % 50), concat('H', doc_id % 7)] AS genes FROM k),
top AS (SELECT label, count(*) AS size, avg(score) AS mean_score, row_number() OVER (ORDER BY count(*) DESC, round(avg(score), 9) DESC, label) - 1 AS topic FROM contexts GROUP BY label QUALIFY topic < 12)"""

_ORDERS = f"""{scoring._COHORT},
line AS (SELECT concat('G', l_partkey) AS gene, l_orderkey, l_shipdate, s_nationkey FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
context AS (SELECT l_orderkey, count(DISTINCT gene) AS n_genes, date_diff('day', max(l_shipdate), TIMESTAMP '{A.AS_OF}') <= {RECENT} AS recent, min(s_nationkey) AS topic, l_orderkey % 4 = 0 AS duplicate FROM line GROUP BY 1),
profile AS (SELECT gene, count(*)::DOUBLE AS n, (count(*) FILTER (recent))::DOUBLE AS n_recent, (count(*) FILTER (n_genes > 1))::DOUBLE AS n_shared, (count(*) FILTER (duplicate))::DOUBLE AS n_dup, count(DISTINCT topic)::DOUBLE AS n_topics
  FROM (SELECT DISTINCT gene, l_orderkey FROM line) JOIN context USING (l_orderkey) GROUP BY 1),
feature AS (SELECT gene, [composite_score, adjusted_score, mutation_freq, crispr_dependency, survival_correlation, expression_specificity, pdb_structure_count, af_plddt_mean, fpocket_best_score, chembl_inhibitor_count, reactome_escape_pathway_count, literature_novelty_velocity,
    n, n - n_shared, n_shared, n_recent / n, n_dup / n, n_topics]::DOUBLE[] AS raw FROM ranked JOIN profile USING (gene)),
scaled AS (SELECT gene, raw, list_transform([raw[1], raw[2], raw[3], -raw[4] / 2, (raw[5] + 1) / 2, raw[6] / 5, raw[7] / 10, raw[8] / 100, raw[9] / 3, raw[10] / 100, raw[11] / 25, raw[12], raw[13] / 8, raw[14] / 8, raw[15] / 8, raw[16], 1 - raw[17], raw[18] / 6], lambda x: least(greatest(x, 0.0), 1.0)) AS v FROM feature)"""

ORACLE = {
    "r12_topics": f"""WITH {_DOCUMENTS},
m AS (SELECT label, terms, genes FROM contexts SEMI JOIN top USING (label)),
t AS (SELECT label, term, row_number() OVER (PARTITION BY label ORDER BY times DESC, term) AS place FROM (SELECT label, term, count(*) AS times FROM (SELECT label, unnest(terms) AS term FROM m) GROUP BY 1, 2) QUALIFY place <= 3)
SELECT topic::INT AS topic, label, size, round(mean_score, 6) AS mean_score, coalesce((SELECT string_agg(term, ',' ORDER BY place) FROM t WHERE t.label = top.label), '') AS terms, (SELECT array_to_string(list_sort(list_distinct(flatten(list(genes)))), ',') FROM m WHERE m.label = top.label) AS genes FROM top""",
    "r14_profiles_with_topics": f"""WITH {_DOCUMENTS},
g AS (SELECT unnest(genes) AS gene, date_diff('day', TIMESTAMP '2020-01-01' + to_days((doc_id % 1400)::INT), TIMESTAMP '{A.AS_OF}') <= 365 AS recent, doc_id % 3 = 0 AS duplicate, topic FROM contexts LEFT JOIN top USING (label))
SELECT gene, count(*) AS n_chunks, count(*) FILTER (recent) AS n_recent, count(*) AS n_shared, count(*) FILTER (duplicate) AS n_duplicate, count(DISTINCT topic) AS n_topics FROM g GROUP BY 1""",
    "r17_gene_features": f"WITH {_ORDERS} SELECT gene, (unnest(range(1, 19)) - 1)::INT AS place, round(unnest(raw), 6) AS value, round(unnest(v), 6) AS scaled FROM scaled",
    "r18_links_of_all_genes": f"""WITH {_ORDERS},
sets AS (SELECT gene, list_distinct(list(s_nationkey)) AS topics, count(DISTINCT l_orderkey) AS chunks FROM line GROUP BY 1),
held AS (SELECT s.gene, v, topics, chunks FROM scaled s JOIN sets USING (gene)),
entry AS (SELECT DISTINCT gene, l_orderkey FROM line),
both_in AS (SELECT a.gene AS a, b.gene AS b, count(*) AS shared FROM entry a JOIN entry b ON a.l_orderkey = b.l_orderkey AND a.gene < b.gene GROUP BY ALL),
pair AS (SELECT x.gene AS a, y.gene AS b, list_cosine_similarity(x.v, y.v) AS c, coalesce(shared, 0) AS chunks, x.chunks + y.chunks - coalesce(shared, 0) AS all_chunks, len(list_intersect(x.topics, y.topics)) AS topics, len(x.topics) + len(y.topics) AS both_topics
  FROM held x JOIN held y ON x.gene < y.gene LEFT JOIN both_in ON a = x.gene AND b = y.gene),
told AS (SELECT a, b, round(0.70 * (c + 1) / 2 + 0.20 * chunks / all_chunks + 0.10 * topics / (both_topics - topics), 9) AS score, chunks AS shared_chunks, topics AS shared_topics FROM pair)
SELECT a, b, round(score, 6) AS score, shared_chunks, shared_topics::BIGINT AS shared_topics FROM told WHERE score >= 0.55 OR shared_chunks > 0 OR shared_topics > 0 ORDER BY told.score DESC, a, b LIMIT 50""",
    "u02_ranking_by_scorer": f"""WITH {scoring._COHORT}, novel AS (SELECT gene, mean_confidence, least(greatest(0.7 * n9 + 0.3 * n7 - penalty, 0.0), 1.0) AS c FROM s2),
told AS (SELECT gene, c, least(c * (0.55 + 0.45 * mean_confidence), 0.95) AS adjusted FROM novel)
SELECT gene, row_number() OVER (ORDER BY round(c, 9) DESC, round(adjusted, 9) DESC, gene)::INT AS rank, round(c, 6) AS composite_score FROM told""",
}
