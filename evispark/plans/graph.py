"""Queries over facts (K)."""

from __future__ import annotations

from pyspark.sql import functions as F

from evispark.functions import rules
from evispark.operators import graph as G
from evispark.plans import adapters as A

R = 6


def _round(df, *columns):
    return df.withColumns({c: F.round(c, R) for c in columns})


def _facts(s, d):
    return A.kg_facts(s, d)


_EDGES = f"""{A.SIGNAL},
grouped AS (SELECT subject_name AS source, object_name AS target, predicate, count(*) AS weight, avg(least(greatest(confidence, 0.01), 1.0)) AS avg_confidence,
  count(*) FILTER (tier = 'high') AS h, count(*) FILTER (tier = 'medium') AS m, count(*) FILTER (tier = 'low') AS l, count(*) FILTER (provenance = 'provider') AS p, count(*) FILTER (provenance = 'extracted') AS x, count(*) FILTER (provenance = 'generic') AS g
  FROM signal WHERE subject_name <> object_name GROUP BY 1, 2, 3),
edges AS (SELECT source, target, predicate, weight, avg_confidence, CASE greatest(h, m, l) WHEN h THEN 'high' WHEN m THEN 'medium' ELSE 'low' END AS tier, CASE greatest(p, x, g) WHEN p THEN 'provider' WHEN x THEN 'extracted' ELSE 'generic' END AS provenance FROM grouped)"""
_SPECIFICITY = " ".join(f"WHEN '{k}' THEN {v}" for k, v in rules.PREDICATE_SPECIFICITY.items())
_SCORED = f"""{_EDGES},
degree AS (SELECT node, sum(weight) AS degree FROM (SELECT source AS node, weight FROM edges UNION ALL SELECT target, weight FROM edges) GROUP BY 1),
scored AS (SELECT e.*, a.degree AS source_degree, b.degree AS target_degree, least(greatest((0.58 * least(greatest(avg_confidence, 0.08), 1.0) + 0.42 * least(greatest(ln(1 + weight) / 3.6, 0.12), 1.0)) * CASE predicate {_SPECIFICITY} ELSE 1.0 END::DOUBLE
  * (1 / (1 + 0.62 * ln(1 + greatest(a.degree + b.degree, 1)))), 0.0), 2.5) * CASE tier WHEN 'high' THEN 1.16 WHEN 'low' THEN 0.82 ELSE 1.0 END AS score
  FROM edges e JOIN degree a ON a.node = source JOIN degree b ON b.node = target)"""


def _scored(s, d):
    return G.scored_edges(_facts(s, d))


def _small_graph(s, d):
    """Edges between nations and segments of customers, for walks."""
    c = A.table(s, d, "customer")
    return c.groupBy(F.concat(F.lit("S"), "c_mktsegment", (F.col("c_custkey") % 40).cast("string")).alias("source"), F.concat(F.lit("N"), "c_nationkey").alias("target")).agg(F.count("*").alias("weight"), F.avg("c_acctbal").alias("score")).withColumn("predicate", F.lit("in")).withColumn("avg_confidence", F.lit(0.5))


_SMALL = "g AS (SELECT concat('S', c_mktsegment, c_custkey % 40) AS source, concat('N', c_nationkey) AS target, count(*) AS weight, avg(c_acctbal) AS score FROM customer GROUP BY 1, 2)"



QUERIES = {
    "k01_facts_by_object": lambda s, d: G.find_facts(_facts(s, d), object_id="C3", predicate="inhibits").select("id", "subject_id", F.round("confidence", R).alias("confidence")),
    "k02_facts_of_set": lambda s, d: G.facts_of(_facts(s, d), A.table(s, d, "part").where("p_size > 45").select(F.concat(F.lit("G"), "p_partkey"))).select("id", "subject_id", "predicate"),
    "k03_search_facts": lambda s, d: G.search_facts(_facts(s, d), gene="g12", term="c1", predicate="activates").select("id", "subject_name", "object_name"),
    "k04_predicates": lambda s, d: G.predicates(_facts(s, d)),
    "k05_count_by_subject": lambda s, d: G.count_by_subject(_facts(s, d)),
    "k06_current_facts": lambda s, d: G.find_facts(_facts(s, d), current_only=True, as_of="1997-06-01").groupBy("predicate").agg(F.count("*").alias("n")),
    "k07_supersede": lambda s, d: _superseded(s, d),
    "k08_k10_fact_signal": lambda s, d: _round(G.with_signal(_facts(s, d)), "signal_weight", "confidence").groupBy("predicate", "provenance", "tier", "signal_weight").agg(F.count("*").alias("n"), F.round(F.sum("confidence"), 4).alias("confidence_sum")),
    "k11_predicate_groups": lambda s, d: G.filter_predicates(_facts(s, d), "mechanistic").groupBy("predicate").agg(F.count("*").alias("n")),
    "k12_high_tier": lambda s, d: G.filter_signal(G.with_signal(_facts(s, d)), tier="high", provenance="extracted").groupBy("object_name").agg(F.count("*").alias("n")),
    "k13_edges": lambda s, d: _round(G.edges(_facts(s, d)), "avg_confidence"),
    "k14_scored_edges": lambda s, d: _round(_scored(s, d), "avg_confidence", "score"),
    "k15_capped_edges": lambda s, d: G.cap_edges(_round(_small_graph(s, d), "score"), 12).select("source", "target", "weight", "score"),
    "k16_neighbourhood": lambda s, d: G.neighbourhood(_small_graph(s, d), A.table(s, d, "nation").where("n_nationkey = 3").select(F.concat(F.lit("n"), "n_nationkey")), 2),
    "k17_shortest_path": lambda s, d: G.shortest_path(_round(_small_graph(s, d), "score"), "N1", "N2").select("source", "target", "weight"),
    "k18_node_strength": lambda s, d: _round(G.node_strength(_scored(s, d)), "strength"),
    "k18_top_subgraph": lambda s, d: G.top_subgraph(_scored(s, d), 60).select("source", "target", "predicate", "weight"),
    "k19_node_sizes": lambda s, d: _round(G.node_sizes(_scored(s, d)), "size"),
    "k20_clusters": lambda s, d: G.clusters(_clustered(s, d)),
    "k21_cluster_links": lambda s, d: _round(G.cluster_links(_scored(s, d), _assignment(s, d)), "score", "confidence"),
    "k22_evidence_by_title": lambda s, d: G.evidence_by_title(_facts(s, d), A.papers(s, d)),
    "k23_entities": lambda s, d: G.find_entities(_entities(s, d), entity_type="SMALL", query="blue").select("id", "name"),
    "k24_suggest": lambda s, d: G.suggest(_facts(s, d), "g1", 20),
    "k25_statistics": lambda s, d: G.statistics(_facts(s, d)),
    "k26_conflicts": lambda s, d: G.conflicts(_facts(s, d)).groupBy("conflict_type", "resolution").agg(F.count("*").alias("n"), F.round(F.sum("net_confidence"), 3).alias("net")),
    "k27_contradiction_rate": lambda s, d: _round(G.contradiction_rate(_facts(s, d)), "rate"),
    "k28_noisy_or": lambda s, d: _round(G.noisy_or(_facts(s, d)), "confidence"),
    "k29_signed_confidence": lambda s, d: _round(G.signed_confidence(_facts(s, d).withColumn("signed", F.when(F.col("predicate") == "inhibits", -F.col("confidence")).otherwise(F.col("confidence"))), ["subject_id", "object_id"]), "net_confidence"),
    "k30_evidence_confidence": lambda s, d: _round(G.evidence_confidence(_modified(s, d)), "confidence").groupBy("confidence").agg(F.count("*").alias("n")),
    "k31_lethal_partners": lambda s, d: _round(G.lethal_partners(_facts(s, d).withColumn("predicate", F.when(F.col("predicate") == "inhibits", "synthetic_lethal_with").otherwise(F.col("predicate"))), "C7", 0.6), "confidence"),
    "k32_binding_evidence": lambda s, d: _round(G.binding_evidence(_facts(s, d)), "avg_confidence", "calibrated").drop("latest"),
    "k33_fact_brief": lambda s, d: G.fact_brief(_facts(s, d), "c5", 40),
    "k34_predicate_shares": lambda s, d: _round(G.predicate_shares(_facts(s, d)), "share", "generic_share"),
    "k35_signal_facts": lambda s, d: _round(G.signals_to_facts(A.signals(s, d).withColumn("source", F.lit("cosmic")), {"cosmic": ("mutation_frequency_cosmic", 0.5)}, A.AS_OF), "confidence").select("subject_name", "predicate", "object_name", "confidence"),
    "k36_papers_by_status": lambda s, d: G.count_by(G.update_status(A.papers(s, d), A.table(s, d, "documents").where("doc_id % 7 = 0").select(F.col("doc_id").cast("string").alias("id"), F.lit("updated").alias("parse_status"))), "parse_status"),
    "k37_mention_counts": lambda s, d: G.count_mentions(A.mentions(s, d)),
    "k38_conflicts_of_facts": lambda s, d: G.conflicts_of(G.conflicts(_facts(s, d)), _facts(s, d).where("subject_id = 'G5'").select("id")).groupBy("fact_id").agg(F.count("*").alias("n")),
}


def _superseded(s, d):
    facts = _facts(s, d)
    closed, events = G.supersede(facts, facts.where("subject_id = 'G9'").select("id"), A.AS_OF)
    return closed.groupBy(F.col("valid_until").isNull().alias("is_open")).agg(F.count("*").alias("n"))


def _clustered(s, d):
    """Orders joined to their customer: each customer a component."""
    return A.table(s, d, "orders").select(F.concat(F.lit("o"), "o_orderkey").alias("source"), F.concat(F.lit("c"), "o_custkey").alias("target"))


def _assignment(s, d):
    f = _facts(s, d)
    nodes = f.select(F.col("subject_name").alias("node")).union(f.select("object_name")).distinct()
    return nodes.select("node", (F.substring("node", 2, 9).cast("int") % 5).alias("cluster"))


def _entities(s, d):
    p = A.table(s, d, "part")
    return p.select(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("name"), F.split_part("p_type", F.lit(" "), F.lit(1)).alias("entity_type"), F.concat(F.lit("P:"), "p_partkey").alias("external_id"), F.split("p_name", " ").alias("synonyms"))


def _modified(s, d):
    n = A.table(s, d, "lineitem")
    k = F.col("l_orderkey")
    return n.select(F.when(k % 4 == 0, "experimental_in_vivo").when(k % 4 == 1, "text_mined").when(k % 4 == 2, "computational_ml").otherwise("database_assertion").alias("evidence_type"), (F.col("l_quantity") * 30).cast("int").alias("sample_size"), F.col("l_linenumber").alias("replicated_count"), (F.col("l_tax") * 200).alias("impact_factor"), (F.col("l_returnflag") == "R").alias("is_preprint"), (F.col("l_linestatus") == "O").alias("is_single_cell_line"), (k % 50 == 7).alias("is_retracted"))


ORACLE = {
    "k01_facts_by_object": f"WITH {A.FACTS} SELECT id, subject_id, round(confidence, 6) AS confidence FROM facts WHERE object_id = 'C3' AND predicate = 'inhibits'",
    "k02_facts_of_set": f"WITH {A.FACTS} SELECT id, subject_id, predicate FROM facts WHERE subject_id IN (SELECT concat('G', p_partkey) FROM part WHERE p_size > 45)",
    "k03_search_facts": f"WITH {A.FACTS} SELECT id, subject_name, object_name FROM facts WHERE contains(lower(subject_name), 'g12') AND (contains(lower(subject_name), 'c1') OR contains(lower(object_name), 'c1') OR contains(predicate, 'c1')) AND predicate = 'activates'",
    "k04_predicates": f"WITH {A.FACTS} SELECT DISTINCT predicate FROM facts",
    "k05_count_by_subject": f"WITH {A.FACTS} SELECT subject_id, count(*) AS n_facts FROM facts GROUP BY 1",
    "k06_current_facts": f"WITH {A.FACTS} SELECT predicate, count(*) AS n FROM facts WHERE valid_until IS NULL AND valid_from <= TIMESTAMP '1997-06-01' GROUP BY 1",
    "k07_supersede": f"WITH {A.FACTS} SELECT valid_until IS NULL AND subject_id <> 'G9' AS is_open, count(*) AS n FROM facts GROUP BY 1",
    "k08_k10_fact_signal": f"WITH {A.SIGNAL} SELECT predicate, provenance, tier, round(signal_weight, 6) AS signal_weight, count(*) AS n, round(sum(round(confidence, 6)), 4) AS confidence_sum FROM signal GROUP BY 1, 2, 3, 4",
    "k11_predicate_groups": f"WITH {A.FACTS} SELECT predicate, count(*) AS n FROM facts WHERE predicate IN {rules.MECHANISTIC} GROUP BY 1",
    "k12_high_tier": f"WITH {A.SIGNAL} SELECT object_name, count(*) AS n FROM signal WHERE tier = 'high' AND provenance = 'extracted' GROUP BY 1",
    "k13_edges": f"WITH {_EDGES} SELECT source, target, predicate, weight, round(avg_confidence, 6) AS avg_confidence, tier, provenance FROM edges",
    "k14_scored_edges": f"WITH {_SCORED} SELECT source, target, predicate, weight, round(avg_confidence, 6) AS avg_confidence, tier, provenance, source_degree::BIGINT AS source_degree, target_degree::BIGINT AS target_degree, round(score, 6) AS score FROM scored",
    "k16_neighbourhood": f"WITH {_SMALL}, b AS (SELECT source AS a, target AS b FROM g UNION SELECT target, source FROM g), h1 AS (SELECT DISTINCT b AS node FROM b WHERE a = 'N3'), h2 AS (SELECT DISTINCT b AS node FROM b WHERE a IN (SELECT node FROM h1)) SELECT node, min(hop)::INT AS hop FROM (SELECT 'N3' AS node, 0 AS hop UNION ALL SELECT node, 1 FROM h1 UNION ALL SELECT node, 2 FROM h2) GROUP BY 1",
    "k18_node_strength": f"WITH {_SCORED} SELECT node, round(sum(score), 6) AS strength FROM (SELECT source AS node, score FROM scored UNION ALL SELECT target, score FROM scored) GROUP BY 1",
    "k18_top_subgraph": f"WITH {_SCORED}, top AS (SELECT node FROM (SELECT node, round(sum(score), 9) AS s FROM (SELECT source AS node, score FROM scored UNION ALL SELECT target, score FROM scored) GROUP BY 1) ORDER BY s DESC, node LIMIT 60) SELECT source, target, predicate, weight FROM scored WHERE source IN (SELECT node FROM top) AND target IN (SELECT node FROM top)",
    "k19_node_sizes": f"WITH {_EDGES} SELECT node, count(*) AS degree, round(3.2 + 1.9 * ln(1 + count(*)), 6) AS size FROM (SELECT source AS node FROM edges UNION ALL SELECT target FROM edges) GROUP BY 1",
    "k20_clusters": "WITH m AS (SELECT concat('o', o_orderkey) AS node, o_custkey FROM orders UNION SELECT concat('c', o_custkey), o_custkey FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY node) AS i FROM m) SELECT min(node) AS component, count(*) AS n_nodes, string_agg(node, ', ' ORDER BY node) FILTER (i <= 3) AS label FROM r GROUP BY o_custkey ORDER BY n_nodes DESC, component LIMIT 40",
    "k21_cluster_links": f"WITH {_SCORED}, x AS (SELECT *, substring(source, 2)::INT % 5 AS p, substring(target, 2)::INT % 5 AS q FROM scored) SELECT least(p, q)::INT AS a, greatest(p, q)::INT AS b, sum(weight)::BIGINT AS weight, round(sum(score), 6) AS score, round(sum(avg_confidence), 6) AS confidence FROM x WHERE p <> q GROUP BY 1, 2",
    "k22_evidence_by_title": f"WITH {A.FACTS}, {A.PAPERS} SELECT trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) AS bucket, count(DISTINCT paper_id) AS n_papers, count(*) AS n_facts, min(paper_id) AS first_paper FROM facts JOIN papers ON papers.id = paper_id GROUP BY 1",
    "k23_entities": "SELECT p_partkey::VARCHAR AS id, p_name AS name FROM part WHERE split_part(p_type, ' ', 1) = 'SMALL' AND contains(lower(p_name), 'blue')",
    "k24_suggest": f"WITH {A.FACTS} SELECT name FROM (SELECT DISTINCT subject_name AS name FROM facts UNION SELECT object_name FROM facts) WHERE contains(lower(name), 'g1') AND length(name) BETWEEN 2 AND 48 ORDER BY length(name), name LIMIT 20",
    "k25_statistics": f"WITH {A.FACTS}, n AS (SELECT subject_name AS name FROM facts UNION SELECT object_name FROM facts) SELECT (SELECT count(*) FROM facts) AS n_facts, (SELECT count(DISTINCT predicate) FROM facts) AS n_predicates, count(*) AS n_entities, count(*) FILTER (regexp_matches(name, '^[A-Za-z0-9_-]{{1,16}}$') AND regexp_matches(name, '[A-Z]')) AS n_genes, count(*) FILTER (regexp_matches(name, '^[A-Z0-9]{{1,8}}$')) AS n_cancers FROM n",
    "k26_conflicts": f"WITH {A.FACTS}, p AS (SELECT DISTINCT least(a.id, b.id) AS x, greatest(a.id, b.id) AS y, a.confidence AS c, b.confidence AS e FROM facts a JOIN facts b ON a.subject_id = b.subject_id AND a.object_id = b.object_id AND a.predicate = 'inhibits' AND b.predicate = 'activates' AND a.id <> b.id), o AS (SELECT x, y, any_value(c) AS c, any_value(e) AS e FROM p GROUP BY 1, 2) SELECT 'directional' AS conflict_type, CASE WHEN c > 0.7 AND e > 0.7 THEN 'manual_review' ELSE 'unresolved' END AS resolution, count(*) AS n, round(sum(least(1.0, 0.7 * abs(c - e))), 3) AS net FROM o GROUP BY 1, 2",
    "k27_contradiction_rate": f"WITH {A.FACTS}, p AS (SELECT subject_id, object_id, bool_or(predicate = 'inhibits') AND bool_or(predicate = 'activates') AS hit FROM facts GROUP BY 1, 2) SELECT count(*) AS n_pairs, count(*) FILTER (hit) AS n_contradicting, round(count(*) FILTER (hit) / count(*), 6) AS rate FROM p",
    "k28_noisy_or": f"WITH {A.FACTS} SELECT subject_id, predicate, object_id, count(*) AS n, round(1 - product(1 - least(greatest(confidence, 0.0), 1.0)), 6) AS confidence FROM facts GROUP BY 1, 2, 3",
    "k29_signed_confidence": f"WITH {A.FACTS} SELECT subject_id, object_id, round(least(1.0, abs(sum(CASE WHEN predicate = 'inhibits' THEN -confidence ELSE confidence END)) * 0.7), 6) AS net_confidence FROM facts GROUP BY 1, 2",
    "k30_evidence_confidence": "WITH x AS (SELECT CASE l_orderkey % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.3 WHEN 2 THEN 0.5 ELSE 0.4 END::DOUBLE AS w, (l_quantity * 30)::INT AS n, l_linenumber AS r, l_tax * 200 AS i, l_returnflag = 'R' AS p, l_linestatus = 'O' AS c, l_orderkey % 50 = 7 AS z FROM lineitem) SELECT round(CASE WHEN z THEN 0.0 ELSE least(1.0, w * CASE WHEN n > 1000 THEN 1.2::DOUBLE ELSE 1 END * CASE WHEN r >= 2 THEN 1.15::DOUBLE ELSE 1 END * CASE WHEN i > 10 THEN 1.05::DOUBLE ELSE 1 END * CASE WHEN p THEN 0.7::DOUBLE ELSE 1 END * CASE WHEN c THEN 0.85::DOUBLE ELSE 1 END) END, 6) AS confidence, count(*) AS n FROM x GROUP BY 1",
    "k31_lethal_partners": f"WITH {A.FACTS} SELECT subject_name AS partner, round(max(confidence), 6) AS confidence FROM facts WHERE predicate = 'inhibits' AND object_name = 'C7' AND confidence >= 0.6 GROUP BY 1",
    "k32_binding_evidence": f"WITH {A.FACTS}, g AS (SELECT subject_name, predicate, object_name, count(*) AS n_evidence, avg(confidence) AS a, count(DISTINCT paper_id) AS n_papers FROM facts WHERE predicate IN ('inhibits', 'targets', 'binds') GROUP BY 1, 2, 3), c AS (SELECT *, round(least(greatest(0.68 * a + 0.20 * least(1.0, ln(1 + n_evidence) / ln(13)) + 0.12 * least(1.0, ln(1 + n_papers) / ln(9)), 0.0), 1.0), 9) AS k FROM g) SELECT subject_name, predicate, object_name, n_evidence, round(a, 6) AS avg_confidence, n_papers, round(k, 6) AS calibrated FROM c ORDER BY k DESC, subject_name, predicate, object_name LIMIT 250",
    "k33_fact_brief": f"WITH {A.FACTS} SELECT predicate, subject_name, object_name, count(*) AS n FROM facts WHERE contains(lower(subject_name), 'c5') OR contains(lower(object_name), 'c5') OR contains(predicate, 'c5') GROUP BY 1, 2, 3 ORDER BY n DESC, 1, 2, 3 LIMIT 40",
    "k34_predicate_shares": f"WITH {A.FACTS}, c AS (SELECT predicate, count(*) AS n FROM facts GROUP BY 1), t AS (SELECT *, sum(n) OVER () AS total, sum(CASE WHEN predicate IN ('mentions', 'associated_with') THEN n ELSE 0 END) OVER () / sum(n) OVER () AS g, count(*) OVER () AS k FROM c) SELECT predicate, n, round(n / total, 6) AS share, round(g, 6) AS generic_share, k < 6 OR g > 0.55 AS low_coverage FROM t",
    "k35_signal_facts": f"WITH {A.SIGNALS} SELECT gene_symbol AS subject_name, 'mutation_frequency_cosmic' AS predicate, cancer_code AS object_name, round(0.5 + 0.5 * least(greatest(value / 0.5, 0.0), 1.0), 6) AS confidence FROM signals",
    "k36_papers_by_status": "SELECT CASE WHEN doc_id % 7 = 0 THEN 'updated' WHEN doc_id % 5 = 0 THEN 'failed' ELSE 'parsed' END AS parse_status, count(*) AS n FROM documents GROUP BY 1",
    "k37_mention_counts": "SELECT l_partkey::VARCHAR AS entity_id, count(*) AS n_mentions FROM lineitem GROUP BY 1",
    "k38_conflicts_of_facts": f"WITH {A.FACTS}, p AS (SELECT DISTINCT least(a.id, b.id) AS x, greatest(a.id, b.id) AS y FROM facts a JOIN facts b ON a.subject_id = b.subject_id AND a.object_id = b.object_id AND a.predicate = 'inhibits' AND b.predicate = 'activates' AND a.id <> b.id), e AS (SELECT x AS fact_id FROM p UNION ALL SELECT y FROM p) SELECT fact_id, count(*) AS n FROM e WHERE fact_id IN (SELECT id FROM facts WHERE subject_id = 'G5') GROUP BY 1",
}
