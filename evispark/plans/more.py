"""Queries of operators that need derived inputs: names, files written from tables, chains of extraction and retrieval."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from evispark.functions.similarity import simhash_column
from evispark.operators import checks as C
from evispark.operators import dedup as D
from evispark.operators import extract as N
from evispark.operators import genes as G
from evispark.operators import ops as O
from evispark.operators import retrieve as X
from evispark.operators import score as P
from evispark.operators import text as T
from evispark.plans import adapters as A
from evispark.plans import texts as Q
from evispark.shared import work_dir
from evispark.sources import files, tables

R = 6


def _landed(spark, df, kind, **options):
    """df written as files in the shared folder, as a provider would land them."""
    path = f"{work_dir(spark)}/landed-{uuid.uuid4().hex}"
    df.write.options(**options).format(kind).save(path)
    return path


def _symbols(s, d):
    p = A.table(s, d, "part")
    rank = F.col("p_partkey") % 3
    return p.select(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("symbol"), F.col("p_brand").alias("approved"), F.when(rank == 0, "preferred").when(rank == 1, "alias").otherwise("previous").alias("tier"), rank.alias("tier_rank"))


def _nations(s, d):
    return A.table(s, d, "nation").select(F.col("n_name").alias("synonym"), F.concat(F.lit("C"), "n_nationkey").alias("code"))


def _chunk_genes(s, d):
    found = Q._mentions(s, d).where("entity_type = 'gene'")
    return found.groupBy("doc_id", F.col("canonical").alias("gene")).agg(F.max("confidence").alias("confidence"))


def _relations(s, d):
    genes = N.top_genes(_chunk_genes(s, d), 4, "doc_id")
    built = N.build_facts(Q._docs(s, d), genes.select("doc_id", "gene"), "doc_id", "text", chemicals=["thorin", "station"], pathways=["tionth"], cell_lines=["ertion"])
    names = built.select(F.lit("gene").alias("entity_type"), F.col("gene").alias("name")).union(built.select(N.object_type(F.col("predicate"), F.col("object")), "object"))
    entities = N.resolve_entities(names, s.createDataFrame([], "id string, external_id string"))
    return N.relation_facts(built, genes, entities, "doc_id")


def _contexts(s, d):
    c = A.chunks(s, d)
    query = A.table(s, d, "embeddings").where("vec_id = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    hits = X.vector_search(c, query, 100).select("id", "score")
    genes = c.select("id", F.explode(F.slice(T.context_terms(F.col("content"), F.array(F.lit("the"))), 1, 5)).alias("gene"))
    return X.load_contexts(hits, c, A.papers(s, d), genes)


def _lexical_contexts(s, d):
    """The first 400 chunks that hold a term, copies of each other among them."""
    c = A.chunks(s, d)
    hits = X.substring_search(c, "tion", limit=400).select("id", (1.0 / F.col("rank")).alias("score"))
    return X.load_contexts(hits, c, A.papers(s, d), c.select("id", F.lit("the").alias("gene")), 400)


def _grouped(s, d):
    return _contexts(s, d).withColumn("dedup_group", F.when(F.col("paper_id").cast("long") % 3 == 0, F.col("paper_id"))).withColumn("section", F.lit("other"))


def _manifest(s, d):
    o = A.table(s, d, "orders")
    return o.select((F.col("o_custkey") % 50).cast("string").alias("snapshot_id"), F.col("o_orderpriority").alias("name"), (F.col("o_orderkey") % 9).alias("rows"), (F.col("o_orderkey") % 7 - 1).alias("bytes"), F.when(F.col("o_orderkey") % 5 > 0, F.sha2(F.col("o_orderkey").cast("string"), 256)).alias("sha256"))


def _matrix(s, d):
    scores, _ = A.dependency(s, d)
    wide = scores.withColumn("gene", F.concat("gene", F.lit(" (7)"))).groupBy("cell_line").pivot("gene", [f"G{i} (7)" for i in range(200)]).agg(F.first("score"))
    return files.read_dependency_matrix(s, _landed(s, wide, "csv", header=True))


def _frequencies(s, d):
    own = A.signals(s, d).select(F.col("gene_symbol").alias("Gene"), F.col("cancer_code").alias("Cancer Type"), F.col("mutated").alias("Mutated Samples"), F.col("profiled").alias("Total Samples"))
    return files.read_mutation_frequencies(s, _landed(s, own, "csv", header=True, sep="\t"))[0]


def _payloads(s, d):
    item = F.struct(F.col("gene_symbol").alias("gene"), F.col("cancer_code").alias("cancer"), F.col("mutated").cast("string").alias("mutated"), F.col("profiled").cast("string").alias("profiled"))
    return A.signals(s, d).groupBy("gene_symbol").agg(F.to_json(F.struct(F.collect_list(item).alias("data"))).alias("payload")).select(F.col("gene_symbol").alias("key"), "payload")


def _works(s, d):
    own = Q._docs(s, d).select(F.concat(F.lit("10.1/"), "doc_id").alias("DOI"), F.array("text").alias("title"), F.concat(F.lit("<p>"), "source", F.lit("</p>")).alias("abstract"))
    return files.read_works(s, _landed(s, own, "json"))


def _snapshot(s, d):
    path = f"{work_dir(s)}/snapshot-{uuid.uuid4().hex}"
    return path, tables.export_snapshot({t: A.table(s, d, t) for t in ("nation", "customer", "orders")}, path)


def _changed(s, d):
    """A check of a snapshot of which one table got rows again after the export."""
    path, manifest = _snapshot(s, d)
    A.table(s, d, "customer").limit(1).write.mode("append").json(f"{path}/customer")
    return tables.check_snapshot(s, path, manifest)


def _imported(s, d):
    path, _ = _snapshot(s, d)
    good, bad = tables.import_snapshot(s, f"{path}/customer", A.table(s, d, "customer").schema)
    return good.groupBy("c_mktsegment").agg(F.count("*").alias("n")).union(bad.agg(F.lit("bad"), F.count("*")))


def _appended(s, d):
    path, own = f"{work_dir(s)}/appended-{uuid.uuid4().hex}", A.table(s, d, "customer")
    for batch in (own.drop("c_acctbal"), own):
        tables.append(batch, path, own.schema)
    return tables.scan(s, path, own.schema).groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.count("c_acctbal").alias("n_balances"))


def _cell_lines(s, d):
    code = F.when(F.col("c_custkey") % 4 > 0, F.lower("c_mktsegment"))
    own = A.table(s, d, "customer").select(F.col("c_name").alias("Name"), code.alias("OncotreeCode"), F.col("c_custkey").alias("ModelID"))
    return files.read_cell_lines(s, _landed(s, own, "csv", header=True))


def _nomenclature(s, d):
    key = F.col("p_partkey")
    status = F.when(key % 3 > 0, "Approved").otherwise("Entry Withdrawn")
    own = A.table(s, d, "part").select(F.concat(F.lit("S"), key).alias("symbol"), status.alias("status"), F.concat("p_brand", F.lit("| "), "p_name").alias("alias_symbol"), F.concat(F.lit("s"), key + 1).alias("prev_symbol"))
    return files.read_symbols(s, _landed(s, own, "csv", header=True, sep="\t"))


def _ontology(s, d):
    """A tree for each order, with its lines as children."""
    root = F.concat(F.lit("O"), "l_orderkey")
    lines = A.table(s, d, "lineitem").select(root.alias("root"), *(F.col(c).cast("string").alias(n) for c, n in (("l_partkey", "name"), ("l_suppkey", "mainType"), ("l_linenumber", "tissue")))).distinct()
    code = F.concat_ws("-", "root", "name", "mainType", "tissue")
    child = F.struct(code.alias("code"), "name", "mainType", "tissue", F.col("root").alias("parent"))
    trees = lines.groupBy("root").agg(F.map_from_entries(F.collect_list(F.struct(code, child))).alias("children"))
    return files.ontology_rows(trees.select(F.to_json(F.create_map("root", F.struct(F.col("root").alias("code"), "children"))).alias("json")))


#: Texts without signs that XML gives a meaning or forbids.
PLAIN = "[^A-Za-z0-9 .,]"


def _articles(s, d):
    text = F.regexp_replace(F.coalesce("text", F.lit("")), PLAIN, " ")
    section = lambda title, *inside: F.concat(F.lit(f"<sec><title>{title}</title>"), *inside, F.lit("</sec>"))
    paragraph = lambda c: F.concat(F.lit("<p>"), c, F.lit("</p>"))
    key = F.col("doc_id").cast("string")
    body = F.concat(section("Methods", paragraph(key), section("Inner", paragraph(text), section("Innermost", paragraph(key)))), section("Results", paragraph(text)))
    xml = F.concat(F.lit("<article><front><abstract>"), paragraph(text), F.lit("</abstract></front><body>"), body, F.lit("</body></article>"))
    return files.article_sections(A.table(s, d, "documents").select("doc_id", xml.alias("xml")), id_col="doc_id")


def _components(s, d):
    sig = A.signals(s, d).select(F.col("gene_symbol").alias("gene"), "cancer_code", "value", "profiled")
    return P.provider_components(sig.select("gene", "cancer_code"), sig.select("gene", "cancer_code", (2 * F.col("value") - 1).alias("value")), sig.select("gene", "cancer_code", F.col("profiled").cast("double").alias("value")), sig.select("gene", "cancer_code", (-F.col("value")).alias("value")))


def _rerank(s, d):
    t = A.signals(s, d).groupBy(F.col("gene_symbol").alias("gene")).agg(F.avg("value").alias("score"))
    hits = A.signals(s, d).select(F.col("gene_symbol").alias("gene"), F.col("cancer_code").alias("chunk_id"), F.col("profiled").alias("rank"), F.col("value").alias("score"))
    return X.semantic_rerank(t, hits)


def _event_links(s, d):
    """Links between users by three counts, days and types of their events."""
    counts = Q._profiles(s, d).select("gene", F.array(*(F.col(c).cast("double") for c in ("n_chunks", "n_recent", "n_duplicate"))).alias("scaled"))
    sets = A.table(s, d, "events").groupBy(F.col("user_id").cast("string").alias("gene")).agg(F.collect_set(F.dayofyear("ts").cast("string")).alias("chunks"), F.collect_set("event_type").alias("topics"))
    return G.gene_links(counts.join(sets, "gene"))


TYPED = ("grew HCT116 and A-549 cells, MCF7 and MCF7", "in the MAPK signaling pathway of cells", "with Imatinib and Cisplatin", "the PI3K axis", "nothing")


def _ascii(s, d):
    """Documents whose characters beyond ASCII, which engines bound words by differently, are underscores."""
    return Q._docs(s, d).withColumn("text", F.regexp_replace("text", r"[^ -~\n]", "_"))


def _typed(s, d):
    own = _ascii(s, d).select("doc_id", Q.dealt("text", TYPED, "doc_id").alias("t"))
    found = lambda pattern, terms, least: F.array_join(N.typed_mentions(F.col("t"), pattern, terms, least), "|")
    return own.select("doc_id", found(N.CELL_LINE, ["ertion"], 3).alias("cell_lines"), found(N.PATHWAY, [], 6).alias("pathways"), found(N.CHEMICAL, ["thorin", "station"], 4).alias("chemicals"))


QUERIES = {
    "d04_simhash": lambda s, d: Q._docs(s, d).select("doc_id", simhash_column(F.col("text")).alias("simhash")),
    "d08_context_groups": lambda s, d: D.context_groups(_lexical_contexts(s, d).select("id", "terms", "vector", "score")).withColumn("max_similarity", F.round("max_similarity", R)),
    "n02_symbols": lambda s, d: N.resolve_symbols(A.table(s, d, "part").select("p_partkey", F.split_part("p_name", F.lit(" "), F.lit(2)).alias("name")), _symbols(s, d)),
    "n03_cancers": lambda s, d: N.normalise_cancers(A.table(s, d, "supplier").join(A.table(s, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.when(F.col("s_suppkey") % 2 == 0, F.col("n_name")).otherwise(F.concat(F.lit("old "), F.lower("n_name"), F.lit(" type"))).alias("name")), _nations(s, d)).select("s_suppkey", "code"),
    "n04_protein_changes": lambda s, d: A.table(s, d, "part").select("p_partkey", N.protein_change(F.concat(F.substring("p_name", 1, 1), "p_size", F.lit("d")))["hgvs_p"].alias("hgvs_p")),
    "n07_typed_mentions": lambda s, d: _typed(s, d),
    "n10_gene_candidates": lambda s, d: N.gene_candidates(_ascii(s, d).select("doc_id", F.col("text").alias("content"), F.col("source").alias("title")), Q._mentions(s, d), Q._docs(s, d).select("doc_id", F.col("source").alias("gene")), "doc_id"),
    "n11_stitched": lambda s, d: N.stitched_texts(Q._docs(s, d).select(F.col("source").alias("paper_id"), F.col("doc_id").alias("chunk_index"), F.col("text").alias("content")), A.table(s, d, "documents").where("source IN ('src1', 'src2')").select(F.col("source").alias("paper_id"))).select("paper_id", F.md5("content").alias("md5")),
    "n15_mention_facts": lambda s, d: N.mention_facts(A.mentions(s, d).select("paper_id", "entity_id", F.col("entity_id").alias("text"), F.lit(0.9).alias("confidence")), A.papers(s, d)).groupBy("paper_id").agg(F.count("*").alias("n"), F.min("subject_name").alias("subject")),
    "n16_relation_facts": lambda s, d: _relations(s, d),
    "n17_n18_labels": lambda s, d: A.table(s, d, "events").select(N.entity_label(F.concat(F.lit("B-"), F.when(F.col("event_type") == "view", "drug").when(F.col("event_type") == "error", "protein").otherwise(F.col("event_type")))).alias("label")).withColumn("predicate", N.default_predicate(F.col("label"), F.lit("gene"))).groupBy("label", "predicate").agg(F.count("*").alias("n")),
    "n20_symbols": lambda s, d: Q._docs(s, d).select("doc_id", N.contains_symbol(F.col("text"), F.lit("The")).alias("plain"), N.contains_symbol(F.col("text"), F.lit("of"), underscore=True).alias("strict")),
    "r04_chunk_search": lambda s, d: X.vector_search(A.chunks(s, d), Q._queries(s, d), 5),
    "r06_hybrid_search": lambda s, d: X.hybrid_search(A.chunks(s, d), A.papers(s, d), "tion", [1.0] * 64, 20, must="re").select("id", "score", "source", "rank", "title"),
    "r10_rerank": lambda s, d: _rerank(s, d).select("gene", F.round("boost", R).alias("boost"), F.round("reranked_score", R).alias("reranked_score"), F.col("rank").cast("int").alias("rank")),
    "r11_contexts": lambda s, d: _contexts(s, d).select("id", "paper_id", "score", F.col("published_at").cast("timestamp_ntz").alias("published_at"), F.array_join("genes", ",").alias("genes"), F.size("terms").alias("n_terms")),
    "r14_gene_profiles": lambda s, d: X.gene_profiles(_grouped(s, d), A.AS_OF),
    "r15_snippets": lambda s, d: X.snippets(_grouped(s, d)),
    "r18_gene_links": lambda s, d: _event_links(s, d).withColumn("score", F.round("score", R)),
    "p17_provider_components": lambda s, d: _components(s, d).select("gene", "cancer_code", F.round("survival", R).alias("survival"), F.round("expression", R).alias("expression"), F.round("dependency", R).alias("dependency")),
    "p21_literature_hits": lambda s, d: P.literature_hits(A.kg_facts(s, d), A.papers(s, d), "C3").select("id", "paper_id", "title", "confidence"),
    "o09_manifest_issues": lambda s, d: O.manifest_issues(_manifest(s, d), A.table(s, d, "orders").select("o_orderpriority").distinct()).groupBy("snapshot_id", "severity", "code").agg(F.count("*").alias("n")),
    "o11_decide": lambda s, d: O.decide(A.table(s, d, "customer").select(F.col("c_custkey").cast("string").alias("snapshot_id"), F.lit("pending").alias("status")), A.table(s, d, "orders").select(F.col("o_custkey").cast("string").alias("snapshot_id"), F.when(F.col("o_orderstatus") == "F", "approved").otherwise("rejected").alias("decision"), F.col("o_orderdate").alias("decided_at")))[1].groupBy(F.year("merged_at").alias("year")).agg(F.count("*").alias("n")),
    "s01_page_of_rows": lambda s, d: tables.scan(s, f"{d}/orders.parquet", A.table(s, d, "orders").schema, "o_orderkey", 200, 100).select("o_orderkey"),
    "s02_append": lambda s, d: _appended(s, d),
    "s05_export": lambda s, d: _snapshot(s, d)[1].select("name", "rows"),
    "s06_check": lambda s, d: tables.check_snapshot(s, *_snapshot(s, d)),
    "s06_changed": lambda s, d: _changed(s, d),
    "s07_import": lambda s, d: _imported(s, d),
    "s08_dependency_matrix": lambda s, d: _matrix(s, d).groupBy("gene").agg(F.count("*").alias("n"), F.round(F.sum("score"), R).alias("total")),
    "s09_cell_lines": lambda s, d: _cell_lines(s, d),
    "s10_mutation_frequencies": lambda s, d: _frequencies(s, d).withColumn("frequency", F.round("frequency", R)),
    "s11_api_candidates": lambda s, d: files.best_candidate(files.api_candidates(_payloads(s, d)), ["key"]).select("key", "mutated", "profiled", F.round("frequency", R).alias("frequency")),
    "s12_symbols": lambda s, d: _nomenclature(s, d),
    "s13_ontology": lambda s, d: _ontology(s, d),
    "s15_terms": lambda s, d: tables.term_list(s, ["Gene"], _landed(s, A.table(s, d, "part").select(F.col("p_name").alias("value")), "text"), "alpha, beta"),
    "s16_works": lambda s, d: _works(s, d).select("doi", "title", F.trim("abstract_text").alias("abstract")),
    "s17_article_sections": lambda s, d: _articles(s, d).select("doc_id", "ord", "section_type", "heading", F.length("text").alias("n_chars"), F.md5("text").alias("md5")),
}


def _leak_sql() -> str:
    q = lambda p: p.replace("'", "''")
    hit = {n: f"regexp_matches(text, '{q(p)}')" for n, p, _, _ in C.LEAK_PATTERNS}
    level = " ".join(f"WHEN {' OR '.join(hit[n] for n, _, s, _ in C.LEAK_PATTERNS if s == sev)} THEN '{sev}'" for sev in ("critical", "high", "medium"))
    blocked = " OR ".join(hit[n] for n, _, _, a in C.LEAK_PATTERNS if a == "block")
    total = " + ".join(f"len(regexp_extract_all(text, '{q(p)}'))" for _, p, _, _ in C.LEAK_PATTERNS)
    return f"SELECT ({blocked}) AS blocked, CASE {level} END AS max_severity, count(*) AS n, sum({total})::BIGINT AS n_leaks FROM (SELECT {Q.dealt_sql('text', Q.SECRETS, 'doc_id')} AS text FROM documents) GROUP BY 1, 2"


ORACLE = {
    "c01_leaks": _leak_sql(),
    "p21_literature_hits": f"""WITH {A.FACTS}, {A.PAPERS}, x AS (SELECT facts.id, paper_id, title, confidence, coalesce(trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')), '') AS k FROM facts JOIN papers ON papers.id = paper_id
  WHERE subject_id = 'C3' OR object_id = 'C3'), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY confidence DESC, id) AS n FROM x) SELECT id, paper_id, title, confidence FROM r WHERE n = 1 ORDER BY confidence DESC, id LIMIT 20""",
    "o11_decide": """WITH d AS (SELECT o_orderdate AS decided_at, CASE WHEN o_orderstatus = 'F' THEN 'approved' ELSE 'rejected' END AS decision, o_custkey FROM orders JOIN customer ON o_custkey = c_custkey),
r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY decided_at DESC, decision DESC) AS n FROM d) SELECT year(decided_at)::INT AS year, count(*) AS n FROM r WHERE n = 1 AND decision = 'approved' GROUP BY 1""",
    "n02_symbols": "WITH r AS (SELECT upper(split_part(p_name, ' ', 1)) AS k, p_brand AS approved, p_partkey % 3 AS t, row_number() OVER (PARTITION BY upper(split_part(p_name, ' ', 1)) ORDER BY p_partkey % 3, p_brand) AS n FROM part) SELECT p_partkey, split_part(p_name, ' ', 2) AS name, approved, CASE t WHEN 0 THEN 'preferred' WHEN 1 THEN 'alias' WHEN 2 THEN 'previous' END AS tier FROM part LEFT JOIN r ON k = upper(split_part(p_name, ' ', 2)) AND n = 1",
    "n03_cancers": "WITH x AS (SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN lower(n_name) ELSE 'old ' || lower(n_name) || ' type' END AS k FROM supplier JOIN nation ON s_nationkey = n_nationkey), s AS (SELECT lower(n_name) AS s, min(concat('C', n_nationkey)) AS c FROM nation GROUP BY 1) SELECT s_suppkey, coalesce((SELECT c FROM s WHERE s = k), (SELECT arg_min(c, (-length(s), c)) FROM s WHERE length(s) > 5 AND contains(k, s))) AS code FROM x",
    "n04_protein_changes": "SELECT p_partkey, CASE upper(substring(p_name, 1, 1)) " + " ".join(f"WHEN '{k}' THEN 'p.{v}' || p_size || 'Asp'" for k, v in N.AMINO_ACIDS.items() if k != "*") + " END AS hgvs_p FROM part",
    "n11_stitched": "WITH r AS (SELECT source, text, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents WHERE source NOT IN ('src1', 'src2')), k AS (SELECT *, sum(octet_length(encode(text)) + 1) OVER (PARTITION BY source ORDER BY n) - octet_length(encode(text)) - 2 AS before FROM r WHERE n <= 6) SELECT source AS paper_id, md5(string_agg(text, chr(10) ORDER BY n)) AS md5 FROM k WHERE before <= 24000 GROUP BY 1",
    "n15_mention_facts": "SELECT l_orderkey::VARCHAR AS paper_id, count(DISTINCT l_partkey) AS n, any_value(substring(text, 1, 80) || ' (J)') AS subject FROM lineitem JOIN documents ON doc_id = l_orderkey GROUP BY 1",
    "n17_n18_labels": "WITH l AS (SELECT CASE event_type WHEN 'view' THEN 'chemical' WHEN 'error' THEN 'gene' ELSE event_type END AS label FROM events) SELECT label, CASE label WHEN 'chemical' THEN 'targeted_by' ELSE 'associated_with' END AS predicate, count(*) AS n FROM l GROUP BY 1, 2",
    "n20_symbols": "SELECT doc_id, regexp_matches(' ' || lower(text) || ' ', '[^a-z0-9]the[^a-z0-9]') AS plain, regexp_matches(' ' || lower(text) || ' ', '[^a-z0-9_]of[^a-z0-9_]') AS strict FROM documents",
    "r10_rerank": f"WITH {A.SIGNALS}, t AS (SELECT gene_symbol AS gene, avg(value) AS s, least(0.2, 0.045 * (0.60 / min(profiled) + 0.25 * least(count(DISTINCT cancer_code) / 5, 1) + 0.15 * least(greatest(max(value), 0), 1))) AS b FROM signals GROUP BY 1) SELECT gene, round(b, 6) AS boost, round(least(s + b, 1), 6) AS reranked_score, row_number() OVER (ORDER BY round(least(s + b, 1), 9) DESC, gene)::INT AS rank FROM t",
    "p17_provider_components": f"WITH {A.SIGNALS} SELECT gene_symbol AS gene, cancer_code, round(value, 6) AS survival, round(least(greatest(profiled / ((sum(profiled) OVER w - profiled) / (count(*) OVER w - 1)) / 10, 0), 1), 6)::DOUBLE AS expression, round(1 - (2 - value) / 2, 6) AS dependency FROM signals WINDOW w AS (PARTITION BY gene_symbol)",
    "o09_manifest_issues": "WITH m AS (SELECT (o_custkey % 50)::VARCHAR AS s, o_orderpriority AS p, o_orderkey AS k FROM orders), i AS (SELECT s, 'error' AS v, 'bad_sha256' AS c FROM m WHERE k % 5 = 0 UNION ALL SELECT s, 'error', 'bad_bytes' FROM m WHERE k % 7 = 0 UNION ALL SELECT s, 'warning', 'empty_artifact' FROM m WHERE k % 9 = 0 UNION ALL SELECT s, 'error', 'duplicate_name' FROM (SELECT s, p FROM m GROUP BY 1, 2 HAVING count(*) > 1) UNION ALL SELECT a.s, 'error', 'missing_artifact' FROM (SELECT DISTINCT s FROM m) a, (SELECT DISTINCT p FROM m) b WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.s = a.s AND m.p = b.p)) SELECT s AS snapshot_id, v AS severity, c AS code, count(*) AS n FROM i GROUP BY 1, 2, 3",
    "s01_page_of_rows": "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 100 OFFSET 200",
    "s02_append": "SELECT c_mktsegment, 2 * count(*) AS n, count(c_acctbal) AS n_balances FROM customer GROUP BY 1",
    "s05_export": "SELECT 'nation' AS name, count(*) AS rows FROM nation UNION ALL SELECT 'customer', count(*) FROM customer UNION ALL SELECT 'orders', count(*) FROM orders",
    "s06_changed": "SELECT unnest(['nation', 'customer', 'orders']) AS name, unnest([true, false, true]) AS ok_bytes, unnest([true, false, true]) AS ok_sha256, unnest([true, false, true]) AS ok_rows",
    "s06_check": "SELECT unnest(['nation', 'customer', 'orders']) AS name, true AS ok_bytes, true AS ok_sha256, true AS ok_rows",
    "s07_import": "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1 UNION ALL SELECT 'bad', 0",
    "s08_dependency_matrix": f"WITH {A.DEPENDENCY} SELECT gene, count(*) AS n, round(sum(score), 6) AS total FROM scores GROUP BY 1",
    "s09_cell_lines": "SELECT c_custkey::VARCHAR AS cell_line, upper(c_mktsegment) AS cancer_code FROM customer WHERE c_custkey % 4 > 0",
    "s10_mutation_frequencies": f"WITH {A.SIGNALS} SELECT gene_symbol AS gene, cancer_code AS cancer, mutated, profiled, round(mutated / profiled, 6) AS frequency FROM signals",
    "s11_api_candidates": f"WITH {A.SIGNALS} SELECT gene_symbol AS key, b[3]::BIGINT AS mutated, b[1]::BIGINT AS profiled, round(b[2], 6) AS frequency FROM (SELECT gene_symbol, max([profiled, value, mutated]) AS b FROM signals GROUP BY 1)",
    "s12_symbols": """
WITH a AS (SELECT concat('S', p_partkey) AS approved, p_brand, p_name, concat('s', p_partkey + 1) AS prev FROM part WHERE p_partkey % 3 > 0),
r AS (
  SELECT approved, 0 AS tier_rank, 'preferred' AS tier, approved AS symbol FROM a
  UNION ALL SELECT approved, 1, 'alias', unnest([p_brand, trim(p_name)]) FROM a
  UNION ALL SELECT approved, 2, 'previous', prev FROM a
),
n AS (SELECT *, row_number() OVER (PARTITION BY upper(symbol) ORDER BY tier_rank, approved) AS n FROM r)
SELECT upper(symbol) AS symbol, approved, tier, tier_rank::INT AS tier_rank FROM n WHERE n = 1""",
    "s13_ontology": """
SELECT DISTINCT concat('O', l_orderkey) AS code, NULL::VARCHAR AS name, NULL::VARCHAR AS main_type, NULL::VARCHAR AS tissue, NULL::VARCHAR AS parent FROM lineitem
UNION ALL
SELECT DISTINCT concat_ws('-', concat('O', l_orderkey), l_partkey, l_suppkey, l_linenumber), l_partkey::VARCHAR, l_suppkey::VARCHAR, l_linenumber::VARCHAR, concat('O', l_orderkey) FROM lineitem""",
    "s15_terms": "SELECT term FROM (SELECT lower(trim(p_name)) AS term FROM part UNION SELECT unnest(['gene', 'alpha', 'beta']))",
    "s16_works": "SELECT concat('10.1/', doc_id) AS doi, text AS title, source AS abstract FROM documents",
    "s17_article_sections": f"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '{PLAIN}', ' ', 'g') AS text FROM documents),
s AS (
  SELECT doc_id, 0 AS ord, 'abstract' AS section_type, 'Abstract' AS heading, text FROM t
  UNION ALL SELECT doc_id, 1, 'methods', 'Methods', concat_ws(' ', doc_id, nullif(text, ''), doc_id) FROM t
  UNION ALL SELECT doc_id, 2, 'results', 'Results', text FROM t
)
SELECT doc_id, ord::INT AS ord, section_type, heading, length(text)::INT AS n_chars, md5(text) AS md5 FROM s WHERE trim(text) <> ''""",
}
