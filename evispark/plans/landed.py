"""Queries of readers over files that are written from the tables first, of rules in a table, and of hints."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from evispark.operators import checks as C
from evispark.operators import extract as N
from evispark.operators import graph as K
from evispark.plans import adapters as A
from evispark.plans import chains, graph, more, scoring
from evispark.plans import texts as Q
from evispark.shared import work_dir
from evispark.sources import files, tables

R = 6
LINES = 40


def _nested(s, d):
    """A market segment's candidates, half of them two payloads deeper than the rest, beside values of other kinds."""
    item = F.struct(F.col("gene_symbol").alias("gene"), F.col("cancer_code").alias("cancer"), "mutated", F.col("profiled").alias("n_samples"))
    deep = F.struct(F.struct(F.array(item).alias("items")).alias("payload"), F.lit("page").alias("kind"))
    own = A.signals(s, d).groupBy("gene_symbol").agg(F.collect_list(F.when(F.col("profiled") % 2 == 0, item)).alias("flat"), F.collect_list(F.when(F.col("profiled") % 2 == 1, deep)).alias("deep"))
    payload = F.concat(F.lit('{"count": 3, "next": null, "results": ['), F.to_json("flat"), F.lit(", "), F.to_json("deep"), F.lit(', "text", 7, {"data": null}]}'))
    return files.best_candidate(files.nested_candidates(own.select(F.col("gene_symbol").alias("key"), payload.alias("payload"))), ["key", "cancer"])


def _log(s, d):
    own = A.table(s, d, "events").select(F.col("ts").alias("recorded_at"), F.col("event_id").cast("string").alias("query"))
    path = f"{work_dir(s)}/runs-{uuid.uuid4().hex}"
    for part in range(3):
        log = tables.append_runs(own.where(F.col("query").cast("long") % 3 == part), path)
    return log


def _texts(s, d):
    """Documents as publications: texts without signs that XML gives a meaning or forbids."""
    i = F.col("doc_id")
    return A.table(s, d, "documents").select(F.concat(F.lit("10.1/"), i).alias("doi"), i.cast("string").alias("pmid"), F.concat(F.lit("On "), "source").alias("title"), F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), more.PLAIN, " ")).alias("text"), F.date_format(F.timestamp_seconds(F.lit(1577836800) + i % 1400 * 86400), "yyyy-MM-dd").alias("day"))


def _pubmed(s, d):
    article = F.struct(F.struct(F.lit("J").alias("Title")).alias("Journal"), F.col("title").alias("ArticleTitle"), F.struct(F.array("text").alias("AbstractText")).alias("Abstract"))
    own = _texts(s, d).select(F.struct(F.col("pmid").alias("PMID"), article.alias("Article")).alias("MedlineCitation"), F.struct(F.struct(F.array("pmid", "doi").alias("ArticleId")).alias("ArticleIdList")).alias("PubmedData"))
    return files.read_pubmed(s, more._landed(s, own, "xml", rootTag="PubmedArticleSet", rowTag="PubmedArticle"))


def _atom(s, d):
    own = _texts(s, d).select(F.concat(F.lit("http://x.org/abs/"), "pmid").alias("id"), "title", F.col("text").alias("summary"), F.concat("day", F.lit("T00:00:00Z")).alias("published"))
    return files.read_atom(s, more._landed(s, own, "xml", rootTag="feed", rowTag="entry"))


def _json(s, d, read, *columns, **more_arguments):
    return read(s, more._landed(s, _texts(s, d).select(*columns), "json"), **more_arguments)


def _papers(df):
    return df.select("doi", "pmid", "title", F.md5(F.trim("abstract_text")).alias("abstract"), "journal", "source", F.date_format("published_at", "yyyy-MM-dd").alias("day"))


def _structures(s, d):
    """Each order as a structure: a line of an atom for each of its order lines, the quantity in the columns of confidence."""
    atom = F.concat(F.rpad(F.concat(F.lit("ATOM  "), F.lpad(F.col("l_linenumber").cast("string"), 5, " ")), 60, " "), F.lpad(F.format_number("l_quantity", 2), 6, " "), F.lit("           C"))
    own = A.table(s, d, "lineitem").select((F.col("l_orderkey") % LINES).cast("string").alias("part"), F.array(F.lit("HEADER"), atom, F.lit("TER")).alias("lines"))
    path = f"{work_dir(s)}/landed-{uuid.uuid4().hex}"
    own.select("part", F.explode("lines").alias("value")).repartition("part").write.partitionBy("part").text(path)
    return files.structure_confidence(s, f"{path}/*/*").select(F.regexp_extract("file", "part=([0-9]+)", 1).alias("part"), F.round("plddt", R).alias("plddt"))


def _pockets(s, d):
    line = F.concat(F.lit("Pocket "), "l_linenumber", F.when(F.col("l_linenumber") % 3 == 0, " Volume Score : ").otherwise(" Druggability Score : "), F.round(F.col("l_tax") * 20 + 0.05, 3).cast("string"))
    path = f"{work_dir(s)}/landed-{uuid.uuid4().hex}"
    A.table(s, d, "lineitem").select((F.col("l_orderkey") % LINES).cast("string").alias("part"), line.alias("value")).repartition("part").write.partitionBy("part").text(path)
    return files.pocket_scores(s, path).select(F.regexp_extract("folder", "part=([0-9]+)", 1).alias("part"), F.round("score", R).alias("score"))


def _rules(s, d):
    """A rule for each word of the benchmark."""
    words = A.table(s, d, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{5,}"), F.lit(0))).alias("w")).select(F.lower("w").alias("w")).distinct()
    n = F.length("w")
    return words.select(F.concat(F.lit("has_"), "w").alias("name"), F.concat(F.lit(r"(?i)\b"), "w", F.lit(r"(?:s|ed)?\b")).alias("pattern"), F.when(n % 3 == 0, "critical").when(n % 3 == 1, "high").otherwise("low").alias("severity"), F.when(n % 5 == 0, "block").otherwise("warn").alias("action"))


def _ruled(s, d):
    return C.scan_rules(Q._docs(s, d), _rules(s, d), "doc_id").select("doc_id", F.array_join("names", ",").alias("names"), "n", "max_severity", "blocked")


HINTS = ("the gene KRAS with G12D is mutated in cancer", "KRAS and V600E", "nothing")


def _hinted(s, d):
    """The chunks of a source are its documents; every source is hinted at KRAS, some have facts."""
    docs = Q._docs(s, d).select(F.col("source").alias("paper_id"), F.col("doc_id").alias("chunk_index"), Q.dealt("text", HINTS, "doc_id").alias("content"))
    known = docs.where("paper_id IN ('src1', 'src2')").select("paper_id")
    return N.stitched_facts(docs, known, docs.select("paper_id").distinct().withColumn("gene", F.lit(" kras "))).groupBy("paper_id", "predicate", "gene", "object").agg(F.max("confidence").alias("confidence"))


QUERIES = {
    "s11_nested_candidates": lambda s, d: _nested(s, d).withColumn("frequency", F.round("frequency", R)),
    "s13_patterns": lambda s, d: files.ontology_patterns(more._ontology(s, d)),
    "s14_append_runs": lambda s, d: _log(s, d).select("query"),
    "s16_pubmed": lambda s, d: _papers(_pubmed(s, d)),
    "s16_atom": lambda s, d: _papers(_atom(s, d)),
    "s16_europe_pmc": lambda s, d: _papers(_json(s, d, files.read_europe_pmc, "doi", "pmid", "title", F.col("text").alias("abstractText"), F.lit("J").alias("journalTitle"), F.col("day").alias("firstPublicationDate"))),
    "s16_trials": lambda s, d: _papers(_json(s, d, files.read_trials, F.struct(F.struct(F.col("pmid").alias("nctId"), F.col("title").alias("briefTitle")).alias("identificationModule"), F.struct(F.col("text").alias("briefSummary")).alias("descriptionModule"), F.struct(F.struct(F.col("day").alias("date")).alias("startDateStruct")).alias("statusModule")).alias("protocolSection"))),
    "s16_semantic": lambda s, d: _papers(_json(s, d, files.read_semantic, F.struct(F.col("doi").alias("DOI"), F.col("pmid").alias("PubMed")).alias("externalIds"), "title", F.col("text").alias("abstract"), F.lit("J").alias("venue"), F.col("day").alias("publicationDate"))),
    "s16_preprints": lambda s, d: _papers(_json(s, d, files.read_preprints, "doi", "title", F.col("text").alias("abstract"), F.col("day").alias("date"), keywords=["tion", "SRC1"], as_of="2022-06-01")),
    "s19_structure_confidence": _structures,
    "s20_pocket_scores": _pockets,
    "u03_rules_of_a_table": _ruled,
    "n11_stitched_facts": _hinted,
    "k16_first_nodes": lambda s, d: K.neighbourhood(graph._small_graph(s, d), A.table(s, d, "nation").where("n_nationkey = 3").select(F.concat(F.lit("n"), "n_nationkey")), 2, 60),
}

_DAY = "strftime(TIMESTAMP '2020-01-01' + to_days((doc_id % 1400)::INT), '%Y-%m-%d')"
_ABSTRACT = f"trim(regexp_replace(coalesce(text, ''), '{more.PLAIN}', ' ', 'g'))"


def _paper_sql(source: str, doi: bool = True, pmid: bool = True, journal: bool = True, day: bool = True, where: str = "") -> str:
    null = "NULL::VARCHAR"
    return f"SELECT {"concat('10.1/', doc_id)" if doi else null} AS doi, {'doc_id::VARCHAR' if pmid else null} AS pmid, 'On ' || source AS title, md5({_ABSTRACT}) AS abstract, {"'J'" if journal else null} AS journal, '{source}' AS source, {_DAY if day else null} AS day FROM documents{where}"


_RULES = r"""r AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[A-Za-z]{5,}'))) AS w FROM benchmark),
word AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[0-9a-z_]+'))) AS t FROM documents),
hit AS (SELECT DISTINCT doc_id, w FROM word JOIN r ON t IN (w, w || 's', w || 'ed'))"""

_STITCHED = f"""docs AS (SELECT source AS paper_id, doc_id, {Q.dealt_sql("text", HINTS, "doc_id")} AS text FROM documents WHERE source NOT IN ('src1', 'src2')),
r AS (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY doc_id) AS n FROM docs), k AS (SELECT *, sum(octet_length(encode(text)) + 1) OVER (PARTITION BY paper_id ORDER BY n) - octet_length(encode(text)) - 2 AS before FROM r WHERE n <= 6),
documents AS (SELECT paper_id AS doc_id, string_agg(text, chr(10) ORDER BY n) AS text FROM k WHERE before <= 24000 GROUP BY 1)"""

ORACLE = {
    "s11_nested_candidates": f"WITH {A.SIGNALS} SELECT gene_symbol AS key, cancer_code AS cancer, mutated, profiled, round(mutated / profiled, 6) AS frequency FROM signals",
    "s13_patterns": f"WITH o AS ({more.ORACLE['s13_ontology']}), p AS (SELECT lower(code) AS pattern, code, 'code' AS kind FROM o UNION ALL SELECT lower(name), code, 'name' FROM o WHERE name <> '') SELECT pattern, min((kind, code))[2] AS code, min(kind) AS kind FROM p GROUP BY 1",
    "s14_append_runs": scoring.ORACLE["s14_newest_runs"],
    "s16_pubmed": _paper_sql("pubmed", day=False),
    "s16_atom": _paper_sql("arxiv", doi=False, journal=False),
    "s16_europe_pmc": _paper_sql("europepmc"),
    "s16_trials": _paper_sql("clinicaltrials", doi=False, journal=False),
    "s16_semantic": _paper_sql("semanticscholar"),
    "s16_preprints": _paper_sql("preprint", pmid=False, journal=False, where=f" WHERE (contains(lower({_ABSTRACT}), 'tion') OR contains('on ' || lower(source), 'src1') OR contains('on ' || lower(source), 'tion')) AND date_diff('day', TIMESTAMP '2020-01-01' + to_days((doc_id % 1400)::INT), TIMESTAMP '2022-06-01') BETWEEN 0 AND 730"),
    "s19_structure_confidence": f"SELECT (l_orderkey % {LINES})::VARCHAR AS part, round(least(greatest(avg(l_quantity), 0.0), 100.0), 6) AS plddt FROM lineitem GROUP BY 1",
    "s20_pocket_scores": f"SELECT (l_orderkey % {LINES})::VARCHAR AS part, round(least(max(round(l_tax * 20 + 0.05, 3)), 1.0), 6) AS score FROM lineitem WHERE l_linenumber % 3 <> 0 AND round(l_tax * 20 + 0.05, 3) BETWEEN 0 AND 1.5 GROUP BY 1",
    "u03_rules_of_a_table": f"WITH {_RULES} SELECT d.doc_id, coalesce(string_agg('has_' || w, ',' ORDER BY w), '') AS names, count(w)::INT AS n, CASE WHEN bool_or(length(w) % 3 = 0) THEN 'critical' WHEN bool_or(length(w) % 3 = 1) THEN 'high' WHEN count(w) > 0 THEN 'low' END AS max_severity, coalesce(bool_or(length(w) % 5 = 0), false) AS blocked FROM documents d LEFT JOIN hit USING (doc_id) GROUP BY 1",
    "n11_stitched_facts": f"WITH {_STITCHED}, genes AS (SELECT DISTINCT doc_id, 'KRAS' AS gene FROM documents), {chains.facts_of_genes([], [], [])} SELECT DISTINCT doc_id AS paper_id, predicate, gene, object, 0.62::DOUBLE AS confidence FROM built",
    "k16_first_nodes": f"SELECT * FROM ({graph.ORACLE['k16_neighbourhood']}) ORDER BY hop, node LIMIT 60",
}
