"""SQL of queries that chain operators: extraction into facts, upserts of papers, hybrid retrieval and its contexts, sections by markers, paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from evispark.functions import rules
from evispark.functions.similarity import hash_embedder
from evispark.operators import extract as N
from evispark.operators import retrieve as X
from evispark.operators import text as T
from evispark.plans import adapters as A
from evispark.plans import graph, more, search
from evispark.plans import texts as Q
from evispark.sources import webpages


def _values(terms) -> str:
    return "[" + ", ".join("'" + Q._sql(t) + "'" for t in terms) + "]"


def _ordered(values: str) -> str:
    """The distinct values of a list in the order in which they first come."""
    return f"list_filter({values}, lambda e, i: list_position({values}, e) = i)"


def _typed(text: str, pattern: str, terms: list[str], least: int) -> str:
    found = f"list_filter(list_transform(regexp_extract_all({text}, '{Q._sql(pattern)}', 1), lambda x: upper(trim(x))), lambda x: length(x) >= {least})"
    known = f"list_transform(list_filter({_values(terms)}, lambda x: length(x) >= {least} AND contains(lower({text}), lower(x))), lambda x: upper(x))" if terms else "[]"
    return f"{_ordered(f'list_concat({found}, {known})')}[1:6]"


#: What the engines' word boundaries treat differently counts as a letter in both.
_ASCII = "regexp_replace({}, '[^ -~\\n]', '_', 'g')".format

_N07 = f"""WITH d AS (SELECT doc_id, coalesce({Q.dealt_sql(_ASCII("text"), more.TYPED, "doc_id")}, '') AS t FROM documents)
SELECT doc_id, array_to_string({_typed("t", N.CELL_LINE, ["ertion"], 3)}, '|') AS cell_lines, array_to_string({_typed("t", N.PATHWAY, [], 6)}, '|') AS pathways, array_to_string({_typed("t", N.CHEMICAL, ["thorin", "station"], 4)}, '|') AS chemicals FROM d"""

_MENTIONS = f"mentions AS ({Q.ORACLE['n01_mentions']})"

_N10 = rf"""WITH {_MENTIONS},
tagged AS (
  SELECT doc_id, upper(canonical) AS gene, confidence, 1 AS stage FROM mentions WHERE entity_type = 'gene'
  UNION ALL SELECT doc_id, unnest(list_distinct(regexp_extract_all({_ASCII('text')}, '\b[A-Z][A-Z0-9]{{2,9}}\b'))), 0.72::DOUBLE, 2 FROM documents
  UNION ALL SELECT doc_id, unnest(list_distinct(regexp_extract_all(coalesce(source, ''), '\b[A-Z][A-Z0-9]{{2,9}}\b'))), 0.72::DOUBLE, 3 FROM documents
  UNION ALL SELECT doc_id, upper(source), 0.70::DOUBLE, 4 FROM documents
)
SELECT doc_id, gene, stage, max(confidence) AS confidence FROM tagged WHERE (doc_id, stage) IN (SELECT (doc_id, min(stage)) FROM tagged GROUP BY doc_id) GROUP BY ALL"""


def _chosen(*pairs: tuple[str, str]) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in pairs) + "], lambda x: x IS NOT NULL)"


def _either(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) > 0 THEN {a} ELSE {b} END"


_HAS = "list_contains(p, '{}')".format
_PLAIN = ("mutated_in", "prognostic_for_poor_outcome", "prognostic_for_better_outcome", "biomarker_of")
_OF_CANCER = _either(
    _chosen(*((n, _HAS(n)) for n in _PLAIN), ("drives", f"{_HAS('drives')} OR {_HAS('promotes_tumorigenesis')}"), *((n, _HAS(n)) for n in ("drives_metastasis", "drives_invasion", "upregulated_in", "downregulated_in"))),
    "CASE WHEN regexp_matches(low, 'driver|oncogenic|tumor suppressor') THEN ['drives'] ELSE ['associated_with'] END",
)
_OF_CHEMICAL = _either(_chosen(("targeted_by", f"{_HAS('inhibits')} OR {_HAS('targets')}"), ("sensitized_by", f"{_HAS('sensitizes_to')} OR contains(low, 'sensit')"), ("resistance_to", f"{_HAS('confers_resistance')} OR contains(low, 'resistan')"), ("activated_by_compound", _HAS("activates"))), "['targeted_by']")
_OF_PATHWAY = _either(_chosen(("activates_pathway", f"{_HAS('activates')} OR contains(low, 'activation')"), ("suppresses_pathway", f"{_HAS('inhibits')} OR contains(low, 'suppression') OR contains(low, 'suppresses')")), "['in_pathway']")
_OF_CELL = "CASE WHEN regexp_matches(low, 'dependency|essential|viability') THEN ['dependency_in_cell_line'] ELSE ['studied_in_cell_line'] END"
_OF_MUTATION = "CASE WHEN contains(low, 'resistan') THEN ['has_mutation', 'mutation_confers_resistance'] ELSE ['has_mutation'] END"
_MUTATIONS = r"list_distinct(list_transform(regexp_extract_all(text, '(?i)\b[A-Z]\d+[A-Z]\b'), lambda x: upper(x)))"
def facts_of_genes(chemicals: list[str], pathways: list[str], cell_lines: list[str]) -> str:
    """CTEs up to built (doc_id, predicate, gene, object), from documents and genes (doc_id, gene)."""
    return rf"""sentence AS (SELECT doc_id, code, trim(unnest(string_split_regex(text, '[.!?;\n]+'))) AS text FROM (SELECT doc_id, {Q._KEYWORDS} AS code, text FROM documents)),
told AS (SELECT doc_id, text, lower(text) AS low, coalesce({Q._KEYWORDS}, code) AS cancer, {Q._MATCHED} AS m FROM sentence WHERE text <> ''),
hit AS (SELECT t.*, gene, CASE WHEN len(m) > 1 THEN list_filter(m, lambda z: z <> 'associated_with') ELSE m END AS p FROM told t JOIN genes USING (doc_id) WHERE regexp_matches(' ' || low || ' ', '[^a-z0-9]' || lower(gene) || '[^a-z0-9]')),
part AS (
  SELECT doc_id, gene, {_OF_CANCER} AS names, CASE WHEN cancer IS NULL THEN [] ELSE [cancer] END AS objects FROM hit
  UNION ALL SELECT doc_id, gene, {_OF_MUTATION}, {_MUTATIONS} FROM hit
  UNION ALL SELECT doc_id, gene, {_OF_CHEMICAL}, {_typed("text", N.CHEMICAL, chemicals, 4)} FROM hit
  UNION ALL SELECT doc_id, gene, {_OF_PATHWAY}, {_typed("text", N.PATHWAY, pathways, 6)} FROM hit
  UNION ALL SELECT doc_id, gene, {_OF_CELL}, {_typed("text", N.CELL_LINE, cell_lines, 3)} FROM hit
),
named AS (SELECT doc_id, gene, unnest(names) AS predicate, objects FROM part),
typed AS (SELECT DISTINCT doc_id, predicate, gene, unnest(objects) AS object FROM named),
built AS (
  SELECT doc_id, predicate, gene, object FROM typed
  UNION ALL SELECT doc_id, 'has_mutation', gene, unnest({_MUTATIONS}) FROM documents JOIN genes USING (doc_id) WHERE doc_id NOT IN (SELECT doc_id FROM typed)
)"""


#: A text's four first genes are looked for in each of its sentences.
_FACTS = f"""{_MENTIONS},
genes AS (SELECT doc_id, gene FROM (SELECT DISTINCT doc_id, canonical AS gene FROM mentions WHERE entity_type = 'gene') QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY gene) <= 4),
{facts_of_genes(["thorin", "station"], ["tionth"], ["ertion"])}"""

_KIND = f"""CASE WHEN contains(lower(predicate), 'mutation') THEN 'mutation' WHEN contains(lower(predicate), 'pathway') THEN 'pathway'
  WHEN regexp_matches(lower(predicate), 'targeted_by|sensitized_by|resistance_to|inhibitor|activated_by_compound') THEN 'chemical'
  WHEN regexp_matches(trim(object), '^[A-Z0-9]{{1,8}}$') OR regexp_matches(lower(trim(object)), '{"|".join(rules.CANCER_WORDS)}') THEN 'cancer_type'
  WHEN regexp_matches(lower(trim(object)), 'pathway|signaling|signalling|axis') THEN 'pathway' WHEN regexp_matches(lower(trim(object)), '(mab|nib|parib|platin|taxel)$') THEN 'chemical' ELSE 'disease' END"""

_N16 = f"""WITH {_FACTS}
SELECT doc_id, sha256('GENE:' || upper(gene)) AS subject_id, gene AS subject_name, predicate, sha256(upper({_KIND}) || ':' || upper(trim(object))) AS object_id, object AS object_name,
  CASE predicate WHEN 'associated_with' THEN 0.9::DOUBLE * 0.8 ELSE 0.9 END AS confidence, CASE predicate WHEN 'associated_with' THEN 'generic_relation' ELSE 'typed_relation' END AS evidence_type FROM built"""


def _section(heading: str, kind: str) -> str:
    low, at = "lower(text)", f"strpos(lower(text), '{heading.lower()}')"
    after = f"{at} + {len(heading)}"
    ends = ", ".join(f"nullif(strpos(substring({low}, {after}), chr(10) || '{m}'), 0) + {after} - 1" for m in T.NEXT_MARKERS)
    return f"SELECT doc_id, '{heading}' AS heading, '{kind}' AS section_type, {at}::INT AS start, length(substring(text, {at}, greatest(coalesce(least({ends}), length(text) + 1) - {at}, {len(heading)})))::INT AS n FROM d WHERE {at} > 0"


_T02 = "WITH d AS (SELECT doc_id, 'Abstract of this' || chr(10) || text || chr(10) || 'Methods we used' || chr(10) || 'Results were' || chr(10) || 'References none' AS text FROM documents) " + " UNION ALL ".join(_section(h, k) for h, k in T.MARKERS)

_D07 = f"""
WITH {Q._SIMHASH}, by_id AS ({Q.ORACLE['d02_match_existing']}), by_title AS ({Q.ORACLE['d03_match_titles']}), by_fuzzy AS ({Q.ORACLE['d06_match_fuzzy']}),
texts AS (SELECT doc_id::VARCHAR AS id, simhash FROM prints JOIN documents USING (doc_id) WHERE text IS NOT NULL),
by_print AS (SELECT a.id, min(b.id) AS duplicate_of FROM texts a JOIN texts b ON a.id <> b.id WHERE bit_count(xor(a.simhash, b.simhash)) <= 6 GROUP BY 1)
SELECT i.id, coalesce(i.duplicate_of, t.duplicate_of, p.duplicate_of, f.duplicate_of) AS duplicate_of,
  coalesce(i.method, CASE WHEN t.id IS NOT NULL THEN 'title' WHEN p.id IS NOT NULL THEN 'simhash' WHEN f.id IS NOT NULL THEN 'fuzzy_title' END) AS method, coalesce(i.duplicate_of, t.duplicate_of, p.duplicate_of, f.duplicate_of) IS NULL AS was_new
FROM by_id i LEFT JOIN by_title t ON t.id = i.id LEFT JOIN by_print p ON p.id = i.id LEFT JOIN by_fuzzy f ON f.id = i.id"""

#: Documents in chunks of 800 words with their texts, each with its document's vector.
_CHUNKS = rf"""{Q._chunk_counts(800, 680, 50)}, listed AS (SELECT *, unnest(range(0, last - short::INT + 1)) AS k FROM c),
chunks AS (SELECT concat_ws('-', doc_id, k) AS id, doc_id::VARCHAR AS paper_id, k AS chunk_index, embedding::DOUBLE[] AS v,
  CASE WHEN n <= 800 THEN text WHEN short AND k = last - 1 THEN array_to_string(t[k * 680 + 1 : k * 680 + 800], ' ') || ' ' || array_to_string(t[last * 680 + 1 : last * 680 + 800], ' ') ELSE array_to_string(t[k * 680 + 1 : k * 680 + 800], ' ') END AS content
  FROM listed JOIN (SELECT doc_id, text, regexp_extract_all(text, '\S+') AS t FROM documents) USING (doc_id) LEFT JOIN embeddings ON vec_id = doc_id)"""

_R06 = f"""
WITH {_CHUNKS}, own AS (SELECT * FROM chunks WHERE contains(lower(content), 're')),
lexical AS (SELECT id, row_number() OVER (ORDER BY paper_id, chunk_index) AS r FROM own WHERE contains(lower(content), 'tion') ORDER BY paper_id, chunk_index LIMIT 80),
nearest AS (SELECT id, row_number() OVER (ORDER BY s DESC, id) AS r FROM (SELECT id, round(list_cosine_similarity(v, list_resize([1.0::DOUBLE], 64, 1.0)), 6) AS s FROM own WHERE v IS NOT NULL) ORDER BY s DESC, id LIMIT 80),
f AS (SELECT coalesce(lexical.id, nearest.id) AS id, coalesce(1.0 / (60 + lexical.r), 0)::DOUBLE + coalesce(1.0 / (60 + nearest.r), 0) AS raw, CASE WHEN lexical.id IS NULL THEN 'vector' WHEN nearest.id IS NULL THEN 'lexical' ELSE 'hybrid' END AS source FROM lexical FULL JOIN nearest ON lexical.id = nearest.id),
g AS (SELECT id, round(raw / max(raw) OVER (), 9) AS score, source FROM f)
SELECT id, score, g.source, row_number() OVER (ORDER BY score DESC, id)::INT AS rank, substring(text, 1, 80) AS title FROM g JOIN documents ON doc_id::VARCHAR = split_part(id, '-', 1) ORDER BY score DESC, id LIMIT 20"""

#: Words hashed as in D04 are counted up or down in 64 places, and the vector has length 1.
_R09 = rf"""
WITH {_CHUNKS}, word AS (SELECT id, unnest(string_split_regex(lower(content), '\s+')) AS w FROM chunks WHERE v IS NULL),
bytes AS (SELECT w, list_transform(range(0, octet_length(encode(w))), lambda i: ('0x' || hex(encode(w))[2 * i + 1 : 2 * i + 2])::HUGEINT) AS b FROM (SELECT DISTINCT w FROM word WHERE w <> '')),
hashed AS (SELECT w, list_reduce(list_prepend(14695981039346656037::HUGEINT, b), lambda h, x: (xor(h, x) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT) AS h FROM bytes),
place AS (SELECT id, (h % 64)::INT AS k, sum(CASE WHEN h >= 9223372036854775808::HUGEINT THEN 1 ELSE -1 END)::DOUBLE AS x FROM word JOIN hashed USING (w) GROUP BY ALL)
SELECT id, round(sum(x * (k + 1)) / greatest(sqrt(sum(x * x)), 1e-10), 3) AS checksum FROM place GROUP BY 1"""

_DISTINCT_TERMS = _ordered("list_filter(string_split_regex(lower(content), '[^a-z0-9]+'), lambda w: length(w) >= 3 AND w NOT IN ({}))".format(", ".join(f"'{w}'" for w in T.CONTEXT_STOP_WORDS)))
_CONTEXTS = f"""{_CHUNKS},
hits AS (SELECT c.id, c.paper_id, content, round(list_cosine_similarity(v, e.embedding::DOUBLE[]), 6) AS score FROM chunks c, embeddings e WHERE e.vec_id = 0 AND v IS NOT NULL ORDER BY score DESC, id LIMIT 32),
contexts AS (SELECT id, paper_id, content, score, TIMESTAMP '2020-01-01' + to_days((paper_id::INT % 1400)::INT) AS published_at, terms[1:5] AS genes, len(terms[6:]) AS n_terms, CASE WHEN paper_id::INT % 3 = 0 THEN paper_id END AS dedup_group
  FROM (SELECT *, {_DISTINCT_TERMS} AS terms FROM hits))"""

_R11 = f"WITH {_CONTEXTS} SELECT id, paper_id, score, published_at, array_to_string(list_sort(genes), ',') AS genes, n_terms::INT AS n_terms FROM contexts"
_R14 = f"""WITH {_CONTEXTS}, g AS (SELECT unnest(genes) AS gene, date_diff('day', published_at, TIMESTAMP '{A.AS_OF}') <= 365 AS recent, len(genes) > 1 AS shared, dedup_group IS NOT NULL AS duplicate FROM contexts)
SELECT gene, count(*) AS n_chunks, count(*) FILTER (recent) AS n_recent, count(*) FILTER (shared) AS n_shared, count(*) FILTER (duplicate) AS n_duplicate FROM g GROUP BY 1"""
_R15 = rf"""WITH {_CONTEXTS}, r AS (SELECT *, row_number() OVER (PARTITION BY coalesce(dedup_group, 'id:' || id) ORDER BY score DESC, id) > 1 AS later FROM contexts)
SELECT id, score, substring(trim(regexp_replace(content, '\s+', ' ', 'g')), 1, 240) AS snippet FROM r ORDER BY later, score DESC, id LIMIT 8"""

#: Steps from the start, then of the shortest paths the one through the least names from the end backwards.
_K17 = f"""
WITH RECURSIVE {graph._SMALL}, e AS (SELECT source, target, weight, round(score, 6) AS score FROM g),
both_ways AS (SELECT source AS a, target AS b FROM e UNION SELECT target, source FROM e),
walk(node, hop) AS (SELECT 'N1', 0 UNION SELECT b, hop + 1 FROM walk JOIN both_ways ON a = node WHERE hop < 6),
least AS (SELECT node, min(hop) AS hop FROM walk GROUP BY 1),
back(node, hop) AS (SELECT node, hop FROM least WHERE node = 'N2' UNION ALL SELECT (SELECT min(l.node) FROM least l JOIN both_ways w ON w.a = l.node AND w.b = back.node WHERE l.hop = back.hop - 1), hop - 1 FROM back WHERE hop > 0),
step AS (SELECT x.node AS a, y.node AS b FROM back x JOIN back y ON x.hop = y.hop + 1),
edge AS (SELECT node, e.* FROM e JOIN back ON node = source UNION ALL SELECT node, e.* FROM e JOIN back ON node = target),
best AS (SELECT source, target, weight FROM edge QUALIFY row_number() OVER (PARTITION BY node ORDER BY score DESC, weight DESC, source, target) <= 2)
SELECT source, target, weight FROM best UNION SELECT source, target, weight FROM e WHERE (source, target) IN (SELECT (a, b) FROM step UNION ALL SELECT (b, a) FROM step)"""

_R18 = """
WITH f AS (SELECT user_id::VARCHAR AS gene, [count(*), count(*) FILTER (event_type = 'view'), count(*) FILTER (event_type = 'error')]::DOUBLE[] AS v, list_distinct(list(dayofyear(ts))) AS days, list_distinct(list(event_type)) AS kinds FROM events GROUP BY 1),
p AS (SELECT x.gene AS a, y.gene AS b, list_cosine_similarity(x.v, y.v) AS c, len(list_intersect(x.days, y.days)) AS shared_chunks, len(x.days) + len(y.days) AS days, len(list_intersect(x.kinds, y.kinds)) AS shared_topics, len(x.kinds) + len(y.kinds) AS kinds FROM f x JOIN f y ON x.gene < y.gene),
s AS (SELECT a, b, round(0.7 * (c + 1) / 2 + 0.2 * shared_chunks / (days - shared_chunks) + 0.1 * shared_topics / (kinds - shared_topics), 9) AS score, shared_chunks::BIGINT AS shared_chunks, shared_topics::BIGINT AS shared_topics FROM p)
SELECT a, b, round(score, 6) AS score, shared_chunks, shared_topics FROM s WHERE score >= 0.55 OR shared_chunks > 0 OR shared_topics > 0 ORDER BY s.score DESC, a, b LIMIT 12"""

def _backfilled(s, d):
    """A number of each chunk that had no vector: the sum of its new vector's components times their places."""
    own = A.chunks(s, d)
    fresh = X.backfill_embeddings(own, hash_embedder(64)).join(own.where("embedding IS NULL").select("id"), "id", "left_semi")
    terms = F.transform("embedding", lambda x, k: x.cast("double") * (k + 1))
    return fresh.select("id", F.round(F.aggregate(terms, F.lit(0.0), lambda a, b: a + b), 3).alias("checksum"))


QUERIES = {"r09_backfilled_vectors": _backfilled}
ORACLE = {
    "n07_typed_mentions": _N07,
    "n09_facts": f"WITH {_FACTS} SELECT doc_id, predicate, gene, object FROM built",
    "n10_gene_candidates": _N10,
    "n16_relation_facts": _N16,
    "t02_detect_sections": _T02,
    "d07_upsert_papers": _D07,
    "r06_hybrid_search": _R06,
    "r11_contexts": _R11,
    "r14_gene_profiles": _R14,
    "r15_snippets": _R15,
    "k17_shortest_path": _K17,
    "r09_backfilled_vectors": _R09,
    "r18_gene_links": _R18,
}

#: A pass over edges in order of score that keeps one if both of its ends have kept fewer than 12.
ORACLE["k15_capped_edges"] = f"""
WITH RECURSIVE {graph._SMALL}, e AS (SELECT source, target, weight, round(score, 6) AS score FROM g),
ordered AS (SELECT *, row_number() OVER (ORDER BY score DESC, weight DESC, source, target) AS i FROM e),
fold AS (
  SELECT 0::BIGINT AS i, []::VARCHAR[] AS used, false AS taken
  UNION ALL
  SELECT i, CASE WHEN fits THEN list_concat(used, [source, target]) ELSE used END, fits
  FROM (SELECT o.i, used, source, target, len(list_filter(used, lambda x: x = source)) < 12 AND len(list_filter(used, lambda x: x = target)) < 12 AS fits FROM fold f JOIN ordered o ON o.i = f.i + 1)
)
SELECT source, target, weight, score FROM fold JOIN ordered USING (i) WHERE taken"""


def _page_sql() -> str:
    """Markdown of pages by rules for text: skipped elements go, block tags end a line, headings and the like begin one."""
    text = "regexp_replace(regexp_replace(coalesce(html, ''), '(?s)<!--.*?(-->|$)', '', 'g'), '<[/!?A-Za-z][^<>]*$', '')"
    for name in sorted(webpages.SKIPPED):
        text = f"regexp_replace({text}, '(?is)<{name}\\b.*?(</{name}\\s*>|$)', '', 'g')"
    title = f"regexp_extract({text}, '(?is)<title[^>]*>(.*?)(</title|$)', 1)"
    body = f"regexp_replace({text}, '(?is)<title[^>]*>.*?(</title\\s*>|$)', '', 'g')"
    for level in range(1, 7):
        body = f"regexp_replace({body}, '(?i)<h{level}\\b[^>]*>', chr(1) || '{'#' * level} ', 'g')"
    body = f"regexp_replace(regexp_replace({body}, '(?i)<li\\b[^>]*>', chr(1) || '- ', 'g'), '(?i)<blockquote\\b[^>]*>', chr(1) || '> ', 'g')"
    blocks = "|".join(sorted(webpages.BLOCKS))
    body = f"regexp_replace(regexp_replace({body}, '(?i)</?({blocks})\\b[^>]*>', chr(1), 'g'), '<[^>]*>', '', 'g')"
    plain = "trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace({}, '&amp;?', '&', 'g'), '&quot;', '\"'), '&copy;', '©'), '&middot;', '·'), '&lt;', '<'), '&gt;', '>'), '\\s+', ' ', 'g'))".format
    return f"""WITH t AS (SELECT page_id, html, {title} AS title, string_split({body}, chr(1)) AS parts FROM pages),
m AS (SELECT page_id, html, {plain('title')} AS title, array_to_string(list_filter(list_transform(parts, lambda x: {plain('x')}), lambda x: NOT regexp_matches(x, '^(#{{1,6}}|-|>)?$')), chr(10) || chr(10)) AS markdown FROM t)
SELECT page_id, CASE WHEN trim(coalesce(html, '')) <> '' THEN title END AS title, CASE WHEN trim(coalesce(html, '')) = '' THEN 'empty' WHEN length(markdown) >= 40 THEN 'ok' ELSE 'not_article' END AS status, CASE WHEN trim(coalesce(html, '')) <> '' THEN length(markdown)::INT END AS n FROM m"""


ORACLE["s18_pages"] = _page_sql()


ORACLE["d08_context_groups"] = f"""
WITH RECURSIVE {_CHUNKS},
hits AS (SELECT id, content, v, 1.0::DOUBLE / row_number() OVER (ORDER BY paper_id, chunk_index) AS score FROM chunks WHERE contains(lower(content), 'tion') ORDER BY paper_id, chunk_index LIMIT 400),
d AS (SELECT id, v, score, {search._TERMS.replace("text", "content")} AS terms FROM hits),
{search.GROUPS}
SELECT component, size, round(max_similarity, 6) AS max_similarity, representative FROM grouped ORDER BY size DESC, max_similarity DESC, component LIMIT 5"""
