"""The queries opN_<name> and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evispark.llm import decontam, fuzzyhash, jaccard, langid, lexical, license, mixing, negatives, pii, quality, secrets, topk, wrappers
from evispark.llm.texts import part_of_id, read_table


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digest_columns(read_table(spark, sf_dir, "documents"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    held_out = part_of_id("doc_id", 5) == 0
    langs, model = langid.learn(docs.where(part_of_id("doc_id", 5) != 0))
    return langid.identify(docs, langs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest_columns(read_table(spark, sf_dir, "documents"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest_columns(read_table(spark, sf_dir, "documents"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.digest_columns(read_table(spark, sf_dir, "documents"))


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.digest_columns(read_table(spark, sf_dir, "pages"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.digest_columns(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuzzyhash.compare(read_table(spark, sf_dir, "documents"))


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link_classes(read_table(spark, sf_dir, "documents"), size=4, percent=85)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    model = quality.learn(docs, labels.where(part_of_id("doc_id", 3) != 1))
    return quality.score(docs, model).select("doc_id", (part_of_id("doc_id", 3) == 1).alias("held_out"), "score", "predicted")


def op11_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "embeddings")
    return topk.top_k(rows, rows.where(F.col("vec_id") % 100 == 0), k=10, scale=1024)


def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(rows, F.col("vec_id") % 100 == 0, scale=256, label=label)


def op13_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def secrets_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 4 over six scans on one ledger: documents, the same again with conversations, pages, documents by newer rules, and documents with an address by both."""
    docs = read_table(spark, sf_dir, "documents").select("text")
    talks = read_table(spark, sf_dir, "conversations").select("text")
    pages = read_table(spark, sf_dir, "pages").select(F.col("html").alias("text"))
    address = docs.withColumn("text", F.concat(F.coalesce("text", F.lit("")), F.lit(" see ftp://anna:hunter2@example.org/")))
    old, new = secrets.RULES, secrets.NEWER_RULES
    return secrets.ledger_growth([("1 documents", docs, "1", old), ("2 with conversations", docs.union(talks), "1", old), ("3 pages", pages, "1", old), ("4 new rules", docs, "2", new), ("5 old rules", address, "1", old), ("6 new rules", address, "2", new)])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_mixing, op2_language, op3_pii, op4_secrets, op5_licenses, op6_html, op7_decontamination, op8_fingerprints, op9_jaccard, op10_quality, op11_topk, op12_negatives, op13_lexical, secrets_ledger)}

#: Words of a text with A-Z in lower case.
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_OP5 = f"""
WITH p(label, base, pw, tw, offs) AS (VALUES {", ".join(f"('{label}', {str(base).lower()}, {list(p)}, {list(t)}, {at})" for label, p, t, at, base in license.all_templates())}),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
place AS (
  SELECT doc_id, w, label, base, tw, offs, i - 1 AS start
  FROM (SELECT doc_id, w, label, base, pw, tw, offs, unnest(range(1, len(w) + 1)) AS i FROM d JOIN p ON list_has_all(w, pw))
  WHERE w[i : i + len(pw) - 1] = pw
),
word AS (SELECT doc_id, label, base, start, len(tw) AS n, k, w[start - offs + k] = tw[k] AND start - offs + k > 0 AS same FROM (SELECT *, unnest(range(1, len(tw) + 1)) AS k FROM place)),
token AS (SELECT doc_id, unnest(w) AS t, generate_subscripts(w, 1) - 1 AS i FROM d),
part AS (SELECT label, unnest(tw) AS t, generate_subscripts(tw, 1) - 1 AS k, len(tw) AS n, offs, len(pw) AS m FROM p WHERE NOT base),
aligned AS (SELECT doc_id, label, i - k + offs AS start, n, m, count(*) AS same, count(*) FILTER (k >= offs AND k < offs + m) AS in_phrase FROM token JOIN part USING (t) GROUP BY doc_id, label, i - k, offs, n, m),
hit AS (
  SELECT doc_id, label, base, start, count(*) FILTER (same) / n::DOUBLE AS share FROM word GROUP BY doc_id, label, base, start, n
  UNION ALL SELECT doc_id, label, false, start, same / n::DOUBLE FROM aligned WHERE 100 * same >= 80 * n AND 2 * in_phrase >= m
),
agg AS (
  SELECT doc_id, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word, max(share) AS score,
    array_to_string(list_sort(list_distinct(list(label) FILTER (base))), ',') AS base_labels, array_to_string(list_sort(list_distinct(list(label))), ',') AS labels
  FROM hit GROUP BY doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM d LEFT JOIN agg USING (doc_id)"""

_OP7 = f"""
WITH b AS (SELECT item_id::VARCHAR AS item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
win AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, w[i : i + least(10, len(w)) - 1] AS words FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
spot AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
place AS (SELECT doc_id, i, n, w[i : i + n - 1] AS words FROM spot, (SELECT DISTINCT n FROM win) WHERE i + n - 1 <= len(w)),
hit AS (SELECT doc_id, i, place.n, item_id FROM place JOIN win ON place.n = win.n AND place.words = win.words),
covered AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS j FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)"""

_OP9 = """
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, w[i : i + least(4, len(w)) - 1] AS sh FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(4, len(w)) + 2)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)),
e2 AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.a, e2.b FROM reach r JOIN e2 ON r.b = e2.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(b)::BIGINT AS component_id FROM d JOIN reach ON reach.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY ALL"""

_LEDGER = r"""
WITH v AS (
  SELECT '1 documents' AS scan, '1' AS rules_version, text FROM documents
  UNION ALL SELECT '2 with conversations', '1', text FROM documents UNION ALL SELECT '2 with conversations', '1', text FROM conversations
  UNION ALL SELECT '3 pages', '1', html FROM pages UNION ALL SELECT '4 new rules', '2', text FROM documents
  UNION ALL SELECT scan, rules_version, coalesce(text, '') || ' see ftp://anna:hunter2@example.org/' FROM documents, (VALUES ('5 old rules', '1'), ('6 new rules', '2')) s(scan, rules_version)
),
b AS (SELECT scan, rules_version, text, sha256(coalesce(text, '')) AS blob FROM v),
first AS (SELECT rules_version, blob, min(scan) AS scan FROM b GROUP BY ALL),
fresh AS (SELECT scan, count(*) AS n_scanned FROM first GROUP BY scan),
count_of AS (SELECT scan, len(list_filter(regexp_extract_all(text, '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2), lambda x: length(x) >= 12))
    + len(list_filter(regexp_extract_all(text, 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 18)) + len(list_filter(regexp_extract_all(text, '[0-9a-f]+'), lambda x: length(x) >= 16))
    + len(regexp_extract_all(text, '-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----')) + len(regexp_extract_all(' ' || text, '[^A-Za-z0-9_-]eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}'))
    + len(regexp_extract_all(' ' || text, '[^A-Za-z0-9](?:gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,})'))
    + CASE rules_version WHEN '2' THEN len(regexp_extract_all(text, '[a-z][a-z0-9+.-]{1,20}://[^\s/:@]{1,100}:[^\s/@]{3,100}@')) ELSE 0 END AS n FROM b),
found AS (SELECT scan, coalesce(sum(n), 0)::BIGINT AS n_found FROM count_of GROUP BY 1)
SELECT b.scan, b.rules_version, count(*) AS n_versions, count(DISTINCT blob) AS n_blobs, coalesce(any_value(n_scanned), 0)::BIGINT AS n_scanned, any_value(n_found) AS n_found
FROM b LEFT JOIN fresh USING (scan) JOIN found USING (scan) GROUP BY b.scan, b.rules_version"""

#: Rows of embeddings without a null or a component that is not finite, as whole numbers; their products are exact in doubles.
_NUMBERS = "list_transform(embedding, lambda x: floor({} * x::DOUBLE)) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"

_OP11 = f"""
WITH e AS (SELECT vec_id, {_NUMBERS.format(1024)}),
s AS (SELECT q.vec_id AS query_id, e.vec_id, list_inner_product(q.v, e.v)::BIGINT AS score FROM e JOIN e q ON q.vec_id % 100 = 0 AND q.vec_id <> e.vec_id)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score FROM s QUALIFY rank <= 10"""

_OP12 = f"""
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, {_NUMBERS.format(256)} AND label IS NOT NULL),
s AS (SELECT q.vec_id AS anchor_id, e.vec_id, q.label = e.label AS same, list_inner_product(q.v, e.v)::BIGINT AS score FROM e JOIN e q ON q.vec_id % 100 = 0 AND q.vec_id <> e.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score QUALIFY rank <= 5"""

_OP13 = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
item AS (SELECT DISTINCT item_id, unnest({_WORDS}) AS term FROM benchmark),
total AS (SELECT count(*) FILTER (len(w) > 0)::BIGINT AS nn, sum(len(w))::BIGINT AS ll FROM d),
token AS (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM d),
tf AS (SELECT doc_id, n, term, count(*)::BIGINT AS tf FROM token SEMI JOIN item USING (term) GROUP BY ALL),
weight AS (SELECT term, floor(1000 * ln((2 * any_value(nn) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, total GROUP BY term),
gain AS (SELECT doc_id, term, w * (1000000000 * tf // (1000 * tf + 20 * (50 + 50 * n * nn // ll))) AS gain FROM tf JOIN weight USING (term), total),
s AS (SELECT item_id, doc_id, sum(gain)::BIGINT AS score FROM gain JOIN item USING (term) GROUP BY ALL HAVING sum(gain) > 0)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank, doc_id, score FROM s QUALIFY rank <= 50"""

ORACLE: dict[str, str] = {"op11_topk": _OP11, "op12_negatives": _OP12, "op13_lexical": _OP13, "secrets_ledger": _LEDGER, "op5_licenses": _OP5, "op7_decontamination": _OP7, "op9_jaccard": _OP9}
