"""Entities and relations in text (N)."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import lru_cache
from operator import itemgetter

import pyarrow as pa
from ahocorasick import Automaton
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evispark.functions import rules
from evispark.operators.text import sentences
from evispark.shared import materialize

#: Confidence by type of term; genes by tier of the lexicon row.
TYPE_CONFIDENCE = {"cancer_code": 1.00, "cancer": 0.90, "mutation": 0.90, "chemical": 0.86, "pathway": 0.84, "cell_line": 0.83}


class _Dictionary:
    """An automaton over lower-cased terms; of rows with one term the first counts."""

    def __init__(self, terms: list[tuple]) -> None:
        self.found = Automaton()
        for row in terms:
            key = row[0].lower()
            if key not in self.found:
                self.found.add_word(key, (len(key), len(row[0]) < 4 or row[3], row))
        self.found.make_automaton()

    def matches(self, text: str) -> list[tuple[int, int, tuple]]:
        """Leftmost longest matches that do not overlap; short or flagged terms need bounds that are no letters or digits."""
        low = text.lower()
        if len(low) != len(text):  # a few letters change length in lower case
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        hits = []
        for last, (n, bounded, row) in self.found.iter(low) if len(self.found) else ():
            i, j = last - n + 1, last + 1
            if not bounded or ((i == 0 or not low[i - 1].isalnum()) and (j == len(low) or not low[j].isalnum())):
                hits.append((i, -j, row))
        hits.sort(key=itemgetter(0, 1))
        out, at = [], 0
        for i, j, row in hits:
            if i >= at:
                at = -j
                out.append((i, at, row))
        return out


@lru_cache(maxsize=4)
def _dictionary(shared: _Shared) -> _Dictionary:
    return _Dictionary(shared.value.value)


class _Shared:
    """A broadcast that a worker's cache knows again in its next task."""

    def __init__(self, value: Broadcast, name: str) -> None:
        self.value, self.name = value, name

    def __hash__(self) -> int:
        return hash(self.name)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, _Shared) and self.name == other.name


def find_mentions(chunks: DataFrame, lexicon: DataFrame, id_col: str = "id", text: str = "content", least: float = 0.75, max_bytes: int = 64 << 20) -> DataFrame:
    """(id, start, end, text, entity_type, canonical, confidence) by a dictionary (term, entity_type, canonical, confidence, word_boundary).

    The dictionary is sent to all tasks, and each worker makes one automaton of it, which takes some 30
    bytes for each character; its terms and canonical names must not exceed max_bytes. Terms under four
    characters lose .15, codes do not; matches under least are left out.
    """
    terms = lexicon.select("term", "entity_type", "canonical", "word_boundary", "confidence").where("term <> ''")
    size = terms.agg(F.coalesce(F.sum(F.octet_length("term") + F.coalesce(F.octet_length("canonical"), F.lit(0)) + 32), F.lit(0))).first()[0]
    if size > max_bytes:
        raise ValueError(f"the dictionary has {size} bytes, more than {max_bytes}; split it")
    rows = terms.orderBy("term", F.desc("confidence"), "entity_type", "canonical").collect()
    shared = _Shared(chunks.sparkSession.sparkContext.broadcast([tuple(r) for r in rows]), uuid.uuid4().hex)
    names = [id_col, "start", "end", "text", "entity_type", "canonical", "confidence"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _dictionary(shared)
        for batch in batches:
            out = []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for a, b, (term, kind, canonical, _, confidence) in known.matches(t or ""):
                    score = confidence - (0.15 if len(term) < 4 and kind != "cancer_code" else 0.0)
                    if score >= least:
                        out.append((i, a, b, t[a:b], kind, canonical, score))
            columns = list(zip(*out, strict=True)) or [[] for _ in names]
            kinds = [batch.schema.field(0).type, pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    kind = chunks.schema[id_col].dataType.simpleString()
    return chunks.select(id_col, F.col(text).cast("string")).mapInArrow(work, f"`{id_col}` {kind}, start bigint, end bigint, text string, entity_type string, canonical string, confidence double")


def resolve_symbols(names: DataFrame, symbols: DataFrame, column: str = "name") -> DataFrame:
    """Names with approved symbol and tier (preferred, alias, previous) of symbols (symbol, approved, tier, tier_rank), ignoring case."""
    w = Window.partitionBy("_key").orderBy("tier_rank", "approved")
    known = symbols.select(F.upper(F.trim("symbol")).alias("_key"), "approved", "tier", "tier_rank").withColumn("_n", F.row_number().over(w)).where("_n = 1")
    return names.withColumn("_key", F.upper(F.trim(column))).join(known.select("_key", "approved", "tier"), "_key", "left").drop("_key")


def normalise_cancers(names: DataFrame, synonyms: DataFrame, column: str = "name") -> DataFrame:
    """Names with code: an equal synonym (synonym, code), else the longest of 6+ characters that they contain. Neither list is broadcast by a hint; the planner chooses."""
    known = synonyms.select(F.lower(F.trim("synonym")).alias("_s"), "code").groupBy("_s").agg(F.min("code").alias("code"))
    keyed = names.select(F.col(column).alias("_name")).distinct().withColumn("_k", F.lower(F.trim("_name")))
    exact = keyed.join(known, F.col("_k") == F.col("_s")).select("_name", F.col("code").alias("_exact"))
    # A name that contains a synonym of 6 characters or more has its first 6 somewhere.
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length("_k") - 5, F.lit(1))), lambda i: F.substring(F.col("_k"), i, F.lit(6))))
    long = known.where(F.length("_s") > 5).withColumn("_gram", F.substring("_s", 1, 6))
    parts = keyed.withColumn("_gram", F.explode(grams)).join(long, "_gram").where(F.col("_k").contains(F.col("_s")))
    longest = parts.groupBy("_name").agg(F.min(F.struct(-F.length("_s"), "code"))["code"].alias("_part"))
    found = exact.join(longest, "_name", "full_outer").select(F.col("_name").alias(column), F.coalesce("_exact", "_part").alias("code"))
    return names.join(found, column, "left")


AMINO_ACIDS = {
    "A": "Ala", "C": "Cys", "D": "Asp", "E": "Glu", "F": "Phe", "G": "Gly", "H": "His", "I": "Ile", "K": "Lys", "L": "Leu", "M": "Met", "N": "Asn", "P": "Pro", "Q": "Gln",
    "R": "Arg", "S": "Ser", "T": "Thr", "V": "Val", "W": "Trp", "Y": "Tyr", "*": "Ter",
}


def protein_change(raw: Column) -> Column:
    """Struct (hgvs_p, position, ref_aa, alt_aa) of G12D, p.G12D or p.Gly12Asp; null for other text."""
    three = F.create_map(*(F.lit(x) for k, v in AMINO_ACIDS.items() for x in (k, v)))
    r = F.regexp_replace(F.trim(raw), "^p\\.", "")
    short, long = r"(?i)^([ACDEFGHIKLMNPQRSTVWY])([0-9]+)([ACDEFGHIKLMNPQRSTVWY*])$", r"(?i)^([A-Z][a-z]{2})([0-9]+)([A-Z][a-z]{2})$"
    part = lambda i: F.when(r.rlike(short), three[F.upper(F.regexp_extract(r, short, i))]).when(r.rlike(long), F.initcap(F.regexp_extract(r, long, i)))
    known = F.array(*map(F.lit, AMINO_ACIDS.values()))
    position = F.coalesce(F.nullif(F.regexp_extract(r, short, 2), F.lit("")), F.nullif(F.regexp_extract(r, long, 2), F.lit("")))
    good = F.array_contains(known, part(1)) & F.array_contains(known, part(3))
    return F.when(good, F.struct(F.concat(F.lit("p."), part(1), position, part(3)).alias("hgvs_p"), F.expr("1").cast("int").alias("_"), position.cast("int").alias("position"), part(1).alias("ref_aa"), part(3).alias("alt_aa")).dropFields("_"))


#: Where a word of ASCII letters, digits and _ begins or ends, as the queries' SQL has it; what Java takes for such a place depends on its version.
EDGE = r"(?:(?<!\w)(?=\w)|(?<=\w)(?!\w))"


def ascii_edges(pattern: str) -> str:
    """The pattern with EDGE for each word boundary."""
    return pattern.replace(r"\b", EDGE)


def mutation_mentions(c: Column) -> Column:
    """G12D-like words, upper-cased, distinct."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(ascii_edges(r"(?i)\b[A-Z]\d+[A-Z]\b")), F.lit(0)), F.upper))


def cancer_code(c: Column) -> Column:
    """The code of the first keyword of the list that the text contains."""
    low, out = F.lower(c), F.lit(None).cast("string")
    for word, code in reversed(rules.CANCER_KEYWORDS):
        out = F.when(low.contains(word), F.lit(code)).otherwise(out)
    return out


CHEMICAL = r"(?i)\b([A-Z][A-Za-z0-9\-]{3,40}(?:mab|nib|fenib|ciclib|parib|platin|taxel|mycin|azole|vir))\b"
PATHWAY = r"(?i)\b([A-Za-z0-9\-_/ ]{2,80}?(?:pathway|signaling pathway|signalling pathway|axis))\b"
CELL_LINE = r"\b([A-Z]{1,5}-?\d{2,4}[A-Z0-9]*)\b"


def typed_mentions(c: Column, pattern: str, terms: list[str], least: int, most: int = 6) -> Column:
    """Matches of the pattern, then terms contained, upper-cased and trimmed, distinct, the first most of them."""
    t = F.coalesce(c, F.lit(""))
    found = F.filter(F.transform(F.regexp_extract_all(t, F.lit(ascii_edges(pattern)), F.lit(1)), lambda x: F.upper(F.trim(x))), lambda x: F.length(x) >= least)
    known = F.filter(F.array(*map(F.lit, terms)) if terms else F.array().cast("array<string>"), lambda x: (F.length(x) >= least) & F.contains(F.lower(t), F.lower(x)))
    return F.slice(F.array_distinct(F.concat(found, F.transform(known, F.upper))), 1, most)


def matched_predicates(c: Column) -> Column:
    """Predicates whose rules match, in order, once; associated_with only where there is no other."""
    t = F.coalesce(c, F.lit(""))
    found = F.array_distinct(F.array_compact(F.array(*(F.when(t.rlike(ascii_edges(f"(?i){p}")), F.lit(name)) for p, name in rules.PREDICATE_RULES))))
    return F.when(F.size(found) > 1, F.array_remove(found, "associated_with")).otherwise(found)


def relations(rows: DataFrame) -> DataFrame:
    """Rows (subject, object, text) with predicates, empty unless both stand in the text (the object also by its cancer code's keywords)."""
    low = F.lower("text")
    by_code = F.lit(False)
    for word, code in rules.CANCER_KEYWORDS:
        by_code = by_code | ((F.lower("object") == code.lower()) & low.contains(word))
    both = contains_symbol(F.col("text"), F.col("subject")) & (F.contains(low, F.lower("object")) | by_code)
    return rows.withColumn("predicates", F.when(both, matched_predicates(F.col("text"))).otherwise(F.array().cast("array<string>")))


def contains_symbol(text: Column, symbol: Column, underscore: bool = False) -> Column:
    """The symbol stands in the text, ignoring case, not next to letters or digits (or, with underscore, _). A blank symbol does not."""
    edge = "a-z0-9_" if underscore else "a-z0-9"
    quoted = F.regexp_replace(F.lower(F.trim(symbol)), r"([^a-z0-9])", r"\\$1")
    return (F.trim(symbol) != "") & F.regexp_like(F.lower(text), F.concat(F.lit(f"(?<![{edge}])"), quoted, F.lit(f"(?![{edge}])")))


def build_facts(chunks: DataFrame, genes: DataFrame, id_col: str = "id", text: str = "content", chemicals: list[str] = [], pathways: list[str] = [], cell_lines: list[str] = []) -> DataFrame:  # noqa: B006
    """(id, predicate, gene, object), once each, from chunks and the genes (id, gene) to look for in them.

    A gene's sentence gives typed relations to the cancer (of the sentence, else of the text), mutations,
    chemicals, pathways and cell lines. A chunk without any gives its mutations to all its genes.
    """
    s = sentences(chunks, id_col, text).join(chunks.select(id_col, cancer_code(F.col(text)).alias("_code")), id_col)
    t, low = F.col("sentence"), F.lower("sentence")
    s = s.withColumns({"p": matched_predicates(t), "cancer": F.coalesce(cancer_code(t), "_code"), "mutations": mutation_mentions(t), "chem": typed_mentions(t, CHEMICAL, chemicals, 4), "path": typed_mentions(t, PATHWAY, pathways, 6), "cell": typed_mentions(t, CELL_LINE, cell_lines, 3)})
    rows = s.join(genes.select(id_col, F.upper(F.trim("gene")).alias("gene")).distinct(), id_col).where(contains_symbol(t, F.col("gene")))
    has = lambda x: F.array_contains("p", x)
    pick = lambda *pairs: F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in pairs)))
    direct = [(n, has(n)) for n in ("mutated_in", "prognostic_for_poor_outcome", "prognostic_for_better_outcome", "biomarker_of")]
    direct += [("drives", has("drives") | has("promotes_tumorigenesis")), *((n, has(n)) for n in ("drives_metastasis", "drives_invasion", "upregulated_in", "downregulated_in"))]
    either = lambda a, b: F.when(F.size(a) > 0, a).otherwise(b)
    of_cancer = either(pick(*direct), either(pick(("drives", low.rlike("driver|oncogenic|tumor suppressor"))), F.array(F.lit("associated_with"))))
    of_chemical = either(pick(("targeted_by", has("inhibits") | has("targets")), ("sensitized_by", has("sensitizes_to") | low.contains("sensit")), ("resistance_to", has("confers_resistance") | low.contains("resistan")), ("activated_by_compound", has("activates"))), F.array(F.lit("targeted_by")))
    of_pathway = either(pick(("activates_pathway", has("activates") | low.contains("activation")), ("suppresses_pathway", has("inhibits") | low.contains("suppression") | low.contains("suppresses"))), F.array(F.lit("in_pathway")))
    of_cell = F.array(F.when(low.rlike("dependency|essential|viability"), "dependency_in_cell_line").otherwise("studied_in_cell_line"))
    of_mutation = F.array_compact(F.array(F.lit("has_mutation"), F.when(low.contains("resistan"), F.lit("mutation_confers_resistance"))))
    facts = None
    for objects, names in ((F.array_compact(F.array("cancer")), of_cancer), (F.col("mutations"), of_mutation), (F.col("chem"), of_chemical), (F.col("path"), of_pathway), (F.col("cell"), of_cell)):
        part = rows.select(id_col, F.explode(names).alias("predicate"), "gene", objects.alias("_o")).select(id_col, "predicate", "gene", F.explode("_o").alias("object"))
        facts = part if facts is None else facts.union(part)
    facts = facts.distinct()
    bare = chunks.select(id_col, mutation_mentions(F.col(text)).alias("m")).where(F.size("m") > 0).join(facts.select(id_col).distinct(), id_col, "left_anti")
    spare = bare.join(genes.select(id_col, F.upper(F.trim("gene")).alias("gene")).distinct(), id_col).select(id_col, F.lit("has_mutation").alias("predicate"), "gene", F.explode("m").alias("object"))
    return facts.union(spare)


def gene_candidates(chunks: DataFrame, mentions: DataFrame, hints: DataFrame, id_col: str = "id") -> DataFrame:
    """(id, gene, confidence, stage): genes by dictionary, else gene-like words of the chunk (.72), else of its title (.72), else the hint (.70). chunks has content and title; hints (id, gene)."""
    word = r"\b[A-Z][A-Z0-9]{2,9}\b"
    by = mentions.where("entity_type = 'gene'").select(id_col, F.upper(F.coalesce("canonical", "text")).alias("gene"), "confidence", F.lit(1).alias("stage"))
    words = lambda c, stage: chunks.select(id_col, F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce(F.col(c), F.lit("")), F.lit(word), F.lit(0)))).alias("gene"), F.lit(0.72).alias("confidence"), F.lit(stage).alias("stage"))
    tagged = by.union(words("content", 2)).union(words("title", 3)).union(hints.select(id_col, F.upper("gene"), F.lit(0.70), F.lit(4)))
    first = F.min("stage").over(Window.partitionBy(id_col))
    kept = tagged.withColumn("_first", first).where("stage = _first")
    return kept.groupBy(id_col, "gene", "stage").agg(F.max("confidence").alias("confidence"))


def stitched_texts(chunks: DataFrame, facts: DataFrame, n: int = 6, most: int = 24000) -> DataFrame:
    """(paper_id, content) of the first n chunks of papers without facts (paper_id), a line each; none is added to more than so many bytes.

    The chunks are found by their places alone, so no text but theirs goes to a paper's task.
    """
    w = Window.partitionBy("paper_id").orderBy("chunk_index")
    first = lambda df: df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n)
    heads = first(chunks.select("paper_id", "chunk_index")).select("paper_id", "chunk_index").distinct()
    heads = materialize(heads.join(facts.select("paper_id").distinct(), "paper_id", "left_anti"), "heads").toDF("_paper", "_index")
    own = first(chunks.join(heads, F.col("paper_id").eqNullSafe(F.col("_paper")) & F.col("chunk_index").eqNullSafe(F.col("_index")), "left_semi"))
    before = F.sum(F.octet_length("content") + 1).over(w) - F.octet_length("content") - 2
    own = own.withColumn("_before", before).where(F.col("_before") <= most)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "content"))), lambda x: x["content"]), "\n")
    return own.groupBy("paper_id").agg(joined.alias("content"))


def stitched_facts(chunks: DataFrame, facts: DataFrame, hints: DataFrame, confidence: float = 0.62, **terms: list[str]) -> DataFrame:
    """(paper_id, predicate, gene, object, confidence): what the stitched texts of papers without facts say of the gene that is hinted at (paper_id, gene).

    terms are those of build_facts(). Papers without a hint have none.
    """
    texts = materialize(stitched_texts(chunks, facts), "texts")
    own = hints.where(F.trim("gene") != "").select("paper_id", F.upper(F.trim("gene")).alias("gene")).distinct()
    return build_facts(texts, own, "paper_id", "content", **terms).withColumn("confidence", F.lit(confidence))


def top_genes(candidates: DataFrame, n: int = 4, id_col: str = "id") -> DataFrame:
    """The n most certain genes of a chunk, equal ones by symbol."""
    w = Window.partitionBy(id_col).orderBy(F.desc("confidence"), "gene")
    return candidates.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def resolve_entities(names: DataFrame, entities: DataFrame) -> DataFrame:
    """(entity_type, name, external_id, entity_id, is_new) of distinct names (entity_type, name), known ones by external id TYPE:NAME."""
    key = F.concat_ws(":", F.upper("entity_type"), F.upper(F.trim("name")))
    own = names.where(F.trim("name") != "").select("entity_type", F.trim("name").alias("name"), key.alias("external_id")).groupBy("external_id").agg(F.min("entity_type").alias("entity_type"), F.min("name").alias("name"))
    known = entities.groupBy("external_id").agg(F.min("id").alias("_id"))
    return own.join(known, "external_id", "left").select("entity_type", "name", "external_id", F.coalesce("_id", F.sha2("external_id", 256)).alias("entity_id"), F.col("_id").isNull().alias("is_new"))


def object_type(predicate: Column, obj: Column) -> Column:
    """N14."""
    p, o = F.lower(predicate), F.trim(obj)
    low = F.lower(o)
    return (
        F.when(p.contains("mutation"), "mutation").when(p.contains("pathway"), "pathway")
        .when(p.rlike("targeted_by|sensitized_by|resistance_to|inhibitor|activated_by_compound"), "chemical")
        .when(o.rlike("^[A-Z0-9]{1,8}$") | low.rlike("|".join(rules.CANCER_WORDS)), "cancer_type")
        .when(low.rlike("pathway|signaling|signalling|axis"), "pathway").when(low.rlike("(mab|nib|parib|platin|taxel)$"), "chemical").otherwise("disease")
    )


def mention_facts(mentions: DataFrame, papers: DataFrame) -> DataFrame:
    """(paper_id, subject_name, predicate, object_id, object_name, confidence) once for each paper and entity; the subject is "title (journal)"."""
    own = mentions.groupBy("paper_id", "entity_id", "text").agg(F.max("confidence").alias("confidence"))
    subject = F.when(F.trim(F.coalesce("journal", F.lit(""))) != "", F.concat("title", F.lit(" ("), "journal", F.lit(")"))).otherwise(F.col("title"))
    return own.join(papers.select(F.col("id").alias("paper_id"), subject.alias("subject_name")), "paper_id").select("paper_id", "subject_name", F.lit("mentions").alias("predicate"), F.col("entity_id").alias("object_id"), F.col("text").alias("object_name"), "confidence")


def relation_facts(built: DataFrame, genes: DataFrame, entities: DataFrame, id_col: str = "id") -> DataFrame:
    """build_facts() rows with subject_id, object_id, confidence and tag; genes (id, gene, confidence), entities from resolve_entities()."""
    kind = object_type(F.col("predicate"), F.col("object"))
    own = built.withColumn("_s", F.concat(F.lit("GENE:"), F.upper("gene"))).withColumn("_o", F.concat_ws(":", F.upper(kind), F.upper(F.trim("object"))))
    ids = entities.select("external_id", "entity_id")
    out = own.join(ids.toDF("_s", "subject_id"), "_s").join(ids.toDF("_o", "object_id"), "_o").join(genes.select(id_col, "gene", F.col("confidence").alias("_c")), [id_col, "gene"])
    generic = F.col("predicate") == "associated_with"
    return out.select(id_col, "subject_id", F.col("gene").alias("subject_name"), "predicate", "object_id", F.col("object").alias("object_name"), F.when(generic, F.col("_c") * 0.8).otherwise(F.col("_c")).alias("confidence"), F.when(generic, "generic_relation").otherwise("typed_relation").alias("evidence_type"))


LABELS = {"GENE": "gene", "PROTEIN": "gene", "GENE_OR_GENE_PRODUCT": "gene", "DISEASE": "cancer", "CANCER": "cancer", "CANCER_TYPE": "cancer", "CHEMICAL": "chemical", "DRUG": "chemical", "SIMPLE_CHEMICAL": "chemical", "MUTATION": "mutation", "VARIANT": "mutation", "PATHWAY": "pathway", "CELL_LINE": "cell_line"}


def entity_label(c: Column) -> Column:
    """A label without its B-, I-, E-, S- prefix, mapped; unknown ones in lower case."""
    bare = F.regexp_replace(F.upper(F.trim(c)), "^[BIES]-", "")
    return F.coalesce(F.create_map(*(F.lit(x) for k, v in LABELS.items() for x in (k, v)))[bare], F.lower(bare))


def default_predicate(a: Column, b: Column) -> Column:
    """For a pair of entity types in either order."""
    pair = F.concat_ws("|", F.least(a, b), F.greatest(a, b))
    return F.when(pair == "cancer|gene", "associated_with").when(pair == "gene|mutation", "has_mutation").when(pair == "chemical|gene", "targeted_by").when(pair == "gene|pathway", "in_pathway").when(pair == "cell_line|gene", "studied_in_cell_line").otherwise("associated_with")


def cooccurrences(mentions: DataFrame, n: int = 10, most: int | None = None) -> DataFrame:
    """(a, b, n_chunks, rank): for each entity the n that share most chunks with it. With most, chunks that name more entities are left to the caller."""
    own = mentions.select("chunk_id", "entity_id").distinct()
    if most:
        own = own.join(own.groupBy("chunk_id").count().where(F.col("count") <= most).select("chunk_id"), "chunk_id", "left_semi")
    pairs = own.select("chunk_id", F.col("entity_id").alias("a")).join(own.select("chunk_id", F.col("entity_id").alias("b")), "chunk_id").where("a <> b").groupBy("a", "b").agg(F.count("*").alias("n_chunks"))
    w = Window.partitionBy("a").orderBy(F.desc("n_chunks"), "b")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def lexicon_statistics(lexicon: DataFrame) -> DataFrame:
    """(entity_type, n_terms), and a row for the total."""
    own = lexicon.groupBy("entity_type").agg(F.count("*").alias("n_terms"))
    return own.union(lexicon.agg(F.lit("total"), F.count("*")))
