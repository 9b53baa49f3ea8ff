"""Text preparation: normal forms, sections, chunks, sentences (T)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evispark.functions import rules


def section_type(heading: Column) -> Column:
    """T01."""
    h = F.lower(heading)
    return (
        F.when(h.contains("abstract"), "abstract")
        .when(h.contains("introduction") | h.startswith("background"), "introduction")
        .when(h.contains("method") | h.contains("material"), "methods")
        .when(h.contains("result"), "results")
        .when(h.contains("discussion"), "discussion")
        .when(h.contains("conclusion"), "conclusion")
        .when(h.contains("supplement"), "supplementary_methods")
        .otherwise("other")
    )


MARKERS = (("Abstract", "abstract"), ("Introduction", "introduction"), ("Methods", "methods"), ("Materials and Methods", "methods"), ("Results", "results"), ("Discussion", "discussion"), ("Conclusion", "conclusion"), ("References", "references"))
NEXT_MARKERS = ("introduction", "methods", "results", "discussion", "conclusion", "references")


def detect_sections(papers: DataFrame, id_col: str = "id", text: str = "text") -> DataFrame:
    """(id, heading, section_type, start, text) from the first place of each marker to the next one at the start of a line."""
    # The lower-case text is a column of its own: inside the conditions below it would be made anew in each.
    own = papers.select(id_col, F.col(text).alias("_text"), F.lower(text).alias("_low"))
    own = own.withColumns({f"_at{i}": F.instr("_low", heading.lower()) for i, (heading, _) in enumerate(MARKERS)} | {f"_has{i}": F.instr("_low", f"\n{m}") > 0 for i, m in enumerate(NEXT_MARKERS)})
    found = []
    for k, (heading, kind) in enumerate(MARKERS):
        at = F.col(f"_at{k}")
        after = at + len(heading)
        ends = [F.when(F.col(f"_has{i}"), F.nullif(F.expr(f"locate('\\n{m}', _low, _at{k} + {len(heading)})"), F.lit(0))) for i, m in enumerate(NEXT_MARKERS)]
        end = F.coalesce(F.least(*ends), F.length("_text") + 1)
        found.append(F.when(at > 0, F.struct(F.lit(heading).alias("heading"), F.lit(kind).alias("section_type"), at.alias("start"), F.col("_text").substr(at, F.greatest(end - at, after - at)).alias("text"))))
    return own.select(id_col, F.explode(F.array_compact(F.array(*found))).alias("s")).select(id_col, "s.*")


def page_sections(pages: DataFrame, least: int = 80) -> DataFrame:
    """(paper_id, ord, section_type, text, page) of pages (paper_id, page, text) of at least that length."""
    own = pages.where(F.length(F.trim("text")) >= least)
    return own.select("paper_id", F.row_number().over(Window.partitionBy("paper_id").orderBy("page")).alias("ord"), F.lit("other").alias("section_type"), "text", "page")


def collapse_spaces(c: Column) -> Column:
    """T04."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def abstract_sections(papers: DataFrame) -> DataFrame:
    """Abstract and title of each paper as sections; blank ones are left out."""
    parts = F.array(F.struct(F.lit(0).alias("ord"), F.lit("abstract").alias("section_type"), F.col("abstract_text").alias("text")), F.struct(F.lit(1).alias("ord"), F.lit("other").alias("section_type"), F.col("title").alias("text")))
    return papers.select(F.col("id").alias("paper_id"), F.explode(parts).alias("s")).select("paper_id", "s.*").where(F.trim("text") != "")


def words(c: Column) -> Column:
    """Words of a text between white space; null and blank have none."""
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"\S+"), F.lit(0))


def estimate_tokens(c: Column) -> Column:
    """Words / 0.75, rounded up."""
    return F.ceil(F.size(words(c)) / 0.75).cast("long")


def chunk_sections(sections: DataFrame, max_tokens: int = 510, overlap_tokens: int = 64) -> DataFrame:
    """(paper_id, chunk_index, section_type, content, token_count) of sections (paper_id, ord, section_type, text).

    Abstracts and captions are one chunk; others are windows of words. The index runs on over a paper's sections.
    """
    size, step = int(max_tokens * 0.75), max(1, int(max_tokens * 0.75) - int(overlap_tokens * 0.75))
    whole = F.col("section_type").isin("abstract", "figure_caption")
    own = sections.withColumn("w", words(F.col("text")))
    n = F.size("w")
    # The last window is the first that reaches the end.
    last = F.when(n <= size, 0).otherwise(F.ceil((n - size) / step)).cast("int")
    own = own.where(whole | (n > 0)).withColumn("k", F.explode(F.when(whole, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), last))))
    content = F.when(whole, F.col("text")).otherwise(F.array_join(F.slice("w", F.col("k") * step + 1, size), " "))
    index = F.row_number().over(Window.partitionBy("paper_id").orderBy("ord", "k")) - 1
    return own.select("paper_id", index.cast("long").alias("chunk_index"), "section_type", content.alias("content")).withColumn("token_count", estimate_tokens(F.col("content")))


def chunk_words(docs: DataFrame, id_col: str, text: str, size: int = 800, overlap: float = 0.15, least: int = 50) -> DataFrame:
    """(id, chunk_index, content): windows of size words with overlap; a tail shorter than least is joined to the window before it, words they share twice."""
    step = max(1, size - int(size * overlap))
    own = docs.select(id_col, F.col(text).alias("t"), words(F.col(text)).alias("w")).withColumn("n", F.size("w")).where("n > 0")
    # Windows start at 0, step, ... until one has reached the end and the next would start within least of it.
    reach = F.ceil(F.greatest(F.col("n") - size, F.lit(0)) / step)
    tail = F.ceil((F.col("n") - least) / step) - 1
    last = F.least(F.greatest(reach, tail, F.lit(0)), F.ceil(F.col("n") / step) - 1).cast("int")
    own = own.withColumn("last", F.when(F.col("n") <= size, 0).otherwise(last))
    short = (F.col("last") > 0) & (F.col("n") - F.col("last") * step < least)
    own = own.withColumn("short", short).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("last") - F.col("short").cast("int"))))
    window = lambda k: F.array_join(F.slice("w", k * step + 1, size), " ")
    content = F.when(F.col("n") <= size, F.col("t")).when(F.col("short") & (F.col("k") == F.col("last") - 1), F.concat_ws(" ", window(F.col("k")), window(F.col("last")))).otherwise(window(F.col("k")))
    return own.select(id_col, F.col("k").cast("long").alias("chunk_index"), content.alias("content"))


def parse_quality(sections: DataFrame, least_sections: int = 2, least_chars: int = 1200, light: int = 500) -> DataFrame:
    """(paper_id, n_sections, n_chars, quality_ok, light_path, parse_status)."""
    own = sections.groupBy("paper_id").agg(F.count_if(F.trim("text") != "").alias("n_sections"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n_chars"))
    ok = (F.col("n_sections") >= least_sections) & (F.col("n_chars") >= least_chars)
    return own.select("paper_id", "n_sections", "n_chars", ok.alias("quality_ok"), (F.col("n_chars") < light).alias("light_path"), F.when(ok, "parsed").otherwise("parsed_light").alias("parse_status"))


def chunk_fingerprint(content: Column) -> Column:
    """SHA-256 of the first 512 bytes."""
    return F.sha2(F.substring(content.cast("binary"), 1, 512), 256)


def first_chunks(chunks: DataFrame, scope: str = "global", order: tuple[str, ...] = ("paper_id", "chunk_index")) -> DataFrame:
    """Chunks whose first 512 bytes were not seen before in the scope: off, paper or global."""
    if scope == "off":
        return chunks
    key = chunk_fingerprint(F.col("content"))
    firsts = chunks.groupBy(*(["paper_id"] if scope == "paper" else []), key.alias("_key")).agg(F.min(F.struct(*order)).alias("_first")).select(*(F.col("_first")[c].alias(c) for c in order))
    return chunks.join(firsts, list(order), "left_semi").select(*chunks.columns)


def canonical_doi(c: Column) -> Column:
    """T11."""
    d = F.regexp_replace(F.trim(c), r"(?i)^(https?://(dx\.)?doi\.org/|doi:)", "")
    return F.nullif(F.lower(F.regexp_replace(F.trim(d), r"^/+|/+$", "")), F.lit(""))


def canonical_pmid(c: Column) -> Column:
    """T11."""
    return F.nullif(F.lower(F.regexp_replace(F.regexp_replace(F.trim(c), r"(?i)^(pmid:|pmcid:)", ""), "[^A-Za-z0-9]", "")), F.lit(""))


def text_bucket(c: Column) -> Column:
    """ASCII letters and digits in lower case, all else one space."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def title_key(c: Column) -> Column:
    """As text_bucket(), null for none."""
    return F.nullif(text_bucket(c), F.lit(""))


def identity_key(doi: Column, pmid: Column, pmcid: Column, title: Column) -> Column:
    """T12."""
    return F.coalesce(F.concat(F.lit("doi:"), canonical_doi(doi)), F.concat(F.lit("pmid:"), canonical_pmid(pmid)), F.concat(F.lit("pmcid:"), canonical_pmid(pmcid)), F.concat(F.lit("title:"), title_key(title)), F.lit("title:untitled"))


def title_identity(c: Column) -> Column:
    """The first 36 words of more than one character that are not stop words."""
    kept = F.filter(F.split(text_bucket(c), " "), lambda w: (F.length(w) > 1) & ~w.isin(*rules.TITLE_STOP_WORDS))
    return F.nullif(F.array_join(F.slice(kept, 1, 36), " "), F.lit(""))


def sentences(df: DataFrame, id_col: str, text: str = "text") -> DataFrame:
    """(id, ord, sentence)."""
    parts = F.filter(F.transform(F.split(F.col(text), r"[.!?;\n]+"), lambda x: F.trim(x)), lambda s: s != "")
    return df.select(id_col, F.posexplode(parts).alias("ord", "sentence"))


CONTEXT_STOP_WORDS = "the and for with that this from are was were has have had not but its into than then their these those which while also may can".split()


def context_terms(c: Column, genes: Column) -> Column:
    """Distinct words of ASCII letters and digits of 3 or more, without stop words and genes."""
    terms = F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda w: (F.length(w) >= 3) & ~w.isin(*CONTEXT_STOP_WORDS))
    return F.array_except(F.array_distinct(terms), F.transform(genes, F.lower))
