"""Landed files of providers and publishers as rows of declared schemas (S)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evispark.shared import materialize


def read_dependency_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(cell_line, gene, score) of a wide CSV whose first column is the cell line and others are "SYMBOL (id)"; what is no finite number is left out."""
    wide = spark.read.option("header", True).csv(path)
    first, *genes = wide.columns
    quoted = [F.col(f"`{g}`").alias(g.split(" ")[0]) for g in genes]
    names = [g.split(" ")[0] for g in genes]
    long = wide.select(F.col(f"`{first}`").alias("cell_line"), *quoted).unpivot("cell_line", names, "gene", "value")
    score = F.expr("try_cast(value AS double)")
    return long.select("cell_line", "gene", score.alias("score")).where("score IS NOT NULL AND NOT isnan(score) AND abs(score) < double('infinity')")


def read_cell_lines(spark: SparkSession, path: str, line: str = "ModelID", code: str = "OncotreeCode") -> DataFrame:
    """(cell_line, cancer_code) by the names of the header."""
    return spark.read.option("header", True).csv(path).select(F.col(line).alias("cell_line"), F.upper(F.trim(code)).alias("cancer_code")).where("cell_line IS NOT NULL AND cancer_code <> ''")


ALIASES = {
    "gene": ("gene_symbol", "gene", "gene_name", "hugo_symbol", "symbol"), "cancer": ("cancer_code", "cancer_type", "oncotree_code", "cancer", "primary_site"),
    "mutated": ("mutated_samples", "mutated_sample_count", "mutated", "n_mutated"), "profiled": ("profiled_samples", "profiled_sample_count", "profiled", "total_samples", "n_samples"), "frequency": ("mutation_frequency", "frequency", "freq", "percent_mutated"),
}


def read_mutation_frequencies(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Frequencies (gene, cancer, mutated, profiled, frequency) by gene and cancer, and by gene. The header's line says what separates and names the columns."""
    head = spark.read.text(path).first()
    header = head[0] if head else ""
    sep = max("\t,;|", key=header.count)
    raw = spark.read.option("header", True).option("sep", sep).csv(path)
    names = {c.strip().lower().replace(" ", "_"): c for c in raw.columns}

    def column(key: str) -> Column:
        found = [F.col(f"`{names[a]}`") for a in ALIASES[key] if a in names]
        return F.coalesce(*found) if found else F.lit(None).cast("string")

    number = lambda c: F.try_to_number(c, F.lit("999999999999D999999")).cast("double")
    f = number(F.regexp_replace(column("frequency"), "%", ""))
    rows = raw.select(F.upper(F.trim(column("gene"))).alias("gene"), F.upper(F.trim(column("cancer"))).alias("cancer"), number(column("mutated")).alias("m"), number(column("profiled")).alias("p"), F.when(f.between(1, 100), f / 100).when(f.between(0, 1), f).alias("f")).where("gene <> ''")

    def total(*keys: str) -> DataFrame:
        own = rows.groupBy(*keys).agg(F.sum("m").cast("long").alias("mutated"), F.sum("p").cast("long").alias("profiled"), F.avg("f").alias("mean"))
        return own.select(*keys, "mutated", "profiled", F.when(F.col("profiled") > 0, F.least(F.coalesce("mutated", F.lit(0)) / F.col("profiled"), F.lit(1.0))).otherwise(F.col("mean")).alias("frequency"))

    return total("gene", "cancer"), total("gene")


def api_candidates(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """(key columns, gene, cancer, mutated, profiled, frequency) from JSON texts: an array of objects, or one under data, results, items or payload."""
    others = [c for c in payloads.columns if c != column]
    item = "array<map<string,string>>"
    text = F.col(column)
    lists = [F.from_json(text, item), *(F.from_json(F.get_json_object(text, f"$.{k}"), item) for k in ("data", "results", "items", "payload")), F.array(F.from_json(text, "map<string,string>"))]
    found = F.coalesce(*(F.when(F.size(F.filter(x, lambda m: m.isNotNull())) > 0, x) for x in lists))
    rows = payloads.select(*others, F.explode(found).alias("m"))
    get = lambda key: F.coalesce(*(F.col("m")[a] for a in ALIASES[key]))
    mutated, profiled, f = (F.try_to_number(get(k), F.lit("999999999999D999999")).cast("double") for k in ("mutated", "profiled", "frequency"))
    return rows.select(*others, F.upper(get("gene")).alias("gene"), F.upper(get("cancer")).alias("cancer"), mutated.cast("long").alias("mutated"), profiled.cast("long").alias("profiled"), F.coalesce(F.when(f.between(1, 100), f / 100).otherwise(f), F.try_divide(mutated, profiled)).alias("frequency")).where("gene IS NOT NULL")


#: Keys under which payloads hold further payloads.
NESTED = ("data", "results", "items", "payload")


def nested_candidates(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """(key columns, gene, cancer, mutated, profiled, frequency) of every object, at any depth, that names a gene, a frequency or a number of samples.

    Arrays and what stands under NESTED keys are walked level by level, each a table of its own, until one
    is empty; texts that are not JSON have none. Of a column's names the first that an object has counts.
    """
    spark = payloads.sparkSession
    names = [c for c in payloads.columns if c != column]
    others = [f"_{i}" for i in range(len(names))]
    level, out = payloads.select(*(F.col(c).alias(o) for c, o in zip(names, others, strict=True)), F.try_parse_json(column).alias("_v")).where("_v IS NOT NULL"), None
    get = lambda key, kind: F.coalesce(*(F.try_variant_get("_v", f"$.{a}", kind) for a in ALIASES[key]))
    while out is None or not level.isEmpty():
        level = materialize(level, "level")
        mutated, profiled, f = get("mutated", "double"), get("profiled", "double"), get("frequency", "double")
        rows = level.select(*others, F.upper(get("gene", "string")).alias("gene"), F.upper(get("cancer", "string")).alias("cancer"), mutated.cast("long").alias("mutated"), profiled.cast("long").alias("profiled"), F.coalesce(F.when(f.between(1, 100), f / 100).otherwise(f), F.try_divide(mutated, profiled)).alias("frequency"), F.coalesce(f, mutated).isNotNull().alias("_told"))
        found = rows.where("gene IS NOT NULL OR _told").drop("_told")
        out = found if out is None else out.union(found)
        inner = level.lateralJoin(spark.tvf.variant_explode(F.col("_v").outer()))
        level = inner.where(F.col("key").isNull() | F.col("key").isin(*NESTED)).select(*others, F.col("value").alias("_v"))
    return out.withColumnsRenamed(dict(zip(others, names, strict=True)))


def best_candidate(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """Of each key the candidate with most profiled samples, then the highest frequency."""
    return candidates.groupBy(*keys).agg(F.max(F.struct("profiled", "frequency", "mutated")).alias("b")).select(*keys, "b.mutated", "b.profiled", "b.frequency")


def read_symbols(spark: SparkSession, path: str) -> DataFrame:
    """(symbol, approved, tier, tier_rank) of a tab-separated nomenclature: approved symbols, aliases, previous ones; a symbol keeps its best tier."""
    raw = spark.read.option("header", True).option("sep", "\t").csv(path).where(F.lower("status") == "approved")
    many = lambda c: F.filter(F.transform(F.split(F.regexp_replace(F.coalesce(c, F.lit("")), '"', ""), r"\|"), lambda x: F.trim(x)), lambda x: x != "")
    tiers = F.array(*(F.struct(F.lit(t).alias("tier"), F.lit(i).alias("tier_rank"), s.alias("symbols")) for i, (t, s) in enumerate((("preferred", F.array("symbol")), ("alias", many(F.col("alias_symbol"))), ("previous", many(F.col("prev_symbol")))))))
    rows = raw.select(F.col("symbol").alias("approved"), F.explode(tiers).alias("t")).select("approved", "t.tier", "t.tier_rank", F.explode("t.symbols").alias("symbol"))
    best = rows.groupBy(F.upper("symbol").alias("symbol")).agg(F.min(F.struct("tier_rank", "approved", "tier")).alias("b"))
    return best.select("symbol", "b.approved", "b.tier", "b.tier_rank")


def ontology_rows(trees: DataFrame, column: str = "json") -> DataFrame:
    """(code, name, main_type, tissue, parent) of JSON trees of objects with code, name, mainType, tissue, parent and children by code: level by level, each a table of its own, until one is empty."""
    node = "code string, name string, mainType string, tissue string, parent string, children map<string,string>"
    level, out = trees.select(F.explode(F.from_json(column, "map<string,string>")).alias("k", "v")), None
    while out is None or not level.isEmpty():
        level = materialize(level.select("k", F.from_json("v", node).alias("n")), "level")
        rows = level.select(F.coalesce("n.code", "k").alias("code"), "n.name", F.col("n.mainType").alias("main_type"), "n.tissue", "n.parent")
        out = rows if out is None else out.union(rows)
        level = level.select(F.explode("n.children").alias("k", "v"))
    return out.where("code IS NOT NULL").distinct()


def ontology_patterns(rows: DataFrame) -> DataFrame:
    """(pattern, code, kind) of ontology rows: codes and names in lower case. Of equal patterns a code comes before a name, then the least code."""
    kinds = F.array(F.struct(F.lower("code").alias("pattern"), F.lit("code").alias("kind")), F.struct(F.lower("name").alias("pattern"), F.lit("name").alias("kind")))
    own = rows.select("code", F.inline(kinds)).where("pattern <> ''")
    return own.groupBy("pattern").agg(F.min(F.struct("kind", "code")).alias("b")).select("pattern", "b.code", "b.kind")


PAPER = ["id", "doi", "pmid", "title", "abstract_text", "journal", "source", "published_at"]


def _papers(df: DataFrame, source: str, **columns: Column) -> DataFrame:
    """Rows of the common paper schema; the id is a digest of source and the first identifier there is."""
    own = {c: columns.get(c, F.lit(None).cast("string")) for c in PAPER if c not in ("id", "source", "published_at")}
    when = F.try_to_timestamp(columns["date"], F.lit("yyyy-MM-dd")) if "date" in columns else F.lit(None).cast("timestamp")
    out = df.select(*(v.cast("string").alias(k) for k, v in own.items()), F.lit(source).alias("source"), when.alias("published_at"))
    return out.withColumn("id", F.sha2(F.concat_ws("|", "source", F.coalesce("doi", "pmid", "title")), 256)).select(*PAPER)


def read_pubmed(spark: SparkSession, path: str) -> DataFrame:
    """Article sets in XML."""
    schema = "MedlineCitation struct<PMID:string,Article:struct<ArticleTitle:string,Journal:struct<Title:string>,Abstract:struct<AbstractText:array<string>>>>, PubmedData struct<ArticleIdList:struct<ArticleId:array<string>>>"
    raw = spark.read.format("xml").option("rowTag", "PubmedArticle").option("ignoreNamespace", True).option("attributePrefix", "_").schema(schema).load(path)
    a = F.col("MedlineCitation.Article")
    doi = F.element_at(F.filter("PubmedData.ArticleIdList.ArticleId", lambda x: x.startswith("10.")), 1)
    return _papers(raw, "pubmed", pmid=F.col("MedlineCitation.PMID"), title=a["ArticleTitle"], journal=a["Journal"]["Title"], abstract_text=F.array_join(a["Abstract"]["AbstractText"], " "), doi=F.when(F.size("PubmedData.ArticleIdList.ArticleId") > 0, doi))


def read_atom(spark: SparkSession, path: str) -> DataFrame:
    """Atom entries."""
    raw = spark.read.format("xml").option("rowTag", "entry").schema("id string, title string, summary string, published string").load(path)
    return _papers(raw, "arxiv", pmid=F.element_at(F.split("id", "/abs/"), -1), title=F.trim("title"), abstract_text=F.trim("summary"), date=F.substring("published", 1, 10))


def read_works(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of works (DOI, title list, container-title list, abstract)."""
    raw = spark.read.schema("DOI string, title array<string>, `container-title` array<string>, abstract string, created struct<`date-time`:string>").json(path)
    return _papers(raw, "crossref", doi=F.col("DOI"), title=F.try_element_at("title", F.lit(1)), journal=F.try_element_at("container-title", F.lit(1)), abstract_text=F.regexp_replace("abstract", "<[^>]+>", " "), date=F.substring(F.col("created")["date-time"], 1, 10))


def read_europe_pmc(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of results (doi, pmid, title, abstractText, journalTitle, firstPublicationDate)."""
    raw = spark.read.schema("doi string, pmid string, title string, abstractText string, journalTitle string, firstPublicationDate string").json(path)
    return _papers(raw, "europepmc", doi=F.col("doi"), pmid=F.col("pmid"), title=F.col("title"), abstract_text=F.col("abstractText"), journal=F.col("journalTitle"), date=F.substring("firstPublicationDate", 1, 10))


def read_trials(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of registered studies; the identifier stands as pmid."""
    raw = spark.read.schema("protocolSection struct<identificationModule:struct<nctId:string,briefTitle:string>,descriptionModule:struct<briefSummary:string>,statusModule:struct<startDateStruct:struct<date:string>>>").json(path)
    p = F.col("protocolSection")
    return _papers(raw, "clinicaltrials", pmid=p["identificationModule"]["nctId"], title=p["identificationModule"]["briefTitle"], abstract_text=p["descriptionModule"]["briefSummary"], date=p["statusModule"]["startDateStruct"]["date"])


def read_semantic(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of papers (externalIds, title, abstract, venue, publicationDate)."""
    raw = spark.read.schema("externalIds struct<DOI:string,PubMed:string>, title string, abstract string, venue string, publicationDate string").json(path)
    return _papers(raw, "semanticscholar", doi=F.col("externalIds.DOI"), pmid=F.col("externalIds.PubMed"), title=F.col("title"), abstract_text=F.col("abstract"), journal=F.col("venue"), date=F.col("publicationDate"))


def read_preprints(spark: SparkSession, path: str, keywords: list[str], as_of, days: int = 730) -> DataFrame:
    """JSON lines of preprints (doi, title, abstract, date) of the last days whose title or abstract holds any keyword."""
    raw = spark.read.schema("doi string, title string, abstract string, date string").json(path)
    text = F.lower(F.concat_ws(" ", "title", "abstract"))
    hit = F.lit(False)
    for k in keywords:
        hit = hit | text.contains(k.lower())
    out = _papers(raw.where(hit), "preprint", doi=F.col("doi"), title=F.col("title"), abstract_text=F.col("abstract"), date=F.col("date"))
    return out.where(F.datediff(F.lit(as_of).cast("timestamp"), "published_at").between(0, days))


def _outer_sections(body: Column) -> Column:
    """The outermost <sec> elements of a text, in order. A fold over pieces cut at the tags: a pattern for whole elements would recurse over long ones."""
    pieces = F.split(body, r"(?=<sec\b)|(?<=</sec>)")

    def step(state: Column, piece: Column) -> Column:
        opens, closes = piece.rlike(r"^<sec\b"), piece.endswith("</sec>")
        depth = F.greatest(state["depth"] + opens.cast("int") - closes.cast("int"), F.lit(0))
        own = F.when((state["depth"] > 0) | opens, F.concat(state["own"], piece)).otherwise("")
        whole = (depth == 0) & (own != "")
        done = F.when(whole, F.array_append(state["done"], own)).otherwise(state["done"])
        return F.struct(depth.alias("depth"), F.when(whole, "").otherwise(own).alias("own"), done.alias("done"))

    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("own"), F.array().cast("array<string>").alias("done"))
    return F.aggregate(pieces, start, step, lambda state: state["done"])


def article_sections(articles: DataFrame, column: str = "xml", id_col: str = "paper_id") -> DataFrame:
    """(paper_id, ord, section_type, heading, text) of article XML texts: the abstract's paragraphs, then each outer section with those inside it."""
    from evispark.operators.text import section_type

    x = F.col(column)
    abstract = F.array_join(F.xpath(x, F.lit("//abstract//p//text()")), " ")
    first = articles.select(id_col, F.lit(0).alias("ord"), F.lit("abstract").alias("section_type"), F.lit("Abstract").alias("heading"), abstract.alias("text"))
    # A path must be constant: the outer sections are cut out of the text, and each is read by itself.
    outer = _outer_sections(F.regexp_extract(x, r"(?s)<body\b[^>]*>(.*)</body>", 1))
    sections = articles.select(id_col, F.posexplode(outer).alias("i", "s"))
    heading = F.xpath_string("s", F.lit("/sec/title"))
    rest = sections.select(id_col, (F.col("i") + 1).alias("ord"), section_type(heading).alias("section_type"), heading.alias("heading"), F.array_join(F.xpath("s", F.lit("//p//text()")), " ").alias("text"))
    return first.union(rest).where(F.trim("text") != "")


def structure_confidence(spark: SparkSession, path: str) -> DataFrame:
    """(file, plddt): the mean of columns 61 to 66 of a structure file's atoms, 0 to 100."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value").where("value LIKE 'ATOM%'")
    value = F.expr("try_cast(trim(substring(value, 61, 6)) AS double)")
    return lines.groupBy("file").agg(F.least(F.greatest(F.avg(value), F.lit(0.0)), F.lit(100.0)).alias("plddt"))


def pocket_scores(spark: SparkSession, path: str) -> DataFrame:
    """(folder, score): the best score of the output files of a folder: lines that name a score and no volume, 0 to 1.5, 1 at most."""
    lines = spark.read.option("recursiveFileLookup", True).text(path).select(F.regexp_replace("_metadata.file_path", "/[^/]*$", "").alias("folder"), F.lower("value").alias("v"))
    score = F.expr("try_cast(regexp_extract(v, '(-?[0-9]+(?:[.][0-9]+)?)[^0-9]*$', 1) AS double)")
    hit = lines.where("v LIKE '%score%' AND v NOT LIKE '%volume%'").select("folder", score.alias("s")).where("s BETWEEN 0 AND 1.5")
    return hit.groupBy("folder").agg(F.least(F.max("s"), F.lit(1.0)).alias("score"))
