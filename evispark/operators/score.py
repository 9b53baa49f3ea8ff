"""Scoring and ranking of candidates from many signals (P)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evispark.functions import rules
from evispark.functions.rules import clamp
from evispark.operators.graph import with_signal
from evispark.operators.ranks import row_numbers
from evispark.shared import materialize


def _evidence_rows(facts: DataFrame) -> DataFrame:
    """A row for each side of a fact that is not a mention and has a gene-like name, with what gene_evidence() sums."""
    own = facts.where(F.lower("predicate") != "mentions")
    p = F.lower("predicate")

    def side(gene_id: str, gene: str, other_id: str, other: str, mutation: Column) -> DataFrame:
        cancer = rules.is_cancer_like(F.col(other))
        return own.where(rules.is_gene_like(F.col(gene)) & F.col(gene_id).isNotNull()).select(
            F.col(gene_id).alias("gene_id"), F.col(gene).alias("gene"), "confidence", mutation.cast("int").alias("mutation"), cancer.cast("int").alias("cancer"),
            F.when(cancer, F.struct(F.col("created_at").alias("t"), F.col("id").alias("id"), F.col(other).alias("code"))).alias("last"),
        )

    return side("subject_id", "subject_name", "object_id", "object_name", p.contains("mutation")).union(side("object_id", "object_name", "subject_id", "subject_name", F.lit(False)))


def _summed_evidence(rows: DataFrame) -> DataFrame:
    return rows.groupBy("gene_id", "gene").agg(
        F.count("*").alias("total_evidence"), F.sum("mutation").alias("mutation_evidence"), F.sum("cancer").alias("cancer_evidence"), F.sum("confidence").alias("confidence_sum"), F.max("last")["code"].alias("cancer_code")
    )


def gene_evidence(facts: DataFrame) -> DataFrame:
    """Evidence of each gene-like name on either side of facts that are not mentions."""
    return _summed_evidence(_evidence_rows(facts))


def evidence_score(evidence: DataFrame) -> DataFrame:
    """composite_score, adjusted_score and shortlist_tier of gene_evidence()."""
    count = lambda c, scale: clamp(F.log1p(c) / F.log1p(F.lit(scale)), 0.0, 1.0)
    out = evidence.where("total_evidence > 0").withColumns({"literature_score": count("total_evidence", 30.0), "mutation_score": count("mutation_evidence", 12.0), "cancer_score": count("cancer_evidence", 16.0)})
    mean = clamp(F.col("confidence_sum") / F.col("total_evidence"), 0.0, 1.0)
    base = clamp(0.50 * F.col("literature_score") + 0.30 * F.col("mutation_score") + 0.20 * F.col("cancer_score"), 0.0, 1.0)
    kinds = sum((F.col(c) >= 0.12).cast("int") for c in ("literature_score", "mutation_score", "cancer_score"))
    composite = clamp((1 - F.exp(-1.8 * base)) * clamp(0.70 + 0.10 * kinds, 0.70, 1.0), 0.0, 0.98)
    out = out.withColumn("composite_score", composite)
    out = out.withColumn("adjusted_score", clamp(F.col("composite_score") * clamp(0.50 + 0.50 * mean, 0.50, 1.0), 0.0, 0.95))
    return out.withColumn("shortlist_tier", F.when(F.col("adjusted_score") >= 0.65, "primary").when(F.col("adjusted_score") >= 0.50, "secondary").otherwise("excluded"))


#: Bytes of changed ids that go to all tasks.
MAX_IDS = 64 << 20


def rescore(facts: DataFrame, changed: DataFrame) -> DataFrame:
    """Scores of the entity ids in changed (one column), from all facts that touch them on either side.

    Ids are few against facts: as long as they fit in MAX_IDS they go to the facts, of which only sums are shuffled then.
    """
    ids = materialize(changed.toDF("gene_id").where("gene_id IS NOT NULL").distinct(), "changed")
    # A row costs some 48 bytes beside its text.
    size = ids.agg(F.coalesce(F.sum(F.octet_length(F.col("gene_id").cast("string")) + 48), F.lit(0))).first()[0]
    return evidence_score(_summed_evidence(_evidence_rows(facts).join(F.broadcast(ids) if size <= MAX_IDS else ids, "gene_id", "left_semi")))


POOR, BETTER, NORMAL = "poor|worse|decreased|shorter|reduced", "improved|better|longer|favorable|increased", "normal|healthy|non-tumor|adjacent"
#: kind of mention: pattern of its predicates.
MENTIONS = {"mutation": "mutation", "survival": "survival|hazard|mortality|prognosis|progression_free", "expression": "expression|overexpress|underexpress|upregulat|downregulat", "inhibitor": "inhibit|bind|target|antagon", "pathway": "pathway|reactome", "structural": "pdb|alphafold|structure", "pocket": "pocket|drugg"}


#: Parts of a subject's facts, so that none of a subject with very many has them all.
PARTS = 8


def candidates(facts: DataFrame, conflict: DataFrame, gene: str = "", cancer: str = "") -> DataFrame:
    """Weighted counts of each subject's facts; facts with a conflict below .30 go, each up to .60 costs 30 % of the confidence."""
    own = with_signal(facts.where((F.lower("predicate") != "mentions") & rules.is_gene_like(F.col("subject_name"))))
    if gene:
        own = own.where(F.lower("subject_name").contains(gene.lower()))
    if cancer:
        own = own.where(reduce(lambda a, b: a | b, (F.lower(c).contains(cancer.lower()) for c in ("subject_name", "object_name", "predicate"))))
    own = own.withColumn("_p", F.lower("predicate")).withColumn("_text", F.lower(F.concat_ws("\x01", "subject_name", "object_name", F.coalesce("evidence", F.lit("")))))
    kind = {k: F.col("_p").rlike(p) for k, p in MENTIONS.items()}
    told = kind | {"poor": F.col("_text").rlike(POOR), "better": F.col("_text").rlike(BETTER), "normal": F.col("_text").rlike(NORMAL), "provider": F.col("provenance") == "provider", "high": F.col("tier") == "high"}
    cancer_like = rules.is_cancer_like(F.col("object_name"))
    # What a fact tells, as bits of a number: facts are moved and sorted without their texts.
    bits = reduce(add, (F.when(c, 1 << i).otherwise(0) for i, c in enumerate(told.values())))
    own = own.select("id", "subject_id", F.col("subject_name").alias("gene"), "paper_id", F.when(cancer_like, F.upper("object_name")).alias("code"), "confidence", F.col("signal_weight").alias("w"), "sample_size", bits.alias("bits"))
    ends = conflict.select(F.explode(F.array("fact_a_id", "fact_b_id")).alias("id"), "net_confidence")
    gate = ends.groupBy("id").agg(F.min("net_confidence").alias("_least"), F.count_if(F.col("net_confidence") <= 0.60).alias("_disputes"))
    own = own.join(gate, "id", "left").where(F.coalesce(F.col("_least") >= 0.30, F.lit(True)))
    confidence = clamp(F.col("confidence") * F.pow(F.lit(0.70), F.coalesce("_disputes", F.lit(0))), 0.0, 1.0)
    own = own.withColumns({"confidence": confidence, "disputed": F.coalesce(F.col("_disputes") > 0, F.lit(False))})
    # A subject's facts stand together, in so many parts; a paper's are in one part, where the first counts the paper.
    part = F.pmod(F.xxhash64("paper_id"), F.lit(PARTS))
    own = own.withColumn("part", part).repartition("subject_id", "part")
    first = F.row_number().over(Window.partitionBy("subject_id", "part", "paper_id").orderBy("bits")) == 1
    own = materialize(own.select("subject_id", "gene", "code", "confidence", "w", "sample_size", "bits", "disputed", (first & F.col("paper_id").isNotNull()).alias("paper")), "candidates")
    says = {k: F.col("bits").bitwiseAND(1 << i) > 0 for i, k in enumerate(told)}
    w = F.col("w")
    weighed = {f"{k}_w": F.when(says[k], w).otherwise(0.0) for k in kind if k != "expression"}
    weighed |= {
        "survival_negative_w": F.when(says["survival"] & says["poor"], w).otherwise(0.0), "survival_positive_w": F.when(says["survival"] & ~says["poor"] & says["better"], w).otherwise(0.0),
        "expression_normal_w": F.when(says["expression"] & says["normal"], w).otherwise(0.0), "expression_tumor_w": F.when(says["expression"] & ~says["normal"], w).otherwise(0.0), "cancer_w": F.when(F.col("code").isNotNull(), w).otherwise(0.0),
    }
    # Rounded, so that thresholds on them do not depend on the order of summing.
    total = lambda c: F.round(F.sum(c), 9)
    sums = [total(c).alias(k) for k, c in weighed.items()]
    grouped = own.groupBy("subject_id").agg(
        F.min("gene").alias("gene"), F.count("*").alias("fact_count"), total(w).alias("evidence_w"), total("confidence").alias("confidence_sum"), total(clamp(F.col("confidence") * w, 0.0, 1.0)).alias("confidence_w"),
        F.count_if(says["provider"]).alias("provider_facts"), F.count_if(says["high"]).alias("high_facts"), F.count_if("paper").alias("n_papers"),
        F.max("disputed").alias("disputed"), F.sum(F.when(F.col("sample_size") > 0, F.col("sample_size"))).alias("sample_sum"), F.count_if(F.col("sample_size") > 0).alias("sample_obs"), *sums,
    )
    codes = own.where("code IS NOT NULL").groupBy("subject_id", "code").agg(F.count("*").alias("n"))
    # The most frequent code, the first in order of equal ones.
    mode = codes.groupBy("subject_id").agg(F.min(F.struct(-F.col("n"), "code")).alias("mode")).select("subject_id", F.col("mode.code").alias("cancer_code"))
    return grouped.join(mode, "subject_id", "left")


def proxy_metrics(c: DataFrame) -> DataFrame:
    """mean_confidence and the ten metrics of candidates()."""
    mean = clamp(clamp(F.col("confidence_w") / F.col("evidence_w"), 0.0, 1.0) + F.when(F.col("provider_facts") > 0, 0.02).otherwise(0.0) + F.when(F.col("high_facts") > 0, 0.02).otherwise(0.0), 0.0, 1.0)
    evidence = F.greatest("evidence_w", F.lit(1.0))
    survival = F.when(F.col("survival_w") > 0, clamp(((F.col("survival_positive_w") - F.col("survival_negative_w")) / F.col("survival_w") + 1) / 2, 0.0, 1.0)).when(F.col("sample_obs") > 0, F.least(F.log1p(F.col("sample_sum") / F.col("sample_obs")), F.lit(10.0)) / 10)
    told = F.col("expression_tumor_w") + F.col("expression_normal_w")
    expression = F.when(told > 0, clamp((F.col("expression_tumor_w") + 1) / (F.col("expression_normal_w") + 1), 0.5, 5.0)).otherwise(clamp(1 + 4 * F.col("cancer_w") / evidence, 0.5, 5.0))
    out = c.withColumn("mean_confidence", mean).withColumn("pdb_structure_count", F.round("structural_w").cast("long"))
    return out.withColumns({
        "mutation_freq": clamp(F.col("mutation_w") / evidence, 0.0, 1.0), "crispr_dependency": clamp(-2.0 * F.col("mean_confidence"), -2.0, 0.0), "survival_correlation": F.coalesce(survival, F.col("mean_confidence")),
        "expression_specificity": expression, "af_plddt_mean": F.when(F.col("pdb_structure_count") > 0, 70 + 25 * F.col("mean_confidence")).otherwise(45 + 20 * F.col("mean_confidence")),
        "fpocket_best_score": clamp(0.2 + 0.8 * F.col("pocket_w") / evidence, 0.0, 1.0), "chembl_inhibitor_count": F.round("inhibitor_w").cast("long"), "reactome_escape_pathway_count": F.round("pathway_w").cast("long"),
        "literature_novelty_velocity": 1 / (1 + F.log1p(evidence)),
    })


def enrich(genes: DataFrame, dimensions: dict[str, tuple[DataFrame, Column]]) -> DataFrame:
    """Genes (symbol, ...) with one column for each dimension: name to (rows with a column symbol, aggregate); 0 where there are none."""
    for name, (rows, aggregate) in dimensions.items():
        genes = genes.join(rows.groupBy("symbol").agg(aggregate.alias(name)), "symbol", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return genes


def resolve_signal(genes: DataFrame, a: DataFrame, b: DataFrame, as_of, fresh_days: int = 14) -> DataFrame:
    """Genes (gene, cancer_code) with value and origin: exact a, exact b, any cancer of a, of b (the largest cohort); fresh before stale in each.

    a and b have (gene_symbol, cancer_code, value, profiled, fetched_at), one row for each gene and code.
    """
    out, found = genes, []
    for name, source in (("a", a), ("b", b)):
        fresh = F.datediff(F.lit(as_of).cast("timestamp"), "fetched_at") <= fresh_days
        marked = source.select(F.col("gene_symbol").alias("gene"), "cancer_code", "value", "profiled", fresh.alias("fresh"))
        out = out.join(marked.select("gene", "cancer_code", F.struct("value", "fresh").alias(f"exact_{name}")), ["gene", "cancer_code"], "left")
        largest = marked.groupBy("gene").agg(F.max_by(F.struct("value", "fresh"), F.struct("profiled", "value")).alias(f"any_{name}"))
        out = out.join(largest, "gene", "left")
    order = [(f"exact_{n}", True) for n in "ab"] + [(f"exact_{n}", False) for n in "ab"] + [(f"any_{n}", None) for n in "ab"]
    for column, is_fresh in order:
        c = F.col(column)
        label = F.concat(F.lit(column), F.when(c["fresh"], "_fresh").otherwise("_stale"))
        found.append(F.when(c.isNotNull() & (F.lit(True) if is_fresh is None else c["fresh"] == F.lit(is_fresh)), F.struct(c["value"].alias("value"), label.alias("origin"))))
    return out.withColumn("_found", F.coalesce(*found)).select(*genes.columns, F.col("_found.value").alias("value"), F.col("_found.origin").alias("origin"))


CITATION_PATHS = ("$.citation_count", "$.citationCount", "$.cited_by_count", "$.citedByCount", "$.is-referenced-by-count", "$.metrics.citations", "$.message.is-referenced-by-count")


def citation_count(raw: Column) -> Column:
    """The first of the known paths in a JSON text that holds a whole number; null for other text."""
    return F.coalesce(*(F.try_to_number(F.get_json_object(raw, p), F.lit("999999999999")).cast("long") for p in CITATION_PATHS))


def literature_novelty(gene_papers: DataFrame, papers: DataFrame, as_of) -> DataFrame:
    """(gene, novelty, used_citations) from (gene, paper_id) and papers (id, published_at, citation_count)."""
    age = F.greatest(F.datediff(F.lit(as_of).cast("timestamp"), "published_at"), F.lit(0))
    recency = F.coalesce(1 / (1 + age / 365.0), F.lit(0.5))
    by_citations = F.coalesce(1 / (1 + F.log1p("citation_count")), recency)
    own = papers.select(F.col("id").alias("paper_id"), (0.55 * by_citations + 0.45 * recency).alias("novelty"), F.col("citation_count").isNotNull().alias("cited"))
    return gene_papers.distinct().join(own, "paper_id").groupBy("gene").agg(F.avg("novelty").alias("novelty"), F.max("cited").alias("used_citations"))


def dependency_statistics(scores: DataFrame, cell_lines: DataFrame) -> DataFrame:
    """By gene and cancer: n, mean, median, min, max, strong (< -1), moderate (< -.5), weak. scores (gene, cell_line, score); cell_lines (cell_line, cancer_code)."""
    s = F.col("score")
    strong, moderate = F.count_if(s < -1.0), F.count_if((s >= -1.0) & (s < -0.5))
    return scores.join(cell_lines, "cell_line").groupBy("gene", "cancer_code").agg(F.count("*").alias("n"), F.avg(s).alias("mean"), F.median(s).alias("median"), F.min(s).alias("min"), F.max(s).alias("max"), strong.alias("strong"), moderate.alias("moderate"), F.count_if(s >= -0.5).alias("weak"))


def top_dependencies(statistics: DataFrame, n: int = 10) -> DataFrame:
    """The n genes of each cancer with the lowest mean."""
    w = Window.partitionBy("cancer_code").orderBy(F.round("mean", 9), "gene")
    return statistics.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def rank_normalise(df: DataFrame, column: str, out: str, higher_is_best: bool = True, by: list[str] | None = None) -> DataFrame:
    """P10: mean rank of equal values over the number of rows; the best value gets 1/N."""
    cohort = Window.partitionBy(*(by or []))
    order = F.desc(column) if higher_is_best else F.asc(column)
    rank = F.rank().over(cohort.orderBy(order))
    peers = F.count("*").over(Window.partitionBy(*(by or []), column))
    return df.withColumn(out, (2 * rank + peers - 1) / 2 / F.count("*").over(cohort))


def minmax_normalise(df: DataFrame, column: str, out: str, by: list[str] | None = None) -> DataFrame:
    """P10: (x - min) / (max - min) of the cohort, .5 where all are equal."""
    w = Window.partitionBy(*(by or []))
    low, high = F.min(column).over(w), F.max(column).over(w)
    return df.withColumn(out, F.when(high - low < 1e-10, 0.5).otherwise((F.col(column) - low) / (high - low)))


def dependency_normalise(c: Column) -> Column:
    """P10: -2 is 1, 0 is 0."""
    return 1 - clamp((c + 2) / 2, 0.0, 1.0)


def penalty(inhibitors: Column, expression: Column, structures: Column, plddt: Column) -> Column:
    """P13."""
    unresolved = (structures == 0) & (F.coalesce(plddt, F.lit(0.0)) < 50)
    return F.when(inhibitors > 50, 0.15).otherwise(0.0) + F.when(expression < 1.5, 0.10).otherwise(0.0) + F.when(unresolved, 0.08).otherwise(0.0)


#: The components that are ranks, and of what.
RANKED = {"n1": "mutation_freq", "n3": "survival_correlation", "n4": "expression_specificity", "n9": "literature_novelty_velocity"}


def cohort_scores(metrics: DataFrame, gene_col: str = "gene", digits: int = 9) -> DataFrame:
    """n1 to n9, penalty and composite_score of a cohort of candidates. Ranks are ordinal, equal values in order of gene.

    The four ranks are taken at once, as places of (component, value) in one table of four rows a candidate.
    """
    own = materialize(metrics.withColumn("_row", F.monotonically_increasing_id()), "cohort")
    size = own.count()
    values = F.array(*(F.struct(F.lit(n).alias("component"), F.round(F.col(c).cast("double"), digits).alias("value")) for n, c in RANKED.items()))
    long = own.select("_row", F.col(gene_col).alias("gene"), F.inline(values))
    places = row_numbers(long, ["value", "gene", "_row"], ("component",)).groupBy("_row").pivot("component", list(RANKED)).agg(F.first("rank"))
    ranks = places.select("_row", *(F.col(n).alias(f"_{n}") for n in RANKED))
    rank = lambda n: F.col(f"_{n}") / size
    pocket = clamp(F.col("fpocket_best_score"), 0.0, 1.0)
    structures = F.col("pdb_structure_count")
    out = own.join(ranks, "_row").withColumns({
        "n1": rank("n1"), "n2": dependency_normalise(F.col("crispr_dependency")), "n3": rank("n3"), "n4": rank("n4"),
        "n5": F.when(structures > 0, 0.40 * F.least(structures / 5.0, F.lit(1.0)) + 0.25 * pocket).otherwise(0.35 * F.col("af_plddt_mean") / 100 + 0.25 * pocket), "n6": pocket,
        "n7": 1 / (1 + F.col("chembl_inhibitor_count")), "n8": 1 / (1 + F.col("reactome_escape_pathway_count")), "n9": rank("n9"),
        "penalty": penalty(F.col("chembl_inhibitor_count"), F.col("expression_specificity"), structures, F.col("af_plddt_mean")),
    }).drop("_row", *(f"_{n}" for n in RANKED))
    return out.withColumn("composite_score", composite(out, rules.COMPONENT_WEIGHTS, F.col("penalty"), curve=1.6, each=0.03))


def composite(df: DataFrame, weights: tuple[float, ...], minus: Column, curve: float = 1.7, each: float = 0.04) -> Column:
    """The saturated weighted sum of n1, n2, ... less a penalty, times diversity."""
    n = [F.col(f"n{i + 1}") for i in range(len(weights))]
    base = clamp(reduce(add, (w * c for w, c in zip(weights, n, strict=True))) - minus, 0.0, 1.0)
    active = reduce(add, ((c >= 0.15).cast("int") for c in n))
    return clamp((1 - F.exp(-curve * base)) * clamp(0.72 + each * active, 0.72, 1.0), 0.0, 0.98)


def confidence_adjusted(score: Column, mean_confidence: Column) -> Column:
    """P12."""
    return clamp(score * clamp(0.55 + 0.45 * clamp(mean_confidence, 0.0, 1.0), 0.55, 1.0), 0.0, 0.95)


def renormalise(weights: dict[str, float]) -> dict[str, float]:
    """Weights that sum to 1; raises if one is negative or all are 0."""
    total = sum(weights.values())
    if total <= 0 or min(weights.values()) < 0:
        raise ValueError("weights must be 0 or more and not all 0")
    return {k: v / total for k, v in weights.items()}


def shortlist_tier(adjusted: Column, mutation_freq: Column, tractability: Column, inhibitors: Column, novelty: Column) -> Column:
    """P14."""
    return (
        F.when((inhibitors > 50) & (novelty < 0.20), "excluded")
        .when((adjusted >= 0.65) & (F.coalesce(mutation_freq, F.lit(0.0)) > 0.05) & (tractability > 0.40), "primary")
        .when(adjusted >= 0.50, "secondary")
        .otherwise("excluded")
    )


def flags() -> Column:
    """An array of what is notable, from the columns of cohort_scores() and candidates()."""
    return F.array_compact(F.array(
        F.when(F.col("disputed"), "DISPUTED"), F.when(F.col("expression_specificity") < 1.20, "WARNING_LOW_TUMOR_SPECIFICITY"),
        F.when((F.col("pdb_structure_count") == 0) & (F.col("af_plddt_mean") < 50), "WARNING_STRUCTURALLY_UNRESOLVED"), F.when((F.col("chembl_inhibitor_count") > 50) & (F.col("n7") < 0.20), "HARD_EXCLUSION_SATURATED_TARGET"),
    ))


def final_ranking(df: DataFrame, score: str = "composite_score", second: str = "adjusted_score", gene_col: str = "gene", n: int | None = None, digits: int = 9) -> DataFrame:
    """Rank and percentile 100 * (1 - i/N) in order of score, second, gene; the first n."""
    order = [F.desc(F.round(score, digits)), F.desc(F.round(second, digits)), F.col(gene_col)]
    if n:
        # A report of n rows needs of the others only how many there are.
        out = df.orderBy(*order).limit(n).withColumn("rank", F.row_number().over(Window.orderBy(*order)))
        total = df.agg(F.count("*").alias("_total"))
    else:
        own = materialize(df, "ranking")
        out, total = row_numbers(own, order), own.agg(F.count("*").alias("_total"))
    return out.crossJoin(F.broadcast(total)).withColumn("percentile", 100.0 * (1 - (F.col("rank") - 1) / F.col("_total"))).drop("_total")


#: Scorers by name: functions from a cohort with n1 to n9 and penalty to a column.
SCORERS: dict[str, Callable[[DataFrame], Column]] = {}


def register_scorer(name: str, score: Callable[[DataFrame], Column]) -> None:
    """Makes a scorer known by name; it may use built-in functions or a pandas UDF. A name that is taken raises, unless it is the same scorer."""
    if SCORERS.setdefault(name, score) is not score:
        raise ValueError(f"there is another scorer {name!r}")


def ranked_targets(facts: DataFrame, conflict: DataFrame, n: int | None = None, gene: str = "", cancer: str = "", scorer: str | None = None) -> DataFrame:
    """P04, P05, P11 to P16 in one: scored, tiered, flagged and ranked candidates. With scorer (U02), the composite score is that of the scorer of this name, 0 to 1, null as 0."""
    if scorer is not None and scorer not in SCORERS:
        raise ValueError(f"no scorer {scorer!r}; there are {sorted(SCORERS)}")
    scored = cohort_scores(proxy_metrics(candidates(facts, conflict, gene, cancer)))
    if scorer is not None:
        scored = scored.withColumn("composite_score", clamp(F.coalesce(SCORERS[scorer](scored).cast("double"), F.lit(0.0)), 0.0, 1.0))
    scored = scored.withColumn("adjusted_score", confidence_adjusted(F.col("composite_score"), F.col("mean_confidence")))
    tier = shortlist_tier(F.col("adjusted_score"), F.col("mutation_freq"), F.col("n5"), F.col("chembl_inhibitor_count"), F.col("n7"))
    return final_ranking(scored.withColumn("shortlist_tier", tier).withColumn("flags", flags()), n=n)


def provider_components(genes: DataFrame, survival: DataFrame, expression: DataFrame, dependency: DataFrame) -> DataFrame:
    """Genes (gene, cancer_code) with survival (x+1)/2, expression over its mean in other tissues /10, and dependency. Each frame has (gene, cancer_code, value); expression's code is a tissue."""
    out = genes.join(survival.select("gene", "cancer_code", clamp((F.col("value") + 1) / 2, 0.0, 1.0).alias("survival")), ["gene", "cancer_code"], "left")
    w = Window.partitionBy("gene")
    rest = (F.sum("value").over(w) - F.col("value")) / (F.count("*").over(w) - 1)
    ratio = F.try_divide(F.col("value"), F.when(F.count("*").over(w) > 1, rest).otherwise(F.col("value")))
    out = out.join(expression.select("gene", "cancer_code", clamp(ratio / 10, 0.0, 1.0).alias("expression")), ["gene", "cancer_code"], "left")
    return out.join(dependency.groupBy("gene", "cancer_code").agg(dependency_normalise(F.avg("value")).alias("dependency")), ["gene", "cancer_code"], "left")


def upsert_scores(table: DataFrame, fresh: DataFrame) -> DataFrame:
    """Table with fresh rows as the next version of their (gene_id, cancer_id), which alone is current. Of repeated fresh rows the best adjusted score counts."""
    keys = ["gene_id", "cancer_id"]
    best = fresh.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("confidence_adjusted_score"), F.desc("composite_score")))).where("_n = 1").drop("_n")
    latest = table.groupBy(*keys).agg(F.max("score_version").alias("_version"))
    new = best.join(latest, keys, "left").withColumn("score_version", F.coalesce("_version", F.lit(0)).cast("long") + 1).withColumn("is_current", F.lit(True)).drop("_version")
    old = table.join(best.select(*keys).withColumn("_hit", F.lit(True)), keys, "left").withColumn("is_current", F.col("is_current") & F.col("_hit").isNull()).drop("_hit")
    return old.select(*table.columns).unionByName(new.select(*table.columns))


def current_scores(table: DataFrame) -> DataFrame:
    """The current row of each (gene_id, cancer_id), or its latest version where none is current."""
    w = Window.partitionBy("gene_id", "cancer_id").orderBy(F.desc("is_current"), F.desc("score_version"))
    return table.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def tier_counts(scores: DataFrame) -> DataFrame:
    """P19."""
    return scores.groupBy("shortlist_tier").agg(F.count("*").alias("n"))


def recalibrate(scores: DataFrame, facts_per_gene: DataFrame) -> DataFrame:
    """P20: scores at their limit are spread again by evidence: score * (.82 + .18 * evidence/(evidence+12)). facts_per_gene is (gene_id, n_facts)."""
    n = F.coalesce("n_facts", F.lit(0))
    out = scores.join(facts_per_gene, "gene_id", "left")
    saturated = F.col("confidence_adjusted_score") >= 0.95
    return out.withColumn("confidence_adjusted_score", F.when(saturated, F.col("confidence_adjusted_score") * (0.82 + 0.18 * n / (n + 12))).otherwise(F.col("confidence_adjusted_score"))).select(*scores.columns)


def literature_hits(facts: DataFrame, papers: DataFrame, gene_id: str, n: int = 20) -> DataFrame:
    """A gene's facts with paper titles and snippets, one for each title key, or snippet where there is no title, the most certain first.

    A snippet is the evidence, or what the fact says. Facts without either key are all kept.
    """
    from evispark.operators.text import title_key

    own = facts.where((F.col("subject_id") == gene_id) | (F.col("object_id") == gene_id)).join(papers.select(F.col("id").alias("paper_id"), "title"), "paper_id")
    says = F.concat_ws(" ", "subject_name", F.coalesce(F.nullif(F.trim(F.replace("predicate", F.lit("_"), F.lit(" "))), F.lit("")), F.lit("is related to")), "object_name")
    own = own.withColumn("snippet", F.coalesce(F.when(F.trim("evidence") != "", F.col("evidence")), says))
    key = F.coalesce(F.nullif(title_key(F.col("title")), F.lit("")), F.nullif(title_key(F.col("snippet")), F.lit("")))
    w = Window.partitionBy(F.coalesce(key, F.concat(F.lit("\x01"), "id"))).orderBy(F.desc("confidence"), "id")
    return own.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n").orderBy(F.desc("confidence"), "id").limit(n)


def cache_report(genes: DataFrame, signals: DataFrame, providers: DataFrame, as_of, fresh_days: int = 14) -> DataFrame:
    """(gene, source, value, age_days, status) for every gene and provider; signals (gene_symbol, source, value, fetched_at). providers is a short list."""
    newest = signals.groupBy(F.col("gene_symbol").alias("gene"), "source").agg(F.max_by("value", F.struct("fetched_at", "value")).alias("value"), F.max("fetched_at").alias("fetched_at"))
    every = genes.select("gene").distinct().crossJoin(F.broadcast(providers.toDF("source").distinct()))
    age = F.datediff(F.lit(as_of).cast("timestamp"), "fetched_at")
    out = every.join(newest, ["gene", "source"], "left").withColumn("age_days", age)
    return out.select("gene", "source", "value", "age_days", F.when(F.col("age_days").isNull(), "missing").when(F.col("age_days") <= fresh_days, "fresh").otherwise("stale").alias("status"))


def mutation_frequency(mutations: DataFrame, profiled: DataFrame) -> DataFrame:
    """(gene, cancer_code, mutated, profiled, frequency) from (gene, cancer_code, sample) and (cancer_code, profiled)."""
    hit = mutations.groupBy("gene", "cancer_code").agg(F.count_distinct("sample").alias("mutated"))
    return hit.join(profiled, "cancer_code").withColumn("frequency", F.coalesce(F.try_divide("mutated", "profiled"), F.lit(0.0)))


def score_molecules(molecules: DataFrame) -> DataFrame:
    """Violations of the rule of five, qed, composite and rank of (id, mw, logp, hbd, hba, docking_score)."""
    value = lambda c, d: F.coalesce(c, F.lit(d))
    violations = (value("mw", 0.0) > 500).cast("int") + (value("logp", 0.0) > 5).cast("int") + (value("hbd", 0) > 5).cast("int") + (value("hba", 0) > 10).cast("int")
    out = molecules.withColumn("violations", violations).withColumn("qed", clamp(1 - 0.25 * F.col("violations"), 0.0, 1.0))
    out = out.withColumn("composite", -F.col("docking_score") * F.col("qed") - 2.5 * F.col("violations"))
    return row_numbers(out, [F.desc_nulls_last(F.round("composite", 9)), F.col("id")])


def system_metrics(scores: DataFrame, facts: DataFrame) -> DataFrame:
    """P25: (metric, value): n_targets, mean_adjusted, primary_rate smoothed by 8 rows at .25, evidence_density."""
    s = scores.agg(F.count("*").alias("n_targets"), F.coalesce(F.avg("adjusted_score"), F.lit(0.0)).alias("mean_adjusted"), ((F.count_if(F.col("shortlist_tier") == "primary") + 8 * 0.25) / (F.count("*") + 8)).alias("primary_rate"))
    both = s.crossJoin(facts.agg(F.count("*").alias("n_facts")))
    both = both.withColumn("evidence_density", F.coalesce(F.try_divide("n_facts", "n_targets"), F.lit(0.0)))
    names = ["n_targets", "mean_adjusted", "primary_rate", "evidence_density"]
    return both.select(*(F.col(c).cast("double").alias(c) for c in names)).unpivot([], names, "metric", "value")
