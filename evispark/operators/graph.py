"""Lookups and analytics over a table of fact triples (K)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evispark.functions import rules
from evispark.operators.components import connected_components
from evispark.shared import materialize


def find_facts(facts: DataFrame, paper_id=None, subject_id=None, object_id=None, predicate=None, entity_id=None, current_only: bool = False, as_of=None) -> DataFrame:
    """Facts that meet every condition given; entity_id is on either side; current ones have no end, or hold at as_of."""
    for column, value in (("paper_id", paper_id), ("subject_id", subject_id), ("object_id", object_id), ("predicate", predicate)):
        if value is not None:
            facts = facts.where(F.col(column) == value)
    if entity_id is not None:
        facts = facts.where((F.col("subject_id") == entity_id) | (F.col("object_id") == entity_id))
    if current_only:
        facts = facts.where("valid_until IS NULL")
    if as_of is not None:
        facts = facts.where((F.col("valid_from") <= as_of) & (F.col("valid_until").isNull() | (F.col("valid_until") > as_of)))
    return facts


def facts_of(facts: DataFrame, ids: DataFrame, column: str = "subject_id") -> DataFrame:
    """Facts whose column is in ids (one column of ids)."""
    return facts.join(ids.toDF(column).distinct(), column, "left_semi").select(*facts.columns)


def search_facts(facts: DataFrame, gene: str | None = None, term: str | None = None, predicate: str | None = None) -> DataFrame:
    """Subject contains gene; subject, object or predicate contains term, ignoring case; predicate is equal."""
    if gene:
        facts = facts.where(F.lower("subject_name").contains(gene.lower()))
    if term:
        facts = facts.where(F.lower("subject_name").contains(term.lower()) | F.lower("object_name").contains(term.lower()) | F.lower("predicate").contains(term.lower()))
    return facts.where(F.col("predicate") == predicate) if predicate else facts


def predicates(facts: DataFrame) -> DataFrame:
    """K04."""
    return facts.select("predicate").distinct()


def count_by_subject(facts: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """(subject_id, n_facts), for the subjects in ids if given."""
    return (facts_of(facts, ids) if ids is not None else facts).groupBy("subject_id").agg(F.count("*").alias("n_facts"))


def supersede(facts: DataFrame, ids: DataFrame, at) -> tuple[DataFrame, DataFrame]:
    """(facts with an end for those in ids that have none, change events (fact_id, subject_id, old and new confidence))."""
    marked = facts.join(ids.toDF("id").distinct().withColumn("_hit", F.lit(True)), "id", "left")
    closing = F.col("_hit") & F.col("valid_until").isNull()
    closed = marked.withColumn("valid_until", F.when(closing, F.lit(at).cast("timestamp")).otherwise(F.col("valid_until"))).select(*facts.columns)
    events = marked.where(closing).select(F.col("id").alias("fact_id"), "subject_id", F.col("confidence").alias("old_confidence"), F.lit(0.0).alias("new_confidence"), F.lit(at).cast("timestamp").alias("created_at"))
    return closed, events


def with_signal(facts: DataFrame) -> DataFrame:
    """Facts with provenance, tier and signal_weight."""
    out = facts.withColumn("provenance", rules.provenance(F.col("predicate"), F.col("evidence_type"), F.col("evidence")))
    out = out.withColumn("tier", rules.confidence_tier(F.col("provenance"), F.col("predicate"), F.col("confidence")))
    return out.withColumn("signal_weight", rules.signal_weight(F.col("provenance"), F.col("tier"), F.col("predicate")))


def filter_predicates(facts: DataFrame, kind: str = "all") -> DataFrame:
    """All, specific, mechanistic, clinical, or one predicate."""
    p = F.lower("predicate")
    groups = {"": F.lit(True), "all": F.lit(True), "specific": ~p.isin("mentions", "associated_with"), "mechanistic": p.isin(*rules.MECHANISTIC), "clinical": p.isin(*rules.CLINICAL)}
    return facts.where(groups.get(kind.lower(), p == kind.lower()))


def filter_signal(signal: DataFrame, tier: str | None = None, provenance: str | None = None) -> DataFrame:
    """Rows of with_signal() of a tier or provenance."""
    for column, value in (("tier", tier), ("provenance", provenance)):
        if value and value != "all":
            signal = signal.where(F.col(column) == value)
    return signal


def _dominant(counts: list[tuple[str, Column]]) -> Column:
    """The label with the highest count, the first of equal ones."""
    top = F.greatest(*(c for _, c in counts))
    out = F.lit(None).cast("string")
    for label, c in reversed(counts):
        out = F.when(c == top, F.lit(label)).otherwise(out)
    return out


def edges(facts: DataFrame) -> DataFrame:
    """(source, target, predicate, weight, avg_confidence, tier, provenance) without self and blank edges."""
    signal = with_signal(facts).withColumn("source", F.trim("subject_name")).withColumn("target", F.trim("object_name"))
    signal = signal.where("source <> '' AND target <> '' AND source <> target")
    tiers, kinds = ("high", "medium", "low"), ("provider", "extracted", "generic")
    grouped = signal.groupBy("source", "target", "predicate").agg(
        F.count("*").alias("weight"),
        F.avg(rules.clamp(F.col("confidence"), 0.01, 1.0)).alias("avg_confidence"),
        *(F.count_if(F.col("tier") == t).alias(f"n_{t}") for t in tiers),
        *(F.count_if(F.col("provenance") == k).alias(f"n_{k}") for k in kinds),
    )
    return grouped.select("source", "target", "predicate", "weight", "avg_confidence", _dominant([(t, F.col(f"n_{t}")) for t in tiers]).alias("tier"), _dominant([(k, F.col(f"n_{k}")) for k in kinds]).alias("provenance"))


def scored_edges(facts: DataFrame, hub_suppression: float = 0.62) -> DataFrame:
    """Edges with the degree of their ends over all facts, and score."""
    e = edges(facts)
    ends = e.select(F.col("source").alias("node"), "weight").union(e.select("target", "weight"))
    degree = ends.groupBy("node").agg(F.sum("weight").alias("degree"))
    e = e.join(degree.select(F.col("node").alias("source"), F.col("degree").alias("source_degree")), "source")
    e = e.join(degree.select(F.col("node").alias("target"), F.col("degree").alias("target_degree")), "target")
    base = 0.58 * rules.clamp(F.col("avg_confidence"), 0.08, 1.0) + 0.42 * rules.clamp(F.log1p("weight") / 3.6, 0.12, 1.0)
    hub = 1 / (1 + hub_suppression * F.log1p(F.greatest(F.col("source_degree") + F.col("target_degree"), F.lit(1))))
    specificity = rules.choose(F.lower(F.trim("predicate")), rules.PREDICATE_SPECIFICITY, 1.0)
    factor = rules.choose(F.col("tier"), {"high": 1.16, "low": 0.82}, 1.0)
    return e.withColumn("score", rules.clamp(base * specificity * hub, 0.0, 2.5) * factor)



def cap_edges(scored: DataFrame, cap: int = 12) -> DataFrame:
    """What a pass over edges in order of score keeps if a node may have cap edges.

    Each round keeps the open edges whose rank at both ends fits what is left there, and drops those
    with a full end; the first open edge always fits, so rounds end, and no edge is kept out of turn.
    """
    order = [F.desc("score"), F.desc("weight"), F.asc("predicate"), F.asc("source"), F.asc("target")]
    open_edges = materialize(scored, "open")
    kept = None
    while True:
        now = open_edges
        if kept is not None:
            used = kept.select(F.col("source").alias("node")).union(kept.select("target")).groupBy("node").agg(F.count("*").alias("used"))
            for end in ("source", "target"):
                now = now.join(used.select(F.col("node").alias(end), F.col("used").alias(f"used_{end}")), end, "left")
            now = now.where((F.coalesce("used_source", F.lit(0)) < cap) & (F.coalesce("used_target", F.lit(0)) < cap))
        else:
            now = now.withColumn("used_source", F.lit(0)).withColumn("used_target", F.lit(0))
        sides = now.select(F.struct("source", "target", "predicate").alias("edge"), F.explode(F.array(F.struct(F.col("source").alias("node"), F.coalesce("used_source", F.lit(0)).alias("used")), F.struct(F.col("target").alias("node"), F.coalesce("used_target", F.lit(0)).alias("used")))).alias("end"), "score", "weight", "predicate", "source", "target")
        ranked = sides.withColumn("rank", F.row_number().over(Window.partitionBy("end.node").orderBy(*order)))
        fits = ranked.groupBy("source", "target", "predicate").agg(F.min((F.col("rank") + F.col("end.used") <= cap).cast("int")).alias("fits"))
        now = materialize(now.drop("used_source", "used_target").join(fits, ["source", "target", "predicate"]), "round")
        taken = now.where("fits = 1").select(*scored.columns)
        kept = taken if kept is None else kept.union(taken)
        open_edges = now.where("fits = 0").select(*scored.columns)
        if open_edges.isEmpty():
            return kept


def neighbourhood(e: DataFrame, seeds: DataFrame, hops: int = 2, most: int | None = None) -> DataFrame:
    """(node, hop) within hops of the seed names, which match ignoring case; hop is the least. With most, the first so many by hop and name."""
    both = e.select(F.col("source").alias("a"), F.col("target").alias("b")).union(e.select("target", "source")).distinct()
    names = seeds.toDF("seed").select(F.lower("seed").alias("seed")).distinct()
    seen = materialize(both.select(F.col("a").alias("node")).distinct().join(names, F.lower("node") == F.col("seed")).select("node", F.lit(0).alias("hop")), "hops")
    frontier = seen
    for hop in range(1, hops + 1):
        reached = frontier.join(both, F.col("node") == F.col("a")).select(F.col("b").alias("node")).distinct().join(seen, "node", "left_anti")
        frontier = materialize(reached.withColumn("hop", F.lit(hop)), "hops")
        seen = seen.union(frontier)
    return seen.orderBy("hop", "node").limit(most) if most else seen


def shortest_path(e: DataFrame, start: str, end: str, extra: int = 2) -> DataFrame:
    """Edges between neighbours on a shortest undirected path, and each path node's best extra edges; empty if there is none.

    Names match ignoring case. The walk goes on, a round for each hop, until the end or nothing new is
    reached; of several shortest paths the one through the least names, from the end backwards, is taken.
    """
    both = e.select(F.col("source").alias("a"), F.col("target").alias("b")).union(e.select("target", "source")).distinct()
    spark = e.sparkSession
    first = both.select(F.col("a").alias("node")).where(F.lower("node") == start.lower()).distinct()
    seen = frontier = materialize(first.select("node", F.lit(None).cast("string").alias("parent"), F.lit(0).alias("hop")), "path")
    hop, ends = 0, []
    while not (ends := frontier.where(F.lower("node") == end.lower()).orderBy("node").take(1)) and not frontier.isEmpty():
        hop += 1
        step = frontier.select(F.col("node").alias("a")).join(both, "a").groupBy(F.col("b").alias("node")).agg(F.min("a").alias("parent"))
        frontier = materialize(step.join(seen.select("node"), "node", "left_anti").withColumn("hop", F.lit(hop)), "path")
        seen = seen.union(frontier)
    path = [ends[0]["node"]] if ends else []
    for at in range(hop, 0, -1) if ends else ():  # one row a hop
        path.append(seen.where((F.col("hop") == at) & (F.col("node") == path[-1])).first()["parent"])
    on_path = spark.createDataFrame([(a, b) for a, b in zip(path, path[1:], strict=False)], "a string, b string")
    along = e.join(on_path.union(on_path.select("b", "a")).distinct(), (F.col("source") == F.col("a")) & (F.col("target") == F.col("b")), "left_semi")
    nodes = spark.createDataFrame([(x,) for x in path], "node string")
    at = e.join(nodes, F.col("source") == F.col("node")).union(e.join(nodes, F.col("target") == F.col("node")))
    w = Window.partitionBy("node").orderBy(F.desc("score"), F.desc("weight"), "predicate", "source", "target")
    best = at.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= extra).select(*e.columns)
    return along.select(*e.columns).union(best).distinct()


def node_strength(e: DataFrame) -> DataFrame:
    """(node, strength), the sum of the scores of a node's edges."""
    return e.select(F.col("source").alias("node"), "score").union(e.select("target", "score")).groupBy("node").agg(F.sum("score").alias("strength"))


def top_subgraph(e: DataFrame, n: int) -> DataFrame:
    """The edges among the n strongest nodes (equal ones by name)."""
    top = node_strength(e).orderBy(F.desc(F.round("strength", 9)), "node").limit(n).select("node")
    return e.join(top.toDF("source"), "source", "left_semi").join(top.toDF("target"), "target", "left_semi").select(*e.columns)


def node_sizes(e: DataFrame) -> DataFrame:
    """(node, degree, size) for display."""
    return e.select(F.col("source").alias("node")).union(e.select("target")).groupBy("node").agg(F.count("*").alias("degree")).withColumn("size", 3.2 + 1.9 * F.log1p("degree"))


def clusters(e: DataFrame, n: int = 40) -> DataFrame:
    """(component, n_nodes, label) of the n largest components; the label is their first three members."""
    members = connected_components(e, "source", "target")
    place = F.row_number().over(Window.partitionBy("component").orderBy("node"))
    first = members.withColumn("place", place).groupBy("component").agg(F.count("*").alias("n_nodes"), F.array_sort(F.collect_list(F.when(F.col("place") <= 3, F.col("node")))).alias("first"))
    return first.select("component", "n_nodes", F.array_join("first", ", ").alias("label")).orderBy(F.desc("n_nodes"), "component").limit(n)


def cluster_links(e: DataFrame, assignment: DataFrame) -> DataFrame:
    """(a, b, weight, score, confidence) between clusters; assignment is (node, cluster)."""
    of = lambda end: assignment.select(F.col("node").alias(end), F.col("cluster").alias(f"{end}_cluster"))
    both = e.join(of("source"), "source").join(of("target"), "target").where("source_cluster <> target_cluster")
    return both.groupBy(F.least("source_cluster", "target_cluster").alias("a"), F.greatest("source_cluster", "target_cluster").alias("b")).agg(F.sum("weight").alias("weight"), F.sum("score").alias("score"), F.sum("avg_confidence").alias("confidence"))


def evidence_by_title(facts: DataFrame, papers: DataFrame) -> DataFrame:
    """facts' papers grouped by their title's bucket: n_papers, n_facts and the first paper."""
    from evispark.operators.text import text_bucket

    joined = facts.join(papers.select(F.col("id").alias("paper_id"), "title"), "paper_id")
    return joined.groupBy(text_bucket(F.col("title")).alias("bucket")).agg(F.count_distinct("paper_id").alias("n_papers"), F.count("*").alias("n_facts"), F.min("paper_id").alias("first_paper"))


def find_entities(entities: DataFrame, name=None, entity_type=None, synonym=None, external_id=None, query=None) -> DataFrame:
    """By name or synonym ignoring case, type, external id, or a part of the name."""
    if name is not None:
        entities = entities.where(F.lower("name") == name.lower())
    if entity_type is not None:
        entities = entities.where(F.col("entity_type") == entity_type)
    if synonym is not None:
        entities = entities.where(F.exists("synonyms", lambda s: F.lower(s) == synonym.lower()))
    if external_id is not None:
        entities = entities.where(F.col("external_id") == external_id)
    return entities.where(F.lower("name").contains(query.lower())) if query is not None else entities


def suggest(facts: DataFrame, query: str, n: int = 10) -> DataFrame:
    """Up to n names in facts that contain the query, of 2 to 48 characters and 5 words at most, once each ignoring case."""
    names = facts.select(F.trim("subject_name").alias("name")).union(facts.select(F.trim("object_name")))
    found = names.where(F.lower("name").contains(query.lower()) & F.length("name").between(2, 48) & (F.size(F.split("name", r"\s+")) <= 5))
    return found.groupBy(F.lower("name").alias("key")).agg(F.min("name").alias("name")).orderBy(F.length("name"), "name").limit(max(5, min(30, n))).select("name")


def statistics(facts: DataFrame) -> DataFrame:
    """One row: n_facts, n_entities, n_genes, n_cancers, n_predicates."""
    names = facts.select("subject_name", "object_name", "predicate")
    each = names.select(F.explode(F.array("subject_name", "object_name")).alias("name")).distinct()
    counted = each.agg(F.count("name").alias("n_entities"), F.count_if(rules.is_gene_like(F.col("name"))).alias("n_genes"), F.count_if(rules.is_cancer_like(F.col("name"))).alias("n_cancers"))
    return names.agg(F.count("*").alias("n_facts"), F.count_distinct("predicate").alias("n_predicates")).crossJoin(F.broadcast(counted))


def count_by(df: DataFrame, column: str) -> DataFrame:
    """Rows by type, source or status."""
    return df.groupBy(column).agg(F.count("*").alias("n"))


def conflicts(facts: DataFrame) -> DataFrame:
    """A row for each unordered pair of facts on one (subject, object) that conflict.

    directional: one inhibits and one activates; magnitude: both above .6 and more than .4 apart. Only
    facts that can take part are joined: opposed predicates with each other, and strong with weak.
    """
    own = facts.select("id", "subject_id", "object_id", "confidence", F.lower("predicate").alias("p"))
    inhibits, activates = F.col("p").contains("inhibits"), F.col("p").contains("activates")
    side = lambda df, c: df.select("subject_id", "object_id", F.col("id").alias(f"{c}_id"), F.col("confidence").alias(f"{c}_confidence"))
    keys = ["subject_id", "object_id"]
    opposed = side(own.where(inhibits), "x").join(side(own.where(activates), "y"), keys).where("x_id <> y_id").withColumn("conflict_type", F.lit("directional"))
    strong = own.where("confidence > 0.6")
    apart = side(strong.where("confidence > 1.0"), "x").join(side(strong, "y"), keys).where("x_id <> y_id AND x_confidence - y_confidence > 0.4").withColumn("conflict_type", F.lit("magnitude"))
    found = opposed.union(apart)
    swap = F.col("x_id") > F.col("y_id")
    found = found.select(
        F.least("x_id", "y_id").alias("fact_a_id"), F.greatest("x_id", "y_id").alias("fact_b_id"), "conflict_type",
        F.least(F.lit(1.0), 0.7 * F.abs(F.col("x_confidence") - F.col("y_confidence"))).alias("net_confidence"),
        F.when((F.col("x_confidence") > 0.7) & (F.col("y_confidence") > 0.7), "manual_review").otherwise("unresolved").alias("resolution"), swap.alias("_swap"),
    ).drop("_swap")
    return found.groupBy("fact_a_id", "fact_b_id").agg(F.min("conflict_type").alias("conflict_type"), F.first("net_confidence").alias("net_confidence"), F.first("resolution").alias("resolution"))


OPPOSED = (("inhibits", "activates"), ("upregulated_in", "downregulated_in"), ("prognostic_for_poor_outcome", "prognostic_for_better_outcome"), ("confers_resistance", "sensitizes_to"), ("resistance_to", "sensitized_by"))


def contradiction_rate(facts: DataFrame) -> DataFrame:
    """One row: n_pairs of (subject, object), n_contradicting and rate."""
    flags = [F.max(F.col("predicate") == x).alias(f"x{i}") for i, (x, _) in enumerate(OPPOSED)] + [F.max(F.col("predicate") == y).alias(f"y{i}") for i, (_, y) in enumerate(OPPOSED)]
    pairs = facts.groupBy("subject_id", "object_id").agg(*flags)
    hit = F.lit(False)
    for i in range(len(OPPOSED)):
        hit = hit | (F.col(f"x{i}") & F.col(f"y{i}"))
    return pairs.agg(F.count("*").alias("n_pairs"), F.count_if(hit).alias("n_contradicting")).withColumn("rate", F.coalesce(F.try_divide("n_contradicting", "n_pairs"), F.lit(0.0)))


def noisy_or(facts: DataFrame) -> DataFrame:
    """(subject_id, predicate, object_id, n, confidence), confidence being 1 minus the product of 1 - p."""
    p = rules.clamp(F.col("confidence"), 0.0, 1.0)
    return facts.groupBy("subject_id", "predicate", "object_id").agg(F.count("*").alias("n"), (1 - F.product(1 - p)).alias("confidence"))


def signed_confidence(evidence: DataFrame, keys: list[str], signed: str = "signed") -> DataFrame:
    """The size of the sum of signed evidence times .7, 1 at most."""
    return evidence.groupBy(*keys).agg(F.least(F.lit(1.0), F.abs(F.sum(signed)) * 0.7).alias("net_confidence"))


def evidence_confidence(df: DataFrame) -> DataFrame:
    """Adds confidence from evidence_type and the columns sample_size, replicated_count, impact_factor, is_preprint, is_single_cell_line, is_retracted."""
    weight = rules.choose(F.col("evidence_type"), rules.EVIDENCE_BASE_WEIGHT, 0.30)
    factor = (
        F.when(F.col("sample_size") > 1000, 1.20).otherwise(1.0) * F.when(F.col("replicated_count") >= 2, 1.15).otherwise(1.0) * F.when(F.col("impact_factor") > 10, 1.05).otherwise(1.0)
        * F.when(F.col("is_preprint"), 0.70).otherwise(1.0) * F.when(F.col("is_single_cell_line"), 0.85).otherwise(1.0)
    )
    return df.withColumn("confidence", F.when(F.col("is_retracted"), 0.0).otherwise(F.least(F.lit(1.0), weight * factor)))


def lethal_partners(facts: DataFrame, gene: str, least: float = 0.0) -> DataFrame:
    """(partner, confidence) of a gene by synthetic_lethal_with, on either side."""
    own = facts.where((F.col("predicate") == "synthetic_lethal_with") & (F.col("confidence") >= least))
    found = own.where(F.col("subject_name") == gene).select(F.col("object_name").alias("partner"), "confidence").union(own.where(F.col("object_name") == gene).select("subject_name", "confidence"))
    return found.groupBy("partner").agg(F.max("confidence").alias("confidence"))


def binding_evidence(facts: DataFrame, kinds: tuple[str, ...] = ("inhibits", "targets", "binds"), n: int = 250) -> DataFrame:
    """Triples of binding-like predicates with calibrated confidence; the n best."""
    own = facts.where(F.lower("predicate").isin(*kinds))
    grouped = own.groupBy("subject_name", "predicate", "object_name").agg(F.count("*").alias("n_evidence"), F.avg("confidence").alias("avg_confidence"), F.count_distinct("paper_id").alias("n_papers"), F.max("created_at").alias("latest"))
    calibrated = 0.68 * rules.clamp(F.col("avg_confidence"), 0.0, 1.0) + 0.20 * F.least(F.lit(1.0), F.log1p("n_evidence") / F.log(F.lit(13.0))) + 0.12 * F.least(F.lit(1.0), F.log1p("n_papers") / F.log(F.lit(9.0)))
    return grouped.withColumn("calibrated", F.round(rules.clamp(calibrated, 0.0, 1.0), 9)).orderBy(F.desc("calibrated"), "subject_name", "predicate", "object_name").limit(n)


def fact_brief(facts: DataFrame, term: str, n: int = 12) -> DataFrame:
    """The n most frequent (predicate, subject, object) that contain a term."""
    return search_facts(facts, term=term).groupBy("predicate", "subject_name", "object_name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "predicate", "subject_name", "object_name").limit(n)


def predicate_shares(facts: DataFrame) -> DataFrame:
    """(predicate, n, share, generic_share, low_coverage): low if fewer than 6 predicates or a generic share above .55."""
    counted = facts.groupBy("predicate").agg(F.count("*").alias("n"))
    every = Window.partitionBy()
    total = F.sum("n").over(every)
    generic = F.sum(F.when(F.lower("predicate").isin("mentions", "associated_with"), F.col("n")).otherwise(0)).over(every) / total
    return counted.select("predicate", "n", (F.col("n") / total).alias("share"), generic.alias("generic_share"), ((F.count("*").over(every) < 6) | (generic > 0.55)).alias("low_coverage"))


def find_papers(papers: DataFrame, **equal) -> DataFrame:
    """Papers whose columns equal the values given (id, doi, pmid, source, parse_status)."""
    for column, value in equal.items():
        papers = papers.where(F.col(column) == value)
    return papers


def update_status(papers: DataFrame, updates: DataFrame) -> DataFrame:
    """Papers with parse_status from updates (id, parse_status) where it has one; of repeated ids the greatest counts."""
    new = updates.groupBy("id").agg(F.max("parse_status").alias("_new"))
    return papers.join(new, "id", "left").withColumn("parse_status", F.coalesce("_new", "parse_status")).select(*papers.columns)


def count_mentions(mentions: DataFrame, by: str = "entity_id") -> DataFrame:
    """Mentions by entity, paper or chunk."""
    return mentions.groupBy(by).agg(F.count("*").alias("n_mentions"))


def conflicts_of(conflict: DataFrame, ids: DataFrame) -> DataFrame:
    """(fact_id, and the conflict's columns) for both ends that are in ids."""
    both = conflict.select(F.explode(F.array("fact_a_id", "fact_b_id")).alias("fact_id"), "*")
    return both.join(ids.toDF("fact_id").distinct(), "fact_id", "left_semi")


def signals_to_facts(signals: DataFrame, predicates_of: dict[str, tuple[str, float]], as_of) -> DataFrame:
    """Facts from rows (gene_symbol, cancer_code, value, source, fetched_at); predicates_of is source to (predicate, scale of the value)."""
    known = signals.where(F.col("source").isin(*predicates_of))
    predicate = F.create_map(*(F.lit(x) for k, (p, _) in predicates_of.items() for x in (k, p)))[F.col("source")]
    scale = F.create_map(*(F.lit(x) for k, (_, s) in predicates_of.items() for x in (k, s)))[F.col("source")]
    return known.select(
        F.sha2(F.concat_ws("|", "gene_symbol", "cancer_code", "source"), 256).alias("id"), F.lit(None).cast("string").alias("paper_id"), F.col("gene_symbol").alias("subject_id"), F.col("gene_symbol").alias("subject_name"),
        predicate.alias("predicate"), F.col("cancer_code").alias("object_id"), F.col("cancer_code").alias("object_name"), rules.clamp(0.5 + 0.5 * rules.clamp(F.col("value") / scale, 0.0, 1.0), 0.0, 1.0).alias("confidence"),
        F.concat(F.lit("provider="), "source", F.lit(" value="), F.format_number("value", 4)).alias("evidence"), F.lit("provider_signal").alias("evidence_type"), F.lit(as_of).cast("timestamp").alias("created_at"),
    )


def replace_facts(facts: DataFrame, fresh: DataFrame) -> DataFrame:
    """Facts without those that fresh has by id, and fresh; columns that fresh lacks are null."""
    return facts.join(fresh.select("id"), "id", "left_anti").unionByName(fresh, allowMissingColumns=True)
