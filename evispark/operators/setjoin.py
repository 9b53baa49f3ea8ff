"""Pairs of sets that share much, by the prefixes of an order in which rare members come first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evispark.shared import materialize

#: Members of a list that one task pairs; longer lists are cut into slices, and pairs of slices go to tasks of their own.
LIST = 1000


def meetings(own: DataFrame, least: float) -> DataFrame:
    """(term, x_id, x_n, x_rest, y_id, y_n, y_rest) for each term of their prefixes that two of the sets (id, terms) share, as long as it and what follows could be enough."""
    single = own.select("id", F.explode("terms").alias("term"))
    often = single.groupBy("term").agg(F.count("*").alias("often"))
    ordered = single.join(often, "term").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("often", "term"))).alias("order")).withColumn("n", F.size("order"))
    prefix = F.slice("order", 1, (F.col("n") - F.ceil(least * F.col("n") - 1e-9) + 1).cast("int"))
    entries = materialize(ordered.select("id", "n", F.posexplode(prefix).alias("place", "o")).select("id", "n", (F.col("n") - F.col("place") - 1).alias("rest"), F.col("o.term").alias("term")), "prefixes")
    lists = entries.groupBy("term").agg(F.ceil(F.count("*") / LIST).alias("slices"), F.count("*").alias("members")).where("members > 1").drop("members")
    dealt = entries.join(lists, "term").withColumn("slice", F.pmod(F.xxhash64("id"), F.col("slices")))
    side = lambda name, i, j: dealt.select("term", i.alias("i"), j.alias("j"), *(F.col(c).alias(f"{name}_{c}") for c in ("id", "n", "rest")))
    left = side("x", F.col("slice"), F.explode(F.expr("sequence(slice, slices - 1)")))
    right = side("y", F.explode(F.expr("sequence(0L, slice)")), F.col("slice"))
    x, y = F.col("x_id"), F.col("y_id")
    alike = F.least("x_n", "y_n") >= least * F.greatest("x_n", "y_n") - 1e-9
    # Were this the first term that a pair shares, it and what follows would have to be enough. So is each one before such a term.
    enough = 1 + F.least("x_rest", "y_rest") >= least / (1 + least) * (F.col("x_n") + F.col("y_n")) - 1e-9
    return left.join(right, ["term", "i", "j"]).where(((F.col("i") < F.col("j")) & (x != y)) | (x < y)).where(alike & enough)


def similar_sets(sets: DataFrame, least: float) -> DataFrame:
    """(a, b, jaccard), a < b, of rows (id, terms) whose sets of terms have a Jaccard similarity of at least that, above 0. None is lost.

    Two such sets share a term among the first n - ceil(least * n) + 1 of either, in any one order. Rare
    terms come first in it, so a term that most sets hold brings together only sets without rarer ones.
    Sizes and places that rule a pair out are looked at before it is made and shuffled. The terms that it shares,
    with what is left of both sets after the last of them, rule out most pairs before whole sets are compared. Null
    and empty sets are like nothing; repeated terms count once.
    """
    if not 0 < least <= 1:
        raise ValueError("the least similarity is above 0 and at most 1")
    own = materialize(sets.select("id", F.array_distinct(F.filter("terms", lambda t: t.isNotNull())).alias("terms")).where(F.size("terms") > 0), "sets")
    x, y = F.col("x_id"), F.col("y_id")
    met = meetings(own, least)
    # What a pair shares in its prefixes, and at most all that follows the last shared term in either.
    shared = met.groupBy(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).agg(F.count("*").alias("both"), F.min(F.least("x_rest", "y_rest")).alias("left"), F.max(F.col("x_n") + F.col("y_n")).alias("sizes"))
    pairs = shared.where(F.col("both") + F.col("left") >= least / (1 + least) * F.col("sizes") - 1e-9).select("a", "b")
    terms = lambda c: own.select(F.col("id").alias(c), F.col("terms").alias(f"{c}_terms"))
    both = F.size(F.array_intersect("a_terms", "b_terms"))
    found = pairs.join(terms("a"), "a").join(terms("b"), "b").select("a", "b", (both / (F.size("a_terms") + F.size("b_terms") - both)).alias("jaccard"))
    return found.where(F.col("jaccard") >= least - 1e-12)
