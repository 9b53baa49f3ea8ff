"""Ranked full-text search over a table of positions, by cover density."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evispark.shared import materialize

#: What one place of a cover weighs, whatever its term.
WEIGHT = 0.1
WORD_BREAK = r"[^\p{L}\p{N}]+"
#: English endings, in turn: pattern and what is left. They suit both regular expressions of the JVM and of SQL engines without look-around.
ENDINGS = (
    (r"^(.*(?:ss|i))es$", ""),
    (r"^(.*[aeiouy].*[^us])s$", ""),
    (r"^(.*[aeiouy].*[^e])ed$", ""),
    (r"^(.*[aeiouy].*)ing$", ""),
    (r"^(.+[^aeiouy])y$", "i"),
)


def stem(word: Column) -> Column:
    """A lower-case word without the endings of English plurals and verb forms."""
    # Only words with one of these last letters can change.
    return F.when(F.right(word, F.lit(1)).isin("s", "d", "g", "y"), reduce(lambda w, e: F.regexp_replace(w, e[0], f"$1{e[1]}"), ENDINGS, word)).otherwise(word)


def stem_sql(word: str) -> str:
    return reduce(lambda w, e: f"regexp_replace({w}, '{e[0]}', '\\1{e[1]}')", ENDINGS, word)


def positions(chunks: DataFrame, stop: tuple[str, ...] = ()) -> DataFrame:
    """(term, id, pos): the stem of each word of chunks (id, content) at its place. Stop words have places but no rows.

    Written sorted or partitioned by term this is an index: a search reads the rows of its terms alone.
    """
    words = F.filter(F.split(F.lower("content"), WORD_BREAK), lambda w: w != "")
    own = chunks.select("id", F.posexplode(words).alias("pos", "word"))
    kept = own.where(~F.col("word").isin(*stop)) if stop else own
    return kept.select(stem(F.col("word")).alias("term"), "id", "pos")


def query_terms(spark, query: str, stop: tuple[str, ...] = ()) -> list[str]:
    """The distinct stems of a query's words."""
    one = spark.range(1).select(F.lit(0).alias("id"), F.lit(query).alias("content"))
    return sorted({r["term"] for r in positions(one, stop).collect()})


def cover_density_search(index: DataFrame, terms: list[str], k: int | None = 10, digits: int = 6) -> DataFrame:
    """(id, score, rank) of the k best chunks (all, if None) in which every term stands, from their positions.

    A cover is a shortest stretch that holds all terms: none inside it does. Each adds its weight over 1 and
    the other words it holds. From an occurrence on, the cover ends where the last of the terms has come;
    of occurrences with the same end the latest begins a cover. Equal scores go by id.
    """
    own = index.where(F.col("term").isin(*terms) if terms else F.lit(False)).select("id", "pos", "term").distinct()
    by = Window.partitionBy("id").orderBy("pos", "term")
    own = own.withColumn("at", F.struct("pos", F.row_number().over(by).alias("n")))
    # From the end on, so that a row adds to what is known of those after it.
    ahead = Window.partitionBy("id").orderBy(F.desc("pos"), F.desc("term")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    following = [F.min(F.when(F.col("term") == t, F.col("at"))).over(ahead).alias(f"next{i}") for i, t in enumerate(terms)]
    names = [f"next{i}" for i in range(len(terms))]
    whole = own.select("id", "at", *following).where(" AND ".join(f"{c} IS NOT NULL" for c in names) or "false")
    end = F.greatest(*names) if len(names) > 1 else F.col(names[0]) if names else F.col("at")
    covers = whole.select("id", "at", end.alias("end")).groupBy("id", "end").agg(F.max("at").alias("begin"))
    noise = (F.col("end.pos") - F.col("begin.pos")) - (F.col("end.n") - F.col("begin.n"))
    hit = covers.groupBy("id").agg(F.round(F.sum(WEIGHT / (1 + F.greatest(noise, F.lit(0)))), digits).alias("score"))
    if k is None:
        from evispark.operators.ranks import row_numbers

        return row_numbers(materialize(hit, "hits"), [F.desc("score"), F.col("id")])
    return hit.orderBy(F.desc("score"), "id").limit(k).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")))
