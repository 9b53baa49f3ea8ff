"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

Slot i of the schedule is the point frac(i * golden ratio), mapped through the sources' cumulative
shares to a source; a slot's rank among its source's slots is the block it takes. Each source's
documents are put in a shuffled order and repeated, and this stream of words is cut into blocks of
block_tokens words; slots and blocks are joined on (source, rank). The golden ratio spreads each
source's slots evenly, so that any stretch of the mix has nearly the target shares.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evispark.shared import materialize

WEIGHTS = (5, 2, 1)
BLOCK_TOKENS = 256
MAX_REPEATS = 3
#: Of the shuffled order of documents.
SEED = 42
#: Hash ranges by which a source's documents, and runs of slots by which the schedule, are counted in parallel.
SHUFFLE_BUCKETS, RUN = 4096, 65536
#: frac(golden ratio) in units of 2^-48; odd, so points repeat only after 2^48 slots.
UNIT = 1 << 48
STEP = int(0.6180339887498949 * UNIT) | 1
BINS = 1024


def n_words(text: Column) -> Column:
    """Words [^\\x20\\x09-\\x0D]+; null has none. Splitting at one character takes a fifth of the time of counting by a pattern."""
    spaced = F.translate(F.coalesce(text.cast("string"), F.lit("")), "\t\n\x0b\x0c\r", " " * 5)
    return F.size(F.array_remove(F.split(spaced, " "), "")).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, source_size, weight, target) from rows (source, size).

    Sources in code point order, null last, get the weights in turn. All sizes together are shared by
    weight; a target stops at max_repeats times its source's size and the excess is reshared by weight
    among the rest. That has one solution: with sources in order of cap / weight, those whose cap is
    below the level of the remaining share are capped, and the rest share what is left. Rows are one
    for each source.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1
    turn = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int"))
    cap = F.col("source_size") * max_repeats
    ranked = by_source.withColumn("weight", turn.cast("double")).withColumn("cap", cap.cast("double"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.asc_nulls_last("source"))
    everything = Window.partitionBy()
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    ranked = ranked.select("*", F.sum("source_size").over(everything).alias("total"), F.coalesce(F.sum("cap").over(before), F.lit(0.0)).alias("capped"), (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))).alias("left"))
    # The level if this source and those after it are not capped; it is the true one for the first whose cap reaches it.
    ranked = ranked.withColumn("level", (F.col("total") - F.col("capped")) / F.col("left"))
    ranked = ranked.withColumn("at", F.row_number().over(order))
    level = F.min(F.when(F.col("cap") >= F.col("level") * F.col("weight"), F.struct("at", "level"))).over(everything)
    return ranked.withColumn("level", level["level"]).select("source", "source_size", "weight", F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target"))


def schedule(targets: DataFrame, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(slot, source_key, rank, tokens): which block of which source each slot of the mix takes.

    targets has (source_key, quota), quota being a whole number of words. Every source ends with
    exactly its quota: a slot beyond it is left out, and the few that the points still owe a source
    stand at the end.
    """
    spark = targets.sparkSession
    need = F.ceil(F.col("quota") / block_tokens)
    upto = Window.orderBy("source_key").rowsBetween(Window.unboundedPreceding, 0)
    bounds = targets.where("quota > 0").withColumn("need", need).withColumn("high", F.sum("quota").over(upto))
    bounds = bounds.withColumn("total", F.sum("quota").over(Window.partitionBy()))
    scaled = lambda words: F.floor(words / F.col("total") * UNIT)
    bounds = bounds.select("source_key", "quota", "need", scaled(F.col("high") - F.col("quota")).alias("low"), F.when(F.col("high") == F.col("total"), F.lit(UNIT)).otherwise(scaled(F.col("high"))).alias("high"))
    slots = bounds.agg(F.coalesce(F.sum("need"), F.lit(0))).first()[0]
    width = UNIT // BINS
    by_bin = bounds.where("high > low").withColumn("bin", F.explode(F.sequence(F.floor(F.col("low") / width), F.floor((F.col("high") - 1) / width))))
    points = spark.range(slots).select(F.col("id").alias("slot"), F.pmod(F.col("id").cast("decimal(38,0)") * STEP, F.lit(UNIT).cast("decimal(38,0)")).cast("long").alias("point"))
    points = points.withColumn("bin", F.floor(F.col("point") / width)).withColumn("run", F.floor(F.col("slot") / RUN))
    dealt = points.join(by_bin.select("bin", "low", "high", "source_key"), "bin").where("point >= low AND point < high").select("slot", "run", "source_key")
    runs = dealt.groupBy("source_key", "run").count()
    earlier = F.sum("count").over(Window.partitionBy("source_key").orderBy("run")) - F.col("count")
    inside = F.row_number().over(Window.partitionBy("source_key", "run").orderBy("slot")) - 1
    ranked = dealt.withColumn("inside", inside).join(runs.select("source_key", "run", earlier.alias("earlier")), ["source_key", "run"]).select("slot", "source_key", (F.col("earlier") + F.col("inside")).alias("rank"))
    got = runs.groupBy("source_key").agg(F.sum("count").alias("got"))
    owed = bounds.join(got, "source_key", "left").withColumn("got", F.coalesce("got", F.lit(0))).where("got < need")
    owed = owed.select("source_key", F.explode(F.sequence("got", F.col("need") - 1)).alias("rank"))
    owed = owed.select((F.lit(slots) + F.col("rank")).alias("slot"), "source_key", "rank")
    begun = F.col("rank") * block_tokens
    out = ranked.union(owed).join(bounds.select("source_key", "quota"), "source_key").where(begun < F.col("quota"))
    return out.select("slot", "source_key", "rank", F.least(F.lit(block_tokens), F.col("quota") - begun).alias("tokens"))


def _hashes(seed: int, row_id: Column, text: Column) -> list[Column]:
    return [F.xxhash64(F.lit(seed), row_id, text).alias("hash"), F.xxhash64(text, row_id, F.lit(seed)).alias("other")]


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, block_tokens: int = BLOCK_TOKENS, max_repeats: int = MAX_REPEATS, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(pieces, rows): what the mix takes, and one row for each row of docs.

    pieces has (slot, at, row_key, row_check, first_word, n_words): slot by slot, in order of at within a
    slot, the words of a document. rows has id_col, row_key and row_check (together the row's key), hash,
    other and copy (of which the key is made), size, source_size, target (its source's), taken and
    first_slot (null where nothing is taken).
    Null texts have no words; a null source is a source; documents of equal id and text are told apart
    by a number. A source without words has target 0, and an empty table an empty mix. The order is a
    hash of id, text and seed, so reruns agree.
    """
    text = F.col("text").cast("string")
    sized = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), n_words(F.col("text")).alias("size"), *_hashes(seed, F.col(id_col), text))
    copy = F.row_number().over(Window.partitionBy("hash", "other", "id", "source").orderBy("size")) - 1
    # Two hashes make a key of 128 bits: one alone would meet itself in a large corpus.
    keys = [F.xxhash64("hash", "copy", "source").alias("row_key"), F.xxhash64(F.lit(~seed), "hash", "other", "copy", "source").alias("row_check")]
    sized = materialize(sized.withColumn("copy", copy).select("id", "source", "size", "hash", "other", "copy", *keys), "sizes")
    targets = source_targets(sized, weights, max_repeats)
    targets = materialize(targets.withColumn("source_key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))).withColumn("quota", F.round("target").cast("long")), "targets")

    keyed = sized.withColumn("source_key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")))
    keyed = keyed.withColumn("bucket", F.pmod(F.shiftright("row_key", 20), F.lit(SHUFFLE_BUCKETS)))
    totals = keyed.where("size > 0").groupBy("source_key", "bucket").agg(F.sum("size").alias("words"))
    totals = totals.select("source_key", "bucket", (F.sum("words").over(Window.partitionBy("source_key").orderBy("bucket")) - F.col("words")).alias("base"))
    inside = F.sum("size").over(Window.partitionBy("source_key", "bucket").orderBy("row_key", "row_check").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    stream = keyed.where("size > 0").withColumn("inside", inside).join(totals, ["source_key", "bucket"]).join(targets.select("source_key", "source_size", "quota"), "source_key")
    # The stream repeats up to the quota; each pass of a document is cut where blocks end.
    passes = F.sequence(F.lit(0), F.lit(max_repeats - 1))
    stream = stream.withColumn("again", F.explode(passes)).select("row_key", "row_check", "source_key", "size", "quota", (F.col("base") + F.col("inside") + F.col("again") * F.col("source_size")).alias("start")).where("start < quota")
    stop = F.least(F.col("start") + F.col("size"), F.col("quota"))
    blocks = stream.withColumn("stop", stop).withColumn("rank", F.explode(F.sequence(F.floor(F.col("start") / block_tokens), F.floor((F.col("stop") - 1) / block_tokens))))
    begin = F.greatest("start", F.col("rank") * block_tokens)
    end = F.least("stop", (F.col("rank") + 1) * block_tokens)
    blocks = blocks.select("source_key", "rank", "row_key", "row_check", begin.alias("at"), (begin - F.col("start")).alias("first_word"), (end - begin).alias("n_words"))
    pieces = schedule(targets, block_tokens).join(blocks, ["source_key", "rank"]).select("slot", "at", "row_key", "row_check", "first_word", "n_words")
    taken = pieces.groupBy("row_key", "row_check").agg(F.sum("n_words").alias("taken"), F.min("slot").alias("first_slot"))
    rows = keyed.join(targets.select("source_key", "source_size", "target"), "source_key").join(taken, ["row_key", "row_check"], "left")
    return pieces, rows.select(F.col("id").alias(id_col), "row_key", "row_check", "hash", "other", "copy", "first_slot", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


#: The columns that take() adds.
TAKEN = ("size", "source_size", "target", "taken", "first_slot")


def take(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """The rows of docs that the mix takes, with their columns and size, source_size, target, taken (words, repeats counted) and first_slot.

    Sorted by first_slot this is the mix, a row being repeated taken / size times. Rows equal in id,
    text and source are the same document: each has its own taken, and the other columns of one of
    them. Columns of docs named as those added are left out. Without words nothing is taken.
    """
    rows = mix(docs, id_col, source_col, weights)[1].where("taken > 0")
    source_key = F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("n")).alias("_key")
    kept = [c for c in docs.columns if c not in TAKEN]
    own = docs.select(F.struct(*kept).alias("_row"), *_hashes(SEED, F.col(id_col), F.col("text").cast("string")), source_key)
    one = own.groupBy("hash", "other", "_key").agg(F.first("_row").alias("_row"))
    rows = rows.select("hash", "other", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias("_key"), *TAKEN)
    return one.join(rows, ["hash", "other", "_key"]).select(*(F.col("_row")[c].alias(c) for c in kept), *TAKEN)


def digest_columns(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken."""
    return mix(docs)[1].select("doc_id", "size", "source_size", "target", "taken")
