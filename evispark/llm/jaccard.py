"""Similarity self-join of shingle sets by a grouped prefix join, and its classes.

A document is the set of its shingles of `size` words. All shingles have one order: those that are rare come
first. Two sets that link have LEAST of the first shingles in common: of the first
n - ceil(percent / 100 * n) + LEAST of a set of n. So:

1. Shingles of one LANE in four are counted over all documents, to tell the frequent ones.
2. Documents with the same size and prefix become one group; groups are listed under each shingle of
   the prefix. Lists of up to SHORT groups give pairs; pairs with LEAST shingles in common are expanded
   to the groups' distinct sets and verified.
3. Sets in longer lists ("busy") are joined among themselves once more, in the order of exact counts of
   all their shingles. A pair with a set that is not busy shares short lists only, so nothing is lost.
   What is still a long list is verified against one leader at a time, and then each set outside the
   list's largest class against the rest of the list: never all pairs of one large class of copies.
   Pairs with fewer than LEAST shingles in common in short lists can link by those in long lists too:
   they are verified last, where they are still apart and what is left of both sets allows it.

Only classes are asked for, so a pair whose ends are in one class already is not verified.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evispark.llm.texts import IDS_MAX, SPACES, among, group_ends, shingle_hashes, sorted_ids, word_hashes
from evispark.operators.components import connected_components
from evispark.shared import materialize, temporary_tables

SIZE = 4
#: Sets link when 100 * intersection >= percent * union.
PERCENT = 85
#: Common shingles that a pair must have in its prefixes to be verified.
LEAST = 3
#: One shingle in so many is counted in the first pass.
LANE = 4
#: Documents that hold a shingle, from which it is frequent; raised until the frequent ones fit FREQUENT_MAX (16 bytes each, broadcast).
FREQUENT, FREQUENT_MAX = 16, 2_000_000
#: Groups in a list, or sets in a group, up to which all pairs are made.
SHORT = 16
#: Rounds of leaders over long lists before the rest is compared.
LEADERS = 2
#: Steps of a label to a lesser one.
JUMPS = 3


def _needed(n, percent: int):
    """ceil(percent / 100 * n): the least intersection of a set of n with any that it links to."""
    return (percent * n + 99) // 100


def shingle_sets(texts: list[bytes], size: int = SIZE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words, counts = word_hashes(texts, SPACES)
    out, at = [], 0
    for n in counts.tolist():
        out.append(np.unique(shingle_hashes(words[at : at + n], size)))
        at += n
    return out


def _over_sets(docs: DataFrame, schema: str, work, size: int, wanted: Broadcast | None = None) -> DataFrame:
    """work(ids, sets) -> columns, over groups of documents of bounded size; docs has (id, text), or (id, own) with sets already made; wanted is a sorted array of the ids to take."""
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructType

    kinds = {f.name: to_arrow_type(f.dataType) for f in StructType.fromDDL(schema)}
    made = "own" in docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if wanted is not None:
                batch = batch.filter(pa.array(among(wanted.value, batch.column(0))))  # noqa: PLW2901
            contents = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            ids = batch.column(0).to_pylist()
            start = 0
            for end in group_ends([len(t) for t in contents]) if contents else []:
                part = contents[start:end]
                sets = [np.frombuffer(t, np.uint64) for t in part] if made else shingle_sets(part, size)
                yield pa.RecordBatch.from_pydict({k: v if isinstance(v, pa.Array) else pa.array(v, kinds[k]) for k, v in work(ids[start:end], sets).items()})
                start = end

    return docs.select("id", "own" if made else "text").mapInArrow(run, schema)


def _frequent(docs: DataFrame, lane: int, least: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of the lane (hash % lane = 0) that stand in least documents or more, and in how many. Counts cover all docs."""

    def work(ids: list, sets: list[np.ndarray]) -> dict[str, object]:
        every = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        h, n = np.unique(every[every % np.uint64(lane) == 0], return_counts=True)
        return {"h": pa.array(h.view(np.int64)), "n": pa.array(n, pa.int64())}

    counts = _over_sets(docs, "h bigint, n bigint", work, size).groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    counts = materialize(counts, "frequent")
    while counts.where(F.col("n") >= least).count() > FREQUENT_MAX:
        least *= 2
    found = counts.where(F.col("n") >= least).toArrow()
    h, n = found.column("h").to_numpy().view(np.uint64), found.column("n").to_numpy()
    order = np.argsort(h)
    return h[order], n[order]


def _prefixes(docs: DataFrame, lane: int, frequent: tuple[np.ndarray, np.ndarray], words: int, percent: int) -> DataFrame:
    """(id, n, digest of the set, digest of size and prefix, prefix) for every document, of shingles of so many words."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def work(ids: list, sets: list[np.ndarray]) -> dict[str, object]:
        known, times = shared.value
        every = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        # The order: counted and rare, not counted, frequent by count; equal ones by hash.
        rank = np.where(every % np.uint64(lane) == 0, 0, 1)
        if len(known) and len(every):
            near = np.minimum(np.searchsorted(known, every), len(known) - 1)
            rank = np.where(known[near] == every, times[near] + 1, rank)
        n, digests, keys, prefixes, at = [], [], [], [], 0
        for own in sets:
            size = len(own)
            own_rank = rank[at : at + size]
            at += size
            needed = _needed(size, percent)
            length = size - needed + min(LEAST, needed)
            first = own[np.lexsort((own, own_rank))[:length]] if size else own
            n.append(size)
            digests.append(blake2b(own.tobytes(), digest_size=16).digest())
            keys.append(blake2b(first.tobytes() + size.to_bytes(8, "little"), digest_size=16).digest())
            prefixes.append(first.view(np.int64))
        return {"id": ids, "n": n, "digest": digests, "key": keys, "prefix": prefixes}

    return _over_sets(docs, "id bigint, n bigint, digest binary, key binary, prefix array<bigint>", work, words)


def _close(a, b, percent: int):
    """Sizes at which two sets can link."""
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _in_common(lists: DataFrame, percent: int) -> DataFrame:
    """(a, b, common, enough) over lists (s, members (node, n)): pairs in order, and whether the shingles in common are enough for their sizes."""
    pairs = lists.select(F.explode(F.flatten(F.transform("members", lambda x, i: F.transform(F.filter(F.slice("members", i + 2, F.size("members")), lambda y: _close(x["n"], y["n"], percent)), lambda y: F.struct(x.alias("a"), y.alias("b")))))).alias("p"))
    pairs = pairs.select(F.least("p.a.node", "p.b.node").alias("a"), F.greatest("p.a.node", "p.b.node").alias("b"), F.least("p.a.n", "p.b.n").alias("n"))
    needed = F.floor((percent * F.col("n") + 99) / 100)
    pairs = pairs.groupBy("a", "b").agg(F.count("*").alias("common"), F.min("n").alias("n"))
    return pairs.select("a", "b", "common", (F.col("common") >= F.least(F.lit(LEAST), needed)).alias("enough"))


def _short_pairs(lists: DataFrame, percent: int) -> DataFrame:
    """(a, b, common): the pairs of _in_common with enough."""
    return _in_common(lists, percent).where("enough").drop("enough")


def _bounded(x_left, y_left, x_n, y_n, percent: int, before=0):
    """Whether sets can link that have `before` shingles in common, and besides these no more than what is left of either."""
    return (F.least(x_left, y_left) + before) * (100 + percent) >= percent * (x_n + y_n)


def _few_pairs(few: DataFrame, long: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b, common) with too few shingles in common in short lists, those in different classes that can link by what stands from their first long list on."""
    first = materialize(long.groupBy("node").agg(F.min("at").alias("at"), F.min("n").alias("n")), "first")
    for c in ("a", "b"):
        few = few.join(first.toDF(c, f"{c}_at", f"{c}_n"), c)
    few = few.where(_bounded(F.col("a_n") - F.col("a_at"), F.col("b_n") - F.col("b_at"), F.col("a_n"), F.col("b_n"), percent, F.col("common")))
    return _apart(few.select("a", "b"), classes).select("a", "b")


def _listed(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (s, node, n, ...) in lists of 2 or more: (short lists as arrays, rows of long lists).

    Lists are counted with partial sums, and rows of long lists go before rows are dealt by s, so that
    no task holds a long list. Where the long ones are too many to broadcast, the rows are written
    after the join that tells them: a join by itself may be split where a key is hot.
    """
    long_keys = materialize(rows.groupBy("s").count().where(F.col("count") > SHORT).select("s"), "long-keys")
    short = rows.select("s", "node", "n").join(long_keys, "s", "left_anti")
    if long_keys.count() > IDS_MAX:
        short = materialize(short, "short")
    lists = short.groupBy("s").agg(F.collect_list(F.struct("node", "n")).alias("members")).where(F.size("members") > 1)
    return lists, rows.join(long_keys, "s", "left_semi")


def _sets_of(docs: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """(id, own) with the whole sets of the documents in ids, which are distinct."""
    wanted = None
    if ids.count() > IDS_MAX:
        docs = docs.join(ids, "id", "left_semi")
    else:
        wanted = docs.sparkSession.sparkContext.broadcast(sorted_ids(ids))
    own = _over_sets(docs, "id bigint, own binary", lambda ids, sets: {"id": ids, "own": [s.tobytes() for s in sets]}, size, wanted)
    return materialize(own, "own")


def _verified(sets: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets link."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("of_a"), batch.column("of_b"), strict=True):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(100 * both >= percent * (len(p) + len(q) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    joined = pairs.select("a", "b").join(sets.select(F.col("id").alias("b"), F.col("own").alias("of_b")), "b")
    joined = joined.join(sets.select(F.col("id").alias("a"), F.col("own").alias("of_a")), "a")
    return materialize(joined.select("a", "b", "of_a", "of_b").mapInArrow(check, "a bigint, b bigint"), "links")


def _labels(links: DataFrame) -> DataFrame:
    """(node, label): the least of the lesser nodes a node links to, followed for JUMPS steps. Nodes of one label are linked; the reverse need not hold."""
    step = materialize(links.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("label")), "labels")
    now = step
    for _ in range(JUMPS):
        now = now.join(step.toDF("label", "next"), "label", "left").select("node", F.coalesce("next", "label").alias("label"))
    return now


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs (a, b) whose ends have different labels; a node without one is its own."""
    for c in ("a", "b"):
        pairs = pairs.join(labels.toDF(c, f"{c}_in"), c, "left").withColumn(f"{c}_in", F.coalesce(f"{c}_in", c))
    return pairs.where("a_in <> b_in")


def _verify_in_turn(sets: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """Links of pairs (a, b, common), a < b: for each set the pair with most in common is verified, then of the others those that are not linked by these."""
    best = pairs.groupBy("b").agg(F.max_by("a", F.struct("common", -F.col("a"))).alias("a")).select("a", "b")
    best = materialize(best, "best")
    links = _verified(sets, best, percent)
    rest = _apart(pairs.join(best, ["a", "b"], "left_anti").select("a", "b"), _labels(links)).select("a", "b")
    return links.union(_verified(sets, materialize(rest, "rest"), percent))


def _candidates(prefixes: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(pairs (a, b, common) to verify, busy sets (id)) of the first pass."""
    groups = materialize(sets.groupBy("n", "key").agg(F.min("set").alias("group"), F.count("*").alias("sets")), "groups")
    of_groups = prefixes.groupBy("n", "key").agg(F.min(F.struct("id", "prefix")).alias("least"))
    rows = of_groups.select(F.explode("least.prefix").alias("s"), F.col("least.id").alias("node"), "n")
    short, long = _listed(rows)
    members = sets.join(groups, ["n", "key"]).select("group", "set", (F.col("sets") > SHORT).alias("large"))
    crowded = members.where("large").select("set")
    busy = long.select(F.col("node").alias("group")).distinct().join(members, "group").select("set").union(crowded).distinct().select(F.col("set").alias("id"))
    between = _short_pairs(short, percent)
    side = lambda c: members.select(F.col("group").alias(c), F.col("set").alias(f"{c}_set"), F.col("large").alias(f"{c}_large"))
    expanded = between.join(side("a"), "a").join(side("b"), "b").where("NOT (a_large AND b_large)")
    expanded = expanded.select(F.least("a_set", "b_set").alias("a"), F.greatest("a_set", "b_set").alias("b"), "common")
    small = members.where("NOT large")
    inside = small.select("group", F.col("set").alias("a")).join(small.select("group", F.col("set").alias("b")), "group").where("a < b").select("a", "b", F.lit(1 << 20).cast("long").alias("common"))
    return materialize(expanded.union(inside), "pairs"), materialize(busy, "busy")


def _second_pass(sets: DataFrame, size: int, percent: int) -> list[DataFrame]:
    """Links among busy sets, sets (id, own) being theirs alone."""
    prefixes = _prefixes(sets, 1, _frequent(sets, 1, 2, size), size, percent).where("n > 0")
    rows = materialize(prefixes.select(F.posexplode("prefix").alias("at", "s"), F.col("id").alias("node"), "n"), "rows")
    short, long = _listed(rows)
    pairs, long = materialize(_in_common(short, percent), "pairs"), materialize(long, "long")
    links = [_verify_in_turn(sets, pairs.where("enough").drop("enough"), percent)]
    member = lambda c: F.struct("at", "node", "n", *c)
    for turn in range(LEADERS + 1):
        if turn == 0:
            # The set with the fewest rarer shingles leads its list.
            classed = long.withColumn("node_in", F.col("node"))
            lead = classed.groupBy("s").agg(F.min(member(["node_in"])).alias("y"))
        else:
            classes = materialize(connected_components(reduce(DataFrame.union, links), "a", "b"), "classes")
            classed = long.join(classes.toDF("node", "node_in"), "node", "left").withColumn("node_in", F.coalesce("node_in", "node"))
            in_class = classed.groupBy("s", "node_in").agg(F.count("*").alias("size"))
            largest = in_class.groupBy("s").agg(F.max(F.struct("size", "node_in")).alias("top"), F.count("*").alias("classes")).where("classes > 1")
            largest = materialize(largest.select("s", F.col("top.node_in").alias("top")), "largest")
            if largest.isEmpty():
                break
            classed = classed.join(largest, "s")
            outside = classed.where("node_in <> top")
            lead = outside.groupBy("s").agg(F.min(member(["node_in"])).alias("y")) if turn < LEADERS else outside.select("s", member(["node_in"]).alias("y"))
        rest = classed.select("s", member(["node_in"]).alias("x"))
        # Where s is the first that both have, what follows it in either bounds what they have in common. Pairs
        # that have others before it, in short lists, are left to _few_pairs.
        bound = _bounded(F.col("x.n") - F.col("x.at"), F.col("y.n") - F.col("y.at"), F.col("x.n"), F.col("y.n"), percent)
        apart = rest.join(lead, "s").where((F.col("x.node_in") != F.col("y.node_in")) & _close(F.col("x.n"), F.col("y.n"), percent) & bound)
        apart = apart.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()
        links.append(_verified(sets, materialize(apart, "apart"), percent))
    few = _few_pairs(pairs.where("NOT enough"), long, classes, percent)
    links.append(_verified(sets, materialize(few, "few"), percent))
    return links


def link_classes(docs: DataFrame, id_col: str = "doc_id", size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """A row for each row of docs: id, n_shingles, component_id (least id that links reach; its own where nothing links).

    Words are split at white space and A-Z lower-cased; fewer than size words are one shingle, none (a
    null or empty text) is an empty set, which links with nothing. Rows with equal ids count as linked.
    Ids are integers; a null id gets a null component. Only id and text are read.
    """
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    with temporary_tables(docs.sparkSession):
        every = materialize(_prefixes(own, LANE, _frequent(own, LANE, FREQUENT, size), size, percent), "prefixes")
        prefixes = every.where("id IS NOT NULL AND n > 0")
        named = materialize(prefixes.groupBy("n", "key", "digest").agg(F.min("id").alias("set")), "sets")
        pairs, busy = _candidates(prefixes, named, percent)
        sets = _sets_of(own, pairs.select(F.col("a").alias("id")).union(pairs.select("b")).union(busy).distinct(), size)
        links = [_verify_in_turn(sets, pairs, percent)]
        if not busy.isEmpty():
            links += _second_pass(materialize(sets.join(busy, "id", "left_semi"), "busy-sets"), size, percent)
        # Ids that stand for several sets tie them.
        whole = materialize(prefixes.select("id", "n", "key", "digest").join(named, ["n", "key", "digest"]).select("id", "set").distinct(), "members")
        repeated = whole.join(whole.groupBy("id").count().where("count > 1").select("id"), "id").select(F.col("set").alias("a"), F.col("id").alias("b"))
        classes = materialize(connected_components(reduce(DataFrame.union, [*links, repeated]), "a", "b"), "classes")
        of_id = whole.join(classes.toDF("set", "component"), "set", "left").groupBy("id").agg(F.min(F.coalesce("component", "set")).alias("component"))
        found = every.select("id", F.col("n").alias("n_shingles")).join(of_id, "id", "left")
        found = materialize(found.select("id", "n_shingles", F.coalesce("component", "id").alias("component")), "found", outlives=True)
    return found.toDF(id_col, "n_shingles", "component_id")
