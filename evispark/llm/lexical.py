"""Ranked lexical search of many queries at once, by common-subexpression evaluation.

A score is a sum over an item's terms, and items share terms. The terms that many items share are mined
for common sets: again and again the two summands that stand together in most items become one, so the
plan is a graph in which each shared set is added up once. In the scoring pass a group of documents has
one accumulator for each node of the graph; they are filled level by level, and an item's scores
are the sum of the few nodes that are left of it.
"""

from __future__ import annotations

import heapq
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evispark.llm.texts import NOT_WORD
from evispark.llm.vectors import MOST, Best, best_rows, id_array
from evispark.shared import materialize

#: Pairs of an item and a term in a block of items; each block is one plan and one pass over the documents.
BLOCK_TERMS = 20_000
#: An item's terms are mined in pieces of so many, so that its pairs stay in proportion to its terms.
PIECE = 64
#: Cells of the accumulators of a group of documents.
CELLS = 1 << 21
#: Bytes of a text that are cut into words at once.
PART = 1 << 20
#: Bytes to what counts as them: A-Z as a-z, all that ends a word as a space.
TO_WORDS = bytes(0x20 if NOT_WORD[b] and not 0x41 <= b <= 0x5A else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def words(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in order, in parts, so that the words of a long text are not held at once."""
    start = 0
    while start < len(text):
        end = start + PART
        while end < len(text) and TO_WORDS[text[end]] != 0x20:
            end += 1
        yield text[start:end].translate(TO_WORDS).split()
        start = end


@dataclass(frozen=True)
class Plan:
    """Node i < terms is a term; a later one, the sum of its left and right. levels: ranges of later nodes that need only earlier ones. items: their nodes."""

    terms: int
    left: np.ndarray
    right: np.ndarray
    levels: list[tuple[int, int]]
    items: list[list[int]]

    @property
    def nodes(self) -> int:
        return self.terms + len(self.left)


def mine(items: list[list[int]], terms: int) -> Plan:
    """The query-sharing graph of items, lists of distinct terms: while two nodes stand together in two pieces or more, those of most become one node."""
    often = Counter(t for own in items for t in own)
    pieces: list[set[int]] = []
    of: list[list[int]] = []
    for own in items:
        ranked = sorted(own, key=lambda t: (-often[t], t))
        cut = [ranked[i : i + PIECE] for i in range(0, len(ranked), PIECE)]
        of.append(list(range(len(pieces), len(pieces) + len(cut))))
        pieces += [set(c) for c in cut]
    where: dict[int, set[int]] = defaultdict(set)
    shared = {t for t, n in often.items() if n > 1}
    for p, own in enumerate(pieces):
        for x in own & shared:
            where[x].add(p)
    holds = {(c // terms, c % terms): set() for c in _frequent([own & shared for own in pieces], terms)}
    for p, own in enumerate(pieces):
        for pair in holds.keys() & set(combinations(sorted(own & shared), 2)):
            holds[pair].add(p)
    heap = [(-len(own), pair) for pair, own in holds.items()]
    heapq.heapify(heap)
    made: list[tuple[int, int]] = []
    while heap:
        n, (x, y) = heapq.heappop(heap)
        both = holds.get((x, y), set())
        if len(both) != -n:  # as it was when it went in; the newer count went in too
            continue
        new = terms + len(made)
        made.append((x, y))
        meets: dict[int, set[int]] = defaultdict(set)
        gone: set[tuple[int, int]] = set()
        for p in both:
            pieces[p] -= {x, y}
            for z in pieces[p]:
                if z in where:
                    meets[z].add(p)
                    gone |= {(min(x, z), max(x, z)), (min(y, z), max(y, z))}
            pieces[p].add(new)
        del holds[x, y]
        for pair in gone & holds.keys():
            holds[pair] -= both
            if len(holds[pair]) > 1:
                heapq.heappush(heap, (-len(holds[pair]), pair))
            else:
                del holds[pair]
        where[new] = set(both)
        for z, own in meets.items():
            if len(own) > 1:
                holds[z, new] = own
                heapq.heappush(heap, (-len(own), (z, new)))
    return _leveled(made, terms, [sorted(n for p in own for n in pieces[p]) for own in of])


def _frequent(pieces: list[set[int]], terms: int) -> list[int]:
    """Pairs x < y that stand in two pieces or more, as x * terms + y."""
    codes = [np.zeros(0, np.int64)]
    for own in pieces:
        known = np.array(sorted(own), np.int64)
        x, y = np.triu_indices(len(known), 1)
        codes.append(known[x] * terms + known[y])
    found, times = np.unique(np.concatenate(codes), return_counts=True)
    return found[times > 1].tolist()


def _leveled(made: list[tuple[int, int]], terms: int, items: list[list[int]]) -> Plan:
    """Nodes numbered anew by their depth, so that each level is a range."""
    depth = [0] * terms
    for x, y in made:
        depth.append(1 + max(depth[x], depth[y]))
    order = sorted(range(terms, len(depth)), key=lambda i: (depth[i], i))
    new = {**{i: i for i in range(terms)}, **{i: terms + k for k, i in enumerate(order)}}
    left, right = (np.array([new[made[i - terms][side]] for i in order], np.int64) for side in (0, 1))
    deep = np.array([depth[i] for i in order], np.int64)
    cuts = [terms, *(terms + np.flatnonzero(np.diff(deep)) + 1).tolist(), len(depth)] if order else []
    return Plan(terms, left, right, list(zip(cuts, cuts[1:])), [sorted(new[n] for n in own) for own in items])


def accumulated(plan: Plan, leaves: np.ndarray) -> np.ndarray:
    """Accumulators (node, document) with those of the terms given: each shared set is added up once."""
    out = np.empty((plan.nodes, leaves.shape[1]), np.int64)
    out[: plan.terms] = leaves
    for start, end in plan.levels:
        at = slice(start - plan.terms, end - plan.terms)
        np.add(out[plan.left[at]], out[plan.right[at]], out=out[start:end])
    return out


def item_terms(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """(item_id, terms, block): each item's distinct terms as UTF-8 in order; rows of one id are one item. Blocks hold about BLOCK_TERMS of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            found = [sorted({w for part in words(t or b"") for w in part}) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.binary()))], ["item_id", "terms"])

    kind = items.schema[item_id].dataType.simpleString()
    found = items.select(F.col(item_id).alias("item_id"), F.col(text).alias("text")).mapInArrow(run, f"item_id {kind}, terms array<binary>")
    return found.select("item_id", F.explode("terms").alias("term")).groupBy("item_id").agg(F.array_sort(F.collect_set("term")).alias("terms"))


def matched(docs: DataFrame, vocabulary: list[bytes], id_col: str, text: str) -> DataFrame:
    """(doc_id, n, terms, times): of each document its number of terms, and which of the vocabulary it holds how often."""
    known = docs.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(vocabulary)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = known.value
        for batch in batches:
            n, terms, times = [], [], []
            for text in batch.column(1).cast(pa.binary()):
                total, held = 0, Counter()
                for part in words(text.as_py() or b""):
                    total += len(part)
                    held.update(filter(numbers.__contains__, part))
                n.append(total)
                terms.append([numbers[t] for t in held])
                times.append(list(held.values()))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(times, pa.list_(pa.int64()))], ["doc_id", "n", "terms", "times"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, n long, terms array<int>, times array<long>")


def document_frequencies(rows: DataFrame, terms: int) -> DataFrame:
    """(term, df): in how many rows (terms) each of the vocabulary stands; a task sends one row for each term it has met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(terms, np.int64)
        for batch in batches:
            counts += np.bincount(batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.int64), minlength=terms)
        met = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int64()), pa.array(counts[met])], ["term", "df"])

    return rows.select("terms").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))


def gains(times: np.ndarray, n: np.ndarray, weight: np.ndarray, documents: int, length: int) -> np.ndarray:
    """w * ((10^9 tf) div (1000 tf + 20 m)) with m = 50 + (50 n N) div L, of terms with weight w that stand tf times in documents of n terms."""
    if len(n) and int(n.max()) * 50 * documents > MOST:
        m = np.array([50 + 50 * int(x) * documents // length for x in n], np.int64)
    else:
        m = 50 + 50 * n * documents // max(1, length)
    return weight * (1_000_000_000 * times // (1000 * times + 20 * m))


def scores(rows: DataFrame, plan: Plan, weights: np.ndarray, documents: int, length: int, k: int) -> DataFrame:
    """(item, doc_id, score): of each task the k best documents of each item with a score above 0."""
    known = rows.sparkSession.sparkContext.broadcast((plan, weights, [len(own) for own in plan.items], np.array([n for own in plan.items for n in own], np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, weights, sizes, nodes = known.value
        best, least = Best(k), np.zeros(len(sizes), np.int64)
        filled = np.flatnonzero(sizes)
        starts = (np.cumsum(sizes) - sizes)[filled]
        step = max(1, CELLS // max(1, plan.nodes))
        for whole in batches:
            for start in range(0, whole.num_rows, step):
                batch = whole.slice(start, step)
                ids, _ = id_array(batch.column(0))
                at = np.repeat(np.arange(len(ids)), np.diff(batch.column(2).offsets.to_numpy()))
                term, times = (batch.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in (2, 3))
                leaves = np.zeros((plan.terms, len(ids)), np.int64)
                leaves[term, at] = gains(times, batch.column(1).to_numpy()[at], weights[term], documents, length)
                if not len(filled):
                    continue
                sums = np.add.reduceat(accumulated(plan, leaves)[nodes], starts, axis=0)
                item, doc = np.nonzero((sums > 0) & (sums >= least[filled, None]))
                if best.add(filled[item], sums[item, doc], ids[doc]):
                    least = np.maximum(best.floors(len(sizes)), 0)
        item, score, ident = best.cut()
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (item, ident, score)], ["item", "doc_id", "score"])

    return rows.mapInArrow(run, "item long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of highest score above 0 for each item, equal scores by smaller doc_id, null last.

    Terms are maximal runs of letters, digits and characters beyond ASCII, A-Z in lower case. A null or
    empty text has none, and counts neither among the documents nor among the items; items that match
    nothing have no rows. Texts of any length are read whole. Rows that share an item_id (null too) are one
    item of all their terms; rows that repeat a doc_id are documents of their own. Empty tables give no
    rows; other columns are ignored.
    """
    spark = docs.sparkSession
    own = materialize(item_terms(items, item_id, item_text), "items")
    total = own.agg(F.sum(F.size("terms"))).first()[0] or 0
    n = 1 + total // block_terms
    kind = own.schema["item_id"].dataType.simpleString()
    answers = []
    for i in range(n if total else 0):
        table = (own if n == 1 else own.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == i)).toArrow()
        if table.num_rows:
            answers.append(_of_block(docs, table, k, id_col, text, kind))
    return reduce(DataFrame.union, answers) if answers else spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")


def _of_block(docs: DataFrame, table: pa.Table, k: int, id_col: str, text: str, kind: str) -> DataFrame:
    spark = docs.sparkSession
    lists = table.column("terms").to_pylist()
    vocabulary = sorted({t for own in lists for t in own})
    number = {t: i for i, t in enumerate(vocabulary)}
    plan = mine([[number[t] for t in own] for own in lists], len(vocabulary))
    rows = materialize(matched(docs, vocabulary, id_col, text), "matched")
    documents, length = rows.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    odds = F.lit(float(2 * documents + 2)) / (2 * F.col("df") + 1)
    weighed = document_frequencies(rows, len(vocabulary)).select("term", F.floor(1000 * F.log(odds)).alias("w")).toArrow()
    weights = np.zeros(len(vocabulary), np.int64)
    weights[weighed.column("term").to_numpy()] = weighed.column("w").to_numpy()
    found = best_rows(scores(rows, plan, weights, documents, length, k), ["item"], [F.desc("score"), F.asc("doc_id")], k)
    ids = spark.createDataFrame([(i, x) for i, x in enumerate(table.column("item_id").to_pylist())], f"item long, item_id {kind}")
    return found.join(F.broadcast(ids), "item").select("item_id", "rank", F.nullif(F.col("doc_id"), F.lit(MOST)).alias("doc_id"), "score")
