"""Benchmark decontamination: test windows as a broadcast hash set, looked up at every word of the training texts.

Texts are lower-cased (A-Z) and cut into words. A window is WINDOW consecutive words of an item; a
shorter item is one window. Hash hits are verified word by word. A benchmark whose windows exceed
block_windows is looked up in blocks, each small enough to broadcast.
"""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evispark.llm.texts import NOT_WORD, map_texts, shingle_hashes, text_column, word_hashes
from evispark.shared import materialize

WINDOW = 10
#: Windows of one broadcast, of some 100 bytes each.
BLOCK_WINDOWS = 200_000


def _words(text: bytes) -> list[bytes]:
    return bytes(text.lower()).translate(_SPACED).split()


_SPACED = bytes(32 if NOT_WORD[i] else i for i in range(256))


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id string, n, words) for each window of each item with words; words are joined by a space."""

    def work(texts: list[bytes], kept: dict[str, list]) -> dict[str, object]:
        ids, sizes, words = [], [], []
        for item, t in zip(kept["item_id"], texts, strict=True):
            w = _words(t)
            n = min(window, len(w))
            for i in range(len(w) - n + 1 if w else 0):
                ids.append(item)
                sizes.append(n)
                words.append(b" ".join(w[i : i + n]))
        return {"item_id": ids, "n": sizes, "words": words}

    items = benchmark.where("item_id IS NOT NULL").select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    return map_texts(items, ["item_id"], "item_id string, n int, words binary", work)


class _Block:
    """A hash set of windows by length; the lowest bits of their hashes rule out most places at once."""

    def __init__(self, rows: list) -> None:
        items: dict[tuple[int, bytes], set[str]] = defaultdict(set)
        for r in rows:
            items[r["n"], bytes(r["words"])].add(r["item_id"])
        by_length: dict[int, list[bytes]] = defaultdict(list)
        for n, words in items:
            by_length[n].append(words)
        self.items = {k: sorted(v) for k, v in items.items()}
        self.lengths = {}
        for n, windows in by_length.items():
            hashes, _ = word_hashes(windows, NOT_WORD)
            own = np.array([shingle_hashes(hashes[i : i + n], n)[0] for i in range(0, len(hashes), n)], np.uint64)
            mask = np.zeros(1 << 20, bool)
            mask[(own & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
            self.lengths[n] = (np.unique(own), mask)


def _look_up(texts: list[bytes], known: _Block) -> tuple[np.ndarray, list[list[dict]], list[list[str]]]:
    """For each text its number of words, merged spans of hit words and items."""
    hashes, counts = word_hashes(texts, NOT_WORD)
    ends = np.cumsum(counts)
    places = []
    for n, (own, mask) in known.lengths.items():
        if len(hashes) < n:
            continue
        h = shingle_hashes(hashes, n)
        at = np.flatnonzero(mask[(h & np.uint64((1 << 20) - 1)).astype(np.int64)])
        near = np.searchsorted(own, h[at])
        at = at[own[np.minimum(near, len(own) - 1)] == h[at]]
        doc = np.searchsorted(ends, at, side="right")
        whole = at + n <= ends[doc] if len(at) else np.zeros(0, bool)
        places += [(d, a, n) for d, a in zip(doc[whole].tolist(), at[whole].tolist(), strict=True)]
    hit: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for d, a, n in places:
        hit[d].append((a - int(ends[d] - counts[d]), n))
    spans, items = [[] for _ in texts], [[] for _ in texts]
    for d, starts in hit.items():
        words, found, merged = _words(texts[d]), set(), []
        for a, n in sorted(starts):
            if own := known.items.get((n, b" ".join(words[a : a + n]))):
                found.update(own)
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], a + n)
                else:
                    merged.append([a, a + n])
        spans[d], items[d] = [{"start": a, "end": b} for a, b in merged], sorted(found)
    return counts, spans, items


def _scan(docs: DataFrame, id_col: str, block: _Block) -> DataFrame:
    """(id, n_words, spans, items) for each document: merged spans of hit words and the items whose windows occur."""
    shared = docs.sparkSession.sparkContext.broadcast(block)

    def work(texts: list[bytes], kept: dict[str, list]) -> dict[str, object]:
        counts, spans, items = _look_up(texts, shared.value)
        return {"id": kept["id"], "key": kept["key"], "n_words": counts, "spans": spans, "items": items}

    kind = docs.schema[id_col].dataType.simpleString()
    text = F.col("text").cast("string")
    inner = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("key"), text.alias("text"))
    return map_texts(inner, ["id", "key"], f"id {kind}, key bigint, n_words bigint, spans array<struct<start:bigint,end:bigint>>, items array<string>", work)


def find_overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", window: int = WINDOW, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """A row for each row of docs: id, n_words, spans of hit words (start, end exclusive; merged) and the items found, sorted.

    Null texts have no words, and items without words or without item_id no windows; an empty benchmark
    hits nothing. Copies of a row get the same result. Only id_col and text are read.
    """
    windows = benchmark_windows(benchmark, window)
    total = windows.count()
    blocks = max(1, math.ceil(total / block_windows))
    if blocks == 1:
        one = _scan(docs, id_col, _Block(windows.collect()))
        return one.select(F.col("id").alias(id_col), "n_words", "spans", "items")
    windows = materialize(windows, "windows").withColumn("block", F.pmod(F.xxhash64("n", "words"), F.lit(blocks)))
    parts = None
    for b in range(blocks):
        part = materialize(_scan(docs, id_col, _Block(windows.where(F.col("block") == b).collect())).where((F.size("items") > 0)), "overlaps")
        parts = part if parts is None else parts.union(part)
    found = parts.groupBy("id", "key").agg(F.array_sort(F.flatten(F.collect_set("spans"))).alias("all"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    empty = F.array().cast("array<struct<start:bigint,end:bigint>>")
    last = lambda done: F.element_at(done, -1)
    joined = lambda done, s: F.when((F.size(done) > 0) & (s["start"] <= F.try_element_at(done, F.lit(-1))["end"]), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last(done)["start"].alias("start"), F.greatest(last(done)["end"], s["end"]).alias("end"))))).otherwise(F.concat(done, F.array(s)))
    found = found.select("id", "key", F.aggregate("all", empty, joined).alias("spans"), "items")
    rows = _scan(docs, id_col, _Block([])).select(F.col("id").alias("own"), F.col("key").alias("own_key"), "n_words")
    out = rows.join(found, rows["own"].eqNullSafe(found["id"]) & (rows["own_key"] == found["key"]), "left")
    return out.select(F.col("own").alias(id_col), "n_words", F.coalesce("spans", empty).alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def digest_columns(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    found = find_overlaps(docs, benchmark)
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """The rows of docs, all columns, in which no window of the benchmark occurs; order and copies of rows do not matter.

    Each block of windows is one pass over what the blocks before it left.
    """
    windows = benchmark_windows(benchmark)
    blocks = max(1, math.ceil(windows.count() / block_windows))
    windows = windows.withColumn("block", F.pmod(F.xxhash64("n", "words"), F.lit(blocks)))
    for b in range(blocks):
        shared = docs.sparkSession.sparkContext.broadcast(_Block(windows.where(F.col("block") == b).collect()))
        clean = text_column(lambda texts, shared=shared: [not items for items in _look_up(texts, shared.value)[2]], "boolean")
        docs = docs.where(clean(F.col("text").cast("string")))
        if b + 1 < blocks:
            docs = materialize(docs, "clean")
    return docs
