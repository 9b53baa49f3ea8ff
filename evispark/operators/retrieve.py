"""Lexical, vector and fused retrieval, and what is derived from the hits (R)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal
from functools import reduce
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from evispark.operators.ranks import row_numbers
from evispark.shared import materialize


def l2_normalise(v: Column) -> Column:
    """V over its length, which counts as 1e-10 at least."""
    d = F.transform(v, lambda x: x.cast("double"))
    length = F.greatest(F.sqrt(F.aggregate(d, F.lit(0.0), lambda s, x: s + x * x)), F.lit(1e-10))
    return F.transform(d, lambda x: x / length)


#: Bytes of query vectors, and of what a task keeps for them, that are sent to all tasks at once.
QUERY_BYTES = 64 << 20
#: Queries from which rows are dealt to all cores first; queries and rows whose products are held at once.
MANY, QUERIES_AT_ONCE, ROWS_AT_ONCE = 64, 2048, 1024


def vector_search(chunks: DataFrame, queries: DataFrame, k: int = 10, vector: str = "embedding", digits: int = 6, most_bytes: int = QUERY_BYTES) -> DataFrame:
    """(query_id, id, score, rank): the k chunks (id, vector) of highest cosine for each query (query_id, vector).

    The queries are sent to all tasks, in as many blocks of about most_bytes as their measured size
    takes, and each block is one pass over the chunks. Each task keeps k rows of a query before the shuffle.
    """
    usable = lambda df, v: df.where(F.col(v).isNotNull() & ~F.exists(v, lambda x: x.isNull()) & (F.size(v) > 0))
    rows = usable(chunks, vector).select("id", F.col(vector).cast("array<double>").alias("vector"))
    own = materialize(usable(queries, "vector").select("query_id", F.col("vector").cast("array<double>").alias("vector")), "queries")
    count, size = own.agg(F.count("*"), F.sum(8 * F.size("vector") + 64 + 32 * k)).first()
    n = 1 + (size or 0) // most_bytes
    if count > MANY:
        rows = materialize(rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism), "vectors")
    block = lambda i: own if n == 1 else own.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == i)
    return reduce(DataFrame.union, (_nearest(rows, block(i), k, digits) for i in range(n)))


def _nearest(rows: DataFrame, q: DataFrame, k: int, digits: int) -> DataFrame:
    """The k nearest rows (id, vector) of one block of queries."""

    def scan(best: Best, batch: pa.RecordBatch, known: dict[int, tuple[np.ndarray, np.ndarray]]) -> None:
        for size, (at, vectors) in by_size(batch.column("vector")).items():
            if size in known:
                best.add_all(batch.column("id"), at, vectors, *known[size])

    block = q.toArrow()
    return nearest_of_block(rows, block, by_size(block.column("vector").combine_chunks()), scan, k, digits)


def nearest_of_block(rows: DataFrame, block: pa.Table, known: Any, scan: Callable[[Best, pa.RecordBatch, Any], None], k: int, digits: int, distinct: bool = False) -> DataFrame:
    """(query_id, id, score, rank) of a block of queries (query_id, ...): scan() adds each batch of rows to a task's best, with what it is to know; distinct if it may add a row twice."""
    n, id_type = block.num_rows, to_arrow_type(rows.schema["id"].dataType)
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(k, digits, n, distinct)
        for batch in batches:
            scan(best, batch, shared.value)
        found = best.cut()
        for i in range(0, len(found), 1 << 16):
            part = found.iloc[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part["query"].to_numpy(np.int64)), pa.array(part["id"].tolist(), id_type), pa.array(part["score"].to_numpy(np.float64))], ["_place", "id", "score"])

    found = rows.mapInArrow(run, f"_place long, id {rows.schema['id'].dataType.simpleString()}, score double")
    names = spark.createDataFrame(pa.table({"_place": pa.array(range(n), pa.int64()), "query_id": block.column("query_id")}))
    scored = found.join(F.broadcast(names), "_place").select("query_id", "id", F.round("score", digits).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return (scored.distinct() if distinct else scored).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def by_size(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """The places and the matrix of the vectors of each size."""
    sizes = np.diff(column.offsets.to_numpy())
    starts = column.offsets.to_numpy()[:-1] - column.offsets[0].as_py()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return {int(n): (at, flat[starts[at][:, None] + np.arange(n)]) for n in np.unique(sizes) for at in [np.flatnonzero(sizes == n)]}


def _in_order(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dot products of rows, summed from the first component to the last, as cosine() does."""
    out = np.zeros(len(a))
    for i in range(a.shape[1]):
        out += a[:, i] * b[:, i]
    return out


def _rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """10 ** digits times x, rounded as SQL rounds it, half up by its decimal digits. What is no number is largest, as in an order of SQL."""
    scaled = np.abs(x) * 10.0**digits
    out = np.floor(scaled + 0.5)
    near = np.flatnonzero(np.isfinite(x) & (np.abs(scaled - np.floor(scaled) - 0.5) < 1e-3))
    out[near] = [float((abs(Decimal(repr(v))).scaleb(digits)).to_integral_value(ROUND_HALF_UP)) for v in x[near].tolist()]
    return np.where(np.isnan(x), np.inf, np.copysign(out, x))


class Best:
    """The k best rows (score, id) that a task has seen for each query. Single precision rules out what cannot be among them; the others' cosines are summed in order."""

    def __init__(self, k: int, digits: int, queries: int, distinct: bool = False) -> None:
        self.k, self.digits, self.distinct = k, digits, distinct
        self.floor = np.full(queries, -np.inf, np.float32)
        self.parts, self.n, self.limit = [], 0, max(1 << 18, 2 * k * queries)

    def add_all(self, ids: pa.Array, at: np.ndarray, vectors: np.ndarray, place: np.ndarray, wanted: np.ndarray) -> None:
        """Rows, ids[at] with their vectors, against queries, place with their vectors."""
        for i in range(0, len(at), ROWS_AT_ONCE):
            for j in range(0, len(place), QUERIES_AT_ONCE):
                self.add(ids, at[i : i + ROWS_AT_ONCE], vectors[i : i + ROWS_AT_ONCE], place[j : j + QUERIES_AT_ONCE], wanted[j : j + QUERIES_AT_ONCE])

    def add(self, ids: pa.Array, at: np.ndarray, vectors: np.ndarray, place: np.ndarray, wanted: np.ndarray) -> None:
        with np.errstate(all="ignore"):
            (x, zero_x, odd_x), (y, zero_y, odd_y) = _scaled(vectors), _scaled(wanted)
            near = x @ y.T
            near[zero_x] = near[:, zero_y] = near[odd_x] = near[:, odd_y] = np.nan
            # Errors of single precision on both sides, and what rounding makes equal.
            slack = np.float32(2 * 10.0**-self.digits + 2.4e-7 * (vectors.shape[1] + 4))
            hit = near >= self.floor[place] - slack
            if hit.sum() > 4 * self.k * len(place) and len(at) > self.k and (not self.distinct or pc.count_distinct(ids.take(pa.array(at))).as_py() == len(at)):
                kth = np.partition(np.where(np.isnan(near), -np.inf, near), len(at) - self.k, axis=0)[len(at) - self.k]
                self.floor[place] = np.maximum(self.floor[place], kth)
                hit = near >= self.floor[place] - slack
            hit[odd_x], hit[:, odd_y] = True, True
            i, j = np.nonzero(hit)
            a, b = vectors[i], wanted[j]
            length = np.sqrt(_in_order(a, a)) * np.sqrt(_in_order(b, b))
            i, j, score = (v[length != 0] for v in (i, j, _in_order(a, b) / length))
        if len(i):
            self.parts.append(pd.DataFrame({"query": place[j], "key": _rounded(score, self.digits), "id": ids.take(pa.array(at[i])).to_numpy(zero_copy_only=False), "score": score}))
            self.n += len(i)
        if self.n > self.limit:
            self.cut()
            self.limit = max(self.limit, 2 * self.n)

    def cut(self) -> pd.DataFrame:
        if not self.parts:
            return pd.DataFrame({"query": [], "key": [], "id": [], "score": []})
        rows = pd.concat(self.parts, ignore_index=True).sort_values(["query", "key", "id"], ascending=[True, False, True], na_position="first", ignore_index=True)
        if self.distinct:
            rows = rows.drop_duplicates(["query", "key", "id"], ignore_index=True)
        place = rows.groupby("query").cumcount()
        last = rows[place == self.k - 1]
        floor = np.nextafter((last["key"] / 10.0**self.digits).to_numpy(np.float32), np.float32(-np.inf))
        at = last["query"].to_numpy()
        self.floor[at] = np.maximum(self.floor[at], np.where(np.isfinite(floor), floor, 1.0))
        rows = rows[place < self.k]
        self.parts, self.n = [rows], len(rows)
        return rows


def _scaled(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors of length 1 in single precision, which ones are zero, and which are too long or short for that."""
    squares = (vectors**2).sum(1)
    zero = ~vectors.any(1)
    odd = ~zero & ~((squares > 1e-200) & (squares < 1e200))
    plain = np.where(zero | odd, 1.0, squares)
    return np.where((zero | odd)[:, None], 0.0, vectors / np.sqrt(plain)[:, None]).astype(np.float32), zero, odd


def substring_search(chunks: DataFrame, term: str, order: tuple[str, ...] = ("paper_id", "chunk_index"), limit: int | None = None) -> DataFrame:
    """Chunks that contain the term ignoring case, ranked in scan order."""
    hit = chunks.where(F.lower("content").contains(term.lower()))
    if not limit:
        return row_numbers(hit, list(order))
    return hit.orderBy(*order).limit(limit).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def full_text_search(chunks: DataFrame, query: str, k: int = 10, digits: int = 6) -> DataFrame:
    """(id, score, rank) of the k best chunks that hold all terms of the query, by TF-IDF over their number of words."""
    terms = sorted({t for t in "".join(c if c.isalnum() else " " for c in query.lower()).split()})
    low = F.lower("content")
    # A text is searched for a term as a word only if it holds its characters, and cut into words only if it holds all terms.
    # The pattern starts with the term itself, so that what stands before it is looked at only where it occurs.
    whole = lambda t: F.regexp_count("low", F.lit(rf"{t}(?<![\p{{L}}\p{{N}}]{t})(?![\p{{L}}\p{{N}}])"))
    own = chunks.select("id", low.alias("low")).select("id", "low", *(F.when(F.col("low").contains(t), whole(t)).otherwise(0).alias(f"n{i}") for i, t in enumerate(terms)))
    every = F.expr(" AND ".join(f"n{i} > 0" for i in range(len(terms))) or "false")
    words = F.size(F.filter(F.split("low", r"[^\p{L}\p{N}]+"), lambda w: w != ""))
    stats = own.agg(F.count("*").alias("rows"), *(F.count_if(F.col(f"n{i}") > 0).alias(f"df{i}") for i in range(len(terms))))
    joined = own.where(" AND ".join(f"contains(low, '{t}')" for t in terms) or "false").where(every).withColumn("length", words).crossJoin(F.broadcast(stats))
    score = sum((F.col(f"n{i}") * F.log((1 + F.col("rows")) / (1 + F.col(f"df{i}"))) for i in range(len(terms))), F.lit(0.0)) / (1 + F.log1p("length"))
    hit = joined.select("id", F.round(score, digits).alias("score"))
    return hit.orderBy(F.desc("score"), "id").limit(k).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")))


def rank_fusion(lexical: DataFrame, vector: DataFrame, k: int = 60, n: int | None = 10, least: float = 0.0, digits: int = 9) -> DataFrame:
    """(id, score, lexical_rank, vector_rank, source, rank) from two lists (id, rank): sum of 1/(k + rank) over the largest sum."""
    both = lexical.select("id", F.col("rank").alias("lexical_rank")).join(vector.select("id", F.col("rank").alias("vector_rank")), "id", "full_outer")
    part = lambda c: F.coalesce(1.0 / (k + F.col(c)), F.lit(0.0))
    raw = both.withColumn("raw", part("lexical_rank") + part("vector_rank"))
    scored = raw.crossJoin(F.broadcast(raw.agg(F.max("raw").alias("top")))).withColumn("score", F.round(F.col("raw") / F.col("top"), digits)).where(F.col("score") >= least)
    source = F.when(F.col("lexical_rank").isNull(), "vector").when(F.col("vector_rank").isNull(), "lexical").otherwise("hybrid")
    out = scored.select("id", "score", "lexical_rank", "vector_rank", source.alias("source"))
    if not n:
        return row_numbers(out, [F.desc("score"), F.col("id")])
    return out.orderBy(F.desc("score"), "id").limit(n).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")))


def hybrid_search(chunks: DataFrame, papers: DataFrame, term: str, vector: list[float], n: int = 10, must: str | None = None) -> DataFrame:
    """Fused hits with content and title; with must, only chunks that contain it."""
    own = chunks.where(F.lower("content").contains(must.lower())) if must else chunks
    query = chunks.sparkSession.createDataFrame([("q", [float(x) for x in vector])], "query_id string, vector array<double>")
    fused = rank_fusion(substring_search(own, term, limit=4 * n), vector_search(own, query, 4 * n), n=n)
    return fused.join(own.select("id", "paper_id", "content"), "id").join(papers.select(F.col("id").alias("paper_id"), "title"), "paper_id", "left")


def pending_embeddings(chunks: DataFrame) -> DataFrame:
    """(paper_id, n_chunks, n_pending) of papers with chunks without a vector."""
    return chunks.groupBy("paper_id").agg(F.count("*").alias("n_chunks"), F.count_if(F.col("embedding").isNull()).alias("n_pending")).where("n_pending > 0")


#: Texts that an embedder gets at once.
EMBEDDED = 256


def backfill_embeddings(chunks: DataFrame, embed: Callable[[list[str]], list[list[float]]], per_paper: int | None = None) -> DataFrame:
    """Chunks with vectors, normalised, where they had none; with per_paper, so many of a paper, in order.

    A worker holds the texts and vectors of EMBEDDED chunks at a time, beside the batch that Spark hands it.
    Such a part that fails stays null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, len(batch), EMBEDDED):
                part = batch.slice(k, EMBEDDED)
                try:
                    vectors = embed([t or "" for t in part.column(1).to_pylist()])
                except ValueError:
                    vectors = [None] * len(part)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(vectors, pa.list_(pa.float64()))], ["id", "fresh"])

    todo = chunks.where("embedding IS NULL")
    if per_paper:
        w = Window.partitionBy("paper_id").orderBy("chunk_index", "id")
        todo = todo.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= per_paper)
    fresh = todo.select(F.col("id").cast("string"), F.col("content").cast("string")).mapInArrow(run, "id string, fresh array<double>")
    fresh = fresh.select("id", F.transform(l2_normalise(F.col("fresh")), lambda x: x.cast("float")).alias("fresh"))
    return chunks.join(fresh, "id", "left").withColumn("embedding", F.coalesce("embedding", "fresh")).select(*chunks.columns)


def semantic_rerank(targets: DataFrame, hits: DataFrame, weight: float = 0.045, most: float = 0.20) -> DataFrame:
    """Targets (gene, score) with boost and new rank from hits (gene, chunk_id, rank, score)."""
    g = hits.groupBy("gene").agg(F.count_distinct("chunk_id").alias("n"), F.min("rank").alias("best"), F.max("score").alias("top"))
    strength = 0.60 / F.col("best") + 0.25 * F.least(F.col("n") / 5.0, F.lit(1.0)) + 0.15 * F.least(F.greatest("top", F.lit(0.0)), F.lit(1.0))
    out = targets.join(g, "gene", "left").withColumn("boost", F.coalesce(F.least(F.lit(most), weight * strength), F.lit(0.0)))
    out = out.withColumn("reranked_score", F.least(F.col("score") + F.col("boost"), F.lit(1.0))).drop("n", "best", "top")
    return row_numbers(out, [F.desc(F.round("reranked_score", 9)), F.col("gene")])


def load_contexts(hits: DataFrame, chunks: DataFrame, papers: DataFrame, genes: DataFrame, n: int = 32, stop: tuple[str, ...] = ()) -> DataFrame:
    """The n best hits (id, score) with content, published_at, vector (the large one if there is one), genes found in the chunk and terms.

    genes is (id, gene), what was found in which chunk.
    """
    from evispark.operators.text import context_terms

    top = hits.select("id", "score").orderBy(F.desc("score"), "id").limit(n)
    vector = F.coalesce("embedding_large", "embedding") if "embedding_large" in chunks.columns else F.col("embedding")
    own = top.join(chunks.select("id", "paper_id", "content", vector.alias("vector")), "id").join(papers.select(F.col("id").alias("paper_id"), "published_at"), "paper_id", "left")
    found = genes.join(top.select("id"), "id", "left_semi").groupBy("id").agg(F.array_sort(F.collect_set("gene")).alias("genes"))
    own = own.join(found, "id", "left").withColumn("genes", F.coalesce("genes", F.array().cast("array<string>")))
    return own.withColumn("terms", F.array_except(context_terms(F.col("content"), F.col("genes")), F.array(*map(F.lit, stop)) if stop else F.array().cast("array<string>")))


def topic_groups(contexts: DataFrame, n: int = 4) -> DataFrame:
    """(label, size, mean_score) of the n largest groups of chunks (id, section, terms, score): section and the two first terms in order."""
    label = F.concat_ws(":", F.coalesce("section", F.lit("other")), F.array_join(F.slice(F.array_sort("terms"), 1, 2), "+"))
    return contexts.groupBy(label.alias("label")).agg(F.count("*").alias("size"), F.avg("score").alias("mean_score")).orderBy(F.desc("size"), "label").limit(n)


def age_drift(contexts: DataFrame, as_of, recent_days: int = 365) -> DataFrame:
    """One row: n_recent, n_older, ratio, median_age, max_age of contexts (published_at)."""
    age = F.datediff(F.lit(as_of).cast("timestamp"), "published_at")
    own = contexts.select(age.alias("age"))
    return own.agg(F.count_if(F.col("age") <= recent_days).alias("n_recent"), F.count_if(F.col("age") > recent_days).alias("n_older"), F.coalesce(F.try_divide(F.count_if(F.col("age") <= recent_days), F.count("age")), F.lit(0.0)).alias("ratio"), F.median("age").alias("median_age"), F.max("age").alias("max_age"))


def gene_profiles(contexts: DataFrame, as_of, recent_days: int = 365) -> DataFrame:
    """(gene, n_chunks, n_recent, n_shared, n_duplicate) of contexts (id, genes, published_at, dedup_group)."""
    recent = F.datediff(F.lit(as_of).cast("timestamp"), "published_at") <= recent_days
    rows = contexts.select(F.explode(F.array_distinct("genes")).alias("gene"), recent.alias("recent"), (F.size("genes") > 1).alias("shared"), F.col("dedup_group").isNotNull().alias("duplicate"))
    return rows.groupBy("gene").agg(F.count("*").alias("n_chunks"), F.count_if("recent").alias("n_recent"), F.count_if("shared").alias("n_shared"), F.count_if("duplicate").alias("n_duplicate"))


def snippets(contexts: DataFrame, n: int = 8, length: int = 240) -> DataFrame:
    """The n best contexts (id, content, score, dedup_group), first one of each group and those of none, then the rest."""
    w = Window.partitionBy(F.coalesce("dedup_group", F.concat(F.lit("id:"), "id"))).orderBy(F.desc("score"), "id")
    ranked = contexts.withColumn("_turn", F.row_number().over(w))
    out = ranked.orderBy((F.col("_turn") > 1).cast("int"), F.desc("score"), "id").limit(n)
    return out.select("id", "score", F.substring(F.trim(F.regexp_replace("content", r"\s+", " ")), 1, length).alias("snippet"))


def novelty(profiles: DataFrame) -> DataFrame:
    """Profiles (gene, literature, n_chunks, n_recent, n_duplicate) with novelty and label."""
    n = F.greatest("n_chunks", F.lit(1))
    value = 0.45 * F.col("literature") + 0.25 / (1 + F.log1p("n_chunks")) + 0.15 * F.col("n_recent") / n + 0.15 * (1 - F.col("n_duplicate") / n)
    out = profiles.withColumn("novelty", F.round(value, 9))
    return out.withColumn("label", F.when(F.col("novelty") >= 0.70, "novel").when(F.col("novelty") >= 0.45, "mixed").otherwise("established"))


def feature_matrix(genes: DataFrame, columns: list[str]) -> DataFrame:
    """(gene, features): the columns as doubles in order, null as 0."""
    return genes.select("gene", F.array(*(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns)).alias("features"))
