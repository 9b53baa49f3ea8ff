"""Helpers that run inside tasks: Arrow batches of texts as numpy arrays of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts are handled in groups of about this many bytes, so that numpy's temporaries stay small.
GROUP_BYTES = 1 << 18
#: The bytes [\x20\x09-\x0D], which end a word where only white space does.
SPACES = np.zeros(256, bool)
SPACES[[0x20, 9, 10, 11, 12, 13]] = True
#: All bytes but those of words [^\x00-\x2F\x3A-\x60\x7B-\x7F]; UTF-8's bytes from 0x80 on are in words.
NOT_WORD = np.zeros(256, bool)
NOT_WORD[[*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True


def group_ends(sizes: list[int], limit: int = GROUP_BYTES) -> list[int]:
    """Where to cut a list so that each piece holds about limit bytes, or one item."""
    ends, total = [], 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            ends.append(i)
            total = 0
        total += n
    return [*ends, len(sizes)]


def map_texts(df: DataFrame, keep: list[str], schema: str, work: Callable[[list[bytes], dict[str, list]], dict[str, object]]) -> DataFrame:
    """Applies work to groups of (texts as UTF-8 with null as empty, kept columns) and returns its columns. df needs columns text and keep."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            texts = [t or b"" for t in texts]
            start = 0
            for end in group_ends([len(t) for t in texts]) if texts else []:
                part = batch.slice(start, end - start)
                out = work(texts[start:end], {k: part.column(k).to_pylist() for k in keep})
                yield pa.RecordBatch.from_pydict({name: v if isinstance(v, pa.Array) else pa.array(v, type=kind) for (name, v), kind in zip(out.items(), kinds, strict=True)})
                start = end

    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructType

    kinds = [to_arrow_type(f.dataType) for f in StructType.fromDDL(schema)]
    return df.select("text", *keep).mapInArrow(run, schema)


def text_column(work: Callable[[list[bytes]], list], kind: str) -> Callable[[Column], Column]:
    """work as a function of a text column, null as empty. Only the texts go to Python; other columns of the rows stay where they are."""
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructType

    out_type = to_arrow_type(StructType.fromDDL(f"x {kind}")["x"].dataType)

    @F.arrow_udf(kind)
    def run(column: pa.Array) -> pa.Array:
        texts = [t or b"" for t in column.cast(pa.binary()).to_pylist()]
        out, start = [], 0
        for end in group_ends([len(t) for t in texts]) if texts else []:
            out += work(texts[start:end])
            start = end
        return pa.array(out, out_type)

    return run


#: Ids up to which a set of ids is sent to all tasks (8 bytes each) instead of joined.
IDS_MAX = 2_000_000


def with_ids(df: DataFrame, ids: DataFrame, id_col: str, wanted: bool = True) -> DataFrame:
    """Rows of df whose integer id is (or, with wanted false, is not) in ids, a column of distinct ids; null is in none.

    Up to IDS_MAX ids go to every task as a sorted array, so that df is not shuffled; more are joined.
    """
    ids = ids.toDF("_id").select(F.col("_id").cast("long").alias("_id"))
    if ids.count() > IDS_MAX:
        return df.join(ids, F.col(id_col) == F.col("_id"), "left_semi" if wanted else "left_anti")
    known = df.sparkSession.sparkContext.broadcast(sorted_ids(ids))

    @F.arrow_udf("boolean")
    def hit(column: pa.Array) -> pa.Array:
        return pa.array(among(known.value, column))

    return df.where(hit(F.col(id_col).cast("long")) == F.lit(wanted))


def sorted_ids(ids: DataFrame) -> np.ndarray:
    """A column of ids, of a checked number, as a sorted array on the driver."""
    return np.sort(ids.toArrow().column(0).to_numpy())


def among(known: np.ndarray, column: pa.Array) -> np.ndarray:
    """Which ids of an Arrow column are in a sorted array; null is not."""
    values = column.cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False)
    if not len(known):
        return np.zeros(len(values), bool)
    near = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return (known[near] == values) & column.is_valid().to_numpy(zero_copy_only=False)


def word_hashes(texts: list[bytes], breaks: np.ndarray, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of all texts in order, and how many words each text has. A-Z count as a-z.

    Each byte is looked up in a random table and weighed by its place in the word; the sums are mixed.
    """
    joined = np.frombuffer(b" ".join(t.lower() for t in texts) + b" ", np.uint8)
    ends_of_texts = np.cumsum([len(t) + 1 for t in texts])
    cut = breaks[joined]
    inside = ~cut
    first = inside.copy()
    first[1:] &= cut[:-1]
    starts = np.flatnonzero(first)
    counts = np.diff(np.searchsorted(starts, ends_of_texts), prepend=0) if len(texts) else np.zeros(0, np.int64)
    if not len(starts):
        return np.zeros(0, np.uint64), counts
    random = np.random.Generator(np.random.PCG64(seed))
    table = random.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    places = np.arange(len(joined), dtype=np.int64)
    at = places - np.maximum.accumulate(np.where(first, places, 0))
    longest = int(at[inside].max()) + 1
    powers = np.full(longest, 0x9E3779B97F4A7C15, np.uint64)
    powers[0] = 1
    powers = np.cumprod(powers, dtype=np.uint64)
    values = table[joined]
    values *= powers[np.minimum(at, longest - 1)]
    values[cut] = 0
    return mix(np.add.reduceat(values, starts)), counts


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values; multiplication alone leaves the low bits weak."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of every size consecutive words; fewer words make one shingle, none make none."""
    if len(words) == 0:
        return words
    n = min(size, len(words))
    out = np.zeros(len(words) - n + 1, np.uint64)
    for i in range(n):
        out = out * np.uint64(0xD6E8FEB86659FD93) + words[i : len(words) - n + 1 + i]
    return mix(out + np.uint64(n))


def small_batches(spark: SparkSession) -> None:
    """Rows with whole texts are long: 2,000 of them make an Arrow batch of some MB, which bounds Python's share of an executor."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def part_of_id(column: str, modulus: int):
    """crc32(id as text) mod modulus, the fold by which rows are held out."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus
