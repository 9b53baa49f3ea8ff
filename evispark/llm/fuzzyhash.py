"""Context-triggered piecewise hashing of texts, and the likeness of two such fingerprints.

A hash rolls over the last CONTEXT code points; where it hits a value that the block size sets, a piece
ends. Each piece gives PIECE characters of the signature. A fingerprint is "size:pieces:pieces at twice
the size"; two are compared where they share a block size, by the edit distance in which a piece is
inserted or deleted at cost 1, and so substituted at cost 2.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ALPHABET = np.array(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"))
CONTEXT = 7
#: Block sizes are LEAST times powers of two: the first at which a text has LENGTH pieces at most, on average, halved while it has less than half as many.
LEAST, LENGTH = 3, 64
#: Characters of the hash of a piece, of 6 bits each.
PIECE = 5
#: Fingerprints are alike only if they have so many pieces in a row in common, or half of those of the shorter one.
RUN = 7
#: Texts of one range of ids have about so many bytes.
RANGE_BYTES = 32 << 20


def _rolled(codes: np.ndarray) -> np.ndarray:
    """A mixed hash of the CONTEXT code points that end at each place."""
    h = np.zeros(len(codes), np.uint64)
    for k in range(min(CONTEXT, len(codes))):
        h[k:] += codes[: len(codes) - k] * np.uint64(pow(0x9E3779B97F4A7C15, k, 1 << 64))
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _pieces(h: np.ndarray, ends: np.ndarray) -> str:
    """The hashes of the pieces that end at these places, and of what follows the last one."""
    starts = np.concatenate([[0], ends[ends < len(h) - 1] + 1])
    sums = np.add.reduceat(h, starts)
    sums ^= sums >> np.uint64(29)
    sums *= np.uint64(0xBF58476D1CE4E5B9)
    places = sums[:, None] >> np.array([64 - 6 * (k + 1) for k in range(PIECE)], np.uint64)
    return "".join(ALPHABET[(places & np.uint64(63)).astype(np.int64)].ravel())


def fingerprint(text: str) -> str:
    """The fingerprint of a text; an empty one has no pieces."""
    if not text:
        return f"{LEAST}::"
    h = _rolled(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1))
    values = h >> np.uint64(8)
    # What ends a piece at one size is among what does at half of it.
    ends = np.flatnonzero(values % np.uint64(LEAST) == LEAST - 1)
    at = lambda size: ends[values[ends] % np.uint64(size) == size - 1]
    size = LEAST
    while size * LENGTH < len(text):
        size *= 2
    while size > LEAST and 2 * len(at(size)) < LENGTH:
        size //= 2
    return f"{size}:{_pieces(h, at(size))}:{_pieces(h, at(2 * size))}"


def _common(a: Sequence[str], b: Sequence[str]) -> int:
    """Length of the longest common subsequence, a bit for each item of a."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    row, full = (1 << len(a)) - 1, (1 << len(a)) - 1
    for c in b:
        hit = row & places.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def _alike(a: str, b: str) -> float:
    """The share of pieces that need neither be inserted nor deleted; 0 without a run in common."""
    p, q = ([x[i : i + PIECE] for i in range(0, len(x), PIECE)] for x in (a, b))
    run = max(1, min(RUN, min(len(p), len(q)) // 2))
    runs = {tuple(p[i : i + run]) for i in range(len(p) - run + 1)}
    if not any(tuple(q[i : i + run]) in runs for i in range(len(q) - run + 1)):
        return 0.0
    return 2 * _common(p, q) / (len(p) + len(q))


def likeness(a: str, b: str) -> float:
    """1 for equal fingerprints, else the share of pieces that are not edited, at the block size where it is highest; 0 without a common size."""
    if a == b:
        return 1.0
    (size_a, a1, a2), (size_b, b1, b2) = a.split(":"), b.split(":")
    at = {int(size_a): a1, 2 * int(size_a): a2}
    return max((_alike(at[s], x) for s, x in ((int(size_b), b1), (2 * int(size_b), b2)) if s in at), default=0.0)


def _bounds(ids: DataFrame, parts: int) -> np.ndarray:
    """At most parts - 1 keys between ranges with about as many rows each; a key that fills several ranges is repeated."""
    at = ids.approxQuantile("key", [i / parts for i in range(1, parts)], 0.25 / parts) if parts > 1 else []
    return np.array(sorted(int(x) for x in at), dtype=np.int64)


def neighbours(docs: DataFrame, id_col: str = "doc_id", parts: int | None = None) -> DataFrame:
    """Columns key, id, text, part, guest: docs in ranges of ids, each with its last row's next as a guest.

    Rows are in order of id, null ids first, and of a hash of the text where ids are equal; so an id with
    many rows (null, say) is split by that hash. Each range is sorted in one task; its guest is the first
    row of the next range that has rows, and the last range's is the first row of all. Unless parts says
    otherwise there are as many ranges as shuffle partitions, or more so that each has RANGE_BYTES.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("key"), F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("hash"))
    if parts is None:
        size = own.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE_BYTES))
    bounds = _bounds(own.select("key"), parts)

    @F.pandas_udf("int")
    def part(keys: pd.Series, hashes: pd.Series) -> pd.Series:
        k = keys.to_numpy()
        left, right = np.searchsorted(bounds, k, side="left"), np.searchsorted(bounds, k, side="right")
        # A key that is a bound itself is dealt over the ranges around it, in order of the hash.
        share = (hashes.to_numpy() / 2.0**64 + 0.5) * (right - left + 1)
        return pd.Series((left + np.minimum(share.astype(np.int64), right - left)).astype("int32"))

    own = own.withColumn("part", part("key", "hash"))
    # As many rows as ranges: where each begins.
    begins = sorted((r["part"], *r["least"]) for r in own.groupBy("part").agg(F.min(F.struct("key", "hash")).alias("least")).collect())
    rows = own.withColumn("guest", F.lit(False))
    if begins:
        follower = [(*begins[(i + 1) % len(begins)][1:], p) for i, (p, _, _) in enumerate(begins)]
        firsts = F.broadcast(spark.createDataFrame(follower, "key bigint, hash bigint, part int"))
        heads = own.drop("part").join(firsts, ["key", "hash"]).groupBy("key", "id", "hash", "part").agg(F.min("text").alias("text"))
        rows = rows.union(heads.select("key", "id", "text", "hash", "part", F.lit(True).alias("guest")))
    return rows.repartitionById(parts, F.col("part")).sortWithinPartitions("part", "guest", "key", "hash", "text")


def compare(docs: DataFrame, id_col: str = "doc_id", parts: int | None = None) -> DataFrame:
    """A row for each row of docs: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has the last half of the text replaced by as much of the start of the next
    document's, in order of id; after the last comes the first. Null texts are empty. Rows with equal
    ids, null or not, are in order of a hash of their texts. A table of one row is its own next. Only
    id and text are read; a text is held whole, and its fingerprint has a piece for each boundary.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            out = []
            for key, text, guest in zip(batch.column("id").to_pylist(), (t.decode("utf-8", "surrogatepass") for t in batch.column("text").cast(pa.binary()).to_pylist()), batch.column("guest").to_pylist(), strict=True):
                own = fingerprint(text)
                if held is not None:
                    before, old, print_of_old = held
                    n = len(old) // 2
                    edited = old[: len(old) - n] + text[:n]
                    print_of_edited = fingerprint(edited)
                    out.append((before, len(old), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), print_of_old, print_of_edited, likeness(print_of_old, print_of_edited), likeness(print_of_old, own)))
                held = None if guest else (key, text, own)
            kinds = [batch.schema.field("id").type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            columns = list(zip(*out, strict=True)) or [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    rows = neighbours(docs, id_col, parts)
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(run, f"id {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return out.withColumnRenamed("id", id_col)
