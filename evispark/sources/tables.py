"""Tables on disk: scans, appends, upserts, snapshots, run logs (S)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from evispark.shared import materialize


def scan(spark: SparkSession, path: str, schema: StructType | str, order: str = "id", offset: int = 0, limit: int | None = None) -> DataFrame:
    """A Parquet table with a declared schema; a page of it in order if limit is given."""
    df = spark.read.schema(schema).parquet(path)
    return df if limit is None else df.orderBy(order).offset(offset).limit(limit)


def append(df: DataFrame, path: str, schema: StructType) -> None:
    """Appends after casting to the declared schema; a missing column that may not be null raises."""
    missing = [f.name for f in schema if f.name not in df.columns and not f.nullable]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema)).write.mode("append").parquet(path)


def delete_by_key(df: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """Df without the rows whose column is in keys (one column)."""
    return df.join(keys.toDF(column).distinct(), column, "left_anti").select(*df.columns)


def upsert(stored: DataFrame, fresh: DataFrame, keys: list[str], order: str = "fetched_at") -> DataFrame:
    """Stored and fresh, of each key the row with the latest order; fresh before stored where equal."""
    both = stored.withColumn("_new", F.lit(0)).unionByName(fresh.withColumn("_new", F.lit(1)))
    rest = [c for c in stored.columns if c not in keys]
    best = both.groupBy(*keys).agg(F.max(F.struct(F.col(order).alias("_o"), "_new", *rest)).alias("_b"))
    return best.select(*((F.col(c) if c in keys else F.col("_b")[c].alias(c)) for c in stored.columns))


def content_digest(df: DataFrame) -> Column:
    """A digest of rows that their order does not change."""
    return F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).cast("string")


def export_snapshot(tables: dict[str, DataFrame], path: str, rows_per_file: int = 100_000) -> DataFrame:
    """Each table as JSON lines under path/name; the manifest (name, rows, digest, files, bytes, sha256) with a digest of the files' own digests.

    A file's digest takes the whole file into memory, so no file has more than rows_per_file rows.
    """
    manifest = None
    for name, df in tables.items():
        df.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).json(f"{path}/{name}")
        row = df.agg(F.lit(name).alias("name"), F.count("*").alias("rows"), content_digest(df).alias("digest")).crossJoin(file_digest(df.sparkSession, f"{path}/{name}"))
        manifest = row if manifest is None else manifest.union(row)
    return materialize(manifest, "manifest")


def file_digest(spark: SparkSession, path: str) -> DataFrame:
    """(files, bytes, sha256) of a folder: one digest over the digests of its files in order."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("length", F.sha2("content", 256).alias("h"))
    return files.agg(F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"), F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ",").cast("binary"), 256).alias("sha256"))


def check_snapshot(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """(name, ok_bytes, ok_sha256, ok_rows) for each artifact of the manifest, which has a row for each table."""
    out = None
    for r in manifest.select("name", "rows", "bytes", "sha256").collect():
        rows = spark.read.text(f"{path}/{r['name']}").agg(F.count("*").alias("n"))
        one = file_digest(spark, f"{path}/{r['name']}").crossJoin(rows).select(F.lit(r["name"]).alias("name"), (F.col("bytes") == r["bytes"]).alias("ok_bytes"), (F.col("sha256") == r["sha256"]).alias("ok_sha256"), (F.col("n") == r["rows"]).alias("ok_rows"))
        out = one if out is None else out.union(one)
    return out


def import_snapshot(spark: SparkSession, path: str, schema: StructType) -> tuple[DataFrame, DataFrame]:
    """(rows, lines that are not such rows) of JSON lines."""
    both = spark.read.schema(StructType(list(schema.fields)).add("_bad", "string")).option("columnNameOfCorruptRecord", "_bad").json(path)
    both = materialize(both, "import")
    return both.where("_bad IS NULL").drop("_bad"), both.where("_bad IS NOT NULL").select("_bad")


def retain_newest(log: DataFrame, n: int = 400, order: tuple[str, ...] = ("recorded_at", "query")) -> DataFrame:
    """The n newest rows of a run log."""
    return log.orderBy(*(F.desc(c) for c in order)).limit(n)


def append_runs(runs: DataFrame, path: str, n: int = 400, order: tuple[str, ...] = ("recorded_at", "query")) -> DataFrame:
    """Appends to the run log at path and returns it: its n newest rows, as a new version beside the last one.

    A version is a folder of its own, so one that fails half-way leaves the log as it was; readers take the last whole one.
    """
    spark = runs.sparkSession
    version, log = last_runs(spark, path, runs)
    retain_newest(log.unionByName(runs), n, order).write.parquet(f"{path}/version={version + 1}")
    return last_runs(spark, path, runs)[1]


def last_runs(spark: SparkSession, path: str, like: DataFrame) -> tuple[int, DataFrame]:
    """The number of the last whole version of the run log, 0 if there is none, and its rows."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [x.getPath() for x in fs.listStatus(place)] if fs.exists(place) else []
    whole = [int(x.getName().split("=")[1]) for x in found if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(x, "_SUCCESS"))]
    version = max(whole, default=0)
    return version, spark.read.schema(like.schema).parquet(f"{path}/version={version}") if version else like.limit(0)


def term_list(spark: SparkSession, built_in: list[str], path: str | None = None, listed: str = "", most: int | None = None) -> DataFrame:
    """(term) of built-in terms, the lines of a file (# starts a comment) and a comma list; lower case, distinct; with most, the first so many."""
    terms = spark.createDataFrame([(t,) for t in [*built_in, *listed.split(",")]], "term string")
    if path:
        lines = spark.read.text(path).toDF("term")
        terms = terms.union(lines.where(~F.trim("term").startswith("#")))
    out = terms.select(F.lower(F.trim("term")).alias("term")).where("term <> ''").distinct()
    return out.orderBy("term").limit(most) if most else out
