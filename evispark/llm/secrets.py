"""Secrets in versioned texts, through a ledger of blobs: each content is scanned once for each version of the rules.

A path's every version is addressed by the SHA-256 of its content. The ledger is a Parquet table that
every scan adds to: contents that it holds for the present rules are not scanned again; the rest are
deduplicated, scanned and appended, and the findings are joined back to all paths by the address.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from dataclasses import dataclass
from functools import cache, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evispark.llm import spans as S
from evispark.llm.texts import map_texts
from evispark.shared import materialize, work_dir

FOUND = "array<struct<kind:string,start:bigint,end:bigint,score:double>>"


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its pattern in Python's dialect, texts (in lower case) of which a text must hold one to be searched, and what a match must be.

    The secret is the group of the match, least characters long; without a score of its own it counts the
    more, the less it repeats its characters. exact: the texts are looked for as they are.
    """

    kind: str
    pattern: str
    needs: tuple[str, ...] = ()
    group: int = 0
    least: int = 0
    score: float | None = None
    exact: bool = False


#: The base kinds come first, in the order in which spans of one start stand.
RULES = (
    Rule("assign", r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", ("passw", "secret", "token", "apikey", "api_key"), 1, 12),
    Rule("access", r"AKIA[A-Z0-9]+", ("AKIA",), 0, 18, 0.95, True),
    Rule("hex", r"[0-9a-f]{16,}+"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", ("-----BEGIN ",), 0, 0, 1.0, True),
    Rule("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", ("eyJ",), 0, 0, 0.95, True),
    Rule("hosted", r"(?<![A-Za-z0-9])(?:gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,})", ("_", "xox"), 0, 0, 0.95, True),
)
#: A later version of the rules: a password inside an address, too.
NEWER_RULES = (*RULES, Rule("address", r"[a-z][a-z0-9+.-]{1,20}://[^\s/:@]{1,100}:([^\s/@]{3,100})@", ("://",), 1, 3, None, True))
BASE = [r.kind for r in RULES[:3]]
RULES_VERSION = "1"


def entropy(text: str) -> float:
    """Bits for each character."""
    n = len(text)
    return -sum(c / n * math.log2(c / n) for c in Counter(text).values()) if n else 0.0


@cache
def _compiled(pattern: str) -> re.Pattern:
    return re.compile(pattern)


def find_secrets(text: str, rules: tuple[Rule, ...] = RULES) -> list[S.Span]:
    """Spans of all kinds of the rules."""
    found = []
    low = text.lower()
    for r in rules:
        if not r.needs or any(x in (text if r.exact else low) for x in r.needs):
            for m in _compiled(r.pattern).finditer(text):
                if len(own := m[r.group]) >= r.least:
                    found.append((r.kind, m.start(), m.end(), min(1.0, 0.4 + entropy(own) / 8) if r.score is None else r.score))
    return S.in_order(found, [r.kind for r in rules])


def scan_blobs(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, found) for rows (blob, text)."""

    def work(texts: list[bytes], kept: dict[str, list]) -> dict[str, object]:
        found = [[dict(zip(("kind", "start", "end", "score"), s, strict=True)) for s in find_secrets(t.decode("utf-8", "surrogatepass"), rules)] for t in texts]
        return {"blob": kept["blob"], "found": found}

    return map_texts(blobs, ["blob"], f"blob binary, found {FOUND}", work)


LEDGER = f"blob binary, rules_version string, scan string, found {FOUND}"


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """(blob, rules_version, scan, found): what was scanned, by which rules and in which scan; no rows where nothing was yet."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(LEDGER).parquet(path)


def scan_versions(versions: DataFrame, path_cols: list[str], ledger: str, scan: str = "", rules_version: str = RULES_VERSION, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """A row for each row of versions: path_cols, blob and found; what the ledger at that path lacked is scanned and appended to it.

    versions has a column text (null counts as empty) and path_cols, whose rows may repeat; other
    columns are not read. rules are those that rules_version names: other rules need another version. Rows
    of other versions stay in the ledger but do not stop a scan. Copies
    of a content, however many, are collapsed before the texts are shuffled. A text without a finding
    has an empty array, an empty table no rows. A scan that fails appends nothing, and can be repeated.
    """
    spark = versions.sparkSession
    blob = F.unhex(F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"), 256)).alias("blob")
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    known = read_ledger(spark, ledger).where(F.col("rules_version") == rules_version).select("blob")
    known_rows = not known.isEmpty()
    # Copies collapse first: after a join by address they would already stand together in one task.
    fresh = scan_blobs(versions.select(blob, text).dropDuplicates(["blob"]).join(known, "blob", "left_anti"), rules)
    fresh.select("blob", F.lit(rules_version).alias("rules_version"), F.lit(scan).alias("scan"), "found").write.mode("append").parquet(ledger)
    # Most contents hold nothing: only the rest are joined back, by an address that few or many paths share.
    # They are a table of their own, so that the join can be a broadcast, or be split where an address is hot.
    hits = read_ledger(spark, ledger).where((F.col("rules_version") == rules_version) & (F.size("found") > 0)).select("blob", "found")
    if known_rows:  # else all that the ledger holds is from this scan
        hits = hits.join(versions.select(blob).distinct(), "blob", "left_semi")
    hits = materialize(hits.dropDuplicates(["blob"]), "hits")
    return versions.select(*path_cols, blob).join(hits, "blob", "left").select(*path_cols, "blob", F.coalesce("found", F.array().cast(FOUND)).alias("found"))


def new_ledger(spark: SparkSession) -> str:
    """A path in the shared folder at which there is no ledger yet."""
    return f"{work_dir(spark)}/secret-ledger-{uuid.uuid4().hex}"


def digest_columns(docs: DataFrame, id_col: str = "doc_id", ledger: str | None = None) -> DataFrame:
    """id, n_assign, n_access, n_hex, base_sha256 and spans, from a scan with the ledger at that path (a new one by default)."""
    return S.digest_columns(scan_versions(docs, [id_col], ledger or new_ledger(docs.sparkSession)), id_col, BASE)


def ledger_growth(steps: list[tuple[str, DataFrame, str, tuple[Rule, ...]]]) -> DataFrame:
    """(scan, rules_version, n_versions, n_blobs, n_scanned, n_found) for each of the steps (scan, versions, rules_version, rules), done in turn on one new ledger; n_found counts findings in all versions."""
    spark = steps[0][1].sparkSession
    ledger, rows = new_ledger(spark), []
    for scan, versions, rules_version, rules in steps:
        found = scan_versions(versions, [], ledger, scan, rules_version, rules)
        rows.append(found.agg(F.lit(scan).alias("scan"), F.lit(rules_version).alias("rules_version"), F.count("*").alias("n_versions"), F.countDistinct("blob").alias("n_blobs"), F.coalesce(F.sum(F.size("found")), F.lit(0)).alias("n_found")))
    scanned = read_ledger(spark, ledger).groupBy("scan").agg(F.count("*").alias("n_scanned"))
    return reduce(DataFrame.union, rows).join(scanned, "scan", "left").withColumn("n_scanned", F.coalesce("n_scanned", F.lit(0)))
