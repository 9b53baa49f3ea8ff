"""Main text of web pages by wrapper induction over pages of the same host.

Each host has a reference page. The outline of every page of the host is aligned with it by simple tree
matching, and each place of the reference counts in how many pages it is matched and in how many its
texts are the same. Places that stay the same are the host's template, wherever they stand; what varies
is content. Pages with the same article count as one, or copies would look like a template. Names of
elements and classes (menus, forms, adverts, comments) exclude what varies too but is no article.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_hexdigest

from evispark.llm import pagetree
from evispark.shared import materialize

#: A node is template if at least so many pages match it, and so many of them, with the same text.
LEAST_PAGES, LEAST_SHARE = 3, 0.8
#: The weight of one page, whole numbers having exact sums.
ONE_PAGE = 720720
#: Wrappers up to this size are sent to all tasks; beyond it they are joined by host.
BROADCAST_BYTES = 32 << 20
#: A task hands on its counts when it holds so many.
HELD = 200_000
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"


def _host(url):
    return F.nullif(F.lower(F.regexp_extract(url, HOST, 1)), F.lit(""))


def _texts(batch: pa.RecordBatch, name: str) -> list[str]:
    return [(t or b"").decode("utf-8", "surrogatepass") for t in batch.column(name).cast(pa.binary()).to_pylist()]


def outlines(pages: DataFrame) -> DataFrame:
    """(host, rank, article, outline): for each page with a host the digest of its article, as names tell it, and its outline."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            articles, found = [], []
            for page in _texts(batch, "html"):
                root = pagetree.parse(page)[0]
                text = "\n".join(pagetree.main_blocks(root, set())).encode("utf-8", "surrogatepass")
                articles.append(xxh3_64_hexdigest(text) if text else root.digest)
                found.append(json.dumps(pagetree.outline(root).rows(), separators=(",", ":")))
            yield pa.RecordBatch.from_pydict({"host": batch.column("host"), "rank": batch.column("rank"), "article": articles, "outline": found})

    return pages.where("host IS NOT NULL").select("host", "rank", "html").mapInArrow(work, "host string, rank bigint, article string, outline string")


def _with_wrappers(pages: DataFrame, wrappers: DataFrame, columns: list[str], work, schema: str) -> DataFrame:
    """work(batches, wrapper of a row) over pages; wrappers (host, columns) are broadcast if they are small, else joined."""
    size = wrappers.agg(F.coalesce(F.sum(sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in columns), F.lit(100))), F.lit(0))).first()[0]
    if size <= BROADCAST_BYTES:
        shared = pages.sparkSession.sparkContext.broadcast({r["host"]: tuple(r[c] for c in columns) for r in wrappers.collect()})
        return pages.mapInArrow(lambda batches: work(batches, lambda batch: [shared.value.get(h) for h in batch.column("host").to_pylist()]), schema)
    joined = pages.join(wrappers, "host", "left")
    return joined.mapInArrow(lambda batches: work(batches, lambda batch: [None if x[0] is None else x for x in zip(*(batch.column(c).to_pylist() for c in columns), strict=True)]), schema)


def induce(pages: DataFrame) -> DataFrame:
    """(host, reference, template): outline of the reference page and the numbers of its places and members, as JSON, that the host's pages agree on.

    The reference is the page with the least hash of url and html. A page weighs one divided by the
    number of the host's pages with the same article.
    """
    made = materialize(outlines(pages), "outlines")
    references = materialize(made.groupBy("host").agg(F.min(F.struct("rank", "outline")).alias("least")).select("host", F.col("least")["outline"].alias("reference")), "references")
    copies = made.groupBy("host", "article").agg(F.count("*").alias("copies")).where("copies > 1")
    weight = F.ceil(F.lit(ONE_PAGE) / F.coalesce("copies", F.lit(1))).cast("long")
    weighed = made.join(copies, ["host", "article"], "left").select("host", "outline", weight.alias("weight"))

    def count(batches: Iterator[pa.RecordBatch], of) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], list[int]] = {}
        known: dict[str, pagetree.Outline] = {}

        def out() -> pa.RecordBatch:
            rows = [(h, i, n, s) for (h, i), (n, s) in held.items()]
            held.clear()
            return pa.RecordBatch.from_pydict({k: pa.array(v, kind) for k, v, kind in zip(("host", "place", "n", "same"), zip(*rows, strict=True) if rows else ([],) * 4, (pa.string(), pa.int32(), pa.int64(), pa.int64()), strict=True)})

        for batch in batches:
            for host, page, own, wrapper in zip(batch.column("host").to_pylist(), batch.column("outline").to_pylist(), batch.column("weight").to_pylist(), of(batch), strict=True):
                if wrapper is None:
                    continue
                if host not in known:
                    if len(known) > 1000:
                        known.clear()
                    known[host] = pagetree.Outline(*json.loads(wrapper[0]))
                tree = pagetree.Outline(*json.loads(page))
                if tree.digests[0] == known[host].digests[0]:
                    continue  # the reference itself or a copy of it tells nothing
                for i, same, _ in pagetree.compare(known[host], tree):
                    now = held.setdefault((host, i), [0, 0])
                    now[0] += own
                    now[1] += own * same
            if len(held) > HELD:
                yield out()
        yield out()

    counts = _with_wrappers(weighed, references, ["reference"], count, "host string, place int, n bigint, same bigint")
    counts = counts.groupBy("host", "place").agg(F.sum("n").alias("n"), F.sum("same").alias("same"))
    template = counts.where((F.col("n") >= LEAST_PAGES * ONE_PAGE) & (F.col("same") >= LEAST_SHARE * F.col("n"))).groupBy("host").agg(F.to_json(F.array_sort(F.collect_list("place"))).alias("template"))
    return references.join(template, "host", "left").select("host", "reference", F.coalesce("template", F.lit("[]")).alias("template"))


def main_text(page: str, wrapper: tuple[pagetree.Outline, set[int]] | None) -> str:
    """The page's article: blocks in page order joined by line feeds."""
    root = pagetree.parse(page)[0]
    dropped: set[int] = set()
    if wrapper is not None and wrapper[1]:
        dropped = {id(node) for i, same, nodes in pagetree.compare(wrapper[0], pagetree.outline(root)) if same and i in wrapper[1] for node in nodes}
    return "\n".join(pagetree.main_blocks(root, dropped))


def extract(pages: DataFrame) -> DataFrame:
    """A row for each row of pages: page_id, url, text.

    A null html is empty and gives an empty text; a page whose url is null or has no host is judged
    by its elements alone, as is the only page of a host. Repeated rows each get the same text and
    count as one page. Of pages of equal rank the lesser outline is the reference. A page is parsed in
    time in proportion to its length, however deep; alignment of two lists of different elements takes
    time with the product of their lengths. Other columns are not read.
    """
    own = pages.select("page_id", "url", _host(F.col("url")).alias("host"), F.xxhash64("url", "html").alias("rank"), F.col("html").cast("string").alias("html"))
    wrappers = materialize(induce(own), "wrappers")

    def work(batches: Iterator[pa.RecordBatch], of) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[pagetree.Outline, set[int]]] = {}
        for batch in batches:
            texts = []
            for host, page, wrapper in zip(batch.column("host").to_pylist(), _texts(batch, "html"), of(batch), strict=True):
                if wrapper is not None and host not in known:
                    if len(known) > 1000:
                        known.clear()
                    known[host] = pagetree.Outline(*json.loads(wrapper[0])), set(json.loads(wrapper[1]))
                texts.append(main_text(page, known[host] if wrapper is not None else None).encode("utf-8", "replace").decode())
            yield pa.RecordBatch.from_pydict({"page_id": batch.column("page_id"), "url": batch.column("url"), "text": pa.array(texts, pa.string())})

    kind = own.schema["page_id"].dataType.simpleString()
    return _with_wrappers(own.select("page_id", "url", "host", "html"), wrappers, ["reference", "template"], work, f"page_id {kind}, url string, text string")


def digest_columns(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars."""
    return extract(pages).withColumn("n_chars", F.char_length("text").cast("long"))
