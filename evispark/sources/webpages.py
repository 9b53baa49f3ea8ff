"""Pages of HTML as markdown."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SKIPPED = frozenset("script style nav header footer aside form noscript svg template".split())
BLOCKS = frozenset("p div section article main li ul ol table tr h1 h2 h3 h4 h5 h6 blockquote pre br".split())


class _Markdown(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.title, self.lines, self.line, self.mark, self.skip, self.in_title = "", [], [], "", 0, False

    def flush(self) -> None:
        words = " ".join("".join(self.line).split())
        if words:
            self.lines.append(self.mark + words)
        self.line, self.mark = [], ""

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in SKIPPED:
            self.skip += 1
        elif tag == "title":
            self.in_title = True
        elif tag in BLOCKS:
            self.flush()
            self.mark = "#" * int(tag[1]) + " " if tag[0] == "h" and tag[1:].isdigit() else "- " if tag == "li" else "> " if tag == "blockquote" else ""

    def handle_endtag(self, tag: str) -> None:
        if tag in SKIPPED:
            self.skip = max(0, self.skip - 1)
        elif tag == "title":
            self.in_title = False
        elif tag in BLOCKS:
            self.flush()

    def handle_data(self, data: str) -> None:
        if self.in_title:
            self.title += data
        elif not self.skip:
            self.line.append(data)


def to_markdown(page: str) -> tuple[str, str]:
    """(title, markdown) of a page."""
    parser = _Markdown()
    parser.feed(page)
    parser.close()
    parser.flush()
    return " ".join(parser.title.split()), "\n\n".join(parser.lines)


def pages_to_markdown(pages: DataFrame, least: int = 40) -> DataFrame:
    """(page_id, url, title, markdown, status): ok, empty for a null or blank page, not_article for less than so many characters of text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [to_markdown(h) if h and h.strip() else (None, None) for h in batch.column("html").to_pylist()]
            status = ["empty" if m is None else "ok" if len(m) >= least else "not_article" for _, m in rows]
            yield pa.RecordBatch.from_pydict({"page_id": batch.column("page_id"), "url": batch.column("url"), "title": pa.array([t for t, _ in rows], pa.string()), "markdown": pa.array([m for _, m in rows], pa.string()), "status": pa.array(status, pa.string())})

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", F.col("html").cast("string").alias("html")).mapInArrow(run, f"page_id {kind}, url string, title string, markdown string, status string")
