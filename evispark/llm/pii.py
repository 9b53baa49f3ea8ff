"""Personal data: patterns propose spans, checksums confirm them, context words adjust the score.

Every kind has a pattern, a check of the match, a score to begin with and words that raise it when
they stand whole within CONTEXT code points before or after the match. Base kinds (email, ip, card, phone) keep every
match that passes its check, with whatever score; added kinds must reach a threshold.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evispark.llm import spans as S
from evispark.llm.texts import map_texts

BASE = ["email", "ip", "card", "phone"]
ADDED = ["iban", "ssn"]
CONTEXT = 40


def _matches(pattern: re.Pattern, check: Callable[[str], bool]) -> Callable[[str], Iterator[tuple[int, int]]]:
    def find(text: str) -> Iterator[tuple[int, int]]:
        return ((m.start(), m.end()) for m in pattern.finditer(text) if check(m[0]))

    return find


def luhn(digits: str) -> bool:
    """The weighted digit sum that payment cards end in."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """The remainder that an international account number must leave."""
    s = iban.replace(" ", "").upper()
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _ssn(text: str) -> bool:
    area, group, serial = text.split("-")
    return area not in ("000", "666") and area < "900" and group != "00" and serial != "0000"


_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """From each @ backwards over its local part, which takes time in proportion to the text whatever it holds."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            end = m.end()
        at = text.find("@", max(at + 1, end))


# A run of digits is tried from its first digit only: from a later one the same characters follow it.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")

#: kind: finder, score of a confirmed match, words that raise it.
KINDS: dict[str, tuple[Callable[[str], Iterator[tuple[int, int]]], float, tuple[str, ...]]] = {
    "email": (_emails, 0.9, ("mail", "email", "e-mail", "contact", "write")),
    "ip": (_matches(_IP, lambda m: all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.split("."))), 0.6, ("ip", "host", "server", "address")),
    "card": (_matches(_CARD, lambda m: 12 <= len(d := _digits(m)) <= 19 and luhn(d)), 0.8, ("card", "visa", "credit", "payment")),
    "phone": (_matches(_PHONE, lambda m: 9 <= len(_digits(m)) <= 15), 0.7, ("phone", "tel", "call", "mobile", "fax")),
    "iban": (_matches(_IBAN, mod97), 0.8, ("iban", "account", "bank")),
    "ssn": (_matches(_SSN, _ssn), 0.3, ("ssn", "social security")),
}
_NEARBY = {kind: re.compile(rf"(?<![^\W_])(?:{'|'.join(words)})(?![^\W_])", re.I) for kind, (_, _, words) in KINDS.items()}


def find_spans(text: str, threshold: float = 0.5) -> list[S.Span]:
    """All base spans of text, and the added ones whose score reaches threshold."""
    found = []
    for kind, (find, score, _) in KINDS.items():
        for start, end in find(text):
            # A line feed stands for the match, so that no word reaches over it.
            around = f"{text[max(0, start - CONTEXT) : start]}\n{text[end : end + CONTEXT]}"
            now = min(1.0, score + 0.3 * (_NEARBY[kind].search(around) is not None))
            if kind in BASE or now >= threshold:
                found.append((kind, start, end, now))
    return S.in_order(found, BASE + ADDED)


def detect(docs: DataFrame, id_col: str = "doc_id", threshold: float = 0.5) -> DataFrame:
    """One row for each document and repeated row: id, found (kind, start, end, score structs in order) and redacted.

    A null text is empty and has no spans; redacted is null then. Extra columns are not read. The whole
    text is scanned, whatever its length, without a shuffle; an empty table has no rows. Spans are in
    order of start, then of kind as listed, so ties are settled.
    """

    def work(texts: list[bytes], kept: dict[str, list]) -> dict[str, object]:
        found, redacted = [], []
        for t in texts:
            text = t.decode("utf-8", "surrogatepass")
            now = find_spans(text, threshold)
            found.append([dict(zip(("kind", "start", "end", "score"), s, strict=True)) for s in now])
            redacted.append(S.replaced(text, now) if now else text)
        return {"id": kept["id"], "found": found, "redacted": redacted}

    kind = docs.schema[id_col].dataType.simpleString()
    out = map_texts(docs.select(F.col(id_col).alias("id"), F.col("text").cast("string").alias("text")), ["id"], f"id {kind}, found array<struct<kind:string,start:bigint,end:bigint,score:double>>, redacted string", work)
    return out.withColumnRenamed("id", id_col)


def digest_columns(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, n_email, n_ip, n_card, n_phone, base_sha256 and spans, from detect()'s spans."""
    return S.digest_columns(detect(docs, id_col), id_col, BASE)


def redact(docs: DataFrame) -> DataFrame:
    """documents with each span in text replaced by its kind in brackets, n_chars counted anew; other columns as they are."""
    columns = docs.columns
    others = [c for c in columns if c not in ("text", "n_chars")]

    def work(texts: list[bytes], kept: dict[str, list]) -> dict[str, object]:
        out = []
        for t, given in zip(texts, kept["given"], strict=True):
            text = t.decode("utf-8", "surrogatepass")
            out.append(S.replaced(text, find_spans(text)) if given else None)
        return {"row": kept["row"], "text": out}

    inner = docs.select(F.col("text").cast("string").alias("text"), F.struct(*others).alias("row"), F.col("text").isNotNull().alias("given"))
    kind = inner.schema["row"].dataType.simpleString()
    done = map_texts(inner, ["row", "given"], f"row {kind}, text string", work)
    values = {c: F.col("row")[c] for c in others} | {"text": F.col("text"), "n_chars": F.char_length("text").cast("long")}
    return done.select(*(values[c].alias(c) for c in columns))
