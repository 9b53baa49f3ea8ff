"""Language identification as inference of a mixture of languages.

Each language is a distribution over hashed letter trigrams, counted over all documents learned from.
For each document, expectation-maximisation estimates the proportions of all languages; then sets of
the 1, 2, ... largest are fitted anew and the set with the best penalised likelihood of all is kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evispark.llm.texts import group_ends, map_texts, text_column

#: Trigrams are hashed to so many buckets: the model has this many rows and a column for each language.
BUCKETS = 1 << 15
#: Added to each bucket's count.
SMOOTHING = 0.05
#: Trigrams times languages of texts that are fitted at once; a text with more is fitted by itself, slice by slice.
CELLS = 1 << 22
ROUNDS, TOLERANCE = 20, 1e-3
#: Neighbouring trigrams share letters; so many count as one observation in the penalised likelihood.
OVERLAP = 3
#: What EM may still gain, in log-likelihood, when it stops.
SLACK = 3.0
#: Code points of a long text that are taken at a time.
SLICE = 1 << 17


@cache
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def _hashed(codes: np.ndarray) -> np.ndarray:
    """The bucket of each three codes in a row."""
    h = codes[:-2] * np.uint64(0x9E3779B97F4A7C15) + codes[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + codes[2:] * np.uint64(0x165667B19E3779F9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(64 - 15)).astype(np.int64)


def _codes(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Code points in lower case with 32 for what is no letter, and which are letters."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    letter = _letters()[codes.astype(np.int64)]
    codes[~letter] = 32
    return codes, letter


def _counts_of(text: str) -> tuple[np.ndarray, np.ndarray, bool]:
    """Distinct buckets of one text's trigrams, how many of each, and whether it has a letter: slice by slice, each slice going on where the last one ended."""
    total, tail, after_letter, has = np.zeros(BUCKETS, np.int64), np.array([32], np.uint64), False, False
    for at in range(0, len(text) + 1, SLICE):
        codes, letter = _codes(text[at : at + SLICE] + ("" if at + SLICE <= len(text) else " "))
        if not len(codes):
            continue
        keep = letter.copy()
        keep[1:] |= letter[:-1]
        keep[0] |= after_letter
        own = np.concatenate([tail, codes[keep]])
        if len(own) > 2:
            total += np.bincount(_hashed(own), minlength=BUCKETS)
        tail, after_letter, has = own[-2:], bool(letter[-1]), has or bool(letter.any())
    at = np.flatnonzero(total)
    return at, total[at], has


def _trigrams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, count, text number) of every distinct trigram of letters in each text, other runs being one space; and whether each text has a letter."""
    if len(texts) == 1:
        at, n, has = _counts_of(texts[0].decode("utf-8", "surrogatepass"))
        return at, n, np.zeros(len(at), np.int64), np.array([has])
    lowered = [f" {t.decode('utf-8', 'surrogatepass').lower()} " for t in texts]
    sizes = np.array([len(t) for t in lowered])
    codes, letter = _codes("".join(lowered))
    owner = np.repeat(np.arange(len(texts)), sizes)
    has = np.bincount(owner[letter], minlength=len(texts)) > 0
    keep = letter.copy()
    keep[1:] |= letter[:-1] | (owner[1:] != owner[:-1])
    keep[0] = True
    codes, owner = codes[keep], owner[keep]
    whole = owner[:-2] == owner[2:]
    both, n = np.unique(owner[:-2][whole] * BUCKETS + _hashed(codes)[whole], return_counts=True)
    return both % BUCKETS, n, both // BUCKETS, has


def learn(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in order and their smoothed trigram probabilities, from all rows (text, lang) with a lang.

    Counts are summed within each task and then by (lang, bucket), so what reaches the driver is at
    most BUCKETS rows for each language. The model is 256 KB for each language and goes to all tasks;
    there is no limit to their number but that memory.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
            langs = batch.column("lang").to_pylist()
            start = 0
            for end in group_ends([len(t) for t in texts]) if texts else []:
                buckets, n, owner, _ = _trigrams(texts[start:end])
                names = sorted(set(langs[start:end]))
                of = np.array([names.index(x) for x in langs[start:end]])
                got = np.bincount(of[owner] * BUCKETS + buckets, n, minlength=len(names) * BUCKETS).astype(np.int64).reshape(-1, BUCKETS)
                for name, row in zip(names, got, strict=True):
                    totals[name] = totals.get(name, 0) + row
                start = end
        for name, row in totals.items():
            at = np.flatnonzero(row)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([name] * len(at), pa.string()), "bucket": pa.array(at, pa.int32()), "n": pa.array(row[at], pa.int64())})

    labelled = docs.where("lang IS NOT NULL").select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    table = labelled.mapInArrow(count, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(table.column("lang").to_pylist()))
    counts = np.zeros((BUCKETS, len(langs)))
    place = {x: i for i, x in enumerate(langs)}
    counts[table.column("bucket").to_numpy(), [place[x] for x in table.column("lang").to_pylist()]] = table.column("n").to_numpy()
    counts += SMOOTHING
    return langs, counts / counts.sum(axis=0) if langs else counts


def _fit(likelihood: np.ndarray, n: np.ndarray, sizes: np.ndarray, totals: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """EM for all texts at once: proportions within the allowed languages and log-likelihoods. Rows of likelihood are a text's distinct trigrams; a text stays as it is once it has settled."""
    share = allowed / allowed.sum(axis=1, keepdims=True)
    live, rows, own, length = np.arange(len(sizes)), likelihood, n, sizes
    for _ in range(ROUNDS):
        now = share[live]
        weight = own / np.einsum("ij,ij->i", rows, np.repeat(now, length, axis=0))
        new = now * np.add.reduceat(rows * weight[:, None], np.cumsum(length) - length, axis=0) / totals[live][:, None]
        share[live] = new
        moves = np.abs(new - now).max(axis=1) >= TOLERANCE
        if not moves.any():
            break
        if not moves.all():
            keep = np.repeat(moves, length)
            live, rows, own, length = live[moves], rows[keep], own[keep], length[moves]
    mixed = np.einsum("ij,ij->i", likelihood, np.repeat(share, sizes, axis=0))
    return share, np.add.reduceat(n * np.log(mixed), np.cumsum(sizes) - sizes)


def _fit_alone(buckets: np.ndarray, n: np.ndarray, model: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """_fit() of one text, whose likelihoods are made slice by slice in each round."""
    share, total, size = allowed / allowed.sum(axis=1, keepdims=True), n.sum(), max(1, CELLS // model.shape[1])
    slices = [slice(at, at + size) for at in range(0, len(buckets), size)]
    for _ in range(ROUNDS):
        new = np.zeros_like(share)
        for x in slices:
            rows = model[buckets[x]]
            new[0] += (n[x] / (rows @ share[0])) @ rows
        new *= share / total
        moves, share = np.abs(new - share).max() >= TOLERANCE, new
        if not moves:
            break
    return share, np.array([sum(float(n[x] @ np.log(model[buckets[x]] @ share[0])) for x in slices)])


def infer(buckets: np.ndarray, n: np.ndarray, owner: np.ndarray, n_texts: int, model: np.ndarray) -> np.ndarray:
    """Proportions (texts x languages) under the set of languages that is best by penalised likelihood; zeros for a text without trigrams.

    Sets are the 1, 2, ... languages that are largest when all are fitted. A size is left out only if
    it would not win with the likelihood of all languages, and SLACK. Texts are fitted in groups of about
    CELLS trigrams times languages, in order of text; a text that is larger is fitted alone.
    """
    n_langs = model.shape[1]
    out = np.zeros((n_texts, n_langs))
    sizes = np.bincount(owner, minlength=n_texts)
    ends, n = np.cumsum(sizes), n.astype(float)
    group: list[int] = []

    def settle(texts: list[int]) -> None:
        at = np.concatenate([np.arange(ends[t] - sizes[t], ends[t]) for t in texts])
        own, weights, length = model[buckets[at]], n[at], sizes[texts]
        totals = np.add.reduceat(weights, np.cumsum(length) - length)

        def fit(live: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            rows = np.repeat(np.isin(np.arange(len(texts)), live), length)
            return _fit(own[rows], weights[rows], length[live], totals[live], allowed)

        out[texts] = _best_sets(fit, totals, n_langs)

    for t in np.flatnonzero(sizes).tolist():
        if sizes[t] * n_langs > CELLS:
            at = slice(ends[t] - sizes[t], ends[t])
            out[t] = _best_sets(lambda _, allowed, at=at: _fit_alone(buckets[at], n[at], model, allowed), n[at].sum(keepdims=True), n_langs)[0]
            continue
        if group and (sizes[group].sum() + sizes[t]) * n_langs > CELLS:
            settle(group)
            group = []
        group.append(t)
    if group:
        settle(group)
    return out


def _best_sets(fit, totals: np.ndarray, n_langs: int) -> np.ndarray:
    """The proportions of the best set of languages of each text. fit(numbers of texts, languages allowed for each) gives proportions and log-likelihoods."""
    texts = np.arange(len(totals))
    share, most = fit(texts, np.ones((len(texts), n_langs)))
    order = np.argsort(-share, axis=1, kind="stable")
    price = 0.5 * np.log(np.maximum(totals, 2))
    best, best_value, live = np.zeros_like(share), np.full(len(texts), -np.inf), texts
    for size in range(1, n_langs + 1):
        live = live[(most[live] + SLACK) / OVERLAP - size * price[live] > best_value[live]]
        if not len(live):
            break
        allowed = np.zeros((len(live), n_langs))
        np.put_along_axis(allowed, order[live, :size], 1.0, axis=1)
        fitted, value = fit(live, allowed)
        value = value / OVERLAP - size * price[live]
        better = value > best_value[live]
        best[live[better]], best_value[live[better]] = fitted[better], value[better]
    return best


def _judge(texts: list[bytes], names: list[str], model: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Predicted languages, scores and proportions."""
    buckets, n, owner, has = _trigrams(texts)
    share = infer(buckets, n, owner, len(texts), model) if names else np.zeros((len(texts), 1))
    top = share.argmax(axis=1)
    known = has & (share.max(axis=1) > 0) & bool(names)
    return [names[t] if k else "und" for t, k in zip(top, known, strict=True)], np.where(known, np.minimum(share.max(axis=1), 1.0), 0.0), share * known[:, None]


def identify(docs: DataFrame, langs: list[str], model: np.ndarray, id_col: str = "doc_id") -> DataFrame:
    """A row for each row of docs: id, lang_pred, score (the proportion of lang_pred) and mixture (languages with their proportions).

    `und` with score 0 stands for a text that is null or has no letter, and for every text where
    nothing was learned. Equal proportions go to the first language in order. A row's result depends on
    its text alone, so repeated rows agree; an empty table has no rows. Long texts are counted slice by
    slice. Only the text is read.
    """
    shared = docs.sparkSession.sparkContext.broadcast((langs, model))

    def work(texts: list[bytes], kept: dict[str, list]) -> dict[str, object]:
        names, table = shared.value
        pred, score, share = _judge(texts, names, table)
        return {"id": kept["id"], "lang_pred": pred, "score": score, "mixture": [[{"lang": names[j], "share": float(row[j])} for j in np.flatnonzero(row > 1e-3)] for row in share]}

    kind = docs.schema[id_col].dataType.simpleString()
    out = map_texts(docs.select(F.col(id_col).alias("id"), F.col("text").cast("string").alias("text")), ["id"], f"id {kind}, lang_pred string, score double, mixture array<struct<lang:string,share:double>>", work)
    return out.withColumnRenamed("id", id_col)


def with_language(docs: DataFrame, langs: list[str], model: np.ndarray, least: float) -> DataFrame:
    """The rows of docs, all columns, in which one language holds at least that share; `und` is rejected."""
    shared = docs.sparkSession.sparkContext.broadcast((langs, model))

    def work(texts: list[bytes]) -> list[bool]:
        pred, score, _ = _judge(texts, *shared.value)
        return [p != "und" and bool(s >= least) for p, s in zip(pred, score, strict=True)]

    return docs.where(text_column(work, "boolean")(F.col("text").cast("string")))
