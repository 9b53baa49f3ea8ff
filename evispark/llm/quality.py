"""A quality classifier: naive Bayes support vectors over hashed word n-grams.

Indicators of word unigrams and bigrams are scaled by the log ratio of their smoothed counts in the two
classes; a linear model with hinge loss is fitted to them by dual coordinate descent. The fit takes at
most MAX_TRAINING labelled documents, those with the least hash of their id; scoring takes all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evispark.llm.texts import SPACES, map_texts, mix, word_hashes

#: Features are hashed to so many.
FEATURES = 1 << 18
MAX_TRAINING = 8000
SMOOTHING, COST, EPOCHS, TOLERANCE = 1.0, 0.5, 50, 1e-3


def features(texts: list[bytes]) -> list[np.ndarray]:
    """The sorted distinct features of each text.

    A word counts once in lower case and once as its shape, in which letters and digits of a kind are one
    sign; both also in pairs of neighbours. A word that follows itself is marked as such a pair too.
    """
    words, counts = word_hashes(texts, SPACES)
    shapes, _ = word_hashes([t.translate(_SHAPE) for t in texts], SPACES, seed=2)
    out, at = [], 0
    for n in counts.tolist():
        w, s = words[at : at + n], shapes[at : at + n]
        at += n
        pairs = [mix(x[:-1] * np.uint64(0x9E3779B97F4A7C15) + x[1:]) for x in (w, s)]
        # How many neighbours are the same word, by powers of two.
        repeats = mix(np.arange(int((w[:-1] == w[1:]).sum()).bit_length(), dtype=np.uint64) + np.uint64(1))
        out.append(np.unique(np.concatenate([w, s, *pairs, repeats]) & np.uint64(FEATURES - 1)).astype(np.int32))
    return out


#: Letters of either case, digits and other bytes by one sign each; other ASCII as it is.
_SHAPE = bytes(1 if 0x41 <= c <= 0x5A else 2 if 0x61 <= c <= 0x7A or c >= 0x80 else 3 if 0x30 <= c <= 0x39 else c for c in range(256))


class Model:
    """weights (one for each feature), bias, and the slope of the score."""

    def __init__(self, weights: np.ndarray, bias: float, slope: float) -> None:
        self.weights, self.bias, self.slope = weights, bias, slope

    def margins(self, rows: list[np.ndarray]) -> np.ndarray:
        return np.array([self.weights[r].sum() / max(1.0, np.sqrt(len(r))) + self.bias for r in rows])

    def scores(self, rows: list[np.ndarray]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(rows), -30, 30)))


def fit(rows: list[np.ndarray], labels: np.ndarray, seed: int = 7) -> Model:
    """The model for rows of features and labels of 0 and 1. One class alone gives a constant score on its side; no rows give 0.5."""
    y = np.where(labels == 1, 1.0, -1.0)
    if len(set(y)) < 2:
        return Model(np.zeros(FEATURES), float(y[0]) if len(y) else 0.0, 1.0)
    counts = np.full((2, FEATURES), SMOOTHING)
    for r, c in zip(rows, y, strict=True):
        counts[int(c > 0)][r] += 1
    counts /= counts.sum(axis=1, keepdims=True)
    ratio = np.log(counts[1] / counts[0])
    scaled = [ratio[r] / max(1.0, np.sqrt(len(r))) for r in rows]
    # Each class weighs the same in all.
    upper = np.where(y > 0, COST * len(y) / (2 * (y > 0).sum()), COST * len(y) / (2 * (y < 0).sum()))
    w, bias, _ = descend(rows, scaled, y, upper, FEATURES, seed)
    model = Model(w * ratio, bias, 1.0)
    margins = model.margins(rows)
    model.slope = 2.0 / max(1e-6, np.abs(margins - margins.mean()).mean())
    return model


def descend(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, upper: np.ndarray, n_features: int, seed: int) -> tuple[np.ndarray, float, np.ndarray]:
    """(weights, bias, dual variables) of the least hinge loss by dual coordinate descent; the bias is the weight of a feature of value 1 in all rows."""
    square = np.array([x @ x + 1 for x in values])
    w, bias, alpha = np.zeros(n_features), 0.0, np.zeros(len(y))
    order = np.random.Generator(np.random.PCG64(seed))
    for _ in range(EPOCHS):
        moved = 0.0
        for i in order.permutation(len(y)):
            gradient = y[i] * (w[rows[i]] @ values[i] + bias) - 1
            new = min(max(alpha[i] - gradient / square[i], 0.0), upper[i])
            step = (new - alpha[i]) * y[i]
            if step:
                w[rows[i]] += step * values[i]
                bias += step
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < TOLERANCE:
            break
    return w, bias, alpha


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", max_training: int = MAX_TRAINING) -> Model:
    """Fits to at most max_training labelled documents.

    Labels other than 0 and 1 and null ids are not used; a document labelled both ways counts as 0. Of
    rows that repeat a labelled id one is used. Ids may be of any type that sorts. Null texts are empty.
    """
    own = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).cast("int").alias("label"))
    chosen = own.orderBy(F.xxhash64("id"), "id").limit(max_training)
    texts = docs.select(F.col(id_col).alias("id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "id")

    def rows(ts: list[bytes], kept: dict[str, list]) -> dict[str, object]:
        return {"label": kept["label"], "id": kept["id"], "row": [r.tobytes() for r in features(ts)]}

    kind = texts.schema["id"].dataType.simpleString()
    got = map_texts(texts, ["label", "id"], f"label int, id {kind}, row binary", rows).groupBy("id").agg(F.min(F.struct("label", "row")).alias("least"))
    got = got.select("id", "least.label", "least.row")

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, ys, xs = [], [], []
        for batch in batches:
            ids += batch.column("id").to_pylist()
            ys += batch.column("label").to_pylist()
            xs += [np.frombuffer(r, np.int32) for r in batch.column("row").to_pylist()]
        order = sorted(range(len(ids)), key=lambda i: (ids[i], xs[i].tobytes()))
        model = fit([xs[i] for i in order], np.array([ys[i] for i in order]))
        at = np.flatnonzero(model.weights)
        yield pa.RecordBatch.from_pydict({"at": [at.astype(np.int32).tobytes()], "weights": [model.weights[at].tobytes()], "bias": [model.bias], "slope": [model.slope]})

    # One task fits: what it gets is bounded by max_training rows. The scan before it is not part of that task.
    r = got.repartition(1).mapInArrow(train, "at binary, weights binary, bias double, slope double").first()
    weights = np.zeros(FEATURES)
    weights[np.frombuffer(r["at"], np.int32)] = np.frombuffer(r["weights"], np.float64)
    return Model(weights, r["bias"], r["slope"])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id") -> DataFrame:
    """A row for each row of docs: id, score, predicted. A null text is empty and gets the score of the bias. Only the text is read."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(texts: list[bytes], kept: dict[str, list]) -> dict[str, object]:
        s = shared.value.scores(features(texts))
        return {"id": kept["id"], "score": s, "predicted": (s >= 0.5).astype(np.int32)}

    kind = docs.schema[id_col].dataType.simpleString()
    out = map_texts(docs.select(F.col(id_col).alias("id"), F.col("text").cast("string").alias("text")), ["id"], f"id {kind}, score double, predicted int", work)
    return out.withColumnRenamed("id", id_col)
