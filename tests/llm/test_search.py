"""Searches against brute force: top-k, hard negatives, ranked lexical search."""

import math
import random
import re
from collections import Counter
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from evispark.llm import lexical, negatives, topk, vectors

SCHEMA = "vec_id bigint, embedding array<float>, label int, v string, score string, query_id int, _slice int"
LOW, HIGH = -(1 << 63), (1 << 63) - 1


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 1, 2) for r in rows], SCHEMA).repartition(3)


def numbers(v, scale):
    return [math.floor(Fraction(float(np.float32(x))) * scale) for x in v]


def product(a, b):
    return min(max(sum(x * y for x, y in zip(a, b)), LOW), HIGH)


def good(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def brute_top(rows, asked, k, scale):
    own = [(i, numbers(v, scale)) for i, v, _ in rows if good(v)]
    out = []
    for qid, q in {(i, tuple(numbers(v, scale))) for i, v, _ in asked if good(v) and i is not None}:
        ranked = sorted(((-product(q, v), i is None, i or 0) for i, v in own if i != qid))[:k]
        out += [(qid, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(ranked)]
    return sorted(out, key=str)


def some_vectors(seed, n, dims, hot):
    random.seed(seed)
    same = [random.gauss(0, 0.1) for _ in range(dims)]
    rows = [(i, same if random.random() < hot else [random.gauss(0, 0.1) for _ in range(dims)], random.choice([0, 0, 0, 1, 2])) for i in range(n)]
    odd = [(n, None, 0), (n + 1, [None] + same[1:], 0), (n + 2, [math.nan] * dims, 1), (n + 3, [math.inf] + same[1:], 1), (None, same, 0), (n + 4, [], 0), (n + 5, same[:2], 1), (n + 6, same + [1.0], 0), (5, same, 1), (5, same, 1), (n + 7, same, None)]
    return rows + odd


@pytest.mark.parametrize(("seed", "hot"), [(1, 0.0), (2, 0.4), (3, 1.0)])
def test_top_k(spark, monkeypatch, seed, hot):
    monkeypatch.setattr(vectors, "BLOCK_BYTES", 3000)
    rows = some_vectors(seed, 160, 6, hot)
    df = frame(spark, rows)
    got = topk.top_k(df, df.where("vec_id % 20 = 0 OR vec_id IS NULL"), 7, 1024)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    want = brute_top(rows, [r for r in rows if r[0] is not None and r[0] % 20 == 0], 7, 1024)
    assert sorted((tuple(r) for r in got.collect()), key=str) == want


def test_top_k_of_large_numbers_and_few_rows(spark):
    rows = [(i, [x, -x, 1.0], 0) for i, x in enumerate([1e30, -1e30, 1e18, 3e9, 2e15, 0.5, -0.25, 3e38])]
    df = frame(spark, rows)
    want = brute_top(rows, rows, 50, 1024)
    assert sorted((tuple(r) for r in topk.top_k(df, df, 50, 1024).collect()), key=str) == want
    assert topk.top_k(df.limit(0), df, 5, 1024).count() == 0 == topk.top_k(df, df.limit(0), 5, 1024).count()


def test_ties_of_any_ids(spark):
    ids = [HIGH - 1, LOW, -5, 0, 7, 1 << 40, *range(100, 400)]
    rows = [(i, [0.5, 0.5], 0) for i in ids]
    df = frame(spark, rows)
    got = topk.top_k(df, df.where("vec_id = 0 OR vec_id = 100"), 4, 1024).collect()
    assert sorted(tuple(r) for r in got) == brute_top(rows, [r for r in rows if r[0] in (0, 100)], 4, 1024)


def brute_negatives(rows, anchor, scale, n):
    own = [(i, lab, numbers(v, scale)) for i, v, lab in rows if good(v) and lab is not None]
    out = []
    for aid, label, a in {(i, lab, tuple(v)) for i, lab, v in own if i is not None and anchor(i)}:
        place = lambda x: (-product(a, x[2]), x[0] is None, x[0] or 0)
        for p in sorted((x for x in own if x[1] == label and x[0] != aid), key=place)[:n]:
            ps = product(a, p[2])
            far = [x for x in own if x[1] != label and 80 * ps <= 100 * product(a, x[2]) <= 100 * ps]
            out += [(aid, p[0], r + 1, x[0], ps, product(a, x[2])) for r, x in enumerate(sorted(far, key=place)[:n])]
    return sorted(out, key=str)


@pytest.mark.parametrize(("seed", "hot", "scale"), [(1, 0.0, 256), (2, 0.4, 256), (3, 0.4, 1 << 30), (4, 0.9, 1 << 50)])
def test_hard_negatives(spark, monkeypatch, seed, hot, scale):
    monkeypatch.setattr(vectors, "BLOCK_BYTES", 6000)
    rows = some_vectors(seed, 160, 6, hot)
    df = frame(spark, rows)
    got = negatives.hard_negatives(df, F.col("vec_id") % 20 == 0, scale, 3, 3)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    found = sorted((tuple(r) for r in got.collect()), key=str)
    assert found == brute_negatives(rows, lambda i: i % 20 == 0, scale, 3)
    assert negatives.hard_negatives(df.limit(0), F.col("vec_id") % 20 == 0, scale).count() == 0


@pytest.mark.parametrize("size", [1, 100, 1 << 20, 1 << 40, 1 << 61])
def test_packed_products_are_exact(size):
    rng = np.random.default_rng(size)
    rows, anchors = rng.integers(-size, size + 1, (50, 7)), rng.integers(-size, size + 1, (5, 7))
    packed = negatives.pack(rows, anchors)
    for a in anchors:
        assert negatives.packed_scores(packed, a).tolist() == [product([int(x) for x in r], [int(x) for x in a]) for r in rows]


def terms_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_search(docs, items, k):
    own = [(i, Counter(terms_of(t))) for i, t in docs]
    n_docs, length = sum(1 for _, c in own if c), sum(c.total() for _, c in own)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms_of(t))
    df = Counter(t for _, c in own for t in c)
    out = []
    for i, terms in asked.items():
        found = []
        for d, c in own:
            m = 50 + 50 * c.total() * n_docs // max(length, 1)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t in terms if c[t])
            if s > 0:
                found.append((-s, d is None, d or 0))
        out += [(i, r + 1, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [20_000, 40])
def test_search(spark, monkeypatch, block):
    random.seed(5)
    monkeypatch.setattr(lexical, "PIECE", 8)
    monkeypatch.setattr(lexical, "PART", 50)
    vocabulary = [f"W{i}" for i in range(40)] + ["É", "ñandú", "日本", "x1"]
    text = lambda n: random.choice([" ", "-", "\n", "''"]).join(random.choices(vocabulary, range(len(vocabulary), 0, -1), k=n))
    docs = [(i, text(random.randint(1, 60))) for i in range(150)]
    docs += [(200, None), (201, ""), (202, "...!"), (None, text(30)), (None, docs[3][1]), *((i, docs[3][1]) for i in range(300, 380)), (7, docs[7][1]), (400, text(5000))]
    items = [(i, text(random.randint(1, 25))) for i in range(30)] + [(30, None), (31, "?"), (None, text(9)), (None, text(9)), (4, text(9)), (32, "unknown"), (33, items_text := text(9)), (34, items_text)]
    d = spark.createDataFrame([(*x, "x", 1, 1) for x in docs], "doc_id bigint, text string, item_id string, n int, terms int").repartition(3)
    b = spark.createDataFrame([(*x, 1) for x in items], "item_id int, text string, doc_id int")
    got = lexical.search(d, b, 10, block_terms=block)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_search(docs, items, 10)
    assert lexical.search(d.limit(0), b, 10).count() == 0 == lexical.search(d, b.limit(0), 10).count()


def test_plans_add_shared_sets_once():
    random.seed(3)
    common = list(range(10))
    items = [common + random.sample(range(10, 60), 6) for _ in range(40)] + [[], [5], list(range(60))]
    plan = lexical.mine(items, 60)
    leaves = np.random.default_rng(0).integers(0, 1000, (60, 9))
    sums = lexical.accumulated(plan, leaves)
    for own, nodes in zip(items, plan.items, strict=True):
        assert (sums[nodes].sum(0) == leaves[own].sum(0)).all()
    plain = sum(len(x) - 1 for x in items if x)
    assert len(plan.left) + sum(len(x) - 1 for x in plan.items if x) < 0.55 * plain
    assert all(left < start and right < start for start, end in plan.levels for left, right in zip(plan.left[start - 60 : end - 60], plan.right[start - 60 : end - 60]))


def test_score_of_a_very_long_document():
    n = np.array([1 << 40], np.int64)
    want = int(Decimal(1_000_000_000 * 3) // Decimal(3000 + 20 * (50 + 50 * (1 << 40) * (1 << 40) // (1 << 41))))
    assert lexical.gains(np.array([3]), n, np.array([7]), 1 << 40, 1 << 41).tolist() == [7 * want]
