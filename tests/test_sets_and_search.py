"""Set joins, context groups, fingerprints within a distance and cover density against brute force."""

import math
import random
import statistics
import time
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from evispark.operators import contextlinks, dedup, fulltext, hyperplanes, ops, retrieve, setjoin
from evispark.operators.dedup import cosine
from evispark.shared import materialize


def some_sets(r, n):
    words = [f"w{i}" for i in range(60)]
    base = [r.sample(words, 12) for _ in range(5)]
    rows = [[*r.sample(r.choice(base), r.randrange(4, 12)), *r.choices(words[:10], k=r.randrange(4))] for _ in range(n)]
    return [*rows, [], None, ["w1"], ["w1", "w1", None], rows[0]]


@pytest.mark.parametrize(("least", "list_size"), [(0.3, 1000), (0.3, 7), (0.8, 5), (1.0, 1000)])
def test_similar_sets(spark, monkeypatch, least, list_size):
    monkeypatch.setattr(setjoin, "LIST", list_size)
    rows = list(enumerate(some_sets(random.Random(4), 120)))
    sets = {i: set(t or []) - {None} for i, t in rows}
    want = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a, b in combinations(sets, 2) if sets[a] & sets[b]}
    want = {k: j for k, j in want.items() if j >= least}
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "id int, terms array<string>, term string")
    got = {(p["a"], p["b"]): p["jaccard"] for p in setjoin.similar_sets(df, least).collect()}
    assert got == pytest.approx(want) and (want or least == 1.0)
    assert setjoin.similar_sets(df.limit(0), least).count() == 0
    with pytest.raises(ValueError):
        setjoin.similar_sets(df, 0.0)


def test_sets_meet_only_where_enough_can_follow(spark):
    # Of ten terms each, the last four in order are shared: less than the five that a Jaccard similarity of 0.3 asks for.
    df = spark.createDataFrame([(i, [f"{i} {k}" for k in range(6)] + [f"z{k}" for k in range(4)]) for i in range(30)], "id int, terms array<string>")
    assert setjoin.meetings(df, 0.3).count() == 0
    more = df.withColumn("terms", F.when(F.col("id") < 2, F.concat("terms", F.array(F.lit("a")))).otherwise(F.col("terms")))
    assert [(p["a"], p["b"]) for p in setjoin.similar_sets(more, 5 / 17).collect()] == [(0, 1)]


def test_context_groups(spark):
    r = random.Random(7)
    direction = [[r.gauss(0, 1) for _ in range(4)] for _ in range(3)]
    vectors = [None, [0.0] * 4, [1.0, 0.0], *([x + r.gauss(0, 0.2) for x in d] for d in direction for _ in range(3))]
    rows = [(i, t, r.choice(vectors), r.random()) for i, t in enumerate(some_sets(r, 90))]
    rows += [(500, rows[3][1], rows[3][2], 2.0), (501, ["q", "r"], [0.0] * 4, 1.0), (502, ["q", "r"], [0.0] * 4, 1.0), (503, ["z"], None, 1.0), (504, ["z"], None, 1.0)]

    def similarity(a, b):
        (x, p), (y, q) = ((set(row[1] or []) - {None}, row[2]) for row in (a, b))
        jaccard = len(x & y) / len(x | y) if x and y else 0.0
        if p is None or q is None or len(p) != len(q):
            return jaccard, 0.38
        norm = math.sqrt(sum(v * v for v in p) * sum(v * v for v in q))
        return 0.8 * ((sum(v * w for v, w in zip(p, q)) / norm + 1) / 2 if norm else 0.0) + 0.2 * jaccard, 0.86

    parent = {row[0]: row[0] for row in rows}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    links = []
    for a, b in combinations(rows, 2):
        s, least = similarity(a, b)
        if round(s, 9) >= least:
            links.append((a[0], round(s, 9)))
            x, y = sorted((find(a[0]), find(b[0])))
            parent[y] = x
    want = {}
    for row in rows:
        own = [x for x in rows if find(x[0]) == find(row[0])]
        if len(own) > 1:
            want[find(row[0])] = (len(own), max(s for i, s in links if find(i) == find(row[0])), max((x[3], x[0]) for x in own)[1])
    df = spark.createDataFrame([(*x, 1) for x in rows], "id int, terms array<string>, vector array<double>, score double, node int").drop("node").repartition(3)
    got = {x["component"]: (x["size"], x["max_similarity"], x["representative"]) for x in dedup.context_groups(df, n=None).collect()}
    assert {k: (s, r) for k, (s, _, r) in got.items()} == {k: (s, r) for k, (s, _, r) in want.items()} and len(want) > 3
    assert all(got[k][1] == pytest.approx(want[k][1], abs=1e-8) for k in want)
    assert dedup.context_groups(df).count() == min(5, len(want)) and dedup.context_groups(df.limit(0)).count() == 0


def test_groups_hand_on_few_links(spark, monkeypatch):
    # All of a group are alike: 300 contexts have 44,850 links, by terms that everyone holds.
    r = random.Random(9)
    rows = [(i, [f"f{k}" for k in range(30)] + [f"{i % 3} {k}" for k in r.sample(range(40), 8)], None if i % 4 else [1.0, r.random()], r.random()) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, terms array<string>, vector array<double>, score double")
    whole = [tuple(x) for x in dedup.context_groups(df, n=None).collect()]
    links = contextlinks.connecting_links(df, 0.86, 0.38)
    assert 299 <= links.count() < 44_850 / 3 and [x[:2] for x in whole] == [(0, 300)]
    for name, value in (("SENT", 20_000), ("ROWS", 3), ("OTHERS", 5), ("OWN", 4), ("SHARED", 2), ("LOOKED", 40)):
        monkeypatch.setattr(contextlinks, name, value)
    assert [tuple(x) for x in dedup.context_groups(df, n=None).collect()] == whole


@pytest.mark.parametrize("short", [2, 64])
def test_fingerprints_of_few_values(spark, short):
    r = random.Random(short)
    centres = [r.getrandbits(64) for _ in range(4)]
    values = {c ^ sum(1 << b for b in r.sample(range(64), r.randrange(8))) for c in centres for _ in range(60)} | {r.getrandbits(10) for _ in range(60)}
    rows = [(i, v - (1 << 64) if v >> 63 else v) for i, v in enumerate(sorted(values))]
    mask = (1 << 64) - 1
    want = {(a, b): d for (a, x), (b, y) in combinations(rows, 2) if (d := ((x ^ y) & mask).bit_count()) <= 6}
    df = spark.createDataFrame([*rows, (1000, rows[0][1]), (1001, None)], "id long, simhash long")
    got = dedup.simhash_pairs(df, short=short).collect()
    assert {(p["a"], p["b"]): p["distance"] for p in got} == want and len(got) == len(want) > 1000


def test_fingerprints_meet_in_a_list_for_each_block(spark):
    r = random.Random(5)
    centre = r.getrandbits(40)
    values = sorted({centre ^ sum(1 << b for b in r.sample(range(40), r.randrange(1, 6))) for _ in range(500)})
    old = {v: sorted(f"d{r.randrange(10_000)}" for _ in range(r.randrange(3))) for v in values}
    nodes = spark.createDataFrame([(v, *[*ids, None, None][:2]) for v, ids in old.items()], "simhash long, one string, other string")
    want = {v: sorted(i for w in values if w != v and (v ^ w).bit_count() <= 6 for i in old[w])[:2] for v in values}
    for short in (64, 1000):
        found = {}
        for x in dedup.near_ids(nodes, short=short).collect():
            found.setdefault(x["simhash"], set()).add(x["id"])
        assert {v: sorted(i)[:2] for v, i in found.items()} == {v: i for v, i in want.items() if i}
    # No fingerprint goes to more lists than there are blocks, however many are alike.
    assert dedup._cells(nodes, 6, 1000).groupBy("simhash").count().agg({"count": "max"}).first()[0] <= 7


def brute_covers(words, terms):
    spots = [i for i, w in enumerate(words) if w in terms]
    full = [(a, b) for a in spots for b in spots if a <= b and terms <= set(words[a : b + 1])]
    shortest = [(a, b) for a, b in full if not any((c, d) != (a, b) and a <= c and d <= b for c, d in full)]
    return sum(0.1 / (1 + sum(w not in terms for w in words[a : b + 1])) for a, b in shortest)


def test_cover_density(spark):
    r = random.Random(9)
    words = ["gene", "genes", "cell", "the", "binds", "mutated", "x", "y"]
    texts = [r.choice([" ", ", ", "-"]).join(r.choices(words, k=r.randrange(1, 40))) for _ in range(80)] + ["", None, "gene", "Gene CELL", "cells"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, content string")
    base = {"genes": "gene", "cells": "cell", "binds": "bind", "mutated": "mutat"}
    for query, stop in (("gene the CELLS", ()), ("genes", ()), ("the cell mutating", ("the",))):
        terms = fulltext.query_terms(spark, query, stop)
        got = fulltext.cover_density_search(fulltext.positions(df, stop), terms, None).collect()
        lists = {i: [base.get(w, w) for w in (t or "").lower().replace(",", " ").replace("-", " ").split()] for i, t in enumerate(texts)}
        want = {i: s for i, own in lists.items() if (s := brute_covers(own, set(terms)))}
        assert {x["id"]: x["score"] for x in got} == pytest.approx(want, abs=1e-6) and len(want) > 20
        assert [x["id"] for x in sorted(got, key=lambda x: x["rank"])] == sorted(want, key=lambda i: (-round(want[i], 6), i))
        best = fulltext.cover_density_search(fulltext.positions(df, stop), terms, 3).collect()
        assert sorted(best) == sorted(x for x in got if x["rank"] <= 3)
    assert fulltext.cover_density_search(fulltext.positions(df), [], None).count() == 0


def test_stems(spark):
    words = ["genes", "studies", "study", "classes", "binding", "mutated", "gas", "this", "kiwis", "virus", "need", "seeing", "s", "proteins"]
    got = spark.createDataFrame([(w,) for w in words], "w string").select(fulltext.stem(F.col("w"))).collect()
    assert [x[0] for x in got] == ["gene", "studi", "studi", "class", "bind", "mutat", "gas", "this", "kiwi", "virus", "need", "see", "s", "protein"]


def test_search_by_hyperplanes(spark):
    r = random.Random(12)
    centres = [[r.gauss(0, 1) for _ in range(16)] for _ in range(30)]
    rows = [(i, [x + r.gauss(0, 0.15) for x in centres[i % 30]]) for i in range(900)]
    odd = [(1000, None), (1001, [1.0, None] + [0.0] * 14), (1002, [1.0]), (1003, [0.0] * 16)]
    df = spark.createDataFrame([*rows, *odd], "id int, embedding array<float>").repartition(3)
    queries = spark.createDataFrame(rows[:60], "query_id int, vector array<double>")
    normals = hyperplanes.planes(8, 8, 16)
    index = hyperplanes.build_index(df, normals)
    assert index.count() == 8 * 901
    got = {(x["query_id"], x["id"]): x["score"] for x in hyperplanes.search_index(index, queries, normals, 10, 8).collect()}
    want = {(x["query_id"], x["id"]): x["score"] for x in retrieve.vector_search(df.where("size(embedding) = 16 AND id < 1000"), queries, 10).collect()}
    assert len(got.keys() & want.keys()) >= 0.9 * len(want) and all(got[k] == want[k] for k in got.keys() & want.keys())
    met = hyperplanes.probes(queries, normals, 8).join(index, "bucket").select("query_id", "id").distinct().count()
    assert met < 0.5 * 60 * 901
    assert hyperplanes.search_index(index, queries.limit(0), normals).count() == 0


def test_percentiles_with_nulls_and_ties(spark):
    r = random.Random(2)
    rows = [(r.choice(["a", "a", "b", None]), r.choice([None, 1, 2, 2, 3, 9])) for _ in range(200)] + [("c", None), ("d", 5)]
    got = {x["k"]: (x["n"], x["p50"], x["p95"], x["median"]) for x in ops.latency_percentiles(spark.createDataFrame(rows, "k string, v int"), "k", "v").collect()}
    for key in ("a", "b", "c", "d", None):
        own = sorted((v for k, v in rows if k == key), key=lambda v: (v is not None, v))
        full = sorted(v for v in own if v is not None)
        at = lambda p: own[math.floor((len(own) - 1) * p + 0.5)]  # noqa: B023, E731
        assert got[key] == (len(own), at(0.5), at(0.95), statistics.median(full) if full else None)


def test_vector_search_finds_what_the_formula_finds(spark):
    r = np.random.default_rng(3)
    own = [[float(x) for x in v] for v in r.integers(-2, 3, (300, 4))] + [[1.0, 2.0, 3.0, 4.0]] * 40 + [[float("nan"), 1.0, 1.0, 1.0], [float("inf"), 0.0, 1.0, 0.0], [1e-170] * 4, [1e170] * 4, [1.0, 2.0], [None, 1.0, 1.0, 1.0], [], None]
    rows = spark.createDataFrame([(f"é{i}", v) for i, v in enumerate(own)], "id string, embedding array<double>").repartition(3)
    queries = spark.createDataFrame([(i, v) for i, v in enumerate([*own[:70], *own[-9:]])], "query_id long, vector array<double>")
    scored = rows.crossJoin(queries).select("query_id", "id", F.round(cosine(F.col("embedding"), F.col("vector")), 6).alias("score")).where("score IS NOT NULL")
    want = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where("rank <= 7")
    got = retrieve.vector_search(rows, queries, 7)
    key = lambda df: sorted((x["query_id"], x["rank"], x["id"], str(x["score"] + 0.0)) for x in df.collect())
    assert key(got) == key(want)


def test_vector_search_of_many_queries_is_quick(spark):
    vector = F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: F.sin(F.col("id") * i + F.col("id") % 7 + 1))
    rows = spark.range(40_000).withColumn("embedding", vector)
    began = time.monotonic()
    found = retrieve.vector_search(rows, rows.where("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("vector")), 10)
    assert found.count() == 4_000 and found.where("rank = 1").count() == 400
    assert time.monotonic() - began < 60


def test_search_by_hyperplanes_of_many_queries_is_quick(spark):
    vector = F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: F.sin(F.col("id") * i + F.col("id") % 7 + 1))
    rows = spark.range(12_000).withColumn("embedding", vector)
    normals = hyperplanes.planes(16, 10, 64)
    index = materialize(hyperplanes.build_index(rows, normals), "index")
    queries = rows.where("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("vector"))
    began = time.monotonic()
    found = hyperplanes.search_index(index, queries, normals, 10, 40).cache()
    assert found.count() == 1_200 and found.where("rank = 1 AND query_id = id").count() == 120
    assert time.monotonic() - began < 20


def test_calls_of_a_busy_hour_are_counted_in_one_go(spark):
    n = 200_000
    calls = spark.range(n).select("id", F.lit("m").alias("model"), F.timestamp_micros(F.col("id") * 10_000).alias("created_at"))
    began = time.monotonic()
    got = ops.calls_in_hour(calls).agg(F.count("*"), F.count_if(F.col("n_last_hour") == F.col("id") + 1)).first()
    assert tuple(got) == (n, n)
    assert time.monotonic() - began < 15


def test_calls_in_hour_at_its_ends(spark):
    r, hour = random.Random(9), ops.HOUR
    at = [None, None, -1, 0, 1, hour - 1, hour, hour, hour + 1, 2 * hour, 2 * hour + 1, -hour, -hour - 1, *(r.randrange(-3 * hour, 3 * hour) for _ in range(200))]
    rows = [(i, r.choice("ab"), t) for i, t in enumerate(at)]
    calls = spark.createDataFrame(rows, "id long, model string, t long").withColumn("created_at", F.timestamp_micros("t"))
    want = {i: sum(m == o and (s is None if t is None else s is not None and t - hour <= s <= t) for _, o, s in rows) for i, m, t in rows}
    assert {x["id"]: x["n_last_hour"] for x in ops.calls_in_hour(calls).collect()} == want
