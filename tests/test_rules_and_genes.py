"""Rules of a table, nested payloads, run logs, scorers and gene links against brute force and in odd cases."""

import random
import re
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from evispark.operators import checks, dedup, genes, score
from evispark.sources import files, tables

RULES = [r"AKIA[0-9A-Z]{4}", r"(?i)\bsecret\b", r"a|b9", r"x(?:yz)?w", r"(?:ab)+c", r"[0-9]{3}", r"(foo|bar)baz", r"(?i)Pass(word)", r"end$", r"q+uu", r"n.t", r"(?=look)loo", r"kk{2}"]


@pytest.mark.parametrize(("pattern", "literal"), [(RULES[0], "akia"), (RULES[1], "secret"), (RULES[2], ""), (RULES[5], ""), (RULES[7], "password"), (RULES[8], "end"), (r"(?:lit)+x", "lit")])
def test_required_literals(pattern, literal):
    assert checks.required_literal(pattern) == literal


def test_rules_of_a_table(spark):
    r = random.Random(1)
    bits = ["AKIA12AB", "Secret", "secrets", "b9", "xw", "xyzw", "ababc", "123", "foobaz", "PASSWORD", "the end", "quu", "n\nt", "look", "kkk", "é", "KIA", "A"]
    texts = ["".join(r.choices([*bits, " ", " "], k=r.randrange(12))) for _ in range(300)] + ["", None]
    rules = [(f"r{i}", p, checks.SEVERITIES[i % 4] if i % 5 else "odd", "block" if i % 3 == 0 else "warn") for i, p in enumerate(RULES)] + [("r1", RULES[1], "low", "warn"), (None, "x", "low", "warn"), ("none", None, "low", "warn")]
    table = spark.createDataFrame(rules, "name string, pattern string, severity string, action string")
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "id int, text string, names string").repartition(3)
    got = {x["id"]: tuple(x)[1:] for x in checks.scan_rules(df, table, "id").collect()}
    for i, t in enumerate(texts):
        hit = sorted(x for x in rules if x[0] and x[1] and t and re.search(x[1], t, re.A))
        worst = max((checks.SEVERITIES.index(x[2]) for x in hit if x[2] != "odd"), default=-1)
        assert got[i] == ([x[0] for x in hit], len(hit), checks.SEVERITIES[worst] if worst >= 0 else None, any(x[3] == "block" for x in hit))
    assert sum(bool(x[1]) for x in got.values()) > 100
    assert {tuple(x[0]) for x in got.values()} and all(x[1] == 0 for x in (tuple(y)[1:] for y in checks.scan_rules(df, table.limit(0), "id").collect()))
    with pytest.raises(ValueError, match="split"):
        checks.scan_rules(df, table, "id", max_bytes=10)


def test_nested_payloads(spark):
    texts = ['[{"gene": "kras", "mutated": 3, "n_samples": 10}, [{"symbol": "tp53", "frequency": "25"}]]', '{"data": {"results": [{"items": [{"payload": {"gene_symbol": "BRAF", "frequency": 0.5}}]}], "other": {"gene": "NO"}}, "gene": "EGFR"}', "not json", None, "7", "null", "[]", '{"frequency": 0.1}', '{"gene": null}']
    df = spark.createDataFrame(list(enumerate(texts)), "key int, payload string")
    got = sorted(((x["key"], x["gene"], x["mutated"], x["profiled"], x["frequency"]) for x in files.nested_candidates(df).collect()), key=str)
    assert got == sorted([(0, "KRAS", 3, 10, 0.3), (0, "TP53", None, None, 0.25), (1, "EGFR", None, None, None), (1, "BRAF", None, None, 0.5), (7, None, None, None, 0.1)], key=str)
    assert files.nested_candidates(df.limit(0)).count() == 0


def test_patterns_of_an_ontology(spark):
    rows = spark.createDataFrame([("LUAD", "Lung Adenocarcinoma"), ("LUNG", "Luad"), ("X", ""), ("Y", None), ("B", "Same"), ("A", "same")], "code string, name string")
    assert {tuple(x) for x in files.ontology_patterns(rows).collect()} == {("luad", "LUAD", "code"), ("lung adenocarcinoma", "LUAD", "name"), ("lung", "LUNG", "code"), ("x", "X", "code"), ("y", "Y", "code"), ("b", "B", "code"), ("a", "A", "code"), ("same", "A", "name")}


def test_run_logs(spark, tmp_path):
    runs = lambda a, b: spark.createDataFrame([(i, f"q{i}") for i in range(a, b)], "recorded_at int, query string")
    path = str(tmp_path / "log")
    assert tables.append_runs(runs(0, 3), path, 5).count() == 3
    assert sorted(x[0] for x in tables.append_runs(runs(3, 9), path, 5).collect()) == [4, 5, 6, 7, 8]
    # A version that was not finished does not count.
    (tmp_path / "log" / "version=3").mkdir()
    assert tables.last_runs(spark, path, runs(0, 1))[0] == 2
    assert sorted(x[0] for x in tables.append_runs(runs(1, 2), str(tmp_path / "new"), 5).collect()) == [1]


def test_scorers_have_names():
    score.register_scorer("of_test", abs)
    score.register_scorer("of_test", abs)
    with pytest.raises(ValueError):
        score.register_scorer("of_test", len)
    with pytest.raises(ValueError, match="no scorer"):
        score.ranked_targets(None, None, scorer="unknown")


@pytest.mark.parametrize("block", [7, 512])
def test_gene_links(spark, monkeypatch, block):
    monkeypatch.setattr(genes, "BLOCK", block)
    r = random.Random(3)
    rows = [(f"g{i}", [0.0] * 4 if i % 9 == 0 else [round(r.random(), 1) for _ in range(4)], r.choices("abcdefgh", k=r.randrange(4)), r.choices("xyz", k=r.randrange(3)) or None) for i in range(40)]

    def cosine(a, b):
        a, b = np.array(a), np.array(b)
        return (a @ b / np.sqrt((a @ a) * (b @ b)) + 1) / 2 if a.any() and b.any() else 0.0

    want = []
    for x, y in combinations(sorted(rows), 2):
        (c, d), (s, t) = [(set(x[k] or []), set(y[k] or [])) for k in (2, 3)]
        value = round(min(1.0, 0.7 * cosine(x[1], y[1]) + 0.2 * len(c & d) / max(1, len(c | d)) + 0.1 * len(s & t) / max(1, len(s | t))), 9)
        if value >= 0.55 or c & d or s & t:
            want.append((x[0], y[0], value, len(c & d), len(s & t)))
    want.sort(key=lambda x: (-x[2], x[0], x[1]))
    df = spark.createDataFrame(rows, "gene string, scaled array<double>, chunks array<string>, topics array<string>").repartition(3)
    for n in (12, 10_000):
        got = [tuple(x) for x in genes.gene_links(df, n=n).collect()]
        assert [x[:2] + x[3:] for x in got] == [x[:2] + x[3:] for x in want[:n]] and [x[2] for x in got] == pytest.approx([x[2] for x in want[:n]], abs=2e-9)
    assert genes.gene_links(df.limit(0)).count() == 0


def test_genes_are_not_shuffled_to_all_others(spark, monkeypatch):
    monkeypatch.setattr(genes, "BLOCK", 7)
    r = random.Random(4)
    rows = [(f"g{i}", [r.random() for _ in range(5)], r.sample(range(900), r.randrange(6)) + [None] * (i % 90 == 0), r.sample(range(200), r.randrange(9))) for i in range(500)]
    df = spark.createDataFrame(rows, "gene string, scaled array<double>, chunks array<int>, topics array<long>").repartition(4)
    sc = spark.sparkContext
    stages = lambda: sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    shuffled = lambda: sum(stages().apply(i).shuffleWriteRecords() for i in range(stages().size()))
    before = shuffled()
    one = [tuple(x) for x in genes.gene_links(df, n=30).collect()]
    assert 0 < shuffled() - before < 20 * len(rows)
    # So do many passes over little blocks, with many topics to a column and few pairs at once.
    for name, value in (("SENT", 9000), ("COLUMNS", 3), ("SCORED", 8), ("LOOKED", 50)):
        monkeypatch.setattr(genes, name, value, raising=False)
    assert [tuple(x) for x in genes.gene_links(df, n=30).collect()] == one
    want = []
    for x, y in combinations(rows, 2):
        (c, d), (s, t) = [(set(x[k]), set(y[k])) for k in (2, 3)]
        a, b = np.array(x[1]), np.array(y[1])
        value = 0.35 * (a @ b / np.sqrt((a @ a) * (b @ b)) + 1) + 0.2 * len(c & d) / max(1, len(c | d)) + 0.1 * len(s & t) / max(1, len(s | t))
        want.append((-round(value, 9), *sorted((x[0], y[0])), len(c & d), len(s & t)))
    assert [(-x[2], x[0], x[1], x[3], x[4]) for x in one] == [(pytest.approx(w[0], abs=2e-9), *w[1:]) for w in sorted(want)[:30]]


def test_common_members_of_many_and_few():
    r = np.random.default_rng(3)
    lists = lambda n: pd.Series([np.concatenate([np.flatnonzero(r.random(600) < 0.3), 1000 + r.choice(5000, r.integers(0, 30), False)]) for _ in range(n)] + [np.array([], int)])
    for rows, columns in ((90, 70), (3, 4), (0, 1)):
        left, right = lists(rows), lists(columns)
        assert (genes._common(left, right) == [[len(set(a) & set(b)) for b in right] for a in left]).all()
    assert genes._common(pd.Series([], dtype=object), left).shape == (0, len(left))


def test_members_go_to_blocks_as_numbers(spark):
    df = spark.createDataFrame([(1, ["x", "y", None]), (2, ["y", None]), (3, []), (4, ["z"])], "row long, chunks array<string>")
    got = {x["row"]: set(x["chunks"]) for x in genes._coded(df, "chunks").collect()}
    assert [len(got[k]) for k in (1, 2, 4)] == [3, 2, 1] and got[2] < got[1] and not got[4] & got[1] and 3 not in got


def test_fingerprints_of_abstracts(spark):
    texts = ["one two three four five six seven eight nine ten", "something else altogether here", None]
    rows = [(f"p{i}", t) for i, t in enumerate([texts[0], texts[0], texts[1], texts[0] + " ", texts[2]])]
    df = spark.createDataFrame(rows, "id string, abstract_text string")
    assert {x["id"]: x["duplicate_of"] for x in dedup.match_fingerprints(df, df).collect()} == {"p0": "p1", "p1": "p0", "p3": "p0"}
    new = spark.createDataFrame([("a", texts[0]), ("b", "quite new words and nothing known")], "id string, abstract_text string")
    assert {x["id"]: x["duplicate_of"] for x in dedup.match_fingerprints(new, df).collect()} == {"a": "p0"}
    assert df.select(F.count("*")).first()[0] == 5


def test_topics_cut_texts_once(spark):
    own = spark.createDataFrame([(1, "b a", 1.0), (2, "b a c", 2.0), (3, "d", 3.0)], "id int, text string, score double")
    out = genes.topics(own.select("id", F.lit("s").alias("section"), F.split("text", " ").alias("terms"), F.array(F.concat(F.lit("G"), "id")).alias("genes"), "score"), 1)
    assert "split(" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert [tuple(r) for r in out.collect()] == [(0, "s/a/b", 2, 1.5, ["a", "b", "c"], ["G1", "G2"])]
