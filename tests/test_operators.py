"""Known values, odd rows and invariants of the operators."""

import math
import random
import re
import uuid

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evispark.functions import rules
from evispark.functions.similarity import jaro_winkler, simhash
from evispark.operators import checks, dedup, extract, graph, ops, retrieve, score, text
from evispark.operators.components import connected_components
from evispark.operators.ranks import row_numbers
from evispark.sources import files, tables, webpages
from evispark.streaming import rescore


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'double'}" for k, v in values.items()))
    return row.select(column.alias("x")).first()["x"]


def test_components(spark):
    r = random.Random(1)
    pairs = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5), (None, 3)]
    parent = {}

    def top(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a is not None:
            p, q = sorted((top(a), top(b)))
            parent[q] = p
    got = {x["node"]: x["component"] for x in connected_components(spark.createDataFrame(pairs, "src long, dst long")).collect()}
    assert got == {x: top(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_simhash_distances():
    near = simhash("KRAS mutations drive pancreatic cancer growth in many patients today and shape the response to therapy over time"), simhash("KRAS mutations drive pancreatic cancer growth in most patients today and shape the response to therapy over time")
    far = simhash("completely different text about economics of trade between nations"), simhash("galaxies rotate faster than visible matter predicts at large radii")
    assert bin((near[0] ^ near[1]) & (2**64 - 1)).count("1") <= 12
    assert bin((far[0] ^ far[1]) & (2**64 - 1)).count("1") > 10
    assert simhash("") == 0 and simhash("the and of") == 0


def test_simhash_pairs_match_brute_force(spark):
    r = random.Random(3)
    base = [r.getrandbits(64) for _ in range(40)]
    values = base + [b ^ sum(1 << r.randrange(64) for _ in range(r.randrange(9))) for b in base] + base[:3]
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    rows = spark.createDataFrame(list(enumerate(signed)), "id long, simhash long")
    first = {}
    for i, v in enumerate(values):
        first.setdefault(v, i)
    want = {(a, b): bin(x ^ y).count("1") for x, a in first.items() for y, b in first.items() if a < b and bin(x ^ y).count("1") <= 6}
    assert {(p["a"], p["b"]): p["distance"] for p in dedup.simhash_pairs(rows).collect()} == want
    assert dedup.membership(rows).where("id <> node").count() == len(values) - len(first)


def test_jaro_winkler():
    assert jaro_winkler("martha", "marhta") == pytest.approx(0.9611, abs=1e-4)
    assert jaro_winkler("dixon", "dicksonx") == pytest.approx(0.8133, abs=1e-4)
    assert jaro_winkler("", "a") == 0 and jaro_winkler("a", "a") == 1
    assert jaro_winkler("the role of kras in pancreatic cancer", "the roles of kras in pancreatic cancer") >= 0.92


@settings(max_examples=100, deadline=None)
@given(st.text("abc", max_size=12), st.text("abc", max_size=12))
def test_jaro_winkler_bounds(a, b):
    assert 0 <= jaro_winkler(a, b) <= 1.0000001
    assert jaro_winkler(a, b) == pytest.approx(jaro_winkler(b, a), abs=0.35)


def test_chunks(spark):
    words = lambda n: " ".join(f"w{i}" for i in range(n))
    docs = spark.createDataFrame([(0, ""), (1, None), (2, "short text"), (3, words(20)), (4, words(12)), (5, words(2000))], "id int, text string")

    def reference(t, size, overlap, least):
        w = (t or "").split()
        if len(w) <= size:
            return [t] if w else []
        step, out, start = max(1, size - int(size * overlap)), [], 0
        while start < len(w):
            end = min(start + size, len(w))
            if end - start < least and out:
                out[-1] += " " + " ".join(w[start:end])
                break
            out.append(" ".join(w[start:end]))
            start += step
            if start + least >= len(w) and end == len(w):
                break
        return out

    for size, overlap, least in ((10, 0.2, 5), (10, 0.5, 3), (7, 0.0, 1), (100, 0.1, 50)):
        got = {}
        for c in text.chunk_words(docs, "id", "text", size, overlap, least).orderBy("id", "chunk_index").collect():
            got.setdefault(c["id"], []).append(c["content"])
        want = {i: v for i, t in ((r["id"], r["text"]) for r in docs.collect()) if (v := reference(t, size, overlap, least))}
        assert got == want, (size, overlap, least)
    sections = spark.createDataFrame([("p", 0, "abstract", words(900)), ("p", 1, "results", words(2000)), ("p", 2, "other", " "), ("p", 3, "other", "tail")], "paper_id string, ord int, section_type string, text string")
    out = text.chunk_sections(sections, 100, 10).orderBy("chunk_index").collect()
    assert [c["chunk_index"] for c in out] == list(range(len(out))) and len(out[0]["content"].split()) == 900
    assert len(out) == 1 + 1 + -(-(2000 - 75) // 68) + 1


def test_normal_forms(spark):
    assert one(spark, text.canonical_doi(F.col("a")), a=" HTTPS://doi.org/10.1/AbC/ ") == "10.1/abc"
    assert one(spark, text.canonical_pmid(F.col("a")), a="PMID: 12-3x") == "123x"
    assert one(spark, text.title_identity(F.col("a")), a="The Role of KRAS in a Cancer!") == "role kras cancer"
    assert one(spark, text.identity_key(F.col("a"), F.lit(None), F.lit(None), F.lit(" ")), a=None) == "title:untitled"
    assert one(spark, extract.cancer_code(F.col("a")), a="Pancreatic cancer") == "PAAD"
    assert one(spark, extract.cancer_code(F.col("a")), a="lung adenocarcinoma") == "LUAD"
    assert one(spark, extract.cancer_code(F.col("a")), a="none") is None
    assert "drives" in one(spark, extract.matched_predicates(F.col("a")), a="KRAS drives pancreatic cancer progression.")
    assert one(spark, extract.protein_change(F.col("a")), a="p.Gly12Asp")["hgvs_p"] == "p.Gly12Asp"
    assert one(spark, extract.protein_change(F.col("a")), a="g12d")["position"] == 12
    assert one(spark, extract.protein_change(F.col("a")), a="nothing") is None
    assert one(spark, extract.entity_label(F.col("a")), a="B-Protein") == "gene"


def test_facts_from_text(spark):
    t = "KRAS activation of the MAPK signaling pathway is seen in pancreatic cancer. KRAS inhibitors such as sotorasib sensitizes to gefitinib."
    chunks = spark.createDataFrame([("c", t), ("d", "G12D only"), ("e", None)], "id string, content string")
    genes = spark.createDataFrame([("c", "kras"), ("d", "KRAS"), ("e", "KRAS")], "id string, gene string")
    got = {(x["id"], x["predicate"], x["object"]) for x in extract.build_facts(chunks, genes, chemicals=["sotorasib"]).collect()}
    assert any(p == "activates_pathway" for _, p, _ in got)
    assert any(p in ("targeted_by", "sensitized_by") for _, p, _ in got)
    assert any(o == "PAAD" for _, _, o in got)
    assert ("d", "has_mutation", "G12D") in got


def test_words_end_at_letters_beyond_ascii(spark):
    assert one(spark, extract.typed_mentions(F.col("a"), extract.CHEMICAL, [], 4), a="ê laaiviviré, écarboplatin") == ["LAAIVIVIR", "CARBOPLATIN"]
    assert one(spark, extract.mutation_mentions(F.col("a")), a="éG12Dé aG13D") == ["G12D"]
    assert one(spark, extract.matched_predicates(F.col("a")), a="éinhibitsé, xdrives") == ["inhibits"]


def test_facts_of_words_before_letters_beyond_ascii(spark):
    chunks = spark.createDataFrame([("c", "KRAS ê laaiviviré")], "id string, content string")
    genes = spark.createDataFrame([("c", "KRAS", 0.9)], "id string, gene string, confidence double")
    built = extract.build_facts(chunks, genes.select("id", "gene"))
    names = spark.createDataFrame([("gene", "KRAS"), ("chemical", "LAAIVIVIR")], "entity_type string, name string")
    entities = extract.resolve_entities(names, spark.createDataFrame([], "id string, external_id string"))
    got = extract.relation_facts(built, genes, entities).collect()
    assert [(x["predicate"], x["object_name"]) for x in got] == [("targeted_by", "LAAIVIVIR")]


def test_dictionary(spark):
    lexicon = spark.createDataFrame([("kras", "gene", "KRAS", 1.0, False), ("kras mutant", "gene", "KRAS", 0.9, False), ("met", "gene", "MET", 1.0, True), ("PAAD", "cancer_code", "PAAD", 1.0, False)], "term string, entity_type string, canonical string, confidence double, word_boundary boolean")
    chunks = spark.createDataFrame([("a", "KRAS mutant and KRASx metal met PAAD"), ("b", None)], "id string, content string")
    out = [(m["start"], m["end"], m["text"], m["confidence"]) for m in extract.find_mentions(chunks, lexicon).orderBy("start").collect()]
    assert out == [(0, 11, "KRAS mutant", 0.9), (16, 20, "KRAS", 1.0), (28, 31, "met", 0.85), (32, 36, "PAAD", 1.0)]


def test_confidence_rules(spark):
    rows = spark.createDataFrame([("experimental_in_vitro", 10, 1, 1.0, True, False, False), ("text_mined", 1, 1, 1.0, False, False, True), ("experimental_in_vivo", 2000, 3, 20.0, False, False, False)], "evidence_type string, sample_size int, replicated_count int, impact_factor double, is_preprint boolean, is_single_cell_line boolean, is_retracted boolean")
    assert [round(r["confidence"], 6) for r in graph.evidence_confidence(rows).collect()] == [0.595, 0.0, 1.0]
    facts = spark.createDataFrame([("s", "p", "o", 0.7), ("s", "p", "o", 0.7)], "subject_id string, predicate string, object_id string, confidence double")
    assert graph.noisy_or(facts).first()["confidence"] == pytest.approx(0.91)


def test_conflicts(spark):
    rows = [("a", "x", "inhibits", "y", 0.8), ("b", "x", "activates", "y", 0.7), ("c", "x", "targets", "y", 0.75), ("d", "z", "targets", "y", 1.5), ("e", "z", "targets", "y", 0.7)]
    facts = spark.createDataFrame([(i, s, p, o, c) for i, s, p, o, c in rows], "id string, subject_id string, predicate string, object_id string, confidence double")
    got = {(r["fact_a_id"], r["fact_b_id"]): (r["conflict_type"], round(r["net_confidence"], 6)) for r in graph.conflicts(facts).collect()}
    assert got == {("a", "b"): ("directional", 0.07), ("d", "e"): ("magnitude", 0.56)}


def test_edge_cap_is_greedy(spark):
    r = random.Random(5)
    edges = sorted({(f"n{r.randrange(12)}", f"m{r.randrange(12)}") for _ in range(90)})
    rows = [(a, b, "p", 1, 0.5, float(r.randrange(10))) for a, b in edges]
    kept = graph.cap_edges(spark.createDataFrame(rows, "source string, target string, predicate string, weight long, avg_confidence double, score double"), 3)
    used, want = {}, set()
    for a, b, *_ in sorted(rows, key=lambda x: (-x[5], x[0], x[1])):
        if used.get(a, 0) < 3 and used.get(b, 0) < 3:
            used[a], used[b] = used.get(a, 0) + 1, used.get(b, 0) + 1
            want.add((a, b))
    assert {(x["source"], x["target"]) for x in kept.collect()} == want


def test_walks(spark):
    e = spark.createDataFrame([("A", "b"), ("b", "c"), ("c", "d"), ("x", "y"), ("d", "A")], "source string, target string").withColumn("predicate", F.lit("p")).withColumn("weight", F.lit(1)).withColumn("score", F.lit(1.0))
    assert {(r["node"], r["hop"]) for r in graph.neighbourhood(e, spark.createDataFrame([("a",)], "s string"), 1).collect()} == {("A", 0), ("b", 1), ("d", 1)}
    assert graph.shortest_path(e, "A", "x").count() == 0
    assert {(r["source"], r["target"]) for r in graph.shortest_path(e, "b", "d", extra=0).collect()} in ({("A", "b"), ("d", "A")}, {("b", "c"), ("c", "d")})


def test_ranking(spark):
    df = spark.createDataFrame([("a", 10.0), ("b", 20.0), ("c", 30.0)], "g string, v double")
    assert [round(r["r"], 6) for r in score.rank_normalise(df, "v", "r").orderBy("g").collect()] == [1.0, round(2 / 3, 6), round(1 / 3, 6)]
    assert [one(spark, score.dependency_normalise(F.col("a")), a=x) for x in (-2.0, 0.0, -1.0)] == [1, 0, 0.5]
    assert sum(rules.COMPONENT_WEIGHTS) == pytest.approx(1) and sum(score.renormalise({"a": 2, "b": 6}).values()) == 1
    with pytest.raises(ValueError):
        score.renormalise({"a": -1, "b": 2})
    assert score.minmax_normalise(df.where("g = 'a'"), "v", "m").first()["m"] == 0.5
    lines = spark.createDataFrame([("G", "l1", -1.0), ("G", "l2", -0.5), ("G", "l3", -0.8)], "gene string, cell_line string, score double")
    codes = spark.createDataFrame([("l1", "C"), ("l2", "C"), ("l3", "C")], "cell_line string, cancer_code string")
    row = score.dependency_statistics(lines, codes).first()
    assert round(row["mean"], 4) == -0.7667 and row["median"] == -0.8


def test_places_in_an_order(spark):
    r = random.Random(4)
    own = [(i, "big" if i % 3 else f"g{i % 7}", r.choice([None, *range(9)])) for i in range(900)]
    df = spark.createDataFrame(own, "id long, kind string, v int").repartition(5).withColumn("rank", F.lit(-1))
    least = lambda t: (t[2] is not None, t[2] or 0, t[0])
    whole = {t[0]: n for n, t in enumerate(sorted(own, key=least), 1)}
    assert {t["id"]: t["rank"] for t in row_numbers(df, ["v", "id"]).collect()} == whole
    falling = sorted(own, key=lambda t: (t[2] is None, -(t[2] or 0), t[0]))
    assert {t["id"]: t["rank"] for t in row_numbers(df, [F.desc_nulls_last("v"), F.col("id")]).collect()} == {t[0]: n for n, t in enumerate(falling, 1)}
    grouped = {t["id"]: t["rank"] for t in row_numbers(df, ["v", "id"], ("kind",)).collect()}
    for kind in {t[1] for t in own}:
        assert [grouped[t[0]] for t in sorted((t for t in own if t[1] == kind), key=least)] == list(range(1, sum(t[1] == kind for t in own) + 1))
    assert row_numbers(df.limit(0), ["v", "id"]).count() == 0 and row_numbers(df, ["v"]).columns == ["id", "kind", "v", "rank"]


def test_citations(spark):
    assert one(spark, score.citation_count(F.col("a")), a='{"cited_by_count": 7}') == 7
    assert one(spark, score.citation_count(F.col("a")), a="not json") is None


def test_fusion_and_search(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2)], "id string, rank int")
    b = spark.createDataFrame([("y", 1), ("z", 2)], "id string, rank int")
    out = retrieve.rank_fusion(a, b).orderBy("rank").collect()
    assert out[0]["id"] == "y" and out[0]["source"] == "hybrid" and out[0]["score"] == 1.0
    assert {r["source"] for r in out[1:]} == {"vector", "lexical"}
    zero = spark.createDataFrame([("a", [0.0, 0.0]), ("b", [1.0, 1.0]), ("c", None)], "id string, embedding array<double>")
    q = spark.createDataFrame([("q", [1.0, 1.0])], "query_id string, vector array<double>")
    assert [r["id"] for r in retrieve.vector_search(zero, q).collect()] == ["b"]


def test_cancer_names_match_as_all_pairs_do(spark):
    r = random.Random(8)
    part = lambda n: "".join(r.choice("ab ") for _ in range(n))
    known = [(part(r.randrange(3, 10)), f"C{i}") for i in range(60)] + [("", "C98"), (None, "C99")]
    names = [part(r.randrange(0, 25)) for _ in range(200)] + [None, "", known[0][0].upper()]
    code = {}
    for k, c in known:
        if k is not None:
            key = k.strip(" ").lower()
            code[key] = min(code.get(key, c), c)

    def want(name):
        if name is None:
            return None
        low = name.strip(" ").lower()
        held = [(-len(k), c) for k, c in code.items() if len(k) > 5 and k in low]
        return code.get(low) or (min(held)[1] if held else None)

    df = spark.createDataFrame([(n,) for n in names], "name string")
    got = extract.normalise_cancers(df, spark.createDataFrame(known, "synonym string, code string"), "name").collect()
    assert len(got) == len(names) and all(t["code"] == want(t["name"]) for t in got) and any(t["code"] for t in got)


def test_queries_in_blocks_find_the_same(spark):
    r = random.Random(6)
    own = [(i, [r.gauss(0, 1) for _ in range(8)]) for i in range(120)]
    chunks = spark.createDataFrame([*own, (900, None)], "id long, embedding array<double>")
    queries = spark.createDataFrame(own[::4], "query_id long, vector array<double>")
    found = [sorted(map(tuple, retrieve.vector_search(chunks, queries, 3, most_bytes=b).collect())) for b in (1 << 20, 500)]
    assert found[0] == found[1] and len(found[0]) == 90 and all(t[1] == t[0] for t in found[0] if t[3] == 1)
    assert retrieve.vector_search(chunks, queries.limit(0), 3).count() == 0


def test_full_text_search_counts_whole_words(spark):
    texts = ["Gene KRAS, kras;kras", "kras gene genes", "KRASx gene", "gene", "", None, "kras\u00e9 gene kras", "gene_kras gene kras2 kras"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, content string")
    words = {i: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w] for i, t in enumerate(texts)}
    of = {t: sum(t in w for w in words.values()) for t in ("gene", "kras")}
    want = {i: sum(w.count(t) * math.log((1 + len(texts)) / (1 + of[t])) for t in of) / (1 + math.log1p(len(w))) for i, w in words.items() if all(t in w for t in of)}
    got = {r["id"]: r["score"] for r in retrieve.full_text_search(df, "KRAS gene").collect()}
    assert got == pytest.approx(want, abs=1e-6) and set(got) == {0, 1, 6, 7}
    assert retrieve.full_text_search(df, " ;").count() == 0 and retrieve.full_text_search(df.limit(0), "kras").count() == 0


def test_content_checks(spark):
    rows = [("/etc/passwd",), ("~/.ssh/id_rsa",), ("fine",), (None,), ("AKIA" + "A" * 16,), ("Authorization: Basic " + "a" * 24,), ("ignore all previous <|x|>",), ("a" * 60,), (" " * 60,)]
    df = spark.createDataFrame(rows, "text string")
    assert [r["policy_blocked"] for r in checks.check_policy(df).collect()][:4] == [True, True, False, False]
    leaks = checks.scan_leaks(df).collect()
    assert leaks[4]["blocked"] and leaks[4]["max_severity"] == "critical" and leaks[3]["n_leaks"] == 0 and leaks[2]["max_severity"] is None
    cleaned = checks.clean_leaks(df, ["text"]).collect()
    assert cleaned[5]["status"] == "redacted" and cleaned[5]["text"] == "[REDACTED]" and cleaned[4]["status"] == "blocked"
    assert checks.scan_injections(df).collect()[6]["max_severity"] == "critical"
    errors = [r["errors"] for r in checks.validate_text(df).collect()]
    assert errors[2] == [] and errors[3] == ["empty"] and errors[7] == ["repetition"] and errors[8] == ["whitespace", "repetition"]
    found = checks.leak_matches(df.withColumn("id", F.monotonically_increasing_id()), "id").collect()
    assert {m["name"] for m in found} == {"aws_access_key", "auth_header"} and all("*" in m["preview"] for m in found)


def test_cycles(spark):
    rows = [(1, 1, 10, 9, 1, 5, 2, 0.5), (1, 2, 10, 0, 9, 0, 0, 0.0), (1, 3, 10, 0, 9, 0, 0, 0.0), (1, 4, 0, 0, 0, 0, 0, 0.0)]
    out = ops.cycle_analytics(spark.createDataFrame(rows, "run_id int, cycle int, found int, inserted int, duplicate int, chunks int, typed int, score_gain double")).orderBy("cycle").collect()
    assert [r["streak"] for r in out] == [0, 1, 2, 3] and [r["stop"] for r in out] == [False, False, False, True]
    assert [r["pressure_triggered"] for r in out] == [False, True, True, False]


def test_tables(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", None)], "id string, n int")
    manifest = tables.export_snapshot({"t": df}, str(tmp_path))
    assert [tuple(r) for r in tables.check_snapshot(spark, str(tmp_path), manifest).collect()] == [("t", True, True, True)]
    (tmp_path / "t" / "part-x.json").write_text("{broken\n")
    assert [tuple(r)[1:] for r in tables.check_snapshot(spark, str(tmp_path), manifest).collect()] == [(False, False, False)]
    good, bad = tables.import_snapshot(spark, str(tmp_path / "t"), df.schema)
    assert good.count() == 2 and bad.count() == 1
    with pytest.raises(ValueError):
        tables.append(df.drop("id"), str(tmp_path / "x"), spark.createDataFrame([], "id string NOT NULL, n int").schema)
    tables.append(df, str(tmp_path / "x"), df.schema)
    assert tables.scan(spark, str(tmp_path / "x"), df.schema, limit=1, offset=1).first()["id"] == "b"


def test_files(spark, tmp_path):
    (tmp_path / "dep.csv").write_text("ModelID,KRAS (3845),TP53 (7157)\nL1,-1.5,NaN\nL2,x,0.25\n")
    assert {tuple(r) for r in files.read_dependency_matrix(spark, str(tmp_path / "dep.csv")).collect()} == {("L1", "KRAS", -1.5), ("L2", "TP53", 0.25)}
    (tmp_path / "freq.tsv").write_text("Gene\tCancer Type\tMutated Samples\tTotal Samples\nKRAS\tPAAD\t30\t100\nKRAS\tPAAD\t20\t50\n")
    by_cancer, by_gene = files.read_mutation_frequencies(spark, str(tmp_path / "freq.tsv"))
    assert by_cancer.first()["mutated"] == 50 and by_cancer.first()["profiled"] == 150 and by_gene.count() == 1
    api = spark.createDataFrame([("k", '{"data": [{"gene": "KRAS", "cancer": "PAAD", "frequency": "0.3", "profiled": "120"}, {"gene": "KRAS", "cancer": "PAAD", "frequency": "0.9", "profiled": "10"}]}'), ("n", "nonsense")], "key string, payload string")
    best = files.best_candidate(files.api_candidates(api), ["key"]).collect()
    assert [(r["key"], r["frequency"], r["profiled"]) for r in best] == [("k", 0.3, 120)]
    (tmp_path / "sym.tsv").write_text('symbol\tstatus\talias_symbol\tprev_symbol\nKRAS\tApproved\t"KRAS1|KRAS2"\tRASK2\nOLD\tWithdrawn\t\t\nB\tApproved\tKRAS\t\n')
    got = {r["symbol"]: (r["approved"], r["tier"]) for r in files.read_symbols(spark, str(tmp_path / "sym.tsv")).collect()}
    assert got["KRAS"] == ("KRAS", "preferred") and got["KRAS2"] == ("KRAS", "alias") and got["RASK2"] == ("KRAS", "previous") and "OLD" not in got
    tree = spark.createDataFrame([('{"T": {"name": "Tissue", "children": {"PAAD": {"code": "PAAD", "name": "Pancreatic", "parent": "T", "children": {}}}}}',)], "json string")
    assert {r["code"] for r in files.ontology_rows(tree).collect()} == {"T", "PAAD"}
    (tmp_path / "pdb").mkdir()
    (tmp_path / "pdb" / "a.pdb").write_text("HEADER\nATOM" + " " * 56 + " 80.00\nATOM" + " " * 56 + " 90.00\n")
    assert files.structure_confidence(spark, str(tmp_path / "pdb")).first()["plddt"] == 85.0
    (tmp_path / "pockets").mkdir()
    (tmp_path / "pockets" / "o.txt").write_text("Pocket Score : 0.61\nVolume Score : 1.2\nDruggability Score : 1.3\nScore : 9.0\n")
    assert files.pocket_scores(spark, str(tmp_path / "pockets")).first()["score"] == 1.0
    (tmp_path / "w.json").write_text('{"DOI": "10.1/x", "title": ["T"], "container-title": ["J"], "abstract": "<p>A</p>", "created": {"date-time": "2023-05-01T00:00:00Z"}}\n')
    row = files.read_works(spark, str(tmp_path / "w.json")).first()
    assert (row["doi"], row["title"], row["journal"], str(row["published_at"])[:10]) == ("10.1/x", "T", "J", "2023-05-01")
    (tmp_path / "p.json").write_text('{"doi": "10.2/y", "title": "KRAS in cells", "abstract": "", "date": "2023-12-01"}\n{"doi": "10.2/z", "title": "KRAS", "abstract": "", "date": "2010-01-01"}\n{"doi": "1", "title": "x", "abstract": "y", "date": "2023-12-01"}\n')
    assert [r["doi"] for r in files.read_preprints(spark, str(tmp_path / "p.json"), ["kras"], "2024-01-01").collect()] == ["10.2/y"]
    (tmp_path / "a.xml").write_text("<feed><entry><id>http://arxiv.org/abs/1</id><title> T </title><summary>S</summary><published>2024-01-02T00:00:00Z</published></entry></feed>")
    assert files.read_atom(spark, str(tmp_path / "a.xml")).first()["title"] == "T"
    (tmp_path / "m.xml").write_text("<S><PubmedArticle><MedlineCitation><PMID>9</PMID><Article><Journal><Title>J</Title></Journal><ArticleTitle>T</ArticleTitle><Abstract><AbstractText>A</AbstractText><AbstractText>B</AbstractText></Abstract></Article></MedlineCitation><PubmedData><ArticleIdList><ArticleId>9</ArticleId><ArticleId>10.5/q</ArticleId></ArticleIdList></PubmedData></PubmedArticle></S>")
    row = files.read_pubmed(spark, str(tmp_path / "m.xml")).first()
    assert (row["pmid"], row["title"], row["abstract_text"], row["doi"]) == ("9", "T", "A B", "10.5/q")
    xml = spark.createDataFrame([("p", "<article><front><abstract><p>Abs</p></abstract></front><body><sec><title>Methods</title><p>M one</p></sec><sec><title>Results</title><p>R</p></sec></body></article>")], "paper_id string, xml string")
    assert [(r["section_type"], r["text"].strip()) for r in files.article_sections(xml).orderBy("ord").collect()] == [("abstract", "Abs"), ("methods", "M one"), ("results", "R")]


def test_article_sections_of_any_depth_and_length(spark):
    long = "word " * 100_000
    nested = "<sec><title>A</title><p>a</p>" * 30 + "</sec>" * 30
    body = f"<p>no section</p>{nested}<sec><title>Results</title><p>{long}</p></sec><section>other</section>"
    xml = spark.createDataFrame([(1, f"<article><body>{body}</body></article>"), (2, "<article><body></body></article>"), (3, None)], "paper_id int, xml string")
    got = [(r["paper_id"], r["ord"], r["text"]) for r in files.article_sections(xml).orderBy("paper_id", "ord").collect()]
    assert got == [(1, 1, " ".join("a" * 30)), (1, 2, long)]


def test_ontology_of_any_depth(spark):
    tree = ""
    for i in reversed(range(20)):
        tree = f'{{"N{i}": {{"name": "n{i}", "parent": "N{i - 1}", "children": {tree or "{}"}}}}}'
    got = files.ontology_rows(spark.createDataFrame([(tree,), (None,), ("{}",)], "json string"))
    assert sorted((r["code"], r["name"]) for r in got.collect()) == sorted((f"N{i}", f"n{i}") for i in range(20))
    assert files.ontology_rows(spark.createDataFrame([], "json string")).count() == 0


def test_rescoring_shuffles_no_facts(spark):
    """Ids of changes go to the facts, also where the planner would shuffle both; what is dealt by key is sums of each gene."""
    facts = spark.range(3000).select(F.concat(F.lit("f"), "id").alias("id"), *(F.concat(F.lit("G"), F.col("id") % 40).alias(c) for c in ("subject_id", "subject_name")), F.lit("drives").alias("predicate"), *(F.concat(F.lit("G"), F.col("id") % 7).alias(c) for c in ("object_id", "object_name")), F.lit(0.5).alias("confidence"), F.col("id").alias("created_at"))
    changed = spark.createDataFrame([("G3",), ("G39",), ("G3",), (None,), ("other",)], "gene_id string")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = score.rescore(facts, changed)
        plan = got._jdf.queryExecution().executedPlan().toString()
        rows = {r["gene"]: r["total_evidence"] for r in got.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert rows == {"G3": 75 + 429, "G39": 75}
    assert plan.count("Exchange hashpartitioning") == 1


def test_candidates_move_facts_without_texts(spark):
    """Facts are dealt by id and by subject once each, without predicates and evidence; papers are counted once."""
    rows = [(f"f{i}", f"p{i % 5}" if i % 6 else None, f"G{i % 2}", f"G{i % 2}", ("has_mutation", "survival", "expression")[i % 3], "C1", f"C{i % 4}", 0.5 + i / 100, ("poor", "normal tissue", None)[i % 3], "text_mined", i % 3) for i in range(30)]
    facts = spark.createDataFrame(rows, "id string, paper_id string, subject_id string, subject_name string, predicate string, object_id string, object_name string, confidence double, evidence string, evidence_type string, sample_size int")
    conflict = spark.createDataFrame([("f0", "f1", 0.2), ("f2", "f3", 0.5), ("f2", "f4", 0.9)], "fact_a_id string, fact_b_id string, net_confidence double")
    out = score.candidates(facts, conflict)
    got = {r["gene"]: r for r in out.collect()}
    for g in ("G0", "G1"):
        own = [r for r in rows if r[2] == g and r[0] not in ("f0", "f1")]
        r = got[g]
        assert (r["fact_count"], r["n_papers"], r["sample_obs"]) == (len(own), len({x[1] for x in own} - {None}), sum(x[10] > 0 for x in own))
        assert r["confidence_sum"] == pytest.approx(sum(x[7] * (0.7 if x[0] in ("f2", "f3") else 1) for x in own))
        assert (r["mutation_w"] > 0, r["survival_w"] > 0, r["survival_positive_w"], r["expression_normal_w"]) == (True, True, 0.0, 0.0)
        times = {c: sum(x[6] == c for x in own) for c in {x[6] for x in own}}
        assert r["cancer_code"] == min(times, key=lambda c: (-times[c], c)) and r["disputed"]
    # Only sums are read again: the table that the facts became has no text of theirs.
    assert "predicate" not in out._jdf.queryExecution().executedPlan().toString() and "paper_id" not in out._jdf.queryExecution().executedPlan().toString()


def test_sections_need_one_lower_case_text(spark):
    df = spark.createDataFrame([(1, "x ABSTRACT a\nMethods b\nRESULTS c"), (2, None), (3, "none")], "id int, text string")
    out = text.detect_sections(df)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("lower(") == 1
    assert sorted((r["heading"], r["start"], r["text"]) for r in out.collect()) == [("Abstract", 3, "ABSTRACT a"), ("Methods", 14, "Methods b"), ("Results", 24, "RESULTS c")]


def test_stream(spark, tmp_path):
    facts = spark.createDataFrame([("f1", "KRAS", "KRAS", "drives", "PAAD", "PAAD", 0.9, "2024-01-01"), ("f2", "TP53", "TP53", "drives", "PAAD", "PAAD", 0.9, "2024-01-01")], "id string, subject_id string, subject_name string, predicate string, object_id string, object_name string, confidence double, created_at string")
    facts.write.parquet(str(tmp_path / "facts"))
    events = spark.createDataFrame([("f1", "KRAS", 0.5, 0.56, None), ("f2", "TP53", 0.5, 0.53, None)], rescore.EVENT_SCHEMA)
    assert [r["gene_id"] for r in rescore.changed_subjects(events).collect()] == ["KRAS"]
    events.write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(rescore.EVENT_SCHEMA).parquet(str(tmp_path / "events"))
    rescore.start(stream, str(tmp_path / "facts"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert [r["gene"] for r in out.collect()] == ["KRAS"]
    calls = spark.createDataFrame([("m", "2024-01-01 00:00:00", 1.0)], "model string, created_at string, cost double").withColumn("created_at", F.to_timestamp("created_at"))
    calls.write.parquet(str(tmp_path / "calls"))
    q = rescore.spend_windows(spark.readStream.schema(calls.schema).parquet(str(tmp_path / "calls"))).writeStream.format("memory").queryName("spend").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.sql("SELECT count(*) FROM spend").first()[0] == 12


def test_pages(spark):
    rows = [(1, "u", "<title>T &amp; t</title><nav>menu</nav><h2>Head</h2><p>Some words of an article, long enough to count.<ul><li>item</ul><script>x</script>"), (2, None, None), (3, "u", "<p>short")]
    out = webpages.pages_to_markdown(spark.createDataFrame(rows, "page_id long, url string, html string")).orderBy("page_id").collect()
    assert [r["status"] for r in out] == ["ok", "empty", "not_article"]
    assert out[0]["title"] == "T & t" and out[0]["markdown"] == "## Head\n\nSome words of an article, long enough to count.\n\n- item"


def test_titles_match_as_all_pairs_do(spark):
    import random

    from evispark.operators import dedup as D
    from evispark.operators import text as T

    r = random.Random(7)
    words = [w + w[::-1] for w in ("alpha", "beta", "gamma", "delta", "kras", "tumor", "cell", "in")]
    titles = [" ".join(r.choice(words) for _ in range(r.randrange(1, 16))) for _ in range(60)]
    for t in list(titles):
        c = list(t)
        for _ in range(r.randrange(1, 3)):
            k = r.randrange(len(c))
            c[k] = r.choice("abcxyz")
        titles += ["".join(c), t + " and more of it all" if len(t) > 42 else t, t[1:] + t[:1], t]
    papers = spark.createDataFrame([(f"{i:04d}", t, ["Ann Lee" if i % 2 else "Bob Ray"]) for i, t in enumerate(titles)], "id string, title string, authors array<string>").repartition(4)
    key = {x["id"]: x["t"] for x in papers.select("id", T.title_identity(F.col("title")).alias("t")).collect()}

    def score(a, b):
        return 1.0 if a == b or (min(len(a), len(b)) >= 42 and (a.startswith(b) or b.startswith(a))) else round(jaro_winkler(a, b), 9)

    want = {}
    for i, a in key.items():
        best = max(((score(a, b), j) for j, b in key.items() if i != j and a and b), default=(0, ""))
        if best[0] >= 0.992:
            want[i] = best[1]
    assert {x["id"]: x["duplicate_of"] for x in D.match_titles(papers, papers).collect()} == want and len(want) > 100
    rows = {x["id"]: (x["title"].lower(), x["authors"][0]) for x in papers.collect()}
    fuzzy = {}
    for i, (a, who) in rows.items():
        best = max(((round(jaro_winkler(a, b), 9), j) for j, (b, other) in rows.items() if i != j and who == other), default=(0, ""))
        if best[0] >= 0.92:
            fuzzy[i] = (best[1], best[0])
    assert {x["id"]: (x["duplicate_of"], x["similarity"]) for x in D.match_fuzzy(papers, papers).collect()} == fuzzy


def test_titles_are_scored_many_at_a_time(monkeypatch):
    from evispark.functions import similarity

    r = random.Random(2)
    left, right = (["".join(r.choice("abcdefé ") for _ in range(r.choice([0, 1, 3, 5, 12, 12, 12, 20]))) for _ in range(120)] for _ in range(2))
    one_by_one = jaro_winkler
    for least in (0.5, 0.8, 0.92, 0.99):
        calls = []
        monkeypatch.setattr(similarity, "jaro_winkler", lambda a, b: calls.append(1) or one_by_one(a, b))
        got = similarity.similar_pairs(left, right, least)
        want = [(i, j, s) for i, a in enumerate(left) for j, b in enumerate(right) if a != b and round(s := one_by_one(a, b), 9) >= least]
        assert sorted(got) == want and len(calls) < 400


def test_upserts_send_on_what_is_not_found(spark, monkeypatch):
    from evispark.operators import dedup as D

    rows = [(f"p{i}", f"10.1/{i % 5}" if i < 10 else None, None, f"title {i % 14 + 10} of its own {i % 14 + 10} again {i % 14 + 10} and {i % 14 + 10}", f"words of text {i % 16} " * 9, ["Ann Lee"]) for i in range(20)]
    df = spark.createDataFrame(rows, "id string, doi string, pmid string, title string, abstract_text string, authors array<string>")
    asked, made = {}, []
    for name in ("match_titles", "match_fuzzy"):
        one = getattr(D, name)
        monkeypatch.setattr(D, name, lambda new, old, one=one, name=name: asked.update({name: {x["id"] for x in new.collect()}}) or one(new, old))
    kept = D.materialize
    monkeypatch.setattr(D, "materialize", lambda df, name, **o: made.append(name) or kept(df, name, **o))
    got = {x["id"]: (x["duplicate_of"], x["method"]) for x in D.upsert_papers(df, df)[0].collect()}
    assert [got[f"p{i}"] for i in (0, 1, 5)] == [("p5", "doi"), ("p6", "doi"), ("p0", "doi")]
    assert asked["match_titles"] == {f"p{i}" for i in range(10, 20)} and asked["match_fuzzy"] == {k for k in asked["match_titles"] if got[k][1] in (None, "fuzzy_title")}
    assert made.count("fingerprints") == 1 and got["p14"] == ("p0", "title")


def test_titles_with_one_beginning_meet_seldom(spark, monkeypatch):
    from evispark.operators import dedup as D

    r = random.Random(5)
    licence = "this work is under a licence that many begin with, "
    titles = {licence + "".join(r.choice("abcdefghij klmnop") for _ in range(40)) for _ in range(200)}
    titles |= {t[:k] + s + t[k + 1 :] for t in sorted(titles)[:20] for k in (60, 80) for s in "\U0001f600z"}
    df = spark.createDataFrame([(t,) for t in sorted(titles)], "title string")
    met, one = [], D.materialize
    monkeypatch.setattr(D, "materialize", lambda df, name, **o: (lambda out: (met.append(out.count()) if name == "met" else None, out)[1])(one(df, name, **o)))
    want = {(a, b): round(s, 9) for a in titles for b in titles if a != b and round(s := jaro_winkler(a, b), 9) >= 0.992}
    assert {(x[0], x[1]): x[2] for x in D.alike_titles(df, df, 0.992).collect()} == want and len(want) > 150
    # Of 39,000 pairs either way.
    assert len(want) / 2 <= met[0] < 1000
    some, rest = df.where("substring(title, 52, 1) < 'h'"), df.where("substring(title, 52, 1) >= 'c'")
    left, right = ({x[0] for x in part.collect()} for part in (some, rest))
    assert {(x[0], x[1]) for x in D.alike_titles(some, rest, 0.992).collect()} == {k for k in want if k[0] in left and k[1] in right}


def test_a_pair_of_titles_is_compared_once(spark, monkeypatch, tmp_path):
    from evispark.operators import dedup as D

    r = random.Random(6)
    titles = ["".join(r.choice("abcdef ") for _ in range(24)) for _ in range(60)]
    titles = [*titles, *(t[:k] + "z" + t[k + 1 :] for t in titles for k in (8, 20))]
    rows = [(f"{i:03d}", t, ["Ann Lee" if i % 3 else "Bob Ray"]) for i, t in enumerate(titles)]
    monkeypatch.setattr(D, "TITLES", 11)
    compared, one = str(tmp_path), D.similar_pairs

    def counted(left, right, least):
        with open(f"{compared}/{uuid.uuid4().hex}", "w") as f:
            f.write(str(len(left) * len(right)))
        return one(left, right, least)

    monkeypatch.setattr(D, "similar_pairs", counted)
    for new, old in ((rows, rows), (rows[:100], rows[70:]), (rows[:20], rows[20:])):
        for f in tmp_path.iterdir():
            f.write_text("0")
        got = {x["id"]: (x["duplicate_of"], x["similarity"]) for x in D.match_fuzzy(*(spark.createDataFrame(x, "id string, title string, authors array<string>") for x in (new, old))).collect()}
        want = {i: max((round(jaro_winkler(a, b), 9), j) for j, b, other in old if i != j and who == other) for i, a, who in new}
        assert got == {i: (j, s) for i, (s, j) in want.items() if s >= 0.92} and got
        sizes = [[sum(who == x[2] for x in side) for who in (["Ann Lee"], ["Bob Ray"])] for side in (new, old)]
        assert 0 < sum(int(f.read_text()) for f in tmp_path.iterdir()) <= sum(n * m for n, m in zip(*sizes)) * (0.65 if new == old else 1)


def test_titles_of_one_language_meet_seldom(spark):
    from evispark.operators import dedup as D

    r = random.Random(3)
    titles = {" ".join("".join(r.choice(("th", "er", "on", "an", "re", "ed")) for _ in range(3)) for _ in range(11)) for _ in range(300)}
    titles |= {t[:k] + t[k + 1] + t[k] + t[k + 2 :] for t in sorted(titles)[:50] for k in (20, 70)}
    df = spark.createDataFrame([(t,) for t in sorted(titles)], "title string")
    want = {(a, b) for a in titles for b in titles if a != b and jaro_winkler(a, b) >= 0.992}
    met = {(x[0], x[1]) for x in D.title_candidates(df, df, 0.992).collect()}
    assert want <= met and len(want) >= 190 and len(met) < 1000


def test_fingerprint_pairs_match_all_pairs(spark):
    import random

    from evispark.operators import dedup as D

    r = random.Random(8)
    prints = [r.getrandbits(64) for _ in range(60)]
    for p in list(prints):
        for n in (0, 3, 6, 7):
            prints.append(p ^ sum(1 << b for b in r.sample(range(64), n)))
    rows = [(i, p - (1 << 64) if p >> 63 else p) for i, p in enumerate(prints)]
    found = {(x["a"], x["b"]): x["distance"] for x in D.simhash_pairs(spark.createDataFrame(rows, "id long, simhash long")).collect()}
    least = {}
    for i, p in enumerate(prints):
        least.setdefault(p, i)
    nodes = sorted((i, p) for p, i in least.items())
    assert found == {(i, j): (p ^ q).bit_count() for i, p in nodes for j, q in nodes if i < j and (p ^ q).bit_count() <= 6}


def test_long_paths_in_any_case(spark):
    from evispark.operators import graph as G

    edges = [(f"N{k}", f"n{k + 1}" if k == 7 else f"N{k + 1}") for k in range(20)] + [("N3", "side"), ("x", "y")]
    e = spark.createDataFrame([(a, b, "p", 1, 0.5) for a, b in edges], "source string, target string, predicate string, weight int, score double")
    assert {(x["source"], x["target"]) for x in G.shortest_path(e, "n0", "N7", extra=0).collect()} == set(edges[:7])
    assert G.shortest_path(e, "n0", "y", extra=0).count() == 0 and G.shortest_path(e, "nowhere", "y").count() == 0
    long = spark.createDataFrame([(f"M{k}", f"M{k + 1}", "p", 1, 0.5) for k in range(20)], e.schema)
    assert G.shortest_path(long, "m0", "m20", extra=0).count() == 20
    assert G.shortest_path(long, "m0", "M0", extra=0).count() == 0


def test_mentions_match_a_plain_walk(spark):
    import random

    from evispark.operators import extract as N

    r = random.Random(9)
    terms = ["ab", "abc", "b", "cab ba", "abca", "ÉT", "a-b", "bca"]
    rows = [(t, "gene", t.upper(), 0.95, bool(i % 2)) for i, t in enumerate(terms)]
    texts = ["".join(r.choice("aAbBc -é") + r.choice(["", "", "t"]) for _ in range(r.randrange(40))) for _ in range(200)] + [None, "", "İab"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, content string")
    got = sorted((x["id"], x["start"], x["end"], x["canonical"]) for x in N.find_mentions(docs, spark.createDataFrame(rows, "term string, entity_type string, canonical string, confidence double, word_boundary boolean"), least=0.0).collect())
    want = []
    for i, t in enumerate(texts):
        low, at = "".join(c.lower() if len(c.lower()) == 1 else c for c in t or ""), 0
        while at < len(low):
            fits = [(len(x), x, b) for x, _, _, _, b in rows if low.startswith(x.lower(), at)]
            fits = [f for f in fits if not (f[0] < 4 or f[2]) or ((at == 0 or not low[at - 1].isalnum()) and (at + f[0] == len(low) or not low[at + f[0]].isalnum()))]
            if fits:
                n, x, _ = max(fits)
                want.append((i, at, at + n, x.upper()))
            at += max((f[0] for f in fits), default=1)
    assert got == sorted(want)


def test_stitched_texts_move_their_own_chunks_only(spark):
    rows = [("a", 2, "a2"), ("a", 1, "a1"), ("a", 3, "a3"), ("b", 1, "b1"), ("c", 5, None), ("c", 6, "c6"), (None, 1, "n1"), (None, None, "n0"), ("d", 1, "d"), ("d", 1, "d")]
    chunks = spark.createDataFrame(rows, "paper_id string, chunk_index int, content string")
    facts = spark.createDataFrame([("b",)], "paper_id string")
    out = extract.stitched_texts(chunks, facts, 2)
    assert {tuple(x) for x in out.collect()} == {("a", "a1\na2"), (None, "n0\nn1"), ("d", "d\nd"), *((p, t) for p, t in out.where("paper_id = 'c'").collect())}
    # Texts are cut down to the chunks wanted before they are ordered by paper.
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan[plan.rindex("Window [") :]


def test_embedders_get_few_texts_at_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def embed(texts):
        seen.add(1)
        if len(texts) > retrieve.EMBEDDED:
            raise ValueError("too many")
        return [[float(len(t)), 1.0] for t in texts]

    df = spark.range(1000).coalesce(1).select(F.col("id").cast("string").alias("id"), F.lit("p").alias("paper_id"), F.lit(0).alias("chunk_index"), F.when(F.col("id") > 0, "x").alias("content"), F.lit(None).cast("array<float>").alias("embedding"))
    found = {x["id"]: x["embedding"] for x in retrieve.backfill_embeddings(df, embed).collect()}
    assert len(found) == 1000 and found["0"] == [0.0, 1.0] and all(v is not None for v in found.values())
