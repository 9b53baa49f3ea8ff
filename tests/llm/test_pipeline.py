"""The pipeline's stages on a small input, each against what its operator says."""

import corpus_pipeline
import pytest

from evispark.llm import decontam, jaccard, mixing, pii


@pytest.fixture(scope="module")
def steps(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        from evispark.shared import materialize

        out.append(materialize(stage(spark, out[-1], sf), name))
    return out


def test_columns(steps):
    for df in steps[1:-1]:
        assert df.columns == steps[0].columns


def test_each_stage(spark, steps):
    docs, language, near, clean, private, mixed = steps
    assert 0.95 * docs.count() <= language.count() <= docs.count()
    classes = {r["doc_id"]: r["component_id"] for r in jaccard.link_classes(language, size=5, percent=80).collect()}
    assert {r["doc_id"] for r in near.collect()} == set(classes.values())
    bad = {r["doc_id"] for r in decontam.digest_columns(near, spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")).collect() if r["contaminated"]}
    assert {r["doc_id"] for r in clean.collect()} == {r["doc_id"] for r in near.collect()} - bad
    assert {r["doc_id"] for r in private.collect()} == {r["doc_id"] for r in clean.collect()}
    assert not any(s for r in private.collect() for s in pii.find_spans(r["text"] or ""))
    assert mixed.count() > 0 and mixed.where("taken > 3 * size").count() == 0
    texts = {r["doc_id"]: r["text"] for r in private.collect()}
    taken = {r["doc_id"]: r["taken"] for r in mixing.digest_columns(private).collect() if r["taken"]}
    got = mixed.collect()
    assert {r["doc_id"]: r["taken"] for r in got} == taken and len(got) == len(taken)
    assert all(texts[r["doc_id"]] == r["text"] for r in got)


def test_repeated_and_null_ids(spark):
    docs = spark.createDataFrame([(1, "a b c d e", "en", "s", 9), (1, "z y x", "en", "s", 5), (2, "A b c d e", "en", "s", 9), (None, "a b c d e", "en", "s", 9), (None, "q r s t u", "en", "s", 9), (3, None, None, None, None)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in kept.collect()) == [(0, "q r s t u"), (1, "a b c d e"), (1, "z y x"), (3, "")]


def test_stages_on_odd_tables(spark, table):
    """Nulls, empty and very long texts, repeated rows, empty tables, columns named as those that stages use."""
    from pyspark.sql import functions as F

    long = " ".join(f"word{k} of the long text" for k in range(30000))
    odd = table([None, "", "the same words of the text", "the same words of the text", long, "!!", "mail a@b.co now"], ids=[1, 2, 3, 3, 4, None, 6], sources=[None, "s", None, None, "t", "t", "s"])
    extra = odd.select("*", *(F.lit(7).alias(c) for c in ("_first", "given", "row_number", "component_id", "_key", "hash", "taken", "size", "_id", "blob", "label")))
    sf = "/root/testdata/sf0.001"
    want = {"language": [3, 3, 4, 6], "near_duplicates": [0, 1, 2, 3, 4, 6], "decontamination": [0, 1, 2, 3, 3, 4, 6], "personal_data": [0, 1, 2, 3, 3, 4, 6], "mixture": [0, 3, 3, 4, 6]}
    for name, stage in corpus_pipeline.STAGES:
        for docs in (odd, extra):
            out = stage(spark, docs, sf)
            assert set(docs.columns) <= set(out.columns) if name == "mixture" else out.columns == docs.columns
            assert len(set(out.columns)) == len(out.columns)
            assert sorted(r["doc_id"] or 0 for r in out.collect()) == want[name], name
        assert stage(spark, odd.limit(0), sf).count() == 0


def test_near_copies_of_five_words(spark):
    # A replaced block of 6 in 100 words leaves 81 % of five-word shingles and 83 % of four-word ones; one of 7 leaves 79 %.
    texts = []
    for k, block in enumerate((6, 7)):
        base = [f"w{k}x{i}" for i in range(100)]
        texts += [base, base[:40] + [f"n{k}x{i}" for i in range(block)] + base[40 + block :]]
    docs = spark.createDataFrame([(i, " ".join(t), "en", "s", 9) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == [0, 2, 3]
    assert sorted({r["component_id"] for r in jaccard.link_classes(docs).collect()}) == [0, 1, 2, 3]
