"""Helpers that pick rows and cut batches."""

from hypothesis import given
from hypothesis import strategies as st

from evispark.llm import texts


@given(st.lists(st.integers(0, 50), max_size=30), st.integers(1, 60))
def test_groups_cover_all_items_once(sizes, limit):
    ends = texts.group_ends(sizes, limit)
    assert ends[-1] == len(sizes) and ends == sorted(set(ends))
    start = 0
    for end in ends:
        assert end - start <= 1 or sum(sizes[start:end]) <= limit or sum(sizes[start : end - 1]) == 0
        start = end


def test_rows_by_ids(spark, table, monkeypatch):
    docs = table(["a", "b", "c", None], ids=[1, None, 3, 4])
    ids = spark.createDataFrame([(3,), (4,), (9,)], "x long")
    for most in (texts.IDS_MAX, 0):
        monkeypatch.setattr(texts, "IDS_MAX", most)
        assert sorted(r["doc_id"] for r in texts.with_ids(docs, ids, "doc_id").collect()) == [3, 4]
    monkeypatch.undo()
    rest = texts.with_ids(docs, ids, "doc_id", wanted=False)
    assert rest.columns == docs.columns
    assert sorted(r["doc_id"] or 0 for r in rest.collect()) == [0, 1]
    assert texts.with_ids(docs, ids.limit(0), "doc_id").count() == 0
