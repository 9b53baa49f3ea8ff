import pytest
from pyspark.sql import types as T

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, found string, id string, row int"


@pytest.fixture()
def table(spark):
    """documents with extra columns whose names operators use themselves."""

    def make(texts, langs=None, sources=None, ids=None):
        ids = ids if ids is not None else range(len(texts))
        rows = [(i, t, (langs or ["en"] * len(texts))[k], (sources or ["s"] * len(texts))[k], len(t or ""), "x", "y", 1) for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
        return spark.createDataFrame(rows, T._parse_datatype_string(DOCS)).repartition(3)

    return make
