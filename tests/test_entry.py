"""The driver's contract: entry() runs, every SQL has a query, and the library never imports the training-data operators."""

import re
from pathlib import Path

import __spark_entry__ as entry


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns[:2] == ["rank", "gene"] and df.count() == 100


def test_names():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) >= 160
    if entry.HAS_LLM:
        assert {f"op{n}" for n in range(1, 14)} == {k.split("_")[0] for k in queries if re.match(r"op\d", k)}


def test_nothing_imports_the_training_data_operators():
    root = Path(entry.__file__).parent / "evispark"
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert "evispark.llm" not in path.read_text(), path
