"""Places in the order of a whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evispark.shared import materialize


def row_numbers(rows: DataFrame, order: list[str | Column], by: tuple[str, ...] = (), name: str = "rank") -> DataFrame:
    """rows with each one's place, from 1, in the order given, or in that of its group of by (columns without nulls).

    No task sorts all rows, nor all of a group: they are cut into ranges of the order, numbered inside
    each, and a range adds the sizes of those before it. The ranges are a table, as a second reading
    could cut them elsewhere. Rows that the order leaves equal are numbered in any order.
    """
    kept = [c for c in rows.columns if c != name]
    dealt = materialize(rows.repartitionByRange(*by, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    inside = dealt.withColumn("_inside", F.row_number().over(Window.partitionBy(*by, "_range").orderBy(*order)).cast("long"))
    upto = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)
    sizes = dealt.groupBy(*by, "_range").agg(F.count("*").alias("_size"))
    earlier = sizes.select(*by, "_range", (F.sum("_size").over(upto) - F.col("_size")).alias("_earlier"))
    return inside.join(earlier, [*by, "_range"]).select(*kept, (F.col("_inside") + F.col("_earlier")).alias(name))
