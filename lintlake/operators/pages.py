"""Sorted lists as pages of bounded size, for groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lintlake.plans.lineage import written

#: Values of a page.
PAGE_VALUES = 1000


def in_pages(rows: DataFrame, keys: list[str], value: str, page_values: int = PAGE_VALUES) -> DataFrame:
    """``keys, page, values, n_before``: the values of each group in ascending order, cut into pages numbered from 0.

    Rows are dealt out by ranges of group and value and written; a task numbers what falls in its range, and the counts
    of the ranges before give the place in the group. So neither a task nor a row holds a whole group. Null values are
    left out, repeated ones stay, null keys are keys like others, and a group without values has no page.
    """
    sort = [*keys, value]
    # written first, as dealing by ranges reads its input twice
    rows = written(rows.where(F.col(value).isNotNull()).select(*sort), "page-values")
    dealt = rows.repartitionByRange(*sort).withColumn("__range", F.spark_partition_id())
    dealt = written(dealt, "pages")
    before = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy("__range", *keys).agg(F.count("*").alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).alias("c")
    placed = dealt.withColumn("__at", F.row_number().over(Window.partitionBy("__range", *keys).orderBy(value))).alias("d")
    same = F.col("d.__range") == F.col("c.__range")
    for k in keys:
        same &= F.col(f"d.{k}").eqNullSafe(F.col(f"c.{k}"))
    place = F.col("c.__before") + F.col("d.__at") - 1
    paged = placed.join(counts, same).select(*[F.col(f"d.{c}").alias(c) for c in sort], F.floor(place / page_values).cast("long").alias("page"))
    out = paged.groupBy(*keys, "page").agg(F.array_sort(F.collect_list(value)).alias("values"))
    return out.withColumn("n_before", F.col("page") * page_values)
