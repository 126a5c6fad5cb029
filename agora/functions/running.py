"""Running totals over a whole table without one task.

``Window.orderBy`` without partitions sorts everything in one task. Here rows
of one value are added up first (so a value that a third of the rows share is
one row), the distinct values are range-partitioned, each partition sums its
own, and the sums of the partitions before it are added on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agora.session import written


def running_total(df: DataFrame, value: str, descending: bool = True, name: str = "running", total_name: str = "total") -> DataFrame:
    """``df`` with the sum of ``value`` over all rows whose value is not
    below (ascending: not above) the row's own: tied rows share one total, as
    under a RANGE frame; and the sum over all rows as ``total_name``. NULL
    values add nothing and come last; their running total is that of all rows
    (NULL if there is no other value)."""
    order = F.desc_nulls_last(value) if descending else F.asc_nulls_last(value)
    sums = df.groupBy(value).agg(F.sum(value).alias("_sum"))
    # Written with its partition, so that both passes see the same cuts.
    parts = written(sums.repartitionByRange(order).select(value, "_sum", F.spark_partition_id().alias("_part")), "ranges")
    # One row per partition.
    before, total = {}, None
    for r in sorted(parts.groupBy("_part").agg(F.sum("_sum").alias("s")).collect(), key=lambda r: r["_part"]):
        before[r["_part"]] = total
        if r.s is not None:
            total = r.s if total is None else total + r.s
    kind = parts.schema["_sum"].dataType
    offsets = df.sparkSession.createDataFrame(sorted(before.items()), f"_part int, _before {kind.simpleString()}")
    inside = Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run: Column = F.sum("_sum").over(inside)
    totals = parts.join(offsets, "_part").select(
        F.col(value).alias("_value"),
        F.when(run.isNull(), F.col("_before")).otherwise(run + F.coalesce("_before", F.lit(0).cast(kind))).alias(name),
    )
    joined = df.join(totals, F.col(value).eqNullSafe(F.col("_value"))).drop("_value")
    return joined.withColumn(total_name, F.lit(total).cast(kind))
