"""Running sums over an order, for keys of any size.

A window over a hot key would put all its rows into one task.  Here rows are range-partitioned
by (keys, order); each partition sums its own part of a key, the parts' totals (one row per
key and partition) are summed in order, and both are added up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.runtime import stage


def running_sum_before(df: DataFrame, keys: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the key's rows strictly before this one.

    ``order`` must be unique within a key.
    """
    cut = stage(df.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()), "ordered")
    local = Window.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    parts = cut.groupBy(*keys, "_part").agg(F.sum(value).alias("_total"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(*keys, "_part", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_offset"))
    same = None
    a, b = cut.alias("a"), offsets.alias("b")
    for k in [*keys, "_part"]:
        e = F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
        same = e if same is None else same & e
    joined = a.join(b, same).select("a.*", "b._offset")
    return joined.withColumn(out, F.col("_offset") + F.coalesce(F.sum(value).over(local), F.lit(0))).drop("_part", "_offset")


def value_before(df: DataFrame, keys: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """Adds ``out``: the ``value`` of the key's row before this one, null for the first.

    As above: the last value of each part of a key is carried to the first row of the next.
    """
    cut = stage(df.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()), "ordered")
    local = Window.partitionBy(*keys, "_part").orderBy(*order)
    parts = cut.groupBy(*keys, "_part").agg(F.max_by(F.struct(F.col(value).alias("v")), F.struct(*order)).alias("_last"))
    carried = parts.select(*keys, "_part", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_part")).alias("_carry"))
    a, b = cut.alias("a"), carried.alias("b")
    same = None
    for k in [*keys, "_part"]:
        e = F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
        same = e if same is None else same & e
    first = F.row_number().over(local) == 1
    joined = a.join(b, same).select("a.*", "b._carry")
    return joined.withColumn(out, F.when(first, F.col("_carry.v")).otherwise(F.lag(value).over(local))).drop("_part", "_carry")
