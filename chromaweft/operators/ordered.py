"""Numbers, running sums and running minima in one order over a whole table, without a task that holds it.

Rows are dealt to tasks by ranges of the order and sorted there; what a task has to know of the others is one number
per task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chromaweft.plans.durable import durable

ROW = (1 << 33) - 1


def in_ranges(df: DataFrame, *order: str) -> DataFrame:
    """Adds __range (smaller ranges come first) and __row (place within it, from 0)."""
    spread = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return durable(spread.withColumn("__range", F.spark_partition_id()).withColumn("__row", F.monotonically_increasing_id().bitwiseAND(F.lit(ROW))))


def _carried(ranged: DataFrame, value, how: str) -> DataFrame:
    """__r, __c: of each range the sum over those before it, or the least of those behind it. A row per range: a few thousand at most."""
    each = ranged.groupBy(F.col("__range").alias("__r")).agg(value.alias("__v"))
    if how == "sum":
        carried = F.coalesce(F.sum("__v").over(Window.orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    else:
        carried = F.min("__v").over(Window.orderBy("__r").rowsBetween(1, Window.unboundedFollowing))
    return F.broadcast(each.select("__r", carried.alias("__c")))


def numbered(df: DataFrame, *order: str, out: str) -> DataFrame:
    """df with its rows numbered from 1 in the order, which must tell all rows apart."""
    ranged = in_ranges(df, *order)
    shift = _carried(ranged, F.count(F.lit(1)), "sum")
    return ranged.join(shift, F.col("__range") == F.col("__r")).withColumn(out, F.col("__row") + 1 + F.col("__c")).select(*df.columns, out)


def running_sum(ranged: DataFrame, value: str, *order: str, out: str) -> DataFrame:
    """ranged (of in_ranges) with the sum of value up to each row."""
    own = F.sum(value).over(Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return ranged.join(_carried(ranged, F.sum(value), "sum"), F.col("__range") == F.col("__r")).withColumn(out, own + F.col("__c")).drop("__r", "__c")


def least_behind(ranged: DataFrame, value: str, *order: str, out: str) -> DataFrame:
    """ranged with the least value from each row on."""
    own = F.min(value).over(Window.partitionBy("__range").orderBy(*order).rowsBetween(0, Window.unboundedFollowing))
    return ranged.join(_carried(ranged, F.min(value), "min"), F.col("__range") == F.col("__r")).withColumn(out, F.least(own, F.col("__c"))).drop("__r", "__c")
