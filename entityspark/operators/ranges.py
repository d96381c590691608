"""Rows in one global order without a task that sees them all.

Rows are dealt over ranges of the order and written once, with the number of their range; all else reads that table.
Range bounds are sampled, so a second evaluation may deal otherwise, and what one range must know of those before it has
to come from the same table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .checkpoints import written

RANGE, PLACE = "__range", "__place"


def ranged(df: DataFrame, order: list, name: str) -> DataFrame:
    """df with its range, ascending in the order, and the row's place in it, from 0."""
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return written(dealt.withColumn(RANGE, F.spark_partition_id()).withColumn(PLACE, F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)), name)


def before(parts: DataFrame, value: Column, groups: list[str] = ()) -> Column:
    """Of parts, which has a row for each range (of a group): value over the ranges before. A window over as many rows as
    there are ranges."""
    return value.over(Window.partitionBy(*(groups or [F.lit(0)])).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1))


def ranked(df: DataFrame, order: list, into: str, first: int = 0, name: str = "ranked") -> DataFrame:
    """df with its dense rank in the order, from `first` on, in a column of its own."""
    kept = ranged(df, order, name)
    sizes = kept.groupBy(RANGE).agg(F.count("*").alias("__n"))
    starts = sizes.select(RANGE, F.coalesce(before(sizes, F.sum("__n")), F.lit(0)).alias("__start"))
    return kept.join(F.broadcast(starts), RANGE).withColumn(into, F.lit(first) + F.col("__start") + F.col(PLACE)).drop(RANGE, PLACE, "__start")


def lagged(df: DataFrame, order: str, value: str, into: str, name: str = "lagged") -> DataFrame:
    """df with the value of the row before in the whole order, null for the first."""
    kept = ranged(df, [order], name)
    last = kept.groupBy(RANGE).agg(F.max_by(value, PLACE).alias("__last"))
    carry = last.select(RANGE, before(last, F.last("__last")).alias("__carry"))
    own = F.lag(value).over(Window.partitionBy(RANGE).orderBy(PLACE))
    return kept.withColumn(into, own).join(F.broadcast(carry), RANGE).withColumn(into, F.when(F.col(PLACE) == 0, F.col("__carry")).otherwise(F.col(into))).drop(RANGE, PLACE, "__carry")


def nth(rows: DataFrame, value: str, fraction: float, groups: list[str], name: str = "nth") -> DataFrame:
    """(groups, p): for each group the element at min(floor(fraction * n), n - 1) of its sorted values, exactly.

    Values are counted first. A group's counts lie in ranges, which add up apart; what joins them is one row a range.
    """
    counts = ranged(rows.groupBy(*groups, value).agg(F.count("*").alias("__c")), [*groups, value], name)
    sums = counts.groupBy(*groups, RANGE).agg(F.sum("__c").alias("__s"))
    whole = Window.partitionBy(*(groups or [F.lit(0)]))
    parts = sums.select(*groups, RANGE, F.coalesce(before(sums, F.sum("__s"), groups), F.lit(0)).alias("__before"), F.sum("__s").over(whole).alias("__n"))
    parts = parts.withColumn("__at", F.least(F.floor(F.col("__n") * fraction), F.col("__n") - 1)).where((F.col("__at") >= F.col("__before")))
    near = counts.join(parts, [*groups, RANGE])
    upto = F.sum("__c").over(Window.partitionBy(*groups, RANGE).orderBy(value)) + F.col("__before")
    x = near.withColumn("__upto", upto)
    return x.where((F.col("__upto") > F.col("__at")) & (F.col("__upto") - F.col("__c") <= F.col("__at"))).select(*groups, F.col(value).alias("p"))
