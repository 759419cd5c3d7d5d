"""As-of joins: the nearest row before or after, within a group, without a product of the group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Positions that one sort takes in; a group is sorted block by block, and what lies beyond a block's ends comes from its
#: neighbours, so a group with many positions spreads over tasks.
BLOCK = 65_536


def _ends(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of each block of right positions: the last right position before it and the first after it."""
    blocks = rows.groupBy(*keys, "_block").agg(F.min(F.when(F.col("_right"), F.col("_pos"))).alias("first"), F.max(F.when(F.col("_right"), F.col("_pos"))).alias("last"))
    order = Window.partitionBy(*keys).orderBy("_block")
    before = F.last("last", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first("first", ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing))
    return blocks.select(*keys, "_block", before.alias("_before"), after.alias("_after"))


def around(left: DataFrame, right: DataFrame, keys: list[str], position: str, block: int = BLOCK) -> DataFrame:
    """(*keys, position, before, after) of each different left position: the nearest right position at or before it, and the
    nearest after it, of the same keys; null where there is none.

    Both sides are reduced to different positions first, so a position that many rows share is one row. Rows with a null key
    or position have no neighbours."""
    place = lambda df, is_right: df.select(*keys, F.col(position).cast("long").alias("_pos"), F.lit(is_right).alias("_right")).dropna().distinct()
    rows = place(left, False).unionByName(place(right, True)).withColumn("_block", F.floor(F.col("_pos") / block))
    within = Window.partitionBy(*keys, "_block").orderBy("_pos", F.desc("_right"))
    at = F.when(F.col("_right"), F.col("_pos"))
    before = F.last(at, ignorenulls=True).over(within.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(at, ignorenulls=True).over(within.rowsBetween(1, Window.unboundedFollowing))
    near = rows.select("*", before.alias("_b"), after.alias("_a")).where("not _right").join(_ends(rows, keys), [*keys, "_block"], "left")
    return near.select(*keys, F.col("_pos").alias(position), F.coalesce("_b", "_before").alias("before"), F.coalesce("_a", "_after").alias("after"))


def nearer(position: str, before: str = "before", after: str = "after") -> Column:
    """The nearer of two neighbours; ties go to the one before, positions of 0 or less to the one after."""
    down, up = F.col(position) - F.col(before), F.col(after) - F.col(position)
    return F.when(F.col(before).isNull() | (up < down), F.col(after)).otherwise(F.col(before))


def nearest(left: DataFrame, right: DataFrame, keys: list[str], position: str, block: int = BLOCK) -> DataFrame:
    """(*keys, position, nearest): the nearest right position of each different left one; ties to the smaller."""
    return around(left, right, keys, position, block).select(*keys, position, nearer(position).alias("nearest")).where("nearest is not null")
