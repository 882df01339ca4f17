"""Row numbers and running totals of groups of any size.

A window puts a group's rows in one task. Where some group is larger than that should
be, rows are dealt by ranges of the whole order instead, so a group may span many tasks,
and counts of the parts before each tell where its numbers start.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscan.sources.shared import new_path

#: Rows of a group that one task may number.
GROUP_ROWS = 1 << 20
#: Bits of ``monotonically_increasing_id`` below the number of the partition.
PART_BITS = 33


def largest_group(df: DataFrame, group: list[str]) -> int:
    """Rows of the largest group; 0 without rows."""
    return df.groupBy(*group).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n")).first()["n"] or 0


def ranked(df: DataFrame, group: list[str], order: list[Column], name: str = "place", group_rows: int = GROUP_ROWS) -> DataFrame:
    """``df`` with the row number (from 1) of each row in its group by ``order`` (name).

    Null is a group of its own. With a group of more than ``group_rows`` rows, all rows
    are written once, sorted; equal rows get numbers in any order.
    """
    if largest_group(df, group) <= group_rows:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order)).cast("bigint"))
    keys = [F.col(c).asc() for c in group]
    path = new_path(df.sparkSession, "ranked")
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df.repartitionByRange(tasks, *keys, *order).sortWithinPartitions(*keys, *order).withColumn("_at", F.monotonically_increasing_id()).write.parquet(path)
    rows = df.sparkSession.read.parquet(path).withColumn("_part", F.shiftright("_at", PART_BITS))
    parts = rows.groupBy(*group, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    parts = parts.select(*[F.col(c).alias(f"_of_{c}") for c in group], F.col("_part").alias("_of_part"), "_first", "_before")
    same = rows["_part"] == parts["_of_part"]
    for c in group:
        same &= rows[c].eqNullSafe(parts[f"_of_{c}"])
    return rows.join(parts, same).withColumn(name, F.col("_at") - F.col("_first") + F.col("_before") + 1).select(*df.columns, name)


def running(df: DataFrame, group: str, place: str, values: dict[str, tuple[Column, Callable[[Column], Column], Callable[[Column, Column], Column]]], last: int, block: int = GROUP_ROWS) -> DataFrame:
    """``df`` with running totals over each group's rows by ``place``, from its first row
    to each: name to (value, aggregate, how two totals join).

    Places are whole numbers from 0 to ``last``, one row each. Totals are made within
    blocks of places first; where a group has several, the totals of those before are
    added to each.
    """
    inner = Window.partitionBy(group).orderBy(place).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    if last < block:
        return df.withColumns({name: total(value).over(inner) for name, (value, total, _) in values.items()})
    rows = df.withColumn("_block", F.floor(F.col(place) / block))
    inner = Window.partitionBy(group, "_block").orderBy(place).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    blocks = rows.groupBy(group, "_block").agg(*[total(value).alias(name) for name, (value, total, _) in values.items()])
    before = Window.partitionBy(group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.select(F.col(group).alias("_group"), F.col("_block").alias("_of"), *[total(F.col(name)).over(before).alias(f"_{name}") for name, (_, total, _) in values.items()])
    own = rows.withColumns({name: total(value).over(inner) for name, (value, total, _) in values.items()})
    carried = carried.where("_of > 0")
    out = own.join(carried, (own[group] == carried["_group"]) & (own["_block"] == carried["_of"]), "left")
    return out.withColumns({name: F.when(F.col("_of").isNull(), F.col(name)).otherwise(join(F.col(name), F.col(f"_{name}"))) for name, (_, _, join) in values.items()}).select(*df.columns, *values)
