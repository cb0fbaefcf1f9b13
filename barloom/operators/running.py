"""Running values of long series, by blocks of their order: a task holds blocks, and only one row of facts for each block meets those before it.

A block is a day of times, 4096 numbers, or else a value of the first column of the order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

BLOCK = 4096
TASK_ROWS = 1 << 19
"""Rows of a task, on average, where that takes more tasks than spark.sql.shuffle.partitions."""


def before(keys: Sequence[str]) -> WindowSpec:
    """The blocks of a key before each block, of facts with one row for each _g."""
    return Window.partitionBy(*(F.col("_g")[k] for k in keys)).orderBy(F.col("_g")["_b"]).rowsBetween(Window.unboundedPreceding, -1)


def blocked(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """rows with _g: keys and block as one struct, so that null keys meet each other."""
    first, kind = F.col(order[0]), dict(rows.dtypes)[order[0]]
    if kind.startswith("timestamp"):
        first = F.to_date(first)
    elif kind in ("tinyint", "smallint", "int", "bigint"):
        first = F.floor(first / BLOCK)
    tasks = -(-rows.count() // TASK_ROWS)
    rows = rows.withColumn("_g", F.struct(*keys, first.alias("_b")))
    return rows.repartition(tasks, "_g") if tasks > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) else rows


def dealt(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """rows dealt out by the columns for windows over them, in tasks of TASK_ROWS."""
    tasks = -(-rows.count() // TASK_ROWS)
    return rows.repartition(tasks, *by) if tasks > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) else rows.repartition(*by)


def so_far(order: Sequence[str]) -> WindowSpec:
    """A block's rows up to each row."""
    return Window.partitionBy("_g").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)


def blocks_before(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """rows with the facts of their block, merged where the rows lie."""
    named = facts.withColumnRenamed("_g", "_own").hint("shuffle_merge")
    return rows.join(named, rows["_g"] == named["_own"]).drop("_own")
