"""Joins back to what was aggregated by a key, with hot keys dealt to parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key with more rows is hot; at most so many are split, those with most rows first.
HOT_ROWS, MOST_HOT = 100_000, 10_000


def join_by_key(rows: DataFrame, table: DataFrame, key: str, count: str, spread: Column, how: str = "left", hot_rows: int = HOT_ROWS) -> DataFrame:
    """``rows`` with the columns of ``table``, which has one row a key and in ``count`` how many of ``rows`` hold it; ``count`` is dropped.

    Adaptive execution cannot split a key of a side that an aggregate has already dealt out. So rows of a hot key are
    dealt to parts by ``spread``, about ``hot_rows`` to each, and its row of the table is copied to them. The hot keys are
    broadcast, MOST_HOT at most. A null key joins nothing.
    """
    hot = table.where(F.col(count) > hot_rows).select(F.col(key).alias("__hot"), F.ceil(F.col(count) / hot_rows).cast("int").alias("__parts"), F.col(count).alias("__n"))
    hot = F.broadcast(hot.orderBy(F.col("__n").desc(), "__hot").limit(MOST_HOT).drop("__n"))
    parts = F.coalesce("__parts", F.lit(1))

    def dealt(d: DataFrame) -> DataFrame:
        return d.join(hot, F.col(key) == F.col("__hot"), "left").drop("__hot")

    left = dealt(rows).withColumn("__part", F.pmod(spread, parts).cast("int")).drop("__parts")
    right = dealt(table).withColumn("__copy", F.explode(F.sequence(F.lit(0), parts - 1))).drop("__parts", count).withColumnRenamed(key, "__key")
    return left.join(right, (F.col(key) == F.col("__key")) & (F.col("__part") == F.col("__copy")), how).drop("__key", "__part", "__copy")
