"""Constraint checks and repairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def key_collisions(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def renumber_attempts(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    return df.withColumn("attempt", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def keep_best_duplicate(df: DataFrame, keys: Sequence[str], confidence: str, created: str, id_col: str) -> DataFrame:
    """Of each key the row of highest confidence (null last), the oldest, the smallest id; one aggregate."""
    order = F.struct(F.col(confidence).isNull().alias("n"), (-F.col(confidence)).alias("c"), F.col(created).alias("t"), F.col(id_col).alias("i"))
    return df.groupBy(*keys).agg(F.min_by(F.struct(*df.columns), order).alias("r")).select("r.*")


def violations(df: DataFrame, rules: dict[str, Column], key: str) -> DataFrame:
    """(key, rule) for every rule a row breaks; a null counts as kept, as a CHECK constraint does."""
    broken = F.array_compact(F.array(*[F.when(~rule, name) for name, rule in rules.items()]))
    return df.select(key, F.explode(broken).alias("rule"))


def backfill_counters(parents: DataFrame, children: DataFrame, key: str, counted: str, name: str) -> DataFrame:
    n = children.groupBy(key).agg(F.count_distinct(counted).alias(name))
    return parents.join(n, key, "left").withColumn(name, F.coalesce(name, F.lit(0)))
