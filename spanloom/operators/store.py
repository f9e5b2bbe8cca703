"""Keyed stores as set operations: first and last writer wins, ledgers, cascades and precedence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_wins(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The latest row of every key; null keys are one key."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def first_wins(store: DataFrame, new: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The store with those new rows whose key it lacks, the first of each."""
    w = Window.partitionBy(*key).orderBy(*order)
    fresh = new.join(store.select(*key), key, "left_anti").withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")
    return store.unionByName(fresh.select(*store.columns))


def without(df: DataFrame, gone: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key is not among the gone ones: a cascading delete."""
    return df.join(gone.select(*key).distinct(), key, "left_anti")


def ledger(df: DataFrame, scope: list[str], source: str, rendering: str, order: str) -> DataFrame:
    """One batch into an empty ledger: the first rendering of every source, and of every rendering the first source.

    A later source may not take a rendering that another one holds. Sources are unique after the first step, so the
    second is exact. Null sources and renderings are refused.
    """
    x = df.where(F.col(source).isNotNull() & F.col(rendering).isNotNull())
    x = last_wins(x, [*scope, source], [F.col(order).asc()])
    return last_wins(x, [*scope, rendering], [F.col(order).asc()])


def ledger_add(held: DataFrame, new: DataFrame, scope: list[str], source: str, rendering: str, order: str) -> DataFrame:
    """Rows of a further batch that the held ledger admits."""
    x = new.join(held.select(*scope, source), [*scope, source], "left_anti").join(held.select(*scope, rendering), [*scope, rendering], "left_anti")
    return ledger(x, scope, source, rendering, order).select(*held.columns)


def precedence(frames: list[DataFrame], key: list[str], cols: list[str]) -> DataFrame:
    """Of every key the row of the first frame that has it, with the frame's number as ``rank``."""
    x = reduce(DataFrame.unionByName, [f.select(*key, *cols).withColumn("rank", F.lit(i)) for i, f in enumerate(frames)])
    return x.groupBy(*key).agg(F.min_by(F.struct(*cols), "rank").alias("_v"), F.min("rank").alias("rank")).select(*key, *[F.col(f"_v.{c}").alias(c) for c in cols], "rank")
