"""Half-open interval algebra over DataFrames with one row per interval: owner columns, lo, hi."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def valid(df: DataFrame, lo: str, hi: str) -> DataFrame:
    """Rows with 0 <= lo < hi; nulls are left out."""
    return df.where((F.col(lo) >= 0) & (F.col(lo) < F.col(hi)))


def merge(df: DataFrame, owner: list[str], lo: str = "start_ms", hi: str = "end_ms") -> DataFrame:
    """Islands per owner, touching ranges joined, with the number of ranges in each. One shuffle on the owner.

    For owners too large for one task use ``dyadic.between``, which spreads an owner over tiles.
    """
    w = Window.partitionBy(*owner).orderBy(lo, hi)
    reach = F.max(hi).over(w.rowsBetween(Window.unboundedPreceding, -1))
    x = valid(df, lo, hi).select(*owner, lo, hi).withColumn("_new", F.coalesce((F.col(lo) > reach).cast("int"), F.lit(1)))
    x = x.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return x.groupBy(*owner, "_island").agg(F.min(lo).alias(lo), F.max(hi).alias(hi), F.count(F.lit(1)).alias("n")).drop("_island")


def union(frames: list[DataFrame], owner: list[str], lo: str = "start_ms", hi: str = "end_ms") -> DataFrame:
    """Coverage of any number of interval tables together."""
    return merge(reduce(DataFrame.unionByName, [f.select(*owner, lo, hi) for f in frames]), owner, lo, hi)


def subtract(a: DataFrame, b: DataFrame, owner: list[str], lo: str = "start_ms", hi: str = "end_ms") -> DataFrame:
    """What of a is not in b, as maximal ranges: an edge sweep, so that neither side is multiplied."""

    def edges(df: DataFrame, da: int, db: int) -> DataFrame:
        e = lambda at, s: F.struct(F.col(at).alias("at"), F.lit(s * da).alias("da"), F.lit(s * db).alias("db"))
        return valid(df, lo, hi).select(*owner, F.explode(F.array(e(lo, 1), e(hi, -1))).alias("e")).select(*owner, "e.*")

    x = edges(a, 1, 0).unionByName(edges(b, 0, 1)).groupBy(*owner, "at").agg(F.sum("da").alias("da"), F.sum("db").alias("db"))
    w = Window.partitionBy(*owner).orderBy("at")
    x = x.withColumn("a", F.sum("da").over(w)).withColumn("b", F.sum("db").over(w)).withColumn("next", F.lead("at").over(w))
    return merge(x.where("a > 0 and b = 0 and next is not null").select(*owner, F.col("at").alias(lo), F.col("next").alias(hi)), owner, lo, hi).drop("n")


def clip(lo: Column, hi: Column, low: Column, high: Column) -> tuple[Column, Column]:
    """The part of [lo, hi) inside [low, high); empty if the result is not ascending."""
    return F.greatest(lo, low), F.least(hi, high)


def holes(islands: DataFrame, spans: DataFrame, owner: list[str], length: str = "duration_ms") -> DataFrame:
    """Gaps of merged coverage within [0, length) of each row of ``spans``; an owner without coverage is one gap."""
    whole = spans.where(F.col(length) > 0).select(*owner, F.lit(0).cast("long").alias("start_ms"), F.col(length).alias("end_ms"))
    cut = islands.join(spans.select(*owner, length), owner).select(*owner, "start_ms", F.least("end_ms", length).alias("end_ms"))
    return subtract(whole, cut, owner)


def horizon_plan(position: Column, reached: Column, duration: Column, rate: Column, following: Column, high: int = 60_000, first: int = 10_000, window: int = 16_000, most: int = 120_000) -> Column:
    """The next stretch to work on: struct(start_ms, end_ms), null where enough lies ahead.

    It starts where coverage ends and is ``first`` long at the position itself, else ``window``; it ends at the
    duration and at the start of the next range. Nothing is planned beyond ``high`` milliseconds of playback.
    """
    ahead = F.least(F.lit(most), F.floor(F.lit(high) * rate))
    limit = F.least(duration, position + ahead)
    end = F.least(reached + F.when(reached == position, first).otherwise(window), duration, F.coalesce(following, duration))
    return F.when(reached < limit, F.struct(reached.alias("start_ms"), end.alias("end_ms")))


def buffered(position: Column, reached: Column, settled: Column, duration: Column, rate: Column, startup: int = 8000) -> Column:
    """Playback buffer: struct(media_ms, wall_ms, settled_ms, ready)."""
    media, done = reached - position, settled - position
    return F.struct(media.alias("media_ms"), F.floor(media / rate).alias("wall_ms"), done.alias("settled_ms"), (done >= F.least(F.lit(startup), duration - position)).alias("ready"))
