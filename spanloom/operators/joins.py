"""Joins on ranges and neighbours, as equi-joins on buckets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Buckets that a range may stand in; a longer one goes to coarser buckets, each level as much coarser.
SPREAD = 64


def range_join(points: DataFrame, ranges: DataFrame, keys: list[str], at: Column, lo: str, hi: str, bucket: int, how: str = "inner", upper: int = 0) -> DataFrame:
    """Rows of ``points`` with the ranges [lo, hi + upper) of the same keys that hold ``at``.

    A range stands in every bucket it meets and a point in one, so a pair is found once and no product of the sides is
    made; ``bucket`` is best near the usual length of a range. Ranges over more than ``SPREAD`` buckets are joined apart,
    by buckets that much longer, and so on: a range is never more than ``SPREAD`` + 1 rows. Names other than the keys must
    differ. ``how`` is inner, left, left_semi or left_anti.
    """
    size = F.floor((F.col(hi) + upper - F.col(lo)) / bucket)
    levels = _level(ranges.agg(F.max(size).alias("n")).first().n)
    part = lambda k: ranges if not levels else ranges.where((size >= SPREAD**k if k else F.lit(True)) & (size < min(SPREAD ** (k + 1), (1 << 63) - 1)))
    one = lambda p, k, how: _bucket_join(p, part(k), keys, at, lo, hi, bucket * SPREAD**k, how, upper)
    if not levels:
        return one(points, 0, how)
    rest, found = points, []
    for k in range(levels + 1):
        if how in ("inner", "left"):
            found.append(one(points, k, "inner"))
        elif how == "left_semi":
            found.append(one(rest, k, "left_semi"))
        rest = one(rest, k, "left_anti") if how != "inner" else rest
    if how == "left_anti":
        return rest
    if how == "left":
        found.append(rest.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in ranges.schema if f.name not in keys]))
    return reduce(DataFrame.unionByName, found)


def _level(buckets: int | None) -> int:
    n = 0
    while buckets is not None and buckets >= SPREAD ** (n + 1):
        n += 1
    return n


def _bucket_join(points: DataFrame, ranges: DataFrame, keys: list[str], at: Column, lo: str, hi: str, bucket: int, how: str, upper: int) -> DataFrame:
    p = points.withColumn("_at", at).withColumn("_bucket", F.floor(F.col("_at") / bucket))
    r = ranges.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(lo) / bucket), F.floor((F.col(hi) + upper) / bucket))))
    for k in keys:
        r = r.withColumnRenamed(k, f"_{k}")
    on = [p[k] == r[f"_{k}"] for k in keys] + [p["_bucket"] == r["_bucket"], F.col("_at") >= F.col(lo), F.col("_at") < F.col(hi) + upper]
    out = p.join(r, on, how)
    return out.drop("_at", p["_bucket"], *([] if how in ("left_semi", "left_anti") else [r["_bucket"], *(f"_{k}" for k in keys)]))


def contained(inner: DataFrame, outer: DataFrame, keys: list[str], lo: str, hi: str, outer_lo: str, outer_hi: str, slack: int, bucket: int) -> DataFrame:
    """Pairs where [lo, hi] lies in [outer_lo - slack, outer_hi + slack]."""
    wide = outer.withColumn("_lo", F.col(outer_lo) - slack).withColumn("_hi", F.col(outer_hi) + slack)
    return range_join(inner, wide, keys, F.col(lo), "_lo", "_hi", bucket, upper=1).where(F.col(hi) <= F.col("_hi")).drop("_lo", "_hi")


def as_of(points: DataFrame, marks: DataFrame, keys: list[str], at: str, mark: str, value: str, forward: bool = False, strict: bool = False) -> DataFrame:
    """``points`` with the last mark not after ``at`` (or the first not before it) and its value, by one sort of both.

    Adds the columns ``mark`` and ``value``, null where there is none; of equal marks the one with the smallest value
    counts. With ``strict`` a mark at the very moment does not.
    """
    cols = points.columns
    side = points.select(F.struct(*cols).alias("_row"), *keys, F.col(at).alias("_t"), F.lit(None).cast("struct<m:bigint,v:string>").alias("_m"), F.lit(0 if strict else 1).alias("_o"))
    other = marks.where(F.col(mark).isNotNull()).select(F.lit(None).cast(side.schema["_row"].dataType).alias("_row"), *keys, F.col(mark).alias("_t"), F.struct(F.col(mark).cast("long").alias("m"), F.col(value).cast("string").alias("v")).alias("_m"), F.lit(1 if strict else 0).alias("_o"))
    w = Window.partitionBy(*keys).orderBy(F.col("_t").desc() if forward else F.col("_t"), "_o", F.col("_m").desc())
    found = side.unionByName(other).withColumn("_f", F.last("_m", True).over(w.rowsBetween(Window.unboundedPreceding, -1))).where("_row is not null")
    return found.select(*[F.col(f"_row.{c}").alias(c) for c in cols], F.col("_f.m").alias(mark), F.col("_f.v").alias(value))


def neighbours(df: DataFrame, by: list[str], order: list[str], value: str, before: int, after: int) -> DataFrame:
    """Adds arrays ``before`` and ``after`` of the values of that many neighbours in order."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("before", F.collect_list(value).over(w.rowsBetween(-before, -1))).withColumn("after", F.collect_list(value).over(w.rowsBetween(1, after)))


def newest(df: DataFrame, by: list[str], order: list[Column], k: int = 1) -> DataFrame:
    """The first k rows of each group in an order that must have no ties; Spark limits groups before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= k).drop("_rank")
