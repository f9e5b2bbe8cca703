"""References to records that are not there at the moment of the reference.

Parents' stays and children's references are put into one long form (parent table, key, moment, tag) and grouped by
parent table and key. In a group, read by time, the parent flag is the number of stays begun and not ended; children at
a moment without a flag are orphans. A key's children are salted over ``salts`` groups, each of which gets the key's
stays, so that a key with a third of all rows is no single task. No join is made.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Groups over which the children of one key are spread.
SALTS = 32


def stays(df: DataFrame, parent: str, key: Column, begin: str, end: str) -> DataFrame:
    """The presence of parent rows as edges (parent, key, at, step). Stays without a begin, or none long, are nothing."""
    x = df.select(F.lit(parent).alias("parent"), key.alias("key"), F.col(begin).cast("timestamp").alias("b"), F.col(end).cast("timestamp").alias("e")).where("key is not null and b is not null and (e is null or e > b)").distinct()
    edges = F.array(F.struct(F.col("b").alias("at"), F.lit(1).alias("step")), F.when(F.col("e").isNotNull(), F.struct(F.col("e").alias("at"), F.lit(-1).alias("step"))))
    return x.select("parent", "key", F.explode(F.array_compact(edges)).alias("x")).groupBy("parent", "key", "x.at").agg(F.sum("x.step").cast("int").alias("step")).where("step <> 0")


def references(df: DataFrame, child: str, parent: str, row_key: Column, key: Column, at: str) -> DataFrame:
    """Child rows that refer to a key: (child, parent, row_key, key, at). A null key refers to nothing."""
    return df.select(F.lit(child).alias("child"), F.lit(parent).alias("parent"), row_key.cast("string").alias("row_key"), key.alias("key"), F.col(at).cast("timestamp").alias("at")).where("key is not null")


def orphans(children: list[DataFrame], parents: list[DataFrame], salts: int = SALTS) -> DataFrame:
    """References without a present parent: (child, parent, row_key, key, at), repeated rows kept.

    ``children`` come from :func:`references`, ``parents`` from :func:`stays`. Present means begin <= moment, and end
    null or > moment. A reference at an unknown moment (null) has no present parent. Overlapping, repeated and
    touching stays count as they are; without parents every reference is an orphan, without children the result is
    empty.
    """
    c = reduce(DataFrame.unionByName, children).withColumn("salt", F.pmod(F.xxhash64("child", "row_key", "at"), F.lit(salts)).cast("int")).withColumn("step", F.lit(0))
    p = reduce(DataFrame.unionByName, parents).select(F.lit(None).cast("string").alias("child"), "parent", F.lit(None).cast("string").alias("row_key"), "key", "at", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), "step")
    # at one moment the edges come before the references; the sum then holds all stays begun and not ended
    w = Window.partitionBy("parent", "key", "salt").orderBy(F.col("at").asc_nulls_first(), F.col("child").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    return c.unionByName(p.select(*c.columns)).withColumn("flag", F.sum("step").over(w)).where("child is not null and flag = 0").select("child", "parent", "row_key", "key", "at")


def by_period(found: DataFrame) -> DataFrame:
    """Orphans and their distinct keys per child table, parent table and month (null where the moment is unknown)."""
    return found.groupBy("child", "parent", F.date_format("at", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("orphans"), F.countDistinct("key").alias("keys"))
