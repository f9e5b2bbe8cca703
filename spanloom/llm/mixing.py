"""Records of several sources combined to target weights, by pivotal dependent rounding.

A source's weight, size and repeat cap give a number of copies per record, mostly not whole. The whole part is taken;
the fractions are rounded pair by pair: token mass moves at random from one record to the other until one of the two
is whole, each fraction keeping its expectation. So a source's total never strays by more than one record; the largest
records go first, so that this one is seldom large. Every partition leaves at most one record undecided per plan and source; these are paired the same way up a tree.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.session import materialize
from spanloom.sources.tables import key_of

#: Partitions whose undecided records meet at the next level.
FAN_IN = 16
#: Records a task of the first level rounds, about.
TASK_ROWS = 20_000

_ROW = "plan string, source string, doc_id long, tokens long, copies long, part double, open boolean"
_SCHEMA = pa.schema([("plan", pa.string()), ("source", pa.string()), ("doc_id", pa.int64()), ("tokens", pa.int64()), ("copies", pa.int64()), ("part", pa.float64()), ("open", pa.bool_())])
_EPS = 1e-9


def pivot(p: float, s: float, q: float, t: float, u: float) -> tuple[float, float]:
    """Move mass between fractions p of size s and q of size t, by the random number u, until one is whole."""
    up, down = min((1 - p) * s, q * t), min(p * s, (1 - q) * t)
    move = up if u * (up + down) < down else -down
    return p + move / s, q - move / t


def _round(last: bool):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rng, held = None, random.Random(0), None

        def flush() -> list[tuple]:
            nonlocal held
            if held is None:
                return []
            (row, p), held = held, None
            if last:
                return [(*row[:4], row[4] + (rng.random() < p), 0.0, False)]
            return [(*row[:4], row[4], p, True)]

        for b in batches:
            out: list[tuple] = []
            for row in zip(*(b[c].to_pylist() for c in ("plan", "source", "doc_id", "tokens", "copies", "part"))):
                if (row[0], row[1]) != key:
                    out += flush()
                    key = (row[0], row[1])
                    rng = random.Random(f"{key}{row[2]}{last}")
                p = row[5]
                if p <= _EPS or p >= 1 - _EPS:
                    out.append((*row[:4], row[4] + round(p), 0.0, False))
                    continue
                if held is None:
                    held = (row, p)
                    continue
                other, q = held
                p, q = pivot(p, row[3], q, other[3], rng.random())
                held = None
                for r, x in ((row, p), (other, q)):
                    if x <= _EPS or x >= 1 - _EPS:
                        out.append((*r[:4], r[4] + round(x), 0.0, False))
                    else:
                        held = (r, x)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _SCHEMA)], schema=_SCHEMA)
        if out := flush():
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _SCHEMA)], schema=_SCHEMA)

    return run


def rates(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """(plan, source, wanted, size, cap, rate): copies per record that meet the weights at the largest possible total.

    The total of a plan is the largest at which no source needs more than its cap; sources without records are left
    aside for that, and keep their wanted share in the report. Without any cap it is the size of the plan's sources.
    """
    sizes = docs.groupBy("source").agg(F.sum("tokens").alias("size"))
    p = plan.select("plan", key_of("source").alias("source"), F.col("weight").cast("double").alias("weight"), F.col("max_repeats").cast("long").alias("cap")).where("plan is not null and source is not null and weight > 0 and not isnan(weight)").groupBy("plan", "source").agg(F.max("weight").alias("weight"), F.max("cap").alias("cap"))
    p = p.join(sizes, "source", "left").withColumn("size", F.coalesce("size", F.lit(0)))
    total = p.groupBy("plan").agg(F.sum("weight").alias("all"), F.sum(F.when(F.col("size") > 0, F.col("weight"))).alias("there"), F.sum("size").alias("sizes"), F.min(F.when((F.col("size") > 0) & F.col("cap").isNotNull(), F.col("cap") * F.col("size") / F.col("weight"))).alias("bound"))
    x = p.join(total, "plan").withColumn("total", F.coalesce(F.col("bound") * F.col("there"), F.col("sizes").cast("double")))
    return x.select("plan", "source", (F.col("weight") / F.col("all")).alias("wanted"), "size", "cap", F.when(F.col("size") > 0, F.col("weight") / F.col("there") * F.col("total") / F.col("size")).otherwise(F.lit(0.0)).alias("rate"))


def mix(docs: DataFrame, plan: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The chosen records (plan, source, doc_id, tokens, copies) and the table of :func:`rates`.

    ``docs`` has (doc_id, source, tokens), ``plan`` (plan, source, weight, max_repeats); sources are compared without
    surrounding blanks and case, a null source is in no plan, a null cap is none. Rows of a plan without a positive
    weight are ignored; of a source that stands twice in a plan the larger weight and cap count. Records without
    tokens are never chosen. Empty tables give an empty result.
    """
    x = docs.select(F.col("doc_id").cast("long").alias("doc_id"), key_of("source").alias("source"), F.col("tokens").cast("long").alias("tokens")).where("doc_id is not null and source is not null and tokens > 0")
    x = materialize(x, "sizes")
    rows = x.count()
    table = materialize(rates(x, plan).coalesce(1), "rates")  # of known size: the planner broadcasts it if it is small
    want = table.where("rate > 0").select("plan", "source", "rate", "cap")
    x = x.join(want, "source")
    # rounding must not exceed a cap by the error of a division
    rate = F.when(F.col("rate") > F.coalesce(F.col("cap").cast("double"), F.col("rate")) - _EPS, F.coalesce(F.col("cap").cast("double"), F.col("rate"))).otherwise(F.col("rate"))
    x = x.withColumn("rate", rate).select("plan", "source", "doc_id", "tokens", F.floor("rate").alias("copies"), (F.col("rate") - F.floor("rate")).alias("part"))
    n = max(1, -(-rows // TASK_ROWS))
    done = None
    while True:
        level = materialize(x.repartition(n, "doc_id").sortWithinPartitions("plan", "source", F.desc("tokens"), "doc_id").mapInArrow(_round(n == 1), _ROW), "mixed")
        closed = level.where("not open").drop("open", "part")
        done = closed if done is None else done.unionByName(closed)
        if n == 1:
            break
        x, n = level.where("open").drop("open"), -(-n // FAN_IN)
    return done.where("copies > 0"), table


def shares(chosen: DataFrame, table: DataFrame) -> DataFrame:
    """Per plan and source: the wanted share, the actual one, and what makes it up."""
    got = chosen.groupBy("plan", "source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.count(F.lit(1)).alias("records"), F.max("copies").alias("most_copies"))
    whole = got.groupBy("plan").agg(F.sum("tokens").alias("total"))
    x = table.join(got, ["plan", "source"], "left").join(whole, "plan", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return x.select("plan", "source", F.round("wanted", 6).alias("wanted_share"), F.round(F.coalesce(F.col("tokens") / F.col("total"), F.lit(0.0)), 6).alias("actual_share"), zero("tokens"), zero("records"), zero("most_copies"), "cap", F.col("size").alias("source_tokens"))
