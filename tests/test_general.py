"""Periods, gaps and orphans against plain versions of them."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from spanloom.operators import dyadic, orphans

IV = "who string, a long, b long, tbl string"


def plain(rows):
    by = {}
    for who, a, b, _ in rows:
        if who is not None and a is not None and b is not None and 0 <= a < b:
            by.setdefault(who, []).append((a, b))
    out = set()
    for who, v in by.items():
        v.sort()
        periods = []
        for a, b in v:
            if periods and a <= periods[-1][1]:
                periods[-1][1] = max(periods[-1][1], b)
            else:
                periods.append([a, b])
        out |= {("t", who, "period", a, b) for a, b in periods}
        out |= {("t", who, "gap", x[1], y[0]) for x, y in zip(periods, periods[1:])}
    return out


def got(spark, rows):
    df = dyadic.periods_and_gaps(spark.createDataFrame(rows, IV), "t", "who", "a", "b")
    assert df.columns == ["tbl", "owner", "kind", "from_ms", "to_ms"]
    r = [tuple(x) for x in df.collect()]
    assert len(r) == len(set(r))
    return set(r)


def test_random_intervals(spark):
    rng = random.Random(5)
    for span, length in ((300, 40), (20_000_000, 9_000_000), (9_000_000, 30_000)):
        rows = [(rng.choice("abc"), a := rng.randrange(span), a + rng.randrange(1, length), "x") for _ in range(200)]
        rows += rows[:20]
        assert got(spark, rows) == plain(rows)


def test_edges(spark):
    tile = 1 << dyadic.TILE
    rows = [("a", 0, tile, "x"), ("a", tile, 3 * tile, "x"), ("a", 3 * tile + 1, 3 * tile + 2, "x"), ("b", tile - 1, tile + 1, None), ("c", 5, 5, "x"), ("c", None, 5, "x"), ("c", 5, None, "x"), ("c", -3, 5, "x"), (None, 1, 2, "x"), ("d", 1, 2, "x"), ("d", 2, 3, "x"), ("", 1, 2, "x")]
    assert got(spark, rows) == plain(rows)
    assert got(spark, []) == set()


def test_long_intervals_are_few_rows(spark):
    tile, rng = 1 << dyadic.TILE, random.Random(9)
    far = tile * dyadic.LONG
    rows = [("a", 5, far + 9, "x"), ("a", far + 9, far + 12, "x"), ("a", far * 3 + 1, far * 3 + 2, "x"), ("b", 0, 1 << 62, "x"), ("b", 77, 99, "x"), ("c", 3, 9, "x"), ("c", tile * 200, tile * 200 + 1, "x"), ("d", tile, tile + far, "x"), ("d", tile + far, 2 * far + 5 * tile, "x")]
    rows += [(w, a := rng.randrange(far * 4), a + rng.choice((tile // 2, tile * 3, far, far * 2)), "x") for w in "efg" for _ in range(6)] + [(w, a := rng.randrange(far * 9), a + 1000, "x") for w in "efg" for _ in range(40)]
    assert got(spark, rows) == plain(rows)


T0 = datetime(2026, 1, 1)


def test_orphans(spark):
    day = lambda n: T0 + timedelta(days=n)
    parents = spark.createDataFrame([("p", day(1), day(3), 1), ("p", day(5), None, 2), ("q", day(1), day(1), 3), ("r", None, None, 4), (None, day(0), None, 5), ("p", day(1), day(3), 1)], "k string, b timestamp, e timestamp, child int")
    moments = [("p", 0), ("p", 1), ("p", 2), ("p", 3), ("p", 4), ("p", 5), ("p", 9), ("q", 1), ("r", 2), ("x", 2), (None, 2), ("p", None)]
    children = spark.createDataFrame([(i, k, None if n is None else day(n), "z") for i, (k, n) in enumerate(moments)] + [(0, "p", day(0), "z")], "id long, k string, at timestamp, step string")
    found = orphans.orphans([orphans.references(children, "c", "p", F.col("id"), F.col("k"), "at")], [orphans.stays(parents, "p", F.col("k"), "b", "e")], salts=3)
    assert sorted(int(r.row_key) for r in found.collect()) == [0, 0, 3, 4, 7, 8, 9, 11]
    by = {r.month: (r.orphans, r["keys"]) for r in orphans.by_period(found).collect()}
    assert by == {"2026-01": (7, 4), None: (1, 1)}
    none = orphans.orphans([orphans.references(children.where("false"), "c", "p", F.col("id"), F.col("k"), "at")], [orphans.stays(parents, "p", F.col("k"), "b", "e")])
    assert none.count() == 0
    alone = orphans.orphans([orphans.references(children, "c", "p", F.col("id"), F.col("k"), "at")], [orphans.stays(parents.where("false"), "p", F.col("k"), "b", "e")])
    assert alone.count() == 12
