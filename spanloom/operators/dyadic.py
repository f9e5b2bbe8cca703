"""Continuous periods and gaps of intervals, by dyadic blocks.

An integer interval is cut into canonical dyadic blocks ``[i*2^k, (i+1)*2^k)``. Such blocks are nested or disjoint, so
a block is redundant exactly if an ancestor is there, and two siblings are worth their parent. Blocks never leave their
tile of ``2^TILE`` units. Therefore a tile's distinct blocks are bounded however many intervals an entity has, and a
hot entity is spread over its tiles; only the outermost period of either end of a tile is matched with its neighbours.
The whole tiles of an interval over very many of them are decomposed once more, with tiles as the unit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: log2 of a tile's length: about 70 minutes in milliseconds.
TILE = 22
#: Whole tiles from which an interval counts as long: up to there each of them is a row.
LONG = 64


def decompose(owner: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Canonical blocks of the intervals ``[lo, hi)`` as (owner, start, level); no block is longer than a tile."""
    out: list[tuple[np.ndarray, np.ndarray, int]] = []
    lo, hi = lo.copy(), hi.copy()
    for level in range(TILE + 1):
        if not len(lo):
            break
        unit, top = 1 << level, level == TILE
        if top:
            # whole tiles remain
            n = (hi - lo) >> TILE
            at = np.repeat(lo, n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * unit
            out.append((np.repeat(owner, n), at, level))
            break
        left = (lo & unit) != 0
        out.append((owner[left], lo[left], level))
        lo = np.where(left, lo + unit, lo)
        right = ((hi & unit) != 0) & (lo < hi)
        hi = np.where(right, hi - unit, hi)
        out.append((owner[right], hi[right], level))
        keep = lo < hi
        owner, lo, hi = owner[keep], lo[keep], hi[keep]
    if not out:
        return owner[:0], lo[:0], lo[:0]
    return (np.concatenate([x for x, _, _ in out]), np.concatenate([x for _, x, _ in out]), np.concatenate([np.full(len(x), k, np.int64) for _, x, k in out]))


def reduce_blocks(group: np.ndarray, lo: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Without blocks covered by an ancestor, siblings merged upward; sorted. A group lies in one tile."""
    order = np.lexsort((-level, lo, group))
    group, lo, level = group[order], lo[order], level[order]
    if len(lo):
        # nested or disjoint, so a block is covered exactly if it starts before the furthest end so far of its group
        base = group * (1 << (TILE + 1)) + (lo & ((1 << TILE) - 1))
        reach = np.concatenate([[-1], np.maximum.accumulate(base + (1 << level))[:-1]])
        keep = base >= reach
        group, lo, level = group[keep], lo[keep], level[keep]
    for k in range(TILE):
        unit = 1 << k
        first = np.flatnonzero((level[:-1] == k) & (level[1:] == k) & (group[:-1] == group[1:]) & ((lo[:-1] & unit) == 0) & (lo[1:] == lo[:-1] + unit))
        if len(first):
            level[first] += 1
            keep = np.ones(len(lo), bool)
            keep[first + 1] = False
            group, lo, level = group[keep], lo[keep], level[keep]
    return group, lo, level


def _codes(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A small number for each combination of values, and the row where each first stands."""
    code = np.zeros(len(columns[0]), np.int64)
    for c in columns:
        _, one = np.unique(c, return_inverse=True)
        code = code * (int(one.max(initial=0)) + 1) + one
        _, code = np.unique(code, return_inverse=True)
    first = np.zeros(int(code.max(initial=-1)) + 1, np.int64)
    first[code[::-1]] = np.arange(len(code))[::-1]
    return code, first


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Map side: intervals to reduced blocks, batch by batch, so that few rows are shuffled."""
    for b in batches:
        tbl, who = b["tbl"].to_numpy(zero_copy_only=False), b["owner"].to_numpy(zero_copy_only=False)
        code, first = _codes(b["owner"].dictionary_encode().indices.to_numpy(zero_copy_only=False), b["tbl"].dictionary_encode().indices.to_numpy(zero_copy_only=False))
        owner, lo, level = decompose(code, b["lo"].to_numpy(), b["hi"].to_numpy())
        group, at = _codes(owner, lo >> TILE)
        own = owner[at]
        group, lo, level = reduce_blocks(group, lo, level)
        row = first[own[group]]
        yield pa.RecordBatch.from_arrays([pa.array(tbl[row], pa.string()), pa.array(who[row], pa.string()), pa.array(lo >> TILE), pa.array(lo), pa.array(level.astype(np.int32))], ["tbl", "owner", "tile", "lo", "level"])


def _tile_periods(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reduce side: sorted blocks of whole tiles to periods; ``edge`` marks a tile's first and last."""
    rest: pa.Table | None = None

    def done(t: pa.Table) -> pa.RecordBatch:
        t = t.combine_chunks()
        tbl, who, tile = (t[c].to_numpy(zero_copy_only=False) for c in ("tbl", "owner", "tile"))
        new = np.ones(len(tile), bool)
        new[1:] = (tbl[1:] != tbl[:-1]) | (who[1:] != who[:-1]) | (tile[1:] != tile[:-1])
        group = np.cumsum(new) - 1
        head = np.flatnonzero(new)
        group, lo, level = reduce_blocks(group, t["lo"].to_numpy(), t["level"].to_numpy().astype(np.int64))
        end = lo + (1 << level)
        start = np.ones(len(lo), bool)
        start[1:] = (group[1:] != group[:-1]) | (lo[1:] != end[:-1])
        s = np.flatnonzero(start)
        last = np.append(s[1:], len(lo)) - 1
        g = group[s]
        edge = np.ones(len(g), bool)
        edge[1:-1] = (g[1:-1] != g[:-2]) | (g[1:-1] != g[2:])
        # the gap to the next period of the same tile
        nxt = np.where(np.append(g[1:] == g[:-1], False), np.append(lo[s][1:], 0), -1)
        return pa.RecordBatch.from_arrays(
            [pa.array(tbl[head[g]], pa.string()), pa.array(who[head[g]], pa.string()), pa.array(lo[s]), pa.array(end[last]), pa.array(nxt), pa.array(edge)],
            ["tbl", "owner", "lo", "hi", "next_lo", "edge"],
        )

    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        t = pa.concat_tables([rest, t]) if rest is not None else t
        n = t.num_rows
        last = [t[c][n - 1] for c in ("tbl", "owner", "tile")]
        tail = pa.compute.and_(pa.compute.and_(pa.compute.equal(t["tbl"], last[0]), pa.compute.equal(t["owner"], last[1])), pa.compute.equal(t["tile"], last[2]))
        cut = n - pa.compute.sum(tail).as_py()  # rows are sorted, so the last group is the tail
        if cut:
            yield done(t.slice(0, cut))
        rest = t.slice(cut)
    if rest is not None and rest.num_rows:
        yield done(rest)


def tile_periods(intervals: DataFrame) -> DataFrame:
    """(tbl, owner, lo, hi) to periods per tile: (tbl, owner, lo, hi, next_lo, edge)."""
    blocks = intervals.select("tbl", "owner", "lo", "hi").mapInArrow(_split, "tbl string, owner string, tile long, lo long, level int")
    return blocks.repartition("tbl", "owner", "tile").sortWithinPartitions("tbl", "owner", "tile").mapInArrow(_tile_periods, "tbl string, owner string, lo long, hi long, next_lo long, edge boolean")


def periods_and_gaps(df: DataFrame, tbl: str | Column, owner: str, lo: str, hi: str) -> DataFrame:
    """Maximal periods of the union of ``[lo, hi)`` per owner, and the gaps between neighbouring periods.

    Returns (tbl, owner, kind, from_ms, to_ms), each row once. Rows with a null owner, a null end, a negative start or
    ``lo >= hi`` are ignored; so are repeated rows and any further columns of ``df``. Touching intervals are one
    period. An owner with a single period has no gap; an empty input gives an empty result.
    """
    tag = F.lit(tbl) if isinstance(tbl, str) else tbl
    x = df.select(tag.alias("tbl"), F.col(owner).alias("owner"), F.col(lo).cast("long").alias("lo"), F.col(hi).cast("long").alias("hi"))
    return between(x)


def between(x: DataFrame) -> DataFrame:
    """As :func:`periods_and_gaps`, of rows (tbl, owner, lo, hi) of any number of tables.

    Intervals of ``LONG`` tiles and more are rare. If there are any, their whole tiles become periods in a unit of one
    tile, by this same function; only their owners' periods are then put in one order.
    """
    x = x.where("tbl is not null and owner is not null and lo >= 0 and lo < hi")
    long = x.where(F.shiftright(F.col("hi") - F.col("lo"), TILE) >= LONG)
    if long.isEmpty():
        return _kinds(_joined(tile_periods(x)))
    from_tile, to_tile = F.shiftright(F.col("lo") + ((1 << TILE) - 1), TILE), F.shiftright("hi", TILE)
    inside = long.select("tbl", "owner", from_tile.alias("lo"), to_tile.alias("hi"))
    wide = between(inside).where("kind = 'period'").select("tbl", "owner", F.shiftleft("from_ms", TILE).alias("lo"), F.shiftleft("to_ms", TILE).alias("hi"))
    ends = F.array(F.struct("lo", F.shiftleft(from_tile, TILE).alias("hi")), F.struct(F.shiftleft(to_tile, TILE).alias("lo"), "hi"))
    ends = long.select("tbl", "owner", F.explode(ends).alias("e")).select("tbl", "owner", "e.lo", "e.hi").where("lo < hi")
    tiles = tile_periods(x.where(F.shiftright(F.col("hi") - F.col("lo"), TILE) < LONG).select("tbl", "owner", "lo", "hi").unionByName(ends))
    owners = wide.select("tbl", "owner").distinct()
    w = Window.partitionBy("tbl", "owner").orderBy("lo", "hi")
    mixed = tiles.join(owners, ["tbl", "owner"], "left_semi").select("tbl", "owner", "lo", "hi").unionByName(wide)
    mixed = mixed.withColumn("new", F.coalesce((F.col("lo") > F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))).cast("int"), F.lit(1))).withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    mixed = mixed.groupBy("tbl", "owner", "run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("run").withColumn("next", F.lead("lo").over(w))
    return _kinds(_joined(tiles.join(owners, ["tbl", "owner"], "left_anti")).unionByName(mixed))


def _joined(tiles: DataFrame) -> DataFrame:
    """Periods of tiles to whole ones: (tbl, owner, lo, hi, next), the start of the owner's next period."""
    # the edges of one owner are two per tile at most; periods that touch across a tile's border are one
    w = Window.partitionBy("tbl", "owner").orderBy("lo")
    edges = tiles.where("edge").withColumn("new", F.coalesce((F.lag("hi").over(w) != F.col("lo")).cast("int"), F.lit(1))).withColumn("after", F.lead("lo").over(w)).withColumn("run", F.sum("new").over(w))
    whole = edges.groupBy("tbl", "owner", "run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max_by(F.when(F.col("next_lo") >= 0, F.col("next_lo")).otherwise(F.col("after")), "lo").alias("next"))
    inner = tiles.where("not edge").select("tbl", "owner", "lo", "hi", F.col("next_lo").alias("next"))
    return whole.select("tbl", "owner", "lo", "hi", "next").unionByName(inner)


def _kinds(periods: DataFrame) -> DataFrame:
    kinds = F.array(F.struct(F.lit("period").alias("kind"), F.col("lo").alias("from_ms"), F.col("hi").alias("to_ms")), F.when(F.col("next") > F.col("hi"), F.struct(F.lit("gap").alias("kind"), F.col("hi").alias("from_ms"), F.col("next").alias("to_ms"))))
    return periods.select("tbl", "owner", F.explode(F.array_compact(kinds)).alias("x")).select("tbl", "owner", "x.kind", "x.from_ms", "x.to_ms")
