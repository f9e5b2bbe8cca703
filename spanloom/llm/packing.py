"""Items of varying size into containers of fixed capacity, by hierarchical residual packing.

Every task packs its own items best-fit, largest first. Containers that are nearly full are final. The underfull ones are
items of the next level, where eight tasks meet in one, up to a single task; a container is never opened again, only
joined with others as a whole, and only its name and size go up.

After best-fit no two containers of a task that are at most half full are left, so they are as few as the tasks. Any
join needs one of them. Of the others, those with the most room go up, as many as there are half-full ones of the box:
whatever can be joined with some others can be joined with these. So a task of a higher level has a few dozen items a
box at any number of items below.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.session import materialize

#: A container is final when at most this part of it is unused.
SLACK = 0.005
#: Partitions that meet in one at the next level.
FAN_IN = 8
#: Items a task of the first level packs, about.
TASK_ITEMS = 50_000

#: Boxes of different capacity, at most: they are part of the plan, not of the data.
MOST_BOXES = 1000

_ROW = "box string, capacity long, item string, bin string, used long, total long"
_SCHEMA = pa.schema([("box", pa.string()), ("capacity", pa.int64()), ("item", pa.string()), ("bin", pa.string()), ("used", pa.int64()), ("total", pa.int64())])


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Indices per container, best-fit with the largest items first; no size is above the capacity."""
    bins: list[list[int]] = []
    room: list[tuple[int, int]] = []  # (free, container), sorted
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        at = bisect_left(room, (sizes[i], -1))
        if at < len(room):
            free, b = room.pop(at)
        else:
            free, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        if free > sizes[i] or not sizes[i]:
            insort(room, (free - sizes[i], b))
    return bins


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(box, capacity, item, used) to each item's container, named by its first item, and what that holds in all."""
    by: dict[tuple[str, int], list[tuple[str, int]]] = {}
    for b in batches:
        for box, cap, item, used in zip(*(b[c].to_pylist() for c in ("box", "capacity", "item", "used"))):
            by.setdefault((box, cap), []).append((item, used))
    for (box, cap), held in by.items():
        held.sort()  # arrival order must not matter: a task that runs again gives the same containers
        out: list[tuple] = []
        for bin in best_fit([n for _, n in held], cap):
            total, name = sum(held[i][1] for i in bin), held[bin[0]][0]
            out += [(box, cap, held[i][0], name, held[i][1], total) for i in bin]
        for k in range(0, len(out), 20_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out[k : k + 20_000]), _SCHEMA)], schema=_SCHEMA)


def _upward(level: DataFrame, slack: float) -> DataFrame:
    """(box, capacity, item, used): the underfull containers that may still be joined, as items."""
    bins = level.where("item = bin").where(F.col("capacity") - F.col("total") > slack * F.col("capacity")).select("box", "capacity", F.col("bin").alias("item"), F.col("total").alias("used"))
    half = F.col("used") * 2 <= F.col("capacity")
    few = {(r.box, r.capacity): r.n for r in bins.where(half).groupBy("box", "capacity").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not few:
        return bins.where("false")
    w = Window.partitionBy("box", "capacity").orderBy("used", "item")
    hosts = bins.where(~half).withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= max(few.values()))
    most = F.coalesce(*[F.when((F.col("box") == b) & (F.col("capacity") == c), F.lit(n)) for (b, c), n in few.items()], F.lit(0))
    return bins.where(half).unionByName(hosts.where(F.col("nth") <= most).drop("nth"))


def pack(docs: DataFrame, boxes: DataFrame, slack: float = SLACK, task_items: int = TASK_ITEMS) -> DataFrame:
    """A container for every document of (doc_id, tokens), for each of (box, capacity).

    Returns (box, capacity, bin, doc_id, piece, from_token, tokens); ``bin`` names a container inside its box. A
    document larger than the capacity is cut into full containers and a rest, pieces 0, 1, ...; no other is cut. A
    document without tokens takes no room but gets a container. Rows with a null doc_id, and boxes with a null, zero
    or negative capacity, are left out; a box that stands twice counts once. Empty tables give an empty result.
    """
    boxes = boxes.select("box", F.col("capacity").cast("long").alias("capacity")).where("box is not null and capacity > 0").distinct()
    x = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("tokens").cast("long"), F.lit(0)).alias("tokens")).where("doc_id is not null")
    x = materialize(x, "sizes")
    # the few boxes become an array in each row
    few = boxes.orderBy("box", "capacity").limit(MOST_BOXES + 1).collect()
    if len(few) > MOST_BOXES:
        raise ValueError(f"more than {MOST_BOXES} boxes")
    held = F.array(*[F.struct(F.lit(b.box).alias("box"), F.lit(b.capacity).cast("long").alias("capacity")) for b in few]) if few else F.array().cast("array<struct<box:string,capacity:bigint>>")
    x = x.select("doc_id", "tokens", F.explode(held).alias("b")).select("doc_id", "tokens", "b.box", "b.capacity")
    x = x.withColumn("full", F.when(F.col("tokens") > F.col("capacity"), F.floor(F.col("tokens") / F.col("capacity"))).otherwise(F.lit(0)).cast("int"))
    name = lambda piece: F.concat_ws("-", "doc_id", piece)
    whole = x.where("full > 0").withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("full") - 1))).select("box", "capacity", name("piece").alias("bin"), "doc_id", "piece", (F.col("piece") * F.col("capacity")).alias("from_token"), F.col("capacity").alias("tokens"))
    rest = F.col("tokens") - F.col("full") * F.col("capacity")
    x = x.where((F.col("full") == 0) | (rest > 0))
    items = x.select("box", "capacity", name("full").alias("item"), rest.alias("used"))
    n = max(1, -(-items.count() // task_items))
    levels: list[DataFrame] = []
    while True:
        levels.append(materialize(items.repartition(n, "box", "item").mapInArrow(_pack, _ROW), "bins"))
        if n == 1:
            break
        items, n = _upward(levels[-1], slack), -(-n // FAN_IN)
    # from the top down: where the containers of each level have gone
    gone = None
    for level in reversed(levels[1:]):
        to = level.select("box", "capacity", "item", "bin")
        gone = to if gone is None else _follow(to, gone)
    first = levels[0].select("box", "capacity", "item", "bin", F.col("used").alias("tokens"))
    packed = first if gone is None else _follow(first, gone)
    part = F.split("item", "-(?=[0-9]+$)")
    packed = packed.select("box", "capacity", "bin", part[0].cast("long").alias("doc_id"), part[1].cast("int").alias("piece"), (part[1].cast("int") * F.col("capacity")).alias("from_token"), "tokens")
    return whole.unionByName(packed)


def _follow(items: DataFrame, gone: DataFrame) -> DataFrame:
    """Items with the container that theirs went into, if it went on."""
    on = gone.select("box", "capacity", F.col("item").alias("bin"), F.col("bin").alias("_to"))
    # never broadcast: how many go on depends on the number of tasks
    return items.join(on.hint("merge"), ["box", "capacity", "bin"], "left").withColumn("bin", F.coalesce("_to", "bin")).drop("_to")


def fill(packed: DataFrame) -> DataFrame:
    """Per box: containers, tokens, the least number of containers possible and the used part of the room."""
    bins = packed.groupBy("box", "capacity", "bin").agg(F.sum("tokens").alias("used"))
    return bins.groupBy("box", "capacity").agg(F.count(F.lit(1)).alias("bins"), F.sum("used").alias("tokens"), F.max("used").alias("fullest")).withColumn("least_bins", F.ceil(F.col("tokens") / F.col("capacity"))).withColumn("used_share", F.col("tokens") / (F.col("bins") * F.col("capacity")))
