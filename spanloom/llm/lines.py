"""Runs of one line repeated by consecutive events.

Events are read in order inside chunks of an entity's time line, so a hot entity is many tasks and no task is larger
than a chunk. In a chunk the positions of run starts form a sorted array, every event finds its run by binary search in
it, and runs are aggregated. Only the first and last run of a chunk can go on in the neighbouring chunk; these few rows
are joined by a window per entity.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Length of a chunk of an entity's time line, in milliseconds.
CHUNK_MS = 600_000

_APOSTROPHES = re.compile("['’‘ʼ＇´`]")
_WORDS = re.compile(r"[^\W_]+")
_ONE_SCRIPT = re.compile(r"(?:[A-Za-zÀ-ɏḀ-ỿ]+|[Ѐ-ԯ]+)\Z")


def folded(text: str) -> str:
    """The words of a line, blank between them: without case, accents, punctuation, width and apostrophes."""
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text.translate(_EARLY))
        text = "".join([c for c in text if not unicodedata.combining(c)]) if not text.isascii() else text
    return " ".join(_WORDS.findall(_APOSTROPHES.sub("", text).casefold()))


# an accent alone decomposes to a blank and a mark, which would cut a word
_EARLY = {ord(c): "'" for c in "´`＇‘’ʼ"}


def one_letter(a: str, b: str) -> bool:
    """One letter added, dropped or replaced, or two neighbours swapped."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    if len(a) < len(b):
        return a[i:] == b[i + 1 :]
    return a[i + 1 :] == b[i + 1 :] or (i + 1 < len(a) and a[i] == b[i + 1] and a[i + 1] == b[i] and a[i + 2 :] == b[i + 2 :])


def same_line(a: str, b: str) -> bool:
    """Whether two folded lines are one line: equal without blanks, or alike in all words but one misspelt one."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1 + max(a.count(" "), b.count(" ")):
        return False
    if a.replace(" ", "") == b.replace(" ", ""):
        return True
    x, y = a.split(), b.split()
    if len(x) != len(y):
        return False
    odd = [(p, q) for p, q in zip(x, y) if p != q]
    if len(odd) != 1:
        return False
    p, q = odd[0]
    return max(len(p), len(q)) >= 5 and bool(_ONE_SCRIPT.match(p)) and bool(_ONE_SCRIPT.match(q)) and one_letter(p, q)


_PIECE = "owner string, chunk long, run int, edge boolean, first_id string, last_id string, n long, start_ms long, end_ms long, first_line string, last_line string"


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rest: pa.Table | None = None

    def done(t: pa.Table) -> pa.RecordBatch | None:
        owner, chunk, ids, start, end = (t[c].to_numpy() if c in ("chunk", "start_ms") else t[c].to_numpy(zero_copy_only=False) for c in ("owner", "chunk", "id", "start_ms", "end_ms"))
        line = [folded(x) for x in t["text"].to_pylist()]
        keep = np.fromiter((bool(x) for x in line), bool, len(line))
        # delivered twice: neighbours in the order with the same id and place
        keep[1:] &= ~((ids[1:] == ids[:-1]) & (owner[1:] == owner[:-1]) & (start[1:] == start[:-1]))
        at = np.flatnonzero(keep)
        if not len(at):
            return None
        owner, chunk, ids, start, end = owner[at], chunk[at], ids[at], start[at], end[at]
        line = [line[i] for i in at]
        head = np.ones(len(at), bool)
        head[1:] = (owner[1:] != owner[:-1]) | (chunk[1:] != chunk[:-1])
        begins = np.flatnonzero(head | np.fromiter((i == 0 or not same_line(line[i - 1], x) for i, x in enumerate(line)), bool, len(line)))
        run = np.searchsorted(begins, np.arange(len(at)), side="right") - 1
        last = np.append(begins[1:], len(at)) - 1
        # an unknown or impossible end counts as the start
        stop = np.maximum(np.where(np.isnan(end.astype(float)), start, end.astype(float)).astype(np.int64), start)
        tops = np.full(len(begins), np.iinfo(np.int64).min)
        np.maximum.at(tops, run, stop)
        edge = head[begins].copy()
        edge[:-1] |= head[begins][1:]
        edge[-1] = True
        pick = edge | (last > begins)
        b, e = begins[pick], last[pick]
        return pa.RecordBatch.from_arrays(
            [pa.array(owner[b], pa.string()), pa.array(chunk[b]), pa.array(np.flatnonzero(pick).astype(np.int32)), pa.array(edge[pick]), pa.array(ids[b], pa.string()), pa.array(ids[e], pa.string()), pa.array(e - b + 1), pa.array(start[b]), pa.array(tops[pick]),
             pa.array([line[i] if h else None for i, h in zip(b, edge[pick])], pa.string()), pa.array([line[i] if h else None for i, h in zip(e, edge[pick])], pa.string())],
            [x.split()[0] for x in _PIECE.split(", ")],
        )

    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        t = pa.concat_tables([rest, t]) if rest is not None else t
        n = t.num_rows
        tail = pa.compute.and_(pa.compute.equal(t["owner"], t["owner"][n - 1]), pa.compute.equal(t["chunk"], t["chunk"][n - 1]))
        cut = n - pa.compute.sum(tail).as_py()
        if cut and (out := done(t.slice(0, cut))) is not None:
            yield out
        rest = t.slice(cut)
    if rest is not None and rest.num_rows and (out := done(rest)) is not None:
        yield out


@F.pandas_udf(T.BooleanType())
def _same(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([isinstance(x, str) and isinstance(y, str) and same_line(x, y) for x, y in zip(a, b)], dtype=bool)


def runs(df: DataFrame, owner: Column, chunk_ms: int = CHUNK_MS) -> DataFrame:
    """Maximal runs of two or more consecutive events with one line, per owner.

    ``df`` has (id, start_ms, end_ms, text); the order is start_ms, end_ms (null first), id. Returns (owner, first_id,
    last_id, n, start_ms, end_ms, duration_ms): from the first event's start to the furthest known end.

    Rows with a null owner, id, start or text, or without any letter or digit, are left out first; a row delivered
    twice counts once; an unknown or impossible end counts as the event's start. Further columns are ignored. An empty
    input gives an empty result.
    """
    x = df.select(owner.alias("owner"), "id", F.col("start_ms").cast("long").alias("start_ms"), F.col("end_ms").cast("long").alias("end_ms"), "text").where("owner is not null and id is not null and start_ms is not null and text is not null")
    x = x.withColumn("chunk", F.floor(F.col("start_ms") / chunk_ms))
    pieces = x.repartition("owner", "chunk").sortWithinPartitions("owner", "chunk", "start_ms", "end_ms", "id").mapInArrow(_runs, _PIECE)
    w = Window.partitionBy("owner").orderBy("chunk", "run")
    e = pieces.where("edge").withColumn("before", F.lag("last_line").over(w))
    # two runs of one chunk are two runs, whatever stands between them
    e = e.withColumn("new", F.when((F.lag("chunk").over(w) < F.col("chunk")) & _same("before", "first_line"), 0).otherwise(1)).withColumn("island", F.sum("new").over(w))
    joined = e.groupBy("owner", "island").agg(F.min_by("first_id", F.struct("chunk", "run")).alias("first_id"), F.max_by("last_id", F.struct("chunk", "run")).alias("last_id"), F.sum("n").alias("n"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))
    cols = ["owner", "first_id", "last_id", "n", "start_ms", "end_ms"]
    return joined.where("n > 1").select(*cols).unionByName(pieces.where("not edge").select(*cols)).withColumn("duration_ms", F.col("end_ms") - F.col("start_ms"))
