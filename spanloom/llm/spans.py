"""Long exact spans shared between records, by prefix-partitioned suffix subtrees.

A span of ``least`` code points has ``least - PREFIX + 1`` windows of ``PREFIX`` code points; the one with the smallest
fingerprint is chosen by its content alone, so two records that share the span choose the same place in it. Only the
suffixes at chosen places are kept: this loses no span and leaves about one suffix in fifty (a tree of all suffixes would
move every text ``least`` times).

Suffixes are partitioned by a prefix of variable length. It begins as the ``PREFIX`` code points at the place. A prefix
held by one record alone is a leaf and is dropped before any text moves. A prefix held by more than ``GROUP_ROWS``
suffixes is made longer, in both directions by half of what a span still lacks: two suffixes that share a span agree on
at least one of the two longer prefixes, so none is lost. After at most seven rounds a prefix is a whole span, and
those who hold it need no tree.

The suffixes of a group, with what stands before them, are a subtree that fits into memory. It is read as a suffix
array: suffixes in order, with the length of the prefix that each shares with its neighbour. An internal node is a
stretch of the array whose neighbours share that much; where the texts before the suffixes are told apart the same way,
the nodes that are ``least`` deep in all are the maximal repeats, with their length and all their places.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.session import materialize

#: Code points of a suffix's prefix at first. At most half of a span.
PREFIX = 100
#: Suffixes of one prefix above which it is made longer: about 3 KB of memory each.
GROUP_ROWS = 20_000
#: Suffixes, in whole groups, that are read together.
TOGETHER = 4000
#: Records of a node that are paired in one row; larger nodes become rows of two blocks.
BLOCK = 512

_SUFFIX = "h long, doc_id long, pos int, last int, a int, b int"
_SUFFIX_SCHEMA = pa.schema([("h", pa.int64()), ("doc_id", pa.int64()), ("pos", pa.int32()), ("last", pa.int32()), ("a", pa.int32()), ("b", pa.int32())])
_NEAR_SCHEMA = pa.schema([("h", pa.int64()), ("doc_id", pa.int64()), ("pos", pa.int32()), ("last", pa.int32()), ("before", pa.string()), ("suffix", pa.string())])
_NEAR = "h long, doc_id long, pos int, last int, before string, suffix string"

_BASE = 0x9E3779B97F4A7C15
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> _U(33))
    x = x * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


class _Powers:
    """Powers of the base and of its inverse modulo 2**64, as far as needed so far."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def to(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            m = 1 << (n - 1).bit_length()
            cls.up = np.concatenate([[_U(1)], np.cumprod(np.full(m - 1, _BASE, np.uint64))])
            cls.down = np.concatenate([[_U(1)], np.cumprod(np.full(m - 1, pow(_BASE, -1, 1 << 64), np.uint64))])
        return cls.up[:n], cls.down[:n]


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _running(a: np.ndarray, w: int, best: np.ufunc, least: int) -> np.ndarray:
    """The best of every w neighbours, from running bests of blocks of w from either side."""
    n = len(a)
    padded = np.full(-(-n // w) * w, least, a.dtype)
    padded[:n] = a
    blocks = padded.reshape(-1, w)
    fore = best.accumulate(blocks, axis=1).ravel()
    back = best.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return best(back[: n - w + 1], fore[w - 1 : n])


def chosen(h: np.ndarray, w: int) -> np.ndarray:
    """Places that hold the smallest value of some w neighbours; of equal smallest values all."""
    if len(h) <= w:
        return np.flatnonzero(h == h.min())
    low = _running(h, w, np.minimum, np.iinfo(np.uint64).max)
    # no window's smallest is above a value in it, so a place is chosen if the largest of its windows' smallest is its own
    return np.flatnonzero(h == _running(np.concatenate([np.zeros(w - 1, np.uint64), low, np.zeros(w - 1, np.uint64)]), w, np.maximum, 0))


def _sums(p: np.ndarray) -> np.ndarray:
    """Weighted sums of the code points before each place, from which :func:`_stretch` makes fingerprints of any stretch."""
    total = np.zeros(len(p) + 1, np.uint64)
    np.cumsum(_mix(p.astype(np.uint64) + _U(1)) * _Powers.to(len(p) + 1)[0][: len(p)], out=total[1:])
    return total


def _stretch(total: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    return _mix((total[hi] - total[lo]) * _Powers.to(len(total))[1][lo])


def _runs_of(h: np.ndarray, at: np.ndarray, total: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, last) places: chosen places of one record whose whole surroundings are alike, less than PREFIX apart, are one.

    So a periodic text has few suffixes, however long it is.
    """
    last = at.copy()
    order = np.argsort(h[at], kind="stable")
    same = h[at[order[1:]]] == h[at[order[:-1]]]
    if not same.any():
        return at, last
    lo, hi = np.maximum(at - (least - PREFIX), 0), np.minimum(at + least, len(total) - 1)
    around = _stretch(total, lo, hi) ^ _mix((at - lo).astype(np.uint64) * _U(1 << 20) + (hi - at).astype(np.uint64))
    order = np.lexsort((at, around))
    new = np.concatenate([[True], (around[order[1:]] != around[order[:-1]]) | (at[order[1:]] - at[order[:-1]] > PREFIX)])
    first = np.flatnonzero(new)
    return at[order[first]], at[order[np.append(first[1:], len(order)) - 1]]


def _suffixes(least: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, d, p, q = [], [], [], []
            for doc, text in zip(b["doc_id"].to_pylist(), b["text"].to_pylist()):
                total = _sums(points(text))
                n = len(total) - PREFIX
                f = _stretch(total, np.arange(n), np.arange(n) + PREFIX)
                at, last = _runs_of(f, chosen(f, least - PREFIX + 1), total, least)
                h.append(f[at].view(np.int64))
                d.append(np.full(len(at), doc))
                p.append(at.astype(np.int32))
                q.append(last.astype(np.int32))
            if h:
                n = sum(map(len, h))
                yield pa.RecordBatch.from_arrays([*[pa.array(np.concatenate(x)) for x in (h, d, p, q)], pa.array(np.zeros(n, np.int32)), pa.array(np.full(n, PREFIX, np.int32))], schema=_SUFFIX_SCHEMA)

    return run


def _inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of suffixes sorted by prefix those whose prefix more than one record holds; holds back one record's rows at most."""
    held: pa.Table | None = None
    at, inner = None, False
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        t = (pa.concat_tables([held, t]) if held is not None else t).combine_chunks()
        h, d = t["h"].to_numpy(), t["doc_id"].to_numpy()
        cut = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        many = np.minimum.reduceat(d, cut) < np.maximum.reduceat(d, cut)
        many[0] |= inner and h[0] == at
        at, inner = h[-1], bool(many[-1])
        held = None if inner else t.slice(cut[-1])
        keep = np.flatnonzero(np.repeat(many, np.diff(np.append(cut, len(h)))))
        if len(keep):
            yield from t.take(pa.array(keep)).combine_chunks().to_batches()


def _longer(least: int):  # noqa: ANN202
    """(doc_id, text, at: suffixes) to the suffixes of the two longer prefixes of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for doc, text, at in zip(b["doc_id"].to_pylist(), b["text"].to_pylist(), b["at"].to_pylist()):
                total = _sums(points(text))
                for x in at:
                    more = (least - x["a"] - x["b"] + 1) // 2
                    for a_, b_ in ((x["a"], x["b"] + more), (x["a"] + more, x["b"])):
                        lo, hi = x["pos"] - a_, x["pos"] + b_
                        if lo >= 0 and hi < len(total):
                            h = _stretch(total, np.array([lo]), np.array([hi])) ^ _mix(np.array([a_ * 4096 + b_], np.uint64))
                            if a_ + b_ == least:  # no text is compared any more, so a second fingerprint guards the first
                                h ^= _U(int.from_bytes(hashlib.blake2b(text[lo:hi].encode("utf-8", "surrogatepass"), digest_size=8).digest()))
                            out.append((int(h.view(np.int64)[0]), doc, x["pos"], x["last"], a_, b_))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _SUFFIX_SCHEMA)], schema=_SUFFIX_SCHEMA)

    return run


def _near(least: int):  # noqa: ANN202
    """(doc_id, text, at: suffixes) to the suffixes with the text before them, read backward, and their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for doc, text, at in zip(b["doc_id"].to_pylist(), b["text"].to_pylist(), b["at"].to_pylist()):
                for x in at:
                    p = x["pos"]
                    out.append((x["h"], doc, p, x["last"], text[max(0, p - least + PREFIX) : p][::-1], text[p : p + least]))
                if len(out) > 8000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _NEAR_SCHEMA)], schema=_NEAR_SCHEMA)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _NEAR_SCHEMA)], schema=_NEAR_SCHEMA)

    return run


def _matrix(texts: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Code points in rows of ``width``, and the length of each."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    out = np.zeros((len(texts), width), np.uint32)
    out[np.arange(width) < size[:, None]] = points("".join(texts))
    return out, size


def _shared_with_last(m: np.ndarray, size: np.ndarray) -> np.ndarray:
    """How long a prefix each row shares with the row before it."""
    out = np.zeros(len(m), np.int64)
    if len(m) > 1:
        odd = m[1:] != m[:-1]
        first = np.where(odd.any(1), odd.argmax(1), m.shape[1])
        out[1:] = np.minimum(first, np.minimum(size[1:], size[:-1]))
    return out


class _Subtree:
    """Whole groups of suffixes in order, as a suffix array with shared lengths on both sides of the places."""

    def __init__(self, t: pa.Table, least: int) -> None:
        self.least, self.before = least, least - PREFIX
        h, self.doc = t["h"].to_numpy(), t["doc_id"].to_numpy()
        self.pos, self.last = t["pos"].to_numpy().astype(np.int64), t["last"].to_numpy().astype(np.int64)
        self.n = len(h)
        self.group = np.concatenate([[True], h[1:] != h[:-1]])
        self.right, size = _matrix(t["suffix"].to_pylist(), least)
        self.lcp = np.where(self.group, 0, _shared_with_last(self.right, size))
        texts, number = t["before"].to_pylist(), np.cumsum(self.group).tolist()
        self.order = np.array(sorted(range(self.n), key=lambda i: (number[i], texts[i])), np.int64)
        self.left, left_size = _matrix(texts, max(self.before, 1))
        self.left_lcp = np.where(self.group, 0, _shared_with_last(self.left[self.order], left_size[self.order]))
        self.size = (left_size, size)
        _, self.code = np.unique(self.doc, return_inverse=True)

    def nodes(self) -> Iterator[tuple[int, np.ndarray, bool]]:
        """(l, places, known) of every node that begins l code points before its places and is ``least`` deep, in two records or more.

        ``known`` tells that the same places came up with another l.
        """
        seen: set[int] = set()
        cls = np.empty(self.n, np.int64)
        stamp = _mix(np.arange(1, self.n + 1, dtype=np.uint64))
        for back in range(self.before + 1):
            node = np.cumsum(self.group | (self.lcp < self.least - back))
            if node[-1] == self.n:
                continue
            cls[self.order] = np.cumsum(self.group | (self.left_lcp < back))
            key = node * (self.n + 1) + cls
            order = np.argsort(key, kind="stable")
            key = key[order]
            cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            end = np.append(cut[1:], self.n)
            code = self.code[order]
            many = np.flatnonzero(np.minimum.reduceat(code, cut) < np.maximum.reduceat(code, cut))
            sums = np.add.reduceat(stamp[order], cut)[many].tolist()
            for c, s in zip(many.tolist(), sums):
                yield back, order[cut[c] : end[c]], s in seen
                seen.add(s)

    def repeat(self, rows: np.ndarray) -> tuple[int, int]:
        """How far the text of some places is the same before and from them on."""
        reach = lambda m, size: min(int(np.append((m[rows] != m[rows[0]]).any(0), True).argmax()), int(size[rows].min()))
        return reach(self.left, self.size[0]), reach(self.right, self.size[1])


_NODE = {
    "pairs": ("a array<long>, b array<long>", pa.schema([("a", pa.list_(pa.int64())), ("b", pa.list_(pa.int64()))])),
    "stretches": ("doc_id long, lo long, hi long", pa.schema([("doc_id", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64())])),
    "repeats": ("repeat string, doc_id long, at long, length long", pa.schema([("repeat", pa.string()), ("doc_id", pa.int64()), ("at", pa.int64()), ("length", pa.int64())])),
}


def _read(t: pa.Table, least: int, what: str) -> pa.RecordBatch:
    """The rows of ``_NODE[what]`` of whole groups."""
    x = _Subtree(t, least)
    cols: list[list] = [[] for _ in _NODE[what][1]]
    far, near = np.full(x.n, -1), np.full(x.n, least)
    for back, rows, known in x.nodes():
        if what == "stretches":
            far[rows] = np.maximum(far[rows], back)
            near[rows] = np.minimum(near[rows], back)
        elif known:  # one node, seen from places further back
            continue
        elif what == "pairs":
            d = np.unique(x.doc[rows])
            blocks = [d[i : i + BLOCK] for i in range(0, len(d), BLOCK)]
            for i, p in enumerate(blocks):
                for q in blocks[i:]:
                    cols[0].append(p)
                    cols[1].append(q)
        else:
            lo, hi = x.repeat(rows)
            starts = x.pos[rows] - lo
            name = hashlib.blake2b(x.right[rows[0], :hi].tobytes() + b"|" + x.left[rows[0], :lo].tobytes(), digest_size=12).hexdigest()
            for d, at in zip(x.doc[rows].tolist(), starts.tolist()):
                for c, v in zip(cols, (name, d, at, lo + hi)):
                    c.append(v)
    if what == "stretches":
        # windows of one place overlap, so its shared stretch is from the first shared window to the last
        at = np.flatnonzero(far >= 0)
        cols = [x.doc[at], x.pos[at] - far[at], x.last[at] - near[at] + least]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _NODE[what][1])], schema=_NODE[what][1])


def _subtrees(least: int, what: str):  # noqa: ANN202
    """Suffixes sorted by group and text, some whole groups at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            t = pa.concat_tables([rest, t]) if rest is not None else t
            h = t["h"].to_numpy()
            begins = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            done = 0
            for c in begins[1:]:
                if c - done >= TOGETHER or c == begins[-1]:
                    yield _read(t.slice(done, c - done).combine_chunks(), least, what)
                    done = int(c)
            rest = t.slice(done).combine_chunks()
        if rest is not None and rest.num_rows:
            yield _read(rest, least, what)

    return run


def _with_text(docs: DataFrame, suffixes: DataFrame) -> DataFrame:
    at = suffixes.groupBy("doc_id").agg(F.collect_list(F.struct("h", "pos", "last", "a", "b")).alias("at"))
    return docs.join(at, "doc_id")


def _groups(docs: DataFrame, least: int, group_rows: int) -> tuple[DataFrame, DataFrame | None]:
    """Suffixes in groups of at most ``group_rows``, and those of larger groups whose prefix is a whole span."""
    inner = lambda x: x.repartition("h").sortWithinPartitions("h").mapInArrow(_inner, _SUFFIX)
    kept = materialize(inner(docs.mapInArrow(_suffixes(least), _SUFFIX)), "suffixes")
    small, whole = None, None
    while True:
        large = kept.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > group_rows).select("h")
        if large.isEmpty():
            return kept if small is None else small.unionByName(kept), whole
        fits = kept.join(large, "h", "left_anti")
        small = fits if small is None else small.unionByName(fits)
        hot = kept.join(large, "h", "left_semi")
        ends = hot.where(F.col("a") + F.col("b") >= least)
        whole = ends if whole is None else whole.unionByName(ends)
        # one suffix may be reached over two ways
        longer = _with_text(docs, hot.where(F.col("a") + F.col("b") < least)).mapInArrow(_longer(least), _SUFFIX).distinct()
        kept = materialize(inner(longer), "suffixes")


def nodes(df: DataFrame, least: int = 200, what: str = "pairs", group_rows: int = GROUP_ROWS) -> tuple[DataFrame, DataFrame | None]:
    """The deep nodes of all subtrees as rows of ``_NODE[what]``, and the suffixes of groups that need no tree (or null)."""
    if least < 2 * PREFIX:
        raise ValueError(f"a span has at least {2 * PREFIX} code points")
    docs = df.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(f"doc_id is not null and length(text) >= {least}")
    small, whole = _groups(docs, least, group_rows)
    near = _with_text(docs, small).mapInArrow(_near(least), _NEAR)
    return near.repartition("h").sortWithinPartitions("h", "suffix").mapInArrow(_subtrees(least, what), _NODE[what][0]), whole


def pairs(df: DataFrame, least: int = 200, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Pairs (doc_a, doc_b), doc_a < doc_b, of records that share a verbatim span of ``least`` or more code points.

    Null ids, null texts and shorter texts are in no pair; repeats inside a record don't count, nor do rows delivered
    twice (same id). Further columns are ignored; an empty input gives an empty result.
    """
    found, whole = nodes(df, least, "pairs", group_rows)
    # a node's blocks are sorted, so the smaller id is in the first
    x = found.select(F.explode("a").alias("doc_a"), "b").select("doc_a", F.explode("b").alias("doc_b"))
    if whole is not None:
        # blocks of a large group meet two by two, each pair of blocks in one task
        d = whole.select("h", "doc_id").distinct()
        d = d.join(d.groupBy("h").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("n")), "h").withColumn("mine", F.pmod(F.xxhash64("doc_id"), "n").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
        side = lambda c: d.select("h", F.col("doc_id").alias(c), F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"))
        x = x.unionByName(side("doc_a").join(side("doc_b"), ["h", "i", "j"]).select("doc_a", "doc_b"))
    return x.where("doc_a < doc_b").distinct()


def shares(df: DataFrame, least: int = 200, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Per record with a shared span: (doc_id, spans, shared_chars), the code points covered by spans found elsewhere.

    Spans that overlap or touch are one. Records without any are left out; nulls and repeats as in :func:`pairs`. No
    pair of records is made.
    """
    x, whole = nodes(df, least, "stretches", group_rows)
    if whole is not None:
        x = x.unionByName(whole.select("doc_id", (F.col("pos") - F.col("a")).cast("long").alias("lo"), (F.col("last") - F.col("a") + least).cast("long").alias("hi")))
    x = x.distinct()
    w = Window.partitionBy("doc_id").orderBy("lo", "hi")
    reach = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    x = x.withColumn("reach", reach).withColumn("more", F.greatest(F.lit(0), F.col("hi") - F.greatest("lo", F.coalesce("reach", "lo"))))
    return x.groupBy("doc_id").agg(F.count_if(F.col("reach").isNull() | (F.col("lo") > F.col("reach"))).alias("spans"), F.sum("more").alias("shared_chars"))


def repeats(df: DataFrame, least: int = 200, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Maximal repeats held by two records or more: (repeat, doc_id, at, length), a row for each place.

    ``repeat`` is the same for all places of one repeat; linking each place to its repeat instead of to all others keeps
    the rows in proportion to the places. A repeat is followed ``least - PREFIX`` code points back and ``least`` on from
    each chosen place, so a longer one is a chain of repeats that overlap. Nulls as in :func:`pairs`.
    """
    x, whole = nodes(df, least, "repeats", group_rows)
    if whole is not None:
        x = x.unionByName(whole.select(F.lower(F.hex("h")).alias("repeat"), "doc_id", (F.col("pos") - F.col("a")).cast("long").alias("at"), (F.col("last") - F.col("pos") + least).cast("long").alias("length")))
    return x.distinct()
