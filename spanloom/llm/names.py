"""Variant spellings of one person, place or organisation, by a pigeonhole segment join.

A name is read into words. A word with at most k errors, cut into k + 1 segments, has one of them unharmed; so every
word's segments stand in an inverted index, and every word is looked up by its substrings at shifted places, only at
those where k errors can have put the segment. A key also holds the initial of the name's other word, so that a
frequent given name alone brings no pair together; names run together stand in the index too. Pairs that
share a key are verified by banded edit distance word by word, with nicknames, initials and the renderings as further
evidence. Strong links make components; a name that leaves open whom it means - a surname alone, an initial, letters
of an organisation - joins a component only if it fits no other.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.session import materialize, unsent

# Words that say nothing about whom a name means, and kinds of organisations with their short forms.
TITLES = frozenset("mr mrs ms miss mx dr prof professor capt captain sgt sergeant lt col gen maj sir lady lord rev fr sr jr m mme mlle hr herr frau don dona the".split())
KINDS = {
    "co": "company", "comp": "company", "company": "company", "ltd": "limited", "limited": "limited", "inst": "institute", "institute": "institute", "bros": "brothers", "brothers": "brothers",
    "assn": "association", "assoc": "association", "ass": "association", "association": "association", "inc": "incorporated", "incorporated": "incorporated", "corp": "corporation", "corporation": "corporation",
    "soc": "society", "society": "society", "grp": "group", "group": "group", "fdn": "foundation", "foundation": "foundation", "univ": "university", "university": "university", "dept": "department", "department": "department",
    "intl": "international", "international": "international", "mfg": "manufacturing", "manufacturing": "manufacturing", "hosp": "hospital", "hospital": "hospital", "lab": "laboratory", "labs": "laboratory", "laboratory": "laboratory", "works": "works", "union": "union", "club": "club", "council": "council", "trust": "trust", "agency": "agency", "bureau": "bureau", "office": "office", "school": "school", "college": "college", "museum": "museum", "theatre": "theatre", "theater": "theatre", "press": "press", "bank": "bank", "lines": "lines", "line": "lines",
}
_LEFT_OUT = frozenset("and of de la le et und y e".split())
_FINAL = re.compile(r"[’'`´]s?$", re.I)
_SPLIT = re.compile(r"[\s,&+/\-‐–—·_]+")
_OTHER = re.compile(r"[^\w]+")
_PARTS = re.compile(r"[\s·・‧=\-‐•]+")
_RENDER = re.compile(r"\(.*?\)|（.*?）|[\W_]+")


def fold(s: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c)).casefold()


def rendering(s: str | None) -> str:
    return _RENDER.sub("", unicodedata.normalize("NFKC", s)) if s else ""


def parts(s: str | None) -> list[str]:
    """A rendering's parts, where it shows them."""
    return [x for x in (rendering(p) for p in _PARTS.split(unicodedata.normalize("NFKC", s))) if x] if s else []


def _apart(a: list[str], b: list[str], i: int) -> bool:
    """Whether two renderings of two parts differ wholly in part i."""
    if len(a) != 2 or len(b) != 2:
        return False
    n = max(len(a[i]), len(b[i]))
    return distance(a[i], b[i], n) > 0.7 * n


def words_of(source: str) -> tuple[list[str], bool]:
    """The words that tell whom a name means, a trailing full stop kept for a shortened one; whether it is letters only."""
    s = source.strip()
    s = _FINAL.sub("", s)
    raw = [w for w in _SPLIT.split(s) if w]
    caps = len(raw) == 1 and raw[0].isupper() and 2 <= len(raw[0].replace(".", "")) <= 5
    out = []
    for w in raw:
        w = _FINAL.sub("", w)
        short = w.endswith(".")
        w = _OTHER.sub("", fold(w))
        if not w or w in _LEFT_OUT or (w in TITLES and len(raw) > 1):
            continue
        if w in KINDS and out:
            w, short = KINDS[w], False
        out.append(w + "." * (short or len(w) == 1))
    if "," in s and len(out) == 2 and out[1].rstrip(".") not in KINDS.values():
        out = out[::-1]
    if len(out) > 2 and not any(w in KINDS.values() for w in out):
        inner = [w for w in out[1:-1] if len(w) > 2 or not w.endswith(".")]
        out = [out[0], *inner, out[-1]]
    return out, caps


def errors_for(n: int) -> int:
    """Errors allowed in a word of n letters."""
    return 0 if n < 4 else 1 if n < 9 else 2


@lru_cache(maxsize=200_000)
def distance(a: str, b: str, most: int) -> int:
    """Letters added, dropped, replaced or swapped with a neighbour, in a band of ``most`` diagonals; most + 1 if more."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    far = most + 1
    before, last = None, {j: j for j in range(min(len(b), most) + 1)}
    for i in range(1, len(a) + 1):
        now = {}
        for j in range(max(0, i - most), min(len(b), i + most) + 1):
            if j == 0:
                now[0] = i
                continue
            d = min(last.get(j, far) + 1, now.get(j - 1, far) + 1, last.get(j - 1, far) + (a[i - 1] != b[j - 1]))
            if before is not None and i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d = min(d, before.get(j - 2, far) + 1)
            now[j] = d
        if min(now.values(), default=far) > most:
            return far
        before, last = last, now
    return min(last.get(len(b), far), far)


@lru_cache(maxsize=10_000)
def _segments(n: int, k: int) -> list[tuple[int, int]]:
    """Where the k + 1 segments of a word of n letters begin and end, the longer ones last."""
    size, more = divmod(n, k + 1)
    ends = [size * (i + 1) + max(0, i - (k - more)) for i in range(k + 1)]
    return list(zip([0, *ends], ends))


def _swapped(w: str, at: int) -> str:
    """The word with the letters on either side of the place ``at`` swapped."""
    return w[: at - 1] + w[at] + w[at - 1] + w[at + 1 :] if 0 < at < len(w) else w


@lru_cache(maxsize=10_000)
def _bounds(n: int) -> set[int]:
    """Errors allowed between a word of n letters and one as long or longer."""
    return {errors_for(m) for m in range(n, n + 3) if m - n <= errors_for(m)}


@lru_cache(maxsize=100_000)
def index_keys(w: str) -> tuple[str, ...]:
    """Segments under which a word stands in the index, for each number of errors that a longer word may bring.

    Two neighbours swapped over a border of segments harm both. So the word also stands there with the letters at a
    border swapped: then that error is none, and the others leave one segment unharmed.
    """
    out: dict[str, None] = {}
    n = len(w)
    for k in _bounds(n):
        cut = _segments(n, k)
        for v in [w, *(_swapped(w, at) for at, _ in cut[1:])]:
            out |= dict.fromkeys(f"{n}.{k}.{i}.{v[a:b]}" for i, (a, b) in enumerate(cut))
    return tuple(out)


@lru_cache(maxsize=100_000)
def probe_keys(w: str, longer: bool = False) -> tuple[str, ...]:
    """Keys under which a word within the allowed errors of w stands in the index, if it is as long or shorter; with ``longer`` any.

    Of k errors, with i in the segments before the i-th and the rest behind it, at most i shift it from the left and
    k - i from the right; some unharmed segment always lies within both bounds.
    """
    out: dict[str, None] = {}
    for n in range(max(1, len(w) - 2), len(w) + 3 * longer + (not longer)):
        k = errors_for(max(n, len(w)))
        if abs(n - len(w)) > k:
            continue
        for i, (a, b) in enumerate(_segments(n, k)):
            lo, hi = max(0, a - i, a + len(w) - n - (k - i)), min(len(w) - (b - a), a + i, a + len(w) - n + (k - i))
            out |= dict.fromkeys(f"{n}.{k}.{i}.{w[p : p + b - a]}" for p in range(lo, hi + 1))
    return tuple(out)


def keys_of(words: list[str], caps: bool, nick: dict[str, list[str]]) -> tuple[list[str], list[str]]:
    """(index, probe) keys of a name. Of two names the one whose word is longer finds the other."""
    bare = [w.rstrip(".") for w in words]
    long = [i for i, w in enumerate(bare) if len(w) >= 3 and not (words[i].endswith(".") and len(w) < 4)]
    joined = "".join(bare)
    ix, px = set(), set()
    if len(joined) >= 4:
        # run together, in either order
        for v in {joined, "".join(bare[::-1])}:
            ix.update(f"c{k}" for k in index_keys(v))
        px.update(f"c{k}" for k in probe_keys(joined))
    if len(bare) == 1:
        px.update(f"l{k}" for k in probe_keys(joined, longer=True))
        if 2 <= len(joined) <= 5:
            px.add(f"a{joined}")
    else:
        for i in long:
            ks = index_keys(bare[i])
            ix.update(f"l{k}" for k in ks)
            others = [w for j, w in enumerate(bare) if j != i]
            first = {w[0] for w in others} | {f[0] for w in others for f in nick.get(w, ())}
            ix.update(f"{c}:{k}" for k in ks for c in first)
            px.update(f"{c}:{k}" for k in probe_keys(bare[i]) for c in first)
        if len(bare) >= 3:
            ix.add("a" + "".join(w[0] for w in bare))
    return list(ix), list(px)


def _alike(a: str, b: str, nick: dict[str, list[str]]) -> float:
    """How well two words agree: 1 alike, 0.9 nickname, 0.8 misspelt, 0.5 initial or shortened, 0 not."""
    x, y = a.rstrip("."), b.rstrip(".")
    if x == y:
        return 1.0 if len(x) > 1 else 0.5
    short, long = (x, y) if len(x) <= len(y) else (y, x)
    dotted = (a if len(x) <= len(y) else b).endswith(".")
    if dotted and long.startswith(short) or len(short) == 1 and long[0] == short:
        return 0.5
    fx, fy = {x, *nick.get(x, ())}, {y, *nick.get(y, ())}
    if (x in nick or y in nick) and (x in fy or y in fx or (x in nick and y in nick and fx & fy - {x, y})):
        return 0.9
    if dotted and any(f.startswith(short) for f in nick.get(long, ())):
        return 0.5
    k = errors_for(max(len(x), len(y)))
    if k and distance(x, y, k) <= k:
        return 0.8
    # a misspelt nickname's formal name
    for f in (*nick.get(x, ()), *nick.get(y, ())):
        o = y if x in nick else x
        if distance(f, o, 1) <= 1 and len(o) >= 5:
            return 0.8
    return 0.0


def _renders(a: str, b: str) -> float | None:
    """Likeness of two renderings from 0 to 1; None if one is unknown."""
    if not a or not b:
        return None
    n = max(len(a), len(b))
    return 1 - distance(a, b, n) / n


def link(a: list[str], a_caps: bool, ra: str | None, b: list[str], b_caps: bool, rb: str | None, nick: dict[str, list[str]], told: bool = False) -> int:
    """2 the same, 1 the same if nobody else fits, 0 not the same. ``told``: another table calls one a variant of the other."""
    pa_, pb_ = parts(ra), parts(rb)
    ra, rb = rendering(ra), rendering(rb)
    r = _renders(ra, rb)
    part = bool(ra and rb) and (ra.endswith(rb) or rb.endswith(ra) or ra.startswith(rb) or rb.startswith(ra)) and min(len(ra), len(rb)) >= 2
    ja, jb = "".join(a).replace(".", ""), "".join(b).replace(".", "")
    kinds = set(KINDS.values())
    oa, ob = [w for w in a if w in kinds], [w for w in b if w in kinds]
    if ja == jb and not (len(a) > 1 and len(b) > 1 and r is not None and r < 0.3):
        return 2
    if len(a) == len(b) == 1:
        if a_caps != b_caps and (len(ja) < 4 or len(jb) < 4):
            return 0
        k = errors_for(max(len(ja), len(jb)))
        return 2 if k and distance(ja, jb, k) <= k and (r is None or r >= 0.5) else 0
    if oa or ob or len(a) > 2 and len(b) > 2:
        if len(a) == 1 or len(b) == 1:
            one, many = (ja, b) if len(a) == 1 else (jb, a)
            if one == "".join(w[0] for w in many):
                return 2 if told or r is not None and r > 0.8 else 1
            return 1 if _alike(one, many[0], nick) >= 0.8 and (r or 0) > 0.8 else 0
        if oa and ob and oa != ob or len(a) != len(b):
            if not (abs(len(a) - len(b)) == 1 and (r or 0) > 0.8 and all(any(_alike(x, y, nick) >= 0.5 for y in (b if len(a) < len(b) else a)) for x in (a if len(a) < len(b) else b))):
                return 0
            return 2
        # in order, or with the parts in another one
        s = max(([_alike(x, y, nick) for x, y in zip(p, q)] for p, q in ((a, b), (sorted(a), sorted(b)))), key=min)
        return 2 if min(s) >= 0.5 and sum(x < 1 for x in s) <= 2 and (r is None or r >= 0.4) else 0
    if len(a) == 1 or len(b) == 1:
        one, many = (a[0], b) if len(a) == 1 else (b[0], a)
        # run together with a missing blank
        if distance(ja, jb, 1) <= 1 and (min(len(ja), len(jb)) >= 8 or min(len(ja), len(jb)) >= 5 and (r or 0) > 0.8):
            return 2 if r is None or r >= 0.5 else 0
        if _alike(one, many[-1], nick) >= 0.8 and len(one.rstrip(".")) >= 3:
            return 1 if r is None or part or r >= 0.3 else 0
        return 1 if _alike(one, many[0], nick) >= 0.9 and len(one.rstrip(".")) >= 3 and (r is not None and (part or r >= 0.6)) else 0
    best = 0
    for x, y in ((a, b), (a, b[::-1])):
        g, s = _alike(x[0], y[0], nick), _alike(x[-1], y[-1], nick)
        if r is not None and r >= 0.75 and max(g, s) >= 0.9 and min(g, s) == 0:
            # two errors, one in either spelling, with one rendering
            o, e = (x[-1], y[-1]) if g >= 0.9 else (x[0], y[0])
            if min(len(o), len(e)) >= 6 and distance(o, e, 2) <= 2:
                g, s = max(g, 0.8), max(s, 0.8)
        # misspelt, or another one's name: the part of the rendering tells
        if s == 0.8 and _apart(pa_, pb_, 1) or g == 0.8 and _apart(pa_, pb_, 0):
            continue
        if s >= 0.8 and g >= 0.8 and (s == 1 or g >= 0.9 or r is None or r >= 0.5) and (r is None or r >= 0.35 or s == 1 and g == 1 and r >= 0.3):
            best = 2
        elif min(s, g) == 0.5 and max(s, g) >= 0.8:
            if r is not None and r >= 0.75:
                best = 2
            elif r is None or r >= 0.4 or part:
                best = max(best, 1)
        # one rendering holds the surname alone
        elif s >= 0.8 and g >= 0.8 and part:
            best = 2
    return 2 if best == 1 and told else best


_LISTS = pa.list_(pa.string())


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        read = [words_of(x) for x in b["source"].to_pylist()]
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array([w for w, _ in read], _LISTS), pa.array([c for _, c in read], pa.bool_())], [*b.schema.names, "words", "caps"])


def _keys(nick: dict[str, list[str]]):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = [keys_of(w, c, nick) if w else ([], []) for w, c in zip(b["words"].to_pylist(), b["caps"].to_pylist())]
            yield pa.RecordBatch.from_arrays([b["m"], b["target"], b["node"], pa.array([i for i, _ in keys], _LISTS), pa.array([p for _, p in keys], _LISTS)], ["m", "target", "node", "ix", "px"])

    return run


def _verify(nick: dict[str, list[str]]):  # noqa: ANN202
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            kind = [link(list(aw), ac, ar, list(bw), bc, br, nick, t) for aw, ac, ar, bw, bc, br, t in zip(x["aw"], x["ac"], x["ar"], x["bw"], x["bc"], x["br"], x["told"])]
            out = x[["a", "b"]].assign(kind=kind)
            yield out[out["kind"] > 0]

    return run


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, comp): the smallest node reachable over links (a, b), by label propagation with written steps."""
    both = materialize(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    label = materialize(nodes.select("node", F.col("node").alias("comp")), "labels")
    while True:
        near = both.join(unsent(label.withColumnRenamed("node", "b")), "b").groupBy("a").agg(F.min("comp").alias("least"))
        step = label.join(unsent(near), label["node"] == near["a"], "left").select("node", F.least("comp", F.coalesce("least", "comp")).alias("next"), "comp")
        # a label's own label is as good: halves the rounds
        jump = label.select(F.col("node").alias("next"), F.col("comp").alias("over"))
        step = materialize(step.join(unsent(jump), "next").select("node", F.least("next", "over").alias("comp"), F.col("comp").alias("was")), "labels")
        if not step.where("comp <> was").limit(1).count():
            return step.select("node", "comp")
        label = step.select("node", "comp")


def nickname_map(nicknames: DataFrame, most: int = 20_000) -> dict[str, list[str]]:
    """Short form to formal names, folded. The table is of fixed size; a larger one than ``most`` rows is refused."""
    rows = nicknames.where("nick is not null and formal is not null").select("nick", "formal").distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} nicknames")
    out: dict[str, list[str]] = {}
    for r in sorted(rows):
        out.setdefault(fold(r.nick.strip()), []).append(fold(r.formal.strip()))
    return out


def same_names(glossary: DataFrame, media: Column, contexts: DataFrame, context_media: Column, nicknames: DataFrame) -> DataFrame:
    """(seq, comp): rows of one comp have the same media key and target and name the same one.

    ``glossary`` has (seq, target, source, rendering), ``contexts`` (target, variants), ``nicknames`` (nick, formal).
    Rows without seq, media key or target, or without a word in their source, are left out; a row delivered twice
    counts once. A null rendering is no evidence. Empty tables give an empty result.
    """
    nick = nickname_map(nicknames)
    # of rows with one seq that differ, the first in their order counts
    rows = glossary.select("seq", media.alias("m"), "target", F.trim("source").alias("source"), "rendering").where("seq is not null and m is not null and target is not null and source rlike '[\\\\p{L}\\\\p{N}]'")
    rows = rows.groupBy("seq").agg(F.min(F.struct("m", "target", "source", "rendering")).alias("r")).select("seq", "r.*")
    rows = materialize(rows, "rows")
    # rows that are alike in all respects are one node; spread by name, not by film
    nodes = rows.groupBy("m", "target", "source", "rendering").agg(F.min("seq").alias("node"))
    read = materialize(nodes.mapInArrow(_read, "m string, target string, source string, rendering string, node long, words array<string>, caps boolean"), "names")
    # a key of film, target and segment is a number: few bytes are moved for each
    keys = read.select("m", "target", "node", "words", "caps").mapInArrow(_keys(nick), "m string, target string, node long, ix array<string>, px array<string>")
    keyed = lambda c: keys.select("node", F.explode(c).alias("k"), "m", "target").select(F.xxhash64("m", "target", "k").alias("key"), "node")
    pairs = keyed("ix").withColumnRenamed("node", "a").join(unsent(keyed("px").withColumnRenamed("node", "b")), "key").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.lit(False).alias("told"))
    said = contexts.select(context_media.alias("m"), "target", F.explode("variants").alias("x", "y")).where("m is not null and x is not null and y is not null").distinct()
    fold_case = lambda c: F.lower(F.trim(c))
    named = read.select("m", "target", fold_case("source").alias("s"), "node")
    told = said.withColumn("s", fold_case("x")).join(unsent(named.withColumnRenamed("node", "p")), ["m", "target", "s"]).drop("s").withColumn("s", fold_case("y")).join(unsent(named.withColumnRenamed("node", "q")), ["m", "target", "s"])
    told = told.where("p <> q").select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), F.lit(True).alias("told"))
    pairs = pairs.unionByName(told).groupBy("a", "b").agg(F.max("told").alias("told"))
    side = lambda p: read.select(F.col("node").alias(p), F.struct("m", "target").alias(p + "m"), F.col("words").alias(p + "w"), F.col("caps").alias(p + "c"), F.col("rendering").alias(p + "r"))
    links = materialize(pairs.join(unsent(side("a")), "a").join(unsent(side("b")), "b").where("am = bm").drop("am", "bm").mapInPandas(_verify(nick), T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("kind", T.LongType())])), "kinds")
    comp = components(read, links.where("kind = 2"))
    # weak links between components: one joins another if it leans on that one only, and is vague throughout
    vague = read.select("node", ((F.size("words") == 1) | F.exists("words", lambda w: F.length(F.rtrim(w, F.lit("."))) == 1) | F.exists("words", lambda w: F.endswith(w, F.lit(".")))).alias("vague"))
    c = comp.join(unsent(vague), "node")
    whole = c.groupBy("comp").agg(F.min("vague").alias("vague"))
    w = links.where("kind = 1").select("a", "b").join(unsent(comp.select(F.col("node").alias("a"), F.col("comp").alias("ca"))), "a").join(unsent(comp.select(F.col("node").alias("b"), F.col("comp").alias("cb"))), "b").where("ca <> cb").select("ca", "cb").distinct()
    w = w.unionByName(w.select(F.col("cb").alias("ca"), F.col("ca").alias("cb"))).distinct()
    w = w.join(unsent(whole.select(F.col("comp").alias("ca"), F.col("vague").alias("va"))), "ca").join(unsent(whole.select(F.col("comp").alias("cb"), F.col("vague").alias("vb"))), "cb").where("va and not vb")
    only = w.groupBy("ca").agg(F.min("cb").alias("to"), F.count(F.lit(1)).alias("n")).where("n = 1")
    final = comp.join(unsent(only.select(F.col("ca").alias("comp"), "to")), "comp", "left").select("node", F.coalesce("to", "comp").alias("comp"))
    return rows.join(unsent(nodes.withColumnRenamed("source", "s2").withColumnRenamed("rendering", "r2").withColumnRenamed("m", "m2").withColumnRenamed("target", "t2")), (F.col("m") == F.col("m2")) & (F.col("target") == F.col("t2")) & (F.col("source") == F.col("s2")) & F.col("rendering").eqNullSafe(F.col("r2"))).select("seq", "node").join(unsent(final), "node").select("seq", "comp")


def pairs_of(groups: DataFrame) -> DataFrame:
    """All pairs (seq_a, seq_b), seq_a < seq_b, of one comp."""
    a = groups.select("comp", F.col("seq").alias("seq_a"))
    return a.join(groups.select("comp", F.col("seq").alias("seq_b")), "comp").where("seq_a < seq_b").select("seq_a", "seq_b")
