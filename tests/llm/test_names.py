"""Name variants: edit distance, index lookups and links."""

import random

import pytest
from pyspark.sql import functions as F

from spanloom.llm import names
from spanloom.session import materialize

G = "seq long, media string, target string, source string, rendering string, m string"


def slow(a, b):
    d = [[i + j if i * j == 0 else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_distance_and_lookup():
    rng = random.Random(2)
    for _ in range(1500):
        a = "".join(rng.choice("abcd") for _ in range(rng.randrange(4, 12)))
        b = list(a)
        for _ in range(rng.randrange(3)):
            k = rng.randrange(len(b))
            rng.choice([lambda: b.insert(k, rng.choice("abcd")), lambda: b.pop(k), lambda: b.__setitem__(k, rng.choice("abcd"))])()
        b = "".join(b)
        d = slow(a, b)
        assert names.distance(a, b, 2) == min(d, 3)
        k = names.errors_for(max(len(a), len(b)))
        if k and d <= k:
            assert set(names.index_keys(a)) & set(names.probe_keys(b, longer=True)), (a, b)


def harmed(w):
    """Every word one error away: letters added, dropped and replaced, neighbours swapped."""
    out = {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in (w[i : i + 1] or w[-1], "z")}
    out |= {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + "z" + w[i + 1 :] for i in range(len(w))}
    return out | {w[:i] + w[i + 1] + w[i] + w[i + 2 :] for i in range(len(w) - 1)}


@pytest.mark.parametrize("n", range(3, 15))
def test_no_pair_of_words_is_lost(n):
    rng = random.Random(n)
    w = "".join(rng.choice("abcdefgh") for _ in range(n))
    near = harmed(w)
    if names.errors_for(n + 2) == 2:
        near |= {x for v in near for x in harmed(v)}
    index, probe, tried = set(names.index_keys(w)), set(names.probe_keys(w)), 0
    for v in near - {w}:
        k = names.errors_for(max(n, len(v)))
        if k and names.distance(v, w, k) <= k:
            tried += 1
            assert index & set(names.probe_keys(v, longer=True)), (w, v)
            assert index & set(names.probe_keys(v)) or set(names.index_keys(v)) & probe, (w, v)
    assert tried > n or n == 3


def groups(spark, rows, said=()):
    contexts = spark.createDataFrame([("F", "ja", dict(said))] if said else [], "media string, target string, variants map<string,string>")
    nick = spark.createDataFrame([("Bob", "Robert"), ("Rob", "Robert"), (None, "X")], "nick string, formal string")
    df = spark.createDataFrame([(i, m, "ja", s, r, "") for i, (m, s, r) in enumerate(rows)] + [(0, *rows[0][:1], "ja", *rows[0][1:], "")] if rows else [], G)
    got = names.same_names(df, F.lower("media"), contexts, F.lower("media"), nick)
    out = {}
    for r in got.collect():
        out.setdefault(r.comp, []).append(r.seq)
    assert {tuple(r) for r in names.pairs_of(got).collect()} == {(a, b) for v in out.values() for a in v for b in v if a < b}
    return sorted(sorted(v) for v in out.values())


def test_links(spark):
    rows = [
        ("F", "Robert Harlow", "ロバ・ハロ"), ("f", "Bob Harlow", "ロバ・ハロ"), ("F", "Harlow, Robert", None), ("F", "ROBERT HARLOW's", "ロバ・ハロ"), ("F", "Dr. Robert Q. Harlwo", "ロバ・ハロ"), ("F", "R. Harlow", "ロバ・ハロ"), ("F", "Robert Hárlow", "ロバ・ハロ"),
        ("F", "Anna Harlow", "アナ・ハロ"), ("F", "Robert Penrose", "ロバ・ペン"), ("G", "Robert Harlow", "ロバ・ハロ"), ("F", "Kelso Lantern Company", "ケルソ"), ("F", "The Kelso Lantern Co.", "ケルソ"), ("F", "KLC", "ケルソ"), ("F", "Kelso Lantern Society", "ケルソ会"),
        ("F", "Penrose", "ペン"), ("F", "...", "x"), ("F", None, "x"), (None, "Robert Harlow", "x"), ("F", "Zyxwvut " * 200, None),
    ]
    assert groups(spark, rows) == [[0, 1, 2, 3, 4, 5, 6], [7], [8, 14], [9], [10, 11, 12], [13], [18]]
    assert groups(spark, []) == []


def test_near_names_with_other_renderings(spark):
    rows = [("F", "Henry Diazey", "ヘン・コンオ"), ("F", "Henry Diazzey", "ヘン・エモキサ"), ("F", "Henry Diazeyy", "ヘン・コンオ")]
    assert groups(spark, rows) == [[0, 2], [1]]


def test_nothing_that_grows_is_broadcast(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(names, "materialize", lambda df, name: [plans.append(df._jdf.queryExecution().executedPlan().toString()), materialize(df, name)][1])
    rows = [("F", "Robert Harlow", "ロバ・ハロ"), ("F", "Rob Harlow", "ロバ・ハロ"), ("F", "Harlow", None), ("F", "Penrose", "ペン"), ("F", "Pemrose", "ペン")]
    assert groups(spark, rows, {"harlow": "Penrose"}) == [[0, 1, 2], [3, 4]]
    context = spark.createDataFrame([("F", "ja", {"harlow": "Penrose"})], "media string, target string, variants map<string,string>")
    nick = spark.createDataFrame([("Bob", "Robert")], "nick string, formal string")
    df = spark.createDataFrame([(i, m, "ja", s, r, "") for i, (m, s, r) in enumerate(rows)], G)
    plans.append(names.same_names(df, F.lower("media"), context, F.lower("media"), nick)._jdf.queryExecution().executedPlan().toString())
    assert sum(p.count("SortMergeJoin") for p in plans) > 12
    assert not [p for p in plans if "Broadcast" in p]
