"""Shared spans against a brute-force search."""

import random

import pytest

from spanloom.llm import spans

S = "doc_id long, text string, h string"


def brute(docs, least):
    have = {}
    for d, t, _ in docs:
        if d is not None and t is not None:
            have.setdefault(d, t)
    windows = {d: {t[i : i + least] for i in range(len(t) - least + 1)} for d, t in have.items()}
    ids = sorted(have)
    pairs = {(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if windows[a] & windows[b]}
    shared = {}
    for d in ids:
        others = set().union(*[windows[o] for o in ids if o != d], set())
        hit = [False] * len(have[d])
        for i in range(len(have[d]) - least + 1):
            if have[d][i : i + least] in others:
                hit[i : i + least] = [True] * least
        if any(hit):
            shared[d] = sum(hit)
    return pairs, shared


def corpus():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdeфя漢é😀 ") for _ in range(rng.randrange(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))[: n * 5]
    a, b, c = text(200), text(200), text(80)
    docs = [(1, text(30) + a[:200] + text(30)), (2, text(50) + a[:200]), (3, a[:199] + text(60)), (4, b), (5, b), (6, text(10) + b[100:420] + text(9)), (7, c + c + c), (8, "-" * 700), (9, "x" + "-" * 300), (10, "-" * 199), (11, None), (12, ""), (None, b), (13, a[50:260] + b[40:400]), (14, text(3000))]
    docs = [(d, t, "z") for d, t in docs]
    return docs + docs[3:4]


def test_brute_force(spark):
    docs = corpus()
    pairs, shared = brute(docs, 200)
    df = spark.createDataFrame(docs, S).repartition(3)
    got = [tuple(r) for r in spans.pairs(df).collect()]
    assert len(got) == len(set(got)) and set(got) == pairs and len(pairs) > 5
    assert {r.doc_id: r.shared_chars for r in spans.shares(df).collect()} == shared


@pytest.mark.parametrize("rows", [3, 12])
def test_prefixes_of_large_groups_grow(spark, rows):
    rng = random.Random(5)
    text = lambda n: "".join(rng.choice("abcdefg ") for _ in range(n))
    licence = text(520)
    docs = [(i, text(rng.randrange(0, 80)) + licence[rng.randrange(0, 330) :][: rng.randrange(150, 400)] + text(rng.randrange(0, 80)), "") for i in range(30)]
    docs += [(90 + i, licence, "") for i in range(14)] + [(200 + i, "ab" * (130 + i), "") for i in range(8)]
    pairs, shared = brute(docs, 200)
    df = spark.createDataFrame(docs, S).repartition(3)
    assert {tuple(r) for r in spans.pairs(df, group_rows=rows).collect()} == pairs
    assert {r.doc_id: r.shared_chars for r in spans.shares(df, group_rows=rows).collect()} == shared


def test_repeats(spark):
    docs = corpus()
    texts = {d: t for d, t, _ in docs if d is not None and t}
    got = spans.repeats(spark.createDataFrame(docs, S)).collect()
    by = {}
    for r in got:
        by.setdefault(r.repeat, []).append(r)
        assert r.length >= 200
    for rs in by.values():  # one text at all places, which can't be longer on either side unless the look-around ends
        assert len({texts[r.doc_id][r["at"] : r["at"] + r.length] for r in rs}) == 1 and len({r.doc_id for r in rs}) > 1
    pairs = {(a.doc_id, b.doc_id) for rs in by.values() for a in rs for b in rs if a.doc_id < b.doc_id}
    assert pairs == brute(docs, 200)[0]


def test_periodic_text_has_few_suffixes(spark):
    df = spark.createDataFrame([(1, "-" * 20_000, ""), (2, "x" + "-" * 20_000, ""), (3, "ab" * 9_000, "")], S)
    docs = df.select("doc_id", "text")
    assert docs.mapInArrow(spans._suffixes(200), spans._SUFFIX).count() < 1500
    assert [tuple(r) for r in spans.pairs(df).collect()] == [(1, 2)]
    assert {r.doc_id: r.shared_chars for r in spans.shares(df).collect()} == {1: 20_000, 2: 20_000}


def test_large_node_is_cut_into_blocks(spark, monkeypatch):
    t = "".join(random.Random(1).choice("abcdefgh ") for _ in range(260))
    df = spark.createDataFrame([(i, t, "") for i in range(40)], S)
    monkeypatch.setattr(spans, "BLOCK", 16)
    assert spans.pairs(df).count() == 40 * 39 // 2
    assert spans.pairs(df.where("false")).count() == 0
