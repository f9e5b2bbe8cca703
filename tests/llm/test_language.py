"""The byte network on held-out sentences, and the rules about labels and foreign lines."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.llm import language

WORDS = {
    "en": "the and house is with from you where they have been this water night would there".split(),
    "de": "der und das Haus ist mit nicht wo sie haben gewesen dieses Wasser Nacht würde schön".split(),
    "ru": "дом и это есть откуда они были вода ночь где который хорошо сегодня".split(),
    "ja": "これは 家です どこに 水が 夜に 行きます ありました 彼らは".split(),
    "yue": "呢個 係 喺邊度 佢哋 冇 嘅 嘢 點解 食咗".split(),
    "zh": "这个 是 在哪里 他们 没有 的 东西 为什么 吃了".split(),
}


def sentence(code, rng, n=8):
    return " ".join(rng.choice(WORDS[code]) for _ in range(n))


@pytest.fixture(scope="module")
def net():
    rng = random.Random(1)
    rows = [("\n".join(sentence(c, rng) for _ in range(5)), c) for c in WORDS for _ in range(25)]
    rows += [("\n".join(sentence("en", rng) for _ in range(5)), "de") for _ in range(3)]  # wrong labels
    return language.train(rows, epochs=5)


def test_held_out(net):
    rng = random.Random(99)
    texts = [(sentence(c, rng, 6), c) for c in WORDS for _ in range(40)]
    p = language.text_probabilities(net, [t for t, _ in texts])
    right = np.mean([language.LANGUAGES[i] == c for i, (_, c) in zip(p.argmax(1), texts)])
    assert right > 0.97


def test_windows_cover_all():
    t = "aé漢😀" * 500
    assert b"".join(language.windows_of(t)) == t.encode()


def test_tables(spark, net):
    rng = random.Random(5)
    docs = [(1, sentence("en", rng, 400), "EN-gb"), (2, sentence("de", rng, 40), "en"), (3, "", "en"), (4, None, None), (5, "12 34!", "en"), (6, sentence("yue", rng, 40), "zh"), (7, sentence("ru", rng, 40), "und"), (8, sentence("ja", rng, 30), "jpn")]
    df = language.languages(spark.createDataFrame(docs, "doc_id long, text string, label string"), net, ["doc_id", "label"])
    got = {r.doc_id: r.lang for r in df.where(language.mislabelled(df, F.col("label"))).collect()}
    assert got == {2: "de", 6: "yue", 7: "ru"}
    # a few letters are no evidence against a label, but a missing or unknown one is wrong
    few = [(i, "Ann", code) for i, code in enumerate(["en", "de", "ru", None, "xx"])]
    df = language.languages(spark.createDataFrame(few, "doc_id long, text string, label string"), net, ["doc_id", "label"])
    assert sorted(r.doc_id for r in df.where(language.mislabelled(df, F.col("label"))).collect()) == [3, 4]
    cues = [("p", f"{i}", sentence("en", rng, 6)) for i in range(20)] + [("p", "x", sentence("ru", rng, 8)), ("p", "y", "Да"), (None, "z", "no key"), ("p", None, "no id"), ("p", "e", "")]
    cues = [(k, i, n * 1000, None, t) for n, (k, i, t) in enumerate(cues)]
    cues += cues[-5:] + [("p", "late", 900_000, 900_100, "Да"), ("p", "none", None, None, "the night"), ("q", "1", 0, 5, "12")]
    df = spark.createDataFrame(cues, "k string, id string, start_ms long, end_ms long, text string")
    lines = language.classified_cues(df, F.col("k"), net)
    owners = language.of_owners(lines)
    assert [(r.owner, r.main) for r in owners.collect()] == [("p", "en")]
    # a short line is told by its neighbours, whatever the chunks
    for chunk in (600_000, 7_000):
        far = language.foreign(lines, owners, chunk)
        assert sorted((r.id, r.lang) for r in far.collect()) == [("x", "ru"), ("y", "ru")]
    got = language.stretches(far, df, F.col("k")).collect()
    assert [(r.lang, r.first_id, r.last_id, r.lines, r.start_ms, r.end_ms) for r in got] == [("ru", "x", "y", 2, 20_000, 21_000)]
    assert language.foreign(lines.where("false"), owners).count() == 0
    assert language.languages(spark.createDataFrame([], "doc_id long, text string"), net, ["doc_id"]).count() == 0


def test_path_is_the_best_sequence():
    rng = np.random.default_rng(3)
    for _ in range(60):
        e = np.concatenate([np.zeros((6, 1)), rng.normal(0, 4, (6, 2))], axis=1)
        cost = lambda w: sum(e[i, s] for i, s in enumerate(w)) - 2.5 * sum(a != b for a, b in zip((0, *w), (*w, 0)))  # noqa: E731, B023
        best = max(itertools.product(range(3), repeat=6), key=cost)
        assert abs(cost(tuple(language.path(e, 2.5).tolist())) - cost(best)) < 1e-9


def test_segments(spark, net):
    rng = random.Random(7)
    en, ru, ja = sentence("en", rng, 120), sentence("ru", rng, 90), sentence("ja", rng, 60)
    docs = [(1, f"{en} {ru} {en}"), (2, ja), (3, ""), (4, None), (5, "12 !"), (None, ja)]
    got = language.segments(spark.createDataFrame(docs, "doc_id long, text string"), net, "doc_id").collect()
    one = sorted((r.nth, r.lang, r.from_pos, r.to_pos) for r in got if r.doc_id == 1)
    assert [x[1] for x in one] == ["en", "ru", "en"] and one[0][2] == 0 and one[-1][3] == len(docs[0][1]) and all(a[3] == b[2] for a, b in zip(one, one[1:]))
    assert abs(one[1][2] - len(en)) < 200 and abs(one[1][3] - len(en) - len(ru)) < 200
    assert [(r.lang, r.from_pos, r.to_pos) for r in got if r.doc_id == 2] == [("ja", 0, len(ja))] and {r.doc_id for r in got} == {1, 2, None}


def test_lines_join_the_training(spark, net):
    lines = [(o, t, c) for o, c in (("a", "en"), ("b", "de")) for t in (sentence(c, random.Random(1), 9), sentence(c, random.Random(4), 9), "Ciak 3, Umberto.")] + [("c", sentence("en", random.Random(2), 9), "ru"), ("d", "Go", "xx"), ("e", "12", "en")]
    assert {(w.decode(), y) for w, y in language._short(net, lines)} >= {("Ciak 3, Umberto.", 0), ("Ciak 3, Umberto.", 1)}
    assert not [1 for w, y in language._short(net, lines) if language.LANGUAGES[y] == "ru"]
    docs = spark.createDataFrame([(i, sentence(c, random.Random(i), 40), c) for i, c in enumerate(["en", "ru"] * 4)], "doc_id long, text string, lang string")
    few = spark.createDataFrame([("a", "1", "the night and the water"), ("a", "1", "the night and the water"), (None, "2", "x"), ("b", None, "x")], "owner string, id string, text string")
    assert language._lines(few, spark.createDataFrame([("a", "EN"), ("a", None), (None, "ru")], "owner string, lang string")) == [("a", "the night and the water", "en")] * 2
    assert language.fitted(docs, few, few.select("owner", F.lit("en").alias("lang"))) is language.fitted(docs, few, few.select("owner", F.lit("en").alias("lang")))


@pytest.mark.parametrize(("label", "code"), [("EN", "en"), ("pt-BR", "pt"), ("zho", "zh"), ("zh-yue", "yue"), (" fra ", "fr"), ("", None), ("und", None), ("auto", None), (None, None), ("xx", "xx")])
def test_codes(spark, label, code):
    assert spark.createDataFrame([(label,)], "l string").select(language.code_of(F.col("l")).alias("c")).first().c == code
