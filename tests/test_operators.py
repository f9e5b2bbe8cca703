"""Interval algebra, joins, stores, text rules and folds on small cases with known results."""

import pytest
from pyspark.sql import functions as F

from spanloom.functions import text as tx
from spanloom.operators import folds, joins, measures, models, nouns, replies, spans, store
from spanloom.sources import captions
from spanloom.streaming import sessions

R = "k string, start_ms long, end_ms long"


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_merge_and_subtract(spark):
    a = spark.createDataFrame([("a", 600, 630), ("a", 0, 60), ("a", 60, 90), ("b", 5, 5), ("b", None, 7)], R)
    assert rows(spans.merge(a, ["k"]), "start_ms", "end_ms", "n") == [(0, 90, 2), (600, 630, 1)]
    b = spark.createDataFrame([("a", 10, 20), ("a", 80, 610)], R)
    assert rows(spans.subtract(a, b, ["k"]), "start_ms", "end_ms") == [(0, 10), (20, 80), (610, 630)]
    whole = spark.createDataFrame([("a", 700), ("c", 50)], "k string, duration_ms long")
    assert rows(spans.holes(spans.merge(a, ["k"]), whole, ["k"]), "k", "start_ms", "end_ms") == [("a", 90, 600), ("a", 630, 700), ("c", 0, 50)]


@pytest.mark.parametrize(
    ("position", "reached", "duration", "rate", "following", "want"),
    [(0, 60_000, 600_000, 2.0, None, (60_000, 76_000)), (0, 0, 600_000, 1.0, 5000, (0, 5000)), (0, 59_000, 600_000, 1.0, None, (59_000, 75_000)), (0, 60_000, 600_000, 1.0, None, None), (0, 0, 4000, 1.0, None, (0, 4000)), (599_000, 600_000, 600_000, 1.0, None, None)],
)
def test_planner(spark, position, reached, duration, rate, following, want):
    df = spark.createDataFrame([(position, reached, duration, rate, following)], "p long, r long, d long, x double, f long")
    got = df.select(spans.horizon_plan(F.col("p"), F.col("r"), F.col("d"), F.col("x"), F.col("f")).alias("w")).first().w
    assert (tuple(got) if got else None) == want


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_long_ranges_are_few_rows(spark, how):
    p = spark.createDataFrame([("a", t) for t in (0, 5, 70, 5000, 1 << 40, 1 << 61)] + [("b", 1)], "k string, t long")
    r = spark.createDataFrame([("a", 0, 6, 1), ("a", 60, 4000, 2), ("a", 3, 1 << 41, 3), ("a", 1 << 60, 1 << 62, 4), ("a", None, 7, 5)], "k string, lo long, hi long, n long")
    got = joins.range_join(p, r, ["k"], F.col("t"), "lo", "hi", 1, how)
    pairs = {(t, n) for t in (0, 5, 70, 5000, 1 << 40, 1 << 61) for lo, hi, n in ((0, 6, 1), (60, 4000, 2), (3, 1 << 41, 3), (1 << 60, 1 << 62, 4)) if lo <= t < hi}
    alone = {1} | {t for t in (0, 5, 70, 5000, 1 << 40, 1 << 61) if not any(t == x for x, _ in pairs)}
    if how in ("inner", "left"):
        assert {(x.t, x.n) for x in got.collect()} == pairs | ({(t, None) for t in alone} if how == "left" else set())
    else:
        assert {x.t for x in got.collect()} == (alone if how == "left_anti" else {t for t, _ in pairs})


@pytest.mark.parametrize("bucket", [1, 7, 1000])
def test_range_join_is_bucket_free(spark, bucket):
    p = spark.createDataFrame([("a", i, f"p{i}") for i in range(0, 60, 3)] + [(None, 3, "n")], "k string, t long, id string")
    r = spark.createDataFrame([("a", s, s + 5, f"r{s}") for s in range(0, 50, 4)] + [("b", 0, 99, "rb")], "k string, lo long, hi long, rid string")
    want = sorted((f"p{i}", f"r{s}") for i in range(0, 60, 3) for s in range(0, 50, 4) if s <= i < s + 6)
    assert rows(joins.range_join(p, r, ["k"], F.col("t"), "lo", "hi", bucket, upper=1), "id", "rid") == want
    left = joins.range_join(p, r, ["k"], F.col("t"), "lo", "hi", bucket, "left_anti")
    assert {x.id for x in left.collect()} == {f"p{i}" for i in range(0, 60, 3) if not any(s <= i < s + 5 for s in range(0, 50, 4))} | {"n"}


def test_as_of(spark):
    p = spark.createDataFrame([("a", 5), ("a", 10), ("b", 1)], "k string, t long")
    m = spark.createDataFrame([("a", 5, "x"), ("a", 9, "y"), ("a", 10, "z")], "k string, m long, v string")
    assert rows(joins.as_of(p, m, ["k"], "t", "m", "v"), "k", "t", "m") == [("a", 5, 5), ("a", 10, 10), ("b", 1, None)]
    assert rows(joins.as_of(p, m, ["k"], "t", "m", "v", forward=True, strict=True), "k", "t", "m") == [("a", 5, 9), ("a", 10, None), ("b", 1, None)]
    assert rows(joins.as_of(p, m, ["k"], "t", "m", "v", forward=True), "k", "t", "m") == [("a", 5, 5), ("a", 10, 10), ("b", 1, None)]


def test_ledger(spark):
    s = "m string, t string, source string, rendering string, o long"
    x = spark.createDataFrame([("f", "ja", "Nash", "A", 1), ("f", "ja", "Nash", "B", 2), ("f", "ja", "Mash", "A", 3), ("g", "ja", "Mash", "A", 4), ("f", "ja", None, "C", 5)], s)
    held = store.ledger(x, ["m", "t"], "source", "rendering", "o")
    assert rows(held, "m", "source", "rendering") == [("f", "Nash", "A"), ("g", "Mash", "A")]
    more = spark.createDataFrame([("f", "ja", "Nash", "Z", 6), ("f", "ja", "Other", "A", 7), ("f", "ja", "New", "N", 8)], s)
    assert rows(store.ledger_add(held, more, ["m", "t"], "source", "rendering", "o"), "source") == [("New",)]


def test_nearest_rank_and_mentions(spark):
    x = spark.createDataFrame([("a", float(i % 7)) for i in range(41)] + [("a", None)], "k string, v double")
    want = sorted(float(i % 7) for i in range(41))[int(40 * 0.95)]
    assert measures.nearest_rank(x, ["k"], "v", 0.95).first().value == want
    n = spark.createDataFrame([("f", "Nash"), ("f", "St. Ann"), ("f", "Nobody")], "m string, name string")
    t = spark.createDataFrame([("f", 1, "Nash, Nash and Nashville"), ("f", 2, "In St. Ann they met."), ("g", 1, "Nash"), ("f", 3, "Nash-Bell's Nash2 O’Nash"), ("f", 4, "nash")], "m string, i long, text string")
    assert rows(measures.mentions(n, t, ["m"], "name", "text", "i"), "name", "mentions", "occurrences") == [("Nash", 2, 5), ("St. Ann", 1, 1)]
    assert rows(measures.hits(n, t, ["m"], "name", "text", "i", any_case=True), "name", "i", "k") == [("Nash", 1, 2), ("Nash", 3, 3), ("Nash", 4, 1), ("St. Ann", 2, 1)]


def test_text_rules(spark):
    def one(col, value):
        return spark.createDataFrame([(value,)], "t string").select(col(F.col("t")).alias("x")).first().x

    assert one(tx.clean_text, " <i>a</i>{\\an8}\tb　") == "a b"
    assert [one(tx.sentence_end, t) for t in ("Run!", "He met Dr.", "Is it “so?”", "J.", "走れ。」", "a,")] == [True, False, True, False, True, False]
    assert one(tx.clause_end, "so,") and one(tx.weak_ending, "go to the") and not one(tx.weak_ending, "go home")
    assert one(tx.width, "a走é") == 4
    assert one(lambda c: tx.stamp(c.cast("long")), "360000001") == "100:00:00,001"
    assert one(lambda c: tx.stamp(c.cast("long")), "-1") is None
    df = spark.createDataFrame([(["今日", " は ", "", None, "good", "day"],)], "a array<string>")
    assert df.select(tx.join_texts(F.col("a")).alias("x")).first().x == "今日は good day"


def u(a, b, t):
    return {"start_ms": a, "end_ms": b, "text": t}


def told(words):
    return [(w["start_ms"], w["end_ms"], w["text"], w.get("joined", False)) for w in words]


def c(i, a, b, t):
    return {"id": i, "start_ms": a, "end_ms": b, "text": t}


def test_instant_words():
    def got(*words):
        kept, cut, reason = folds.coalesce_instant([u(*w) for w in words])
        return told(kept), cut, reason

    assert got((0, 100, "we"), (100, 100, "a"), (160, 400, "re")) == ([(0, 100, "we", False), (100, 400, "a re", True)], None, None)
    # more than three in a row, none of them at the end of the word before
    assert got((0, 300, "p"), (300, 600, "q"), *[(700, 700, x) for x in "abcd"], (900, 1200, "r")) == ([(0, 300, "p", False), (300, 600, "q", False)], 700, "span")
    assert got((0, 300, "p"), (400, 400, "q"), (2100, 2400, "r")) == ([(0, 300, "p", False)], 400, "span")
    # at the end the stretched word goes as well
    assert got((0, 300, "p"), (9000, 11_100, "q"), (11_100, 11_100, "r")) == ([(0, 300, "p", False)], 9000, "end")
    assert got((0, 300, "p"), (700, 700, "q")) == ([(0, 700, "p q", True)], None, None)
    assert got((5, 5, "alone")) == ([], 5, "end")
    # endings join the word they lie on, what is left the next one
    assert got((100, 500, "4"), (500, 500, "5"), (500, 500, "0"), (3000, 3000, "p"), (3040, 3300, "q")) == ([(100, 500, "4 5 0", True), (3000, 3300, "p q", True)], None, None)
    assert got((0, 500, "p"), *[(500, 500, x) for x in "abcd"], (3000, 3200, "q"))[1:] == (500, "span")
    assert got((0, 300, "p"), (300, 2300, "long"), (2300, 2300, "q"), (5000, 5200, "r"))[1:] == (2300, "span")


def test_instant_words_before_a_window():
    kept, cut, reason, skipped = folds.coalesce_owned([u(0, 0, "p"), u(1600, 1760, "q"), u(1760, 2080, "r")], 1000)
    assert [w["text"] for w in kept] == ["q", "r"] and (cut, reason) == (None, None) and [w["text"] for w in skipped] == ["p"]
    words = [u(1200, 1500, "p"), u(1600, 1600, "q"), u(4000, 4200, "r")]
    assert folds.coalesce_owned(words, 1000) == (words[:1], 1600, "span", [])
    assert folds.coalesce_owned(words, 0) == (*folds.coalesce_instant(words), [])


def test_seam_phantoms():
    left = [u(200, 600, "p"), u(650, 990, "q")]
    assert folds.drop_seam_phantoms([*left, u(1000, 1040, "x"), u(8800, 9200, "r")], 1000) == ([*left, u(8800, 9200, "r")], 1)
    chain = [u(960, 1040, "a"), u(1040, 1080, "b"), u(1080, 1120, "c"), u(1120, 1160, "d"), u(6000, 6400, "e")]
    assert folds.drop_seam_phantoms(chain, 1000) == (chain[3:], 3)
    for kept in ([u(1000, 1400, "p"), u(1500, 1900, "q")], [u(3000, 3080, "p"), u(6000, 6400, "q")], [u(1000, 1040, "alone")]):
        assert folds.drop_seam_phantoms(kept, 1000) == (kept, 0)


def test_transcripts():
    assert folds.transcript_after("Well, go. (Now run)", ["well", "GO"]) == " (Now run)"
    assert folds.transcript_after("走れ。いま", ["走", "れ"]) == "いま" and folds.transcript_after("Well", ["Well"]) == ""
    assert folds.transcript_after("Well", ["ill"]) is None and folds.transcript_after("Well", ["Welles"]) is None
    assert folds.restore_transcript(["Go", "now", "he", "said"], "“Go, now!” he said.") == ["“Go,", " now!”", " he", " said."]
    assert folds.restore_transcript(["he", "said", "go"], "He said: “Go!”") == ["He", " said:", " “Go!”"]
    assert folds.restore_transcript(["go"], "went") is None and folds.restore_transcript(["go", "?"], "go ?") is None and folds.restore_transcript([], "") is None
    assert folds.restore_transcript(["Go", "now"], "Go, now. 「Then」 on", prefix=True) == ["Go,", " now."]
    assert folds.restore_transcript(["stras", "se"], "straße") is None  # two words share a character
    assert folds.valid_units([u(0, 10, "a"), u(10, 20, "b")], 20, "A, b!") and not folds.valid_units([u(0, 10, "a"), u(10, 20, "b")], 20, "A b c")
    assert folds.valid_units([u(0, 10, "a"), u(10, 20, "b")], 20, "A b c", prefix=True) and not folds.valid_units([u(0, 10, "b")], 20, "A b", prefix=True)
    for bad in ([], [u(-1, 2, "a")], [u(3, 2, "a")], [u(0, 0, "a")], [u(0, float("nan"), "a")], [u(0, 1100, "a")], [u(0, 10, "a"), u(5, 20, "b")], [u(0, 10, " ")]):
        assert not folds.valid_units(bad, 1000, "ab", prefix=True)


def test_assemble():
    def got(*words, **kw):
        return [(x["start_ms"], x["end_ms"], x["text"]) for x in folds.assemble([u(*w) for w in words], **kw)]

    assert got((0, 900, "We"), (950, 1800, "walked."), (1850, 1930, "I did."), (1980, 3000, "Then"), (3050, 3800, "we ran.")) == [(0, 1930, "We walked. I did."), (1980, 3800, "Then we ran.")]
    twice = folds.assemble([u(0, 200, "yes"), u(1000, 1200, "yes")], key="p")
    assert [x["text"] for x in twice] == ["yes", "yes"] and twice[0]["id"] != twice[1]["id"] and all(len(x["id"]) == 24 for x in twice)
    assert got((0, 200, "a"), (250, 500, "b"), zero_ms=40_000, core_start=40_200, core_end=41_000) == [(40_250, 40_500, "b")]
    assert got((0, 800, "今日"), (800, 1500, "は")) == [(0, 1500, "今日は")]
    assert got((0, 900, "Go,"), (900, 1500, " now"), verbatim=True) == [(0, 1500, "Go, now")]
    assert got((0, 1000, "one"), (1700, 2700, "two")) == [(0, 1000, "one"), (1700, 2700, "two")]
    # a clause ends a caption that is long enough; a weak word goes with the next caption if enough is left
    assert got((0, 1900, "well,"), (1950, 2900, "then")) == [(0, 1900, "well,"), (1950, 2900, "then")]
    long = [(i * 400, i * 400 + 380, w) for i, w in enumerate("he told them everything about the summer and the house by sea".split())]
    assert [t for _, _, t in got(*long)][0] == "he told them everything about the summer and the house"
    assert [t for _, _, t in got(*[(a, b, t) for a, b, t in long[:10]], (4000, 4600, "of"), (4620, 5200, "stone"))][0] == "he told them everything about the summer and the house"
    assert got() == []


def test_sentence_units():
    def got(*cues):
        x = folds.sentence_units([c(str(i), *q) for i, q in enumerate(cues)])
        return [r["unit"] for r in x], {r["unit"] for r in x if r["continues"]}

    assert got((0, 500, "We"), (600, 1500, "went home."), (1600, 2500, "So then"), (2500, 3200, "we slept.")) == ([0, 0, 1, 1], set())
    assert got((0, 400, "Wait"), (4000, 4400, "for me.")) == ([0, 1], {1})
    assert got(*[(i * 2000, i * 2000 + 1900, "word") for i in range(5)]) == ([0, 0, 0, 1, 1], {1})
    assert got((0, 1000, "x" * 50), (1000, 2000, "y" * 50))[0] == [0, 1]
    assert got((0, 1600, "Wait"), (3680, 4080, "and see."))[0] == [0, 0] and got((0, 1600, "Wait"), (3680, 4080, "Ann is here."))[0] == [0, 1]
    assert got((0, 1600, "Wait"), (5000, 5080, "no."))[0] == [0, 1]
    assert got((0, 1520, "彼の名は"), (3840, 3920, "だった。"))[0] == [0, 0] and got((0, 1600, "見ろよ"), (8000, 8400, "ねえ"))[0] == [0, 1]
    assert got((0, 1760, "島から渡っ"), (6400, 6480, "た。"))[0] == [0, 0] and got((0, 1600, "渡っ"), (7200, 7280, "た。"))[0] == [0, 1]
    # Hangul counts as a script with case would
    assert got((0, 1600, "그는"), (3680, 4080, "갔다"))[0] == [0, 1]
    # a tail that doesn't fit takes the line it ends along
    assert got((0, 2160, "彼の本当の名は、"), (3840, 5360, "本当に彼"), (7680, 7760, "だった。")) == ([0, 1, 1], {1})


def test_hold_back():
    x = [c("a", 500, 2500, "Not one."), c("b", 3000, 3400, "We")]
    assert folds.hold_back(x, 0, 4000, 2000) == (x[:1], 3000) and folds.hold_back(x[:1], 0, 4000, 2000) is None and folds.hold_back([], 0, 4000, 2000) is None
    tail = [c("a", 500, 2500, "Done."), c("b", 3000, 9000, "and then on and on")]
    assert folds.hold_back(tail, 0, 9500, 2000) is None and folds.hold_back(tail, 0, 9500, 2000, 7000) == (tail[:1], 3000)
    short = [c("a", 500, 1500, "Short."), c("b", 1600, 3000, "We")]
    assert folds.hold_back(short, 0, 4000, 2000) is None and folds.hold_back(short, 0, 4000, 1000) == (short[:1], 1600)
    assert folds.hold_back([c("a", 2500, 3000, "We"), c("b", 3100, 4000, "go")], 0, 5000, 2000) == ([], 2500)


def test_speech():
    at = lambda ms: round(ms * 16 / 512)
    assert folds.hysteresis([0.1, 0.49, 0.3] * 50, 150 * 512) == []
    assert folds.hysteresis([0.0] * 5 + [0.9] * at(224) + [0.0] * 10, (15 + at(224)) * 512) == []
    assert folds.hysteresis([0.0] * 5 + [0.9] * at(320) + [0.0] * 10, (15 + at(320)) * 512) == [(5 * 512, (5 + at(320)) * 512)]
    assert folds.hysteresis([0.9] * 10 + [0.1] * 2 + [0.9] * 10 + [0.0] * 10, 32 * 512) == [(0, 22 * 512)]
    # four quiet frames reach 96 ms only
    assert folds.hysteresis([0.9] * 12 + [0.1] * 4 + [0.9] * 12, 28 * 512) == [(0, 28 * 512)]
    assert folds.hysteresis([0.9] * 12 + [0.1] * 5 + [0.9] * 12, 29 * 512) == [(0, 12 * 512), (17 * 512, 29 * 512)]
    assert folds.hysteresis([0.9] * 5 + [0.4] * 20 + [0.0] * 10, 35 * 512) == [(0, 25 * 512)]
    assert folds.speech_detail([0.9] * 25 + [0.0] * 10, 35 * 512) == {"top": 0.9, "speech_ms": 800} and folds.speech_detail([], 0) == {"top": 0.0, "speech_ms": 0}


def test_cache_and_names():
    kept = folds.keep_unless_overlap([c("1", 0, 1000, "a"), c("2", 100, 900, "a"), c("3", 1000, 1500, "b"), c("4", 1200, 1300, "d"), c("5", 2000, 2200, "e")])
    assert [(x["id"], x["conflict"]) for x in kept] == [("1", False), ("3", False), ("4", True)]
    texts = ["X und Y"]
    assert folds.accept_names({"Al": "X", "Alice": "X", "Bo": "Y", "Cy": "Z"}, texts, {"Zed": "Y"}) == {"Alice": "X"}
    assert folds.accept_names({"Bo": "Y"}, texts, {"Bo": "Y"}) == {"Bo": "Y"} and folds.accept_names({"Bo": "Y"}, texts, {}, ["Y"]) == {}


def test_windows():
    w = lambda a, b: u(a, b, "w")
    assert folds.draft_frontier([w(0, 500), w(8500, 9500)], 0, 10_000) == 8500 and folds.draft_frontier([w(8500, 9500)], 0, 10_000, right_known=True) == 10_000
    assert folds.draft_frontier([w(0, 500)], 0, 10_000, last=True) == 10_000 and folds.draft_frontier([], 0, 10_000, cut_ms=1500) is None
    assert folds.draft_frontier([w(500, 9800)], 0, 10_000) == 500 and folds.draft_frontier([w(0, 9800)], 0, 10_000) is None
    assert folds.start_from_previous([w(0, 400), w(700, 1600), w(1600, 1700)], 1000, 1000)[1]["start_ms"] == 1000
    assert folds.start_from_previous([w(900, 1200)], 1000, 1000)[0]["start_ms"] == 900 and folds.start_from_previous([w(700, 2600)], 1000, 1000)[0]["start_ms"] == 700
    assert folds.clip_right([w(0, 1100)], 1000)[-1]["end_ms"] == 1000 and folds.clip_right([w(0, 1300)], 1000) is None


def test_proper_nouns():
    texts = ["Hansen won the Carnegie prize.", "Well, he has his eye on Marlow Labs.", "Nash. Oh, Mr. Sol is here."]
    assert nouns.proper_nouns(texts, ["Then Hansen said no."]) == (["Hansen", "Carnegie", "Marlow Labs", "Sol"], {})
    assert nouns.proper_nouns(["Umberto is late."], []) == ([], {}) and nouns.proper_nouns(["Umberto is late."], ["I saw Umberto."]) == (["Umberto"], {})
    assert nouns.proper_nouns(["Meet John Reed.", "Reed is late."], []) == (["John Reed", "Reed"], {})
    assert nouns.proper_nouns(["I thank Mr. Hanson.", "Hi, Hans.", "There goes Saw."], [], ["Hansen", "Sol"]) == (["Saw"], {"Hanson": "Hansen", "Hans": "Hansen"})
    assert nouns.proper_nouns(["STOP IT NOW."], []) == ([], {}) and nouns.proper_nouns(["She is at MIT now."], []) == (["MIT"], {}) and nouns.proper_nouns(["That is Reed's."], []) == (["Reed"], {})
    assert len(nouns.proper_nouns(["I met Alpha, Bravo, Charlie, Delta, Echo, Foxtrot and Golf."], [])[0]) == 6
    # a known part takes the phrase apart; a name also written small is none
    assert nouns.proper_nouns(["We met Jon Reed there."], [], ["Reed"]) == (["Jon"], {}) and nouns.proper_nouns(["We like Rose.", "a rose", "no rose"], []) == ([], {})
    assert nouns.match_name("Nasch", ["Nash"]) == "Nash" and nouns.match_name("Sal", ["Sol"]) is None
    assert nouns.runs("Anna Maria Bell Reed ran – Otto's dog") == [(["Anna", "Maria", "Bell"], True), (["Reed"], False), (["Otto"], True)]


def test_film_wide_names(spark):
    texts = ["Hansen won the Carnegie prize.", "We saw Hansen and Hanson.", "Meet Jon Reed.", "a rose, the Rose", "Then rose Ann Bell came."]
    df = spark.createDataFrame([(f, i, t) for f in "ab" for i, t in enumerate(texts)], "f string, i long, text string")
    known = spark.createDataFrame([("a", "Hansen", 1), ("a", "Reed", 2), ("b", "Bell", 1)], "f string, known string, ord long")
    found = nouns.settled(nouns.film_runs(df, ["f", "i"]), "f")
    got = {(r.f, r.name, r.match) for r in nouns.new_and_variants(found, df, known, "f").collect()}
    want = set()
    for f in "ab":
        new, variants = nouns.proper_nouns(texts, [], [r.known for r in known.collect() if r.f == f], None)
        want |= {(f, n, None) for n in new} | {(f, n, m) for n, m in variants.items()}
    assert got == want and ("a", "Hanson", "Hansen") in got and ("b", "Hanson", None) in got


def test_nothing_of_a_film_is_broadcast(spark, data, monkeypatch):
    from spanloom.plans import folded

    plans, write = [], folded.materialize
    note = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString())
    for module in (folded, nouns):
        monkeypatch.setattr(module, "materialize", lambda df, name: [note(df), write(df, name)][1])
    df = folded.film_variants(spark, data)
    note(df)
    assert df.count() > 0 and sum(p.count("SortMergeJoin") for p in plans) > 10
    assert not [p for p in plans if "Broadcast" in p]


def test_fold_keeps_groups(spark):
    df = spark.createDataFrame([(k, i, f"{k}{i}") for k in "abc" for i in range(5)], "k string, i long, t string")
    got = folds.fold(df, ["k"], ["i"], lambda rs: [{"n": len(rs), "t": "".join(r["t"] for r in rs)}], "k string, n long, t string")
    assert rows(got, "k", "n", "t") == [(k, 5, "".join(f"{k}{i}" for i in range(5))) for k in "abc"]


def test_model_boundary(spark):
    calls = []

    def model(batch):
        calls.append(len(batch))
        if "bad" in batch:
            raise ValueError
        return [x.upper() for x in batch]

    batch = ["a"] * 5 + ["bad"] + ["b"] * 2
    assert models.bisect(model, batch) == ["A"] * 5 + [None] + ["B"] * 2 and max(calls) == 8
    assert models.one_by_one(model, ["a", "bad"]) == ["A", None]
    assert models.language_trust({"en": 0.7, "de": 0.6}, 50) == "und" and models.language_trust({"en": 0.9, "de": 0.1}, 50) == "en" and models.language_trust({"en": 0.9}, 5) == "und"
    df = spark.createDataFrame([("a",), (None,)], "t string")
    assert {r.o for r in models.apply_model(df, "t", "o", lambda: lambda b: [x * 2 for x in b]).collect()} == {"aa", None}


def test_captions(spark, tmp_path):
    df = spark.createDataFrame([("p", "1", 0, 1000, "Hi"), ("p", "2", 500, 1500, "over"), ("p", "3", 2000, 2000, "none")], "profile string, id string, start_ms long, end_ms long, text string")
    got = {r.n: (r.block, r.error) for r in captions.srt_blocks(df, ["profile"]).collect()}
    assert got == {1: ("1\n00:00:00,000 --> 00:00:01,000\nHi\n", None), 2: (None, "OVERLAP"), 3: (None, "EMPTY")}
    captions.write_srt(df, ["profile"], str(tmp_path / "srt"))
    assert spark.read.text(str(tmp_path / "srt")).count() == 4
    state = captions.export_state(df.where("start_ms < end_ms"), spark.createDataFrame([("p", 1500), ("q", 9)], "profile string, duration_ms long"), ["profile"])
    assert rows(state, "profile", "complete", "suffix") == [("p", True, ".srt"), ("q", False, ".partial.srt")]
    (tmp_path / "a.json").write_text('{"ja": {"Nash": "N1", "Ann": "A1"}}')
    (tmp_path / "b.json").write_text('{"ja": {"Nash": "N2"}}')
    (tmp_path / "c.json").write_text("no")
    g = captions.user_glossary(spark, [str(tmp_path / x) for x in ("a.json", "b.json", "c.json")], "ja")
    assert rows(g, "source", "rendering") == [("Ann", "A1"), ("Nash", "N2")]


def test_session_decisions():
    row = lambda e, s, p, now, ack=None: {"epoch": e, "seq": s, "position_ms": p, "now_ms": now, "revision": ack}
    state, verdicts = None, []
    for r in (row(0, 1, 0, 0), row(0, 1, 5, 10), row(0, 2, 5, 20), row(1, 0, 9, 30), row(0, 9, 9, 40), row(1, 1, 9, 50, 7), row(1, 2, 9, 60, 1), row(1, 3, 9, 60 + 45_001)):
        state, v, _ = sessions.decide(state, r)
        verdicts.append(v)
    assert verdicts == ["OPENED", "STALE_SEQUENCE", "ACCEPTED", "SEEK", "STALE_EPOCH", "STALE_ACK", "ACCEPTED", "EXPIRED"]
    assert sessions.retry("ASR_FAILED", 0, 16_000) == ("half", 8000) and sessions.retry("ASR_FAILED", 1, 8000) == ("hole", 0)
    assert sessions.retry("LANGUAGE_UNCERTAIN", 0, 10_000) == ("longer", 20_000) and sessions.retry("LANGUAGE_UNCERTAIN", 1, 20_000) == ("skip", 0)


def test_replies(spark):
    def parsed(col, text, ids):
        df = spark.createDataFrame([(text, ids)], "r string, ids array<string>")
        return df.select(col(F.col("r"), F.col("ids")).alias("x")).first().x

    ok = '```json\n[{"id": "a", "text": "x"}, {"id": "b", "text": "y"}]\n```'
    assert [r.text for r in parsed(replies.translations, ok, ["a", "b"])] == ["x", "y"]
    for bad in (ok.replace('"b"', '"a"'), ok.replace('"b"', '"c"'), ok.replace('"y"', '" "'), ok.replace('"y"', '"<think "'), "none", None, "[]", '{"id": "a"}'):
        assert parsed(replies.translations, bad, ["a", "b"]) is None
    # a number as text, a key too many, talk around the array, nothing left after cleaning, too long
    for bad in (ok.replace('"y"', "5"), ok.replace('"y"', '"y", "start": 1'), "Sure: " + ok, ok[7:] + " Done.", ok.replace('"y"', '"<b>{x}"'), ok.replace('"y"', f'"{"y" * 1001}"'), ok.replace('"b"', "2"), ok.replace("[", "[1, ")):
        assert parsed(replies.translations, bad, ["a", "b"]) is None
    assert [r.text for r in parsed(replies.translations, ok[7:-3].replace('"y"', '" <i>y</i>\\t"'), ["b", "a"])] == ["x", "y"]
    v = '[{"id": "a", "score": 4, "source_ok": false, "issue": "misheard"}]'
    assert [tuple(r) for r in parsed(replies.verdicts, v, ["a"])] == [("a", 4, False, "misheard")]
    two = '[{"id": "b", "score": 1, "source_ok": true, "issue": " <i>x</i>", "more": 1}, ' + v[1:]
    assert [tuple(r) for r in parsed(replies.verdicts, two, ["a", "b"])] == [("a", 4, False, "misheard"), ("b", 1, True, "x")]
    for bad in (v.replace("4", "9"), v.replace("4", "true"), v.replace("4", "2.5"), v.replace("false", "1"), "[]", v.replace("4", '"4"'), v.replace("false", '"true"'), v.replace("4", "4.0"), v.replace('"misheard"', "null"), v.replace('"a"', '"b"'), "```json" + v + "```"):
        assert parsed(replies.verdicts, bad, ["a"]) is None


def test_retries(spark):
    log = [("w", 1, 0, 16_000, "ASR_FAILED"), ("w", 2, 0, 8000, "ASR_FAILED"), ("w", 3, 0, 8000, None), ("v", 1, 0, 10_000, "LANGUAGE_UNCERTAIN"), ("v", 2, 0, 20_000, None), ("u", 1, 0, 7000, "ALIGNMENT_FAILED"), ("t", 1, 0, 16_000, "NO_DISK"), ("s", 1, 5, 16_005, "TRANSLATION_FAILED"), ("r", 1, 0, 9000, "LANGUAGE_UNCERTAIN"), ("r", 2, 0, 20_000, "LANGUAGE_UNCERTAIN")]
    df = spark.createDataFrame(log, "k string, o long, a long, b long, code string")
    got = {(r.k, r.o): (r.attempt, r.action, r.next_end) for r in sessions.retries(df, ["k"], ["o"], "code", "a", "b").collect()}
    assert got == {("w", 1): (0, "half", 8000), ("w", 2): (1, "hole", None), ("w", 3): (2, "late", None), ("v", 1): (0, "longer", 20_000), ("v", 2): (1, "done", None), ("u", 1): (0, "hole", None), ("t", 1): (0, "stop", None), ("s", 1): (0, "hole", None), ("r", 1): (0, "longer", 20_000), ("r", 2): (1, "skip", None)}
    for (k, o), (attempt, action, end) in got.items():
        row = next(x for x in log if x[:2] == (k, o))
        if row[4] and action != "late":
            assert sessions.retry(row[4], attempt, row[3] - row[2]) == (action, end - row[2] if end else 0)


def test_given_up():
    assert models.gave_up([(0.0, -0.2, 1.1), (1.0, -1.2, 1.0)]) and models.gave_up([(1.0, -0.2, 2.5)])
    assert not models.gave_up([(0.8, -3.0, 9.0), (1.0, -1.0, 2.4)]) and not models.gave_up([])


def test_streams():
    s = [{"index": 0, "language": "en"}, {"index": 1, "language": "ja"}, {"index": 2}]
    assert folds.choose_stream(s, {"language": "ja"})["index"] == 1 and folds.choose_stream(s, {"language": "fr"})["index"] == 2 and folds.choose_stream(s, {}) is None
