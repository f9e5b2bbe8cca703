"""Glossary entries for a batch, name hints and the session factory."""

import pytest
from pyspark.sql import functions as F

from spanloom import session as se
from spanloom.operators import nouns, prompt

E = "f string, source string, rendering string, ord long"


def chosen(spark, user, learned, texts, builtin=None, **kw):
    frame = lambda d: spark.createDataFrame([("f", s, r, i) for s, r, i in d], E)
    t = spark.createDataFrame([("f", b, x) for b, x in texts.items()], "f string, b string, text string")
    got = prompt.select_entries(frame(user), frame(learned), t, ["f"], "b", builtin=frame(builtin) if builtin is not None else None, **kw)
    out = {}
    for r in sorted(got.collect(), key=lambda r: r.nth):
        out.setdefault(r.b, []).append((r.source, r.rendering))
    return out


def test_entries(spark):
    user = [("Nash", "N", 0), ("Morse", "M", 1)]
    learned = [(f"Name{i}", f"r{i}", i) for i in range(1, 51)] + [("Hansen", "H", -1), ("Golden rule", "G", -2), ("Nash", "other", -3)]
    text = "Mr. Hanson, golden rule is Nash's idea."
    got = chosen(spark, user, learned, {"x": text, "y": "nothing"}, [("Idea", "I", 0), ("Ide", "J", 1), ("Morse", "late", 2)])
    assert got["x"] == [("Nash", "N"), ("Idea", "I"), ("Hansen", "H"), ("Golden rule", "G"), *[(f"Name{i}", f"r{i}") for i in range(50, 40, -1)]]
    assert got["y"] == [(f"Name{i}", f"r{i}") for i in range(50, 40, -1)]
    many = chosen(spark, [], [(f"N{i}", "x", 100 - i) for i in range(100)], {"x": " ".join(f"N{i}" for i in range(100))})
    assert [s for s, _ in many["x"]] == [f"N{i}" for i in range(40)]
    assert chosen(spark, [], [], {"x": text}) == {}


def test_entries_as_a_plain_rule_says(spark):
    user, learned = [("Elan", "1", 0), ("Anna Bell", "2", 1)], [("José", "3", 3), ("Jose", "4", 2), ("O'Brien", "5", 1)]
    texts = {"a": "Then JOSÉ and Élan's bell rang.", "b": "anna bell; O’Brian", "c": "O'brien"}
    keys = [s for s, _, _ in user] + [s for s, _, _ in learned]
    got = chosen(spark, user, learned, texts, recent=0)
    for b, t in texts.items():
        words = {nouns._FINAL.sub("", m.group()) for m in nouns._WORD.finditer(t)}
        want = {nouns.match_name(w, keys) for w in words} - {None} | {k for k in keys if any(t.casefold()[i : i + len(k)] == k.casefold() and not t[i - 1 : i].isalpha() and not t[i + len(k) : i + len(k) + 1].isalpha() for i in range(len(t)))}
        assert {s for s, _ in got.get(b, [])} == want, b


def test_hints(spark):
    user = spark.createDataFrame([("f", "Nash", "N", 0)], E)
    learned = spark.createDataFrame([("f", f"L{i}", "x", 30 - i) for i in range(30)] + [("f", "Nash", "x", 99), ("g", "Solo", "x", 1)], E)
    got = sorted((r.f, r.nth, r.source) for r in prompt.names_hint(user, learned, ["f"]).collect())
    assert got == [("f", 1, "Nash"), *[("f", i + 2, f"L{i}") for i in range(19)], ("g", 1, "Solo")]


def test_shared_tables(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(se, "shared_dir", lambda s: str(tmp_path))
    x = se.materialize(spark.range(5).withColumn("v", F.lit("a")), "t")
    assert x.count() == 5 and len(list(tmp_path.iterdir())) == 1
    assert se.forget(spark) >= 1 and not list(tmp_path.iterdir())


class _Unset:
    """A session without spark.checkpoint.dir."""

    class conf:  # noqa: N801
        @staticmethod
        def get(key, other=None):
            return other

    def __init__(self, master):
        self.sparkContext = type("C", (), {"master": master, "applicationId": "app-of-a-test"})


def test_shared_folder():
    mine = se.shared_dir(_Unset("local[2]"))
    assert mine and se.shared_dir(_Unset("local[2]")) == mine
    with pytest.raises(ValueError):
        se.shared_dir(_Unset("spark://somewhere:7077"))
