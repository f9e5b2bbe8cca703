"""Runs of one line against a plain reading of the rows."""

import random

import pytest
from pyspark.sql import functions as F

from spanloom.llm import lines

S = "profile string, id string, start_ms long, end_ms long, text string, chunk string"


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [
        ("Run!", "run", True), ("Café au lait", "café au lait", True), ("ＲＵＮ", "run", True), ("Don't go", "Dont go", True), ("I see", "Isee", True), ("the harbour", "the harbuor", True), ("the harbour", "the harbor", True), ("the harbour", "the harbr", False),
        ("a tram", "a train", False), ("a door", "a dour", False), ("a boats", "a boots", True), ("line 12345", "line 12346", False), ("медный ключ", "медныи ключ", True), ("请把纸船", "请把紙船", False), ("one two", "one two three", False), ("fuses fuses", "fuse fuse", False), ("green radio", "greeny radio", True), ("naïveté", "naivete", True),
    ],
)
def test_same_line(a, b, same):
    x, y = lines.folded(a), lines.folded(b)
    assert lines.same_line(x, y) is same and lines.same_line(y, x) is same


def plain(rows):
    by = {}
    for p, i, s, e, t, _ in dict.fromkeys(rows):
        if p is not None and i is not None and s is not None and t is not None and lines.folded(t):
            by.setdefault(p, []).append((s, -(1 << 60) if e is None else e, i, lines.folded(t), e))
    out = set()
    for p, v in by.items():
        v.sort()
        i = 0
        while i < len(v):
            j = i
            while j + 1 < len(v) and lines.same_line(v[j][3], v[j + 1][3]):
                j += 1
            if j > i:
                out.add((p, v[i][2], v[j][2], j - i + 1, v[i][0], max(max(x[0], x[0] if x[4] is None else x[4]) for x in v[i : j + 1])))
            i = j + 1
    return out


def test_random(spark):
    rng = random.Random(3)
    words = ["Run!", "run", "the harbour", "the harbor", "Not now.", "♪", None, "", "the harbour!"]
    rows = [(rng.choice(["p", "q", None]), f"{k:04}", rng.randrange(0, 4000), rng.choice([None, 10, 2000, 5000]), rng.choice(words), "x") for k in range(400)]
    rows += rows[:30]
    for size in (250, 10**6):
        got = [tuple(r)[:6] for r in lines.runs(spark.createDataFrame(rows, S), F.col("profile"), chunk_ms=size).collect()]
        assert len(got) == len(set(got)) and set(got) == plain(rows)


def test_empty(spark):
    assert lines.runs(spark.createDataFrame([], S), F.col("profile")).count() == 0
