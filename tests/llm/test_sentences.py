"""Sentence ends of texts in several languages, over cues, pauses and brackets."""

import pytest
from pyspark.sql import functions as F

from spanloom.llm import sentences

CASES = [
    "Dr. Reed met Mrs. Fox at 7 p.m. sharp. | They left at 10 p.m. | Was it so? | Yes!",
    "See map.txt, version 2.1.0, no. 7. | No, no. | It cost $3,400.50. | Etc. and so on.",
    "“Why go there?” she asked, and left. | Ann said: “We stay.” | “Stop!” Ann shouted from afar. | I... I only ran.",
    "Wait... what now? | The Zonk! crew left. | J. R. Fox sold it, e.g. to me. | Bring it, the keys, etc. | Then go.",
    "Am 3. Mai kam z. B. Hr. Fuchs. | Nur 10. | „Halt!“, rief er. | Er fragte: „Wo?“ | Bis zum 50. Tag blieb es.",
    "M. Renard a dit, p. ex. hier. | « Non ! » a crié Luc. | Il a demandé : « Où ? » | Bien sûr.",
    "El Dr. Zorro y Ud. van, p. ej. hoy. | —¡Alto! —gritó Ana. | ¿Sí? | ¡No!",
    "Проф. Лис сказал, т. е. да, и т. д. | «Стой!» — крикнул он. | Там 5,1 кг.",
    "彼は「行くな。」と言った。 | それで？ | 雨なら……帰ろう。 | 知ってる。",
    "“别碰！”小槐喊道。 | 医生问：“几点？” | 要是下雨……就回去。 | 过来！",
    '"가지 마!" 하고 말했다. | 6.5킬로그램이에요. | 비가 오면... 간다.',
]


def run(spark, cues):
    df = spark.createDataFrame(cues, "p string, id string, start_ms long, end_ms long, text string, owner string")
    return sorted((r.owner, r.cue_id, r.end_pos) for r in sentences.sentence_ends(df, F.col("p")).collect())


@pytest.mark.parametrize("marked", CASES)
def test_languages(spark, marked):
    parts = marked.split(" | ")
    glue = "" if any("぀" <= c <= "鿿" for c in marked) else " "
    text = glue.join(parts)
    want, at = [], 0
    for part in parts:
        at += len(part)
        want.append(("a", "1", at))
        at += len(glue)
    assert run(spark, [("a", "1", 0, 900, text, "x")]) == want


@pytest.mark.parametrize("size", [7, 23])
def test_cues_of_one_sentence(spark, size):
    """Cut into cues at any blank, the same ends come out."""
    text = CASES[2].replace(" | ", " ")
    cues, at = [], 0
    words = text.split(" ")
    for i in range(0, len(words), size % 5 + 1):
        cues.append(("a", f"{i:03}", at, at + 90, " ".join(words[i : i + size % 5 + 1]), ""))
        at += 100
    ends = run(spark, cues)
    by = {c[1]: c[4] for c in cues}
    assert [by[i][:e].split(" ")[-1] for _, i, e in ends] == ["left.", "stay.”", "afar.", "ran."]


def test_pauses_brackets_and_edges(spark):
    cues = [
        ("a", "1", 0, 500, "no mark here ", ""), ("a", "2", 600, 900, "(music)", ""), ("a", "3", 1000, 1500, "after it", ""), ("a", "4", 3500, 3900, "new one", ""), ("a", "4", 3500, 3900, "new one", ""), ("a", "5", 4000, None, "goes on", ""),
        ("a", "6", 9000, 9100, "still", ""), ("a", "7", 9100, 9050, " ♪ ", ""), ("a", "8", 9500, 9600, None, ""), ("a", "9", 9700, 9800, "", ""), (None, "10", 1, 2, "Lost.", ""), ("b", "11", 599_900, 599_990, "Over the", ""), ("b", "12", 600_050, 600_100, "edge. And", ""), ("b", "13", 1_200_100, 1_200_200, "far", ""),
    ]
    assert run(spark, cues) == [("a", "1", 12), ("a", "2", 7), ("a", "3", 8), ("a", "6", 5), ("b", "12", 5), ("b", "12", 9), ("b", "13", 3)]
    assert run(spark, []) == []


def test_raw_text_is_given_back(spark):
    odd = "A \ue000 \ue003 b\ue00f. And m\ue004ore."
    df = spark.createDataFrame([("a", "1", 0, 900, odd)], "p string, id string, start_ms long, end_ms long, text string")
    got = sorted(r.text for r in sentences.sentences(df, F.col("p")).collect())
    assert got == ["A \ue000 \ue003 b\ue00f.", "And m\ue004ore."]


def test_long_quotes_are_looked_through(spark):
    inner = "we go on and on and on. " * 40
    text = f"“{inner.strip()}” she said, and left. Then."
    assert [e for _, _, e in run(spark, [("a", "1", 0, 900, text, "")])] == [len(text) - 6, len(text)]


def test_mask_keeps_length(spark):
    texts = [c.replace(" | ", " ") for c in CASES]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", sentences.masked(F.col("t")).alias("m"))
    df = df.withColumn("r", sentences.restored(F.col("m"), F.col("t")))
    for r in df.collect():
        assert len(r.m) == len(r.t) and r.r == r.t


def test_whole_sentences(spark):
    cues = [("a", "1", 0, 500, "Dr. Reed met", ""), ("a", "2", 600, 900, "Mrs. Fox. They", ""), ("a", "3", 1000, None, "left... then! Go.", ""), ("a", "4", 1100, 1200, "予", ""), ("a", "5", 1300, 1400, "備だ。", "")]
    df = spark.createDataFrame(cues, "p string, id string, start_ms long, end_ms long, text string, owner string")
    got = sorted((r.start_ms, r.first_id, r.last_id, r.cues, r.end_ms, r.text) for r in sentences.sentences(df, F.col("p")).collect())
    assert got == [(0, "1", "2", 2, 900, "Dr. Reed met Mrs. Fox."), (600, "2", "3", 2, None, "They left... then!"), (1000, "3", "3", 1, None, "Go."), (1100, "4", "5", 2, 1400, "予備だ。")]


def test_list_ends_with_the_cue(spark):
    cues = [("a", "1", 0, 500, "the keys, etc.", ""), ("a", "2", 600, 900, "run", ""), ("a", "3", 1000, 1200, "Fox Inc.", ""), ("a", "4", 1300, 1400, "sent it, etc. and more.", "")]
    assert run(spark, cues) == [("a", "1", 14), ("a", "4", 23)]


def test_long_texts(spark):
    cues = [("a", "1", 0, 500, "One is here. " * 20_000, "")] + [("b", f"{i:05}", i * 100, i * 100 + 50, "and so on", "") for i in range(4000)]
    ends = run(spark, cues)
    assert len(ends) == 20_001 and ends[19_999] == ("a", "1", 20_000 * 13 - 1) and ends[-1] == ("b", "03999", 9)
