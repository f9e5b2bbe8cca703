"""Queries on small tables that hold what a narrower query would leave out, against plain Python."""

import hashlib
import json

from pyspark.sql import functions as F

from spanloom.functions import text as tx
from spanloom.operators import folds
from spanloom.plans import dialogue, folded


def write(spark, folder, table, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{table}.parquet")
    return str(folder)


CUES = "profile string, media string, id string, start_ms long, end_ms long, text string"


def test_digest_ids_of_any_text(spark, tmp_path):
    texts = ["Plain words.", "It's 5 o'clock", 'He said "no"', "C:\\u001F \\\\ /", "Été–là", "走れ。", "Привет", "a\nb\tc\r\b\f", "".join(map(chr, range(32))) + "\x7f\u2028", "😀", "", " "]
    folder = write(spark, tmp_path, "cues", [('p"1', "m", str(i), 10 * i, 10 * i + 5, t) for i, t in enumerate(texts)], CUES)
    want = {str(i): hashlib.sha256(json.dumps(['p"1', 10 * i, 10 * i + 5, t], ensure_ascii=False).encode()).hexdigest()[:24] for i, t in enumerate(texts)}
    assert {r.id: r.digest for r in dialogue.digest_ids(spark, folder).collect()} == want


GLOSSARY = "seq long, media string, target string, source string, rendering string, first_ms long"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last = row
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_casefold(spark):
    new = {0x1C89, 0xA7CB, 0xA7CC, 0xA7DA, 0xA7DC, *range(0x10D50, 0x10D66)}  # of Unicode 16, which the JVM doesn't know
    df = spark.createDataFrame([(chr(i),) for i in range(1, 0x20000) if not 0xD800 <= i < 0xE000 and i not in new] + [("ΟΔΟΣ",), ("Straße",)], "t string")
    assert [r.t for r in df.select("t", tx.casefold(F.col("t")).alias("f")).collect() if r.f != r.t.casefold()] == []


def test_fuzzy_names_of_any_script(spark, tmp_path):
    names = ["Ann", "Anna", "José Marín", "Jose Marin", "Jean-Luc", "Jean-Lux", "O'Brien", "O’Brian", "St. Ann", "St Ann", "Надежда", "Надежна", "надежда", "さくらもち", "さくらもじ", "Мир", "Миру", "Straße", "STRASSE", "Penhallow", "Penhalow", "Penhalo", "Pen", "Élan", "elan", "ΟΔΟΣ", "οδοσα", "Al"]
    folder = write(spark, tmp_path, "glossary", [(i, m, "ja", n, "x", 0) for m, order in (("m", names), ("w", names[::-1])) for i, n in enumerate(order)], GLOSSARY)
    want = {}
    for m, order in (("m", names), ("w", names[::-1])):
        for i, n in enumerate(order):
            if len(n) >= 4:
                near = [(d, j, k) for j, k in enumerate(order[:i]) if k[:1].casefold() == n.casefold()[:1] and (d := distance(n.casefold(), k.casefold())) <= (1 if max(len(n), len(k)) <= 5 else 2)]
                if near:
                    want[m, n] = (min(near)[2], min(near)[0])
    assert {(r.media, r.name): (r.known, r.d) for r in dialogue.fuzzy_names(spark, folder).collect()} == want
    assert want["m", "Jose Marin"] == ("José Marín", 2) and want["m", "Anna"] == ("Ann", 1)


def test_name_tokens_of_any_script(spark, tmp_path):
    texts = ["Renée met Schlüter, Jean-Luc and O’Brien.", "Надежда и Schlüter's NATO, США, a Schlüter.", "Hansens' Ningún dog; McCoy II"]
    folder = write(spark, tmp_path, "documents", [(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    want = {"Renée": 1, "Schlüter": 3, "Jean-Luc": 1, "Надежда": 1, "NATO": 1, "США": 1, "Hansens": 1, "Ningún": 1, "McCoy": 1, "II": 1}
    got = {r.w: (r.n, r.acronym) for r in dialogue.name_tokens(spark, folder).collect()}
    assert got == {w: (n, w.isupper()) for w, n in want.items()}


def test_sentence_groups_continue_across_blocks(spark, tmp_path):
    texts = ["We were", "going home.", "Then he", "left and", "She stayed."]
    folder = write(spark, tmp_path, "cues", [(p, "m", str(i), 20_000 * i, 20_000 * i + 900, t) for p in "pq" for i, t in enumerate(texts)], CUES)
    got = sorted((r.profile, r.id, r.block, r.continues) for r in folded.sentence_groups(spark, folder).collect())
    assert got == [(p, str(i), i + 1, i > 0 and not folds.finished(texts[i - 1])) for p in "pq" for i in range(5)]
    assert [x[-1] for x in got[:5]] == [False, True, False, True, True]


def test_film_names_of_the_whole_film(spark, tmp_path):
    texts = ["We saw Umberto.", "Umberto left.", "Oriana Bell came. Then Надя spoke.", "走れ"]
    films = {"a": "eng", "b": "JA", "c": None, "d": "ja"}  # d's label is wrong
    write(spark, tmp_path, "cues", [(p, p, f"{p}{i}", 20_000 * i, 20_000 * i + 900, t + "走れ" * 40 * (p == "b")) for p in films for i, t in enumerate(texts)], CUES)
    folder = write(spark, tmp_path, "chunks", [(p, i, ({"code": code},)) for p, code in films.items() for i in range(2)], "profile string, seq long, payload struct<language struct<code string>>")
    want = [(p, k, n) for p in "acd" for k, n in ((1, "Umberto"), (2, "Umberto"), (3, "Bell"), (3, "Надя"))]
    assert sorted((r.profile, r.block, r.name) for r in folded.film_names(spark, folder).collect()) == want
