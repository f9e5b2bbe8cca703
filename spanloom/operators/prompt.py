"""Entries of a glossary that a batch of texts needs, and name lists for a recogniser."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions import text as tx
from spanloom.operators import measures, nouns

#: Entries shown at most, the newest learned ones that are always among them, and names of a hint.
MOST_ENTRIES, RECENT, MOST_HINTS = 40, 10, 20


def _ordered(user: DataFrame, builtin: DataFrame | None, learned: DataFrame, film: list[str]) -> DataFrame:
    """(film, source, rendering, tier, ord, fuzzy): user entries, then built-in, then learned ones, newest first."""
    cols = [*film, "source", "rendering"]
    tier = lambda df, n, by, fuzzy: df.select(*cols, F.lit(n).alias("tier"), by.alias("ord"), F.lit(fuzzy).alias("fuzzy"))
    out = tier(user, 0, F.col("ord"), True).unionByName(tier(learned, 2, -F.col("ord"), True))
    return out.unionByName(tier(builtin, 1, F.col("ord"), False)) if builtin is not None else out


def select_entries(user: DataFrame, learned: DataFrame, texts: DataFrame, film: list[str], batch: str, text: str = "text", builtin: DataFrame | None = None, most: int = MOST_ENTRIES, recent: int = RECENT) -> DataFrame:
    """(film, batch, source, rendering, nth): the entries worth showing for each batch of texts, at most ``most``.

    ``user`` and ``learned`` (and ``builtin``) have the film's columns, source, rendering and ``ord``: the place of a user
    entry, and what grows with each learned one. First come entries that the batch's texts hold as a word in any case, or
    of which a word is a misspelling - built-in ones must stand as they are; then the ``recent`` newest learned ones. User
    entries go before built-in ones, these before learned; of a source that stands in several tiers the first counts.
    """
    entries = _ordered(user, builtin, learned, film)
    once = Window.partitionBy(*film, "source").orderBy("tier", "ord", "rendering")
    first = entries.withColumn("_r", F.row_number().over(once)).where("_r = 1").drop("_r")
    # misspellings: every word of a batch stands for at most one entry
    words = texts.select(*film, batch, F.explode(F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(measures.WORD), F.lit(0)))).alias("name"))
    words = words.withColumn("name", tx.without_possessive(F.col("name"))).where("name <> ''").distinct()
    at = Window.partitionBy(*film).orderBy("tier", "ord", "source")
    fuzzy = entries.where("fuzzy").withColumn("_r", F.row_number().over(Window.partitionBy(*film, "source").orderBy("tier", "ord"))).where("_r = 1")
    known = fuzzy.select(F.struct(*film).alias("film"), F.col("source").alias("known"), F.row_number().over(at).alias("ord"))
    meant = nouns.established(words.select(F.struct(*film).alias("film"), "name").distinct(), known, "film")
    told = words.select(F.struct(*film).alias("film"), batch, "name").join(meant, ["film", "name"]).select(*[F.col(f"film.{k}").alias(k) for k in film], batch, F.col("match").alias("source"))
    # entries as they stand, in any case
    there = measures.hits(first, texts, film, "source", text, batch, any_case=True)
    relevant = told.unionByName(there.select(*film, batch, "source")).distinct().join(first, [*film, "source"]).withColumn("part", F.lit(0))
    newest = learned.withColumn("_r", F.row_number().over(Window.partitionBy(*film).orderBy(F.desc("ord"), "source"))).where(F.col("_r") <= recent).select(*film, "source", "rendering", F.lit(2).alias("tier"), (-F.col("ord")).alias("ord"))
    newest = texts.select(*film, batch).distinct().join(newest, film).withColumn("part", F.lit(1))
    cols = [*film, batch, "source", "rendering", "part", "tier", "ord"]
    both = relevant.select(*cols).unionByName(newest.select(*cols))
    both = both.withColumn("_r", F.row_number().over(Window.partitionBy(*film, batch, "source").orderBy("part", "tier", "ord"))).where("_r = 1")
    place = F.row_number().over(Window.partitionBy(*film, batch).orderBy("part", "tier", "ord", "source"))
    return both.withColumn("nth", place).where(F.col("nth") <= most).select(*film, batch, "source", "rendering", "nth")


def names_hint(user: DataFrame, learned: DataFrame, film: list[str], most: int = MOST_HINTS) -> DataFrame:
    """(film, source, nth): user names first, then the newest learned ones that are no user names, at most ``most``."""
    x = user.select(*film, "source", F.lit(0).alias("tier"), "ord").unionByName(learned.join(user.select(*film, "source"), [*film, "source"], "left_anti").select(*film, "source", F.lit(1).alias("tier"), (-F.col("ord")).alias("ord")))
    place = F.row_number().over(Window.partitionBy(*film).orderBy("tier", "ord", "source"))
    return x.withColumn("nth", place).where(F.col("nth") <= most).select(*film, "source", "nth")
