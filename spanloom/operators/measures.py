"""Aggregates: score summaries, languages, quantiles, word and name counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: an issue text that blames the source.
SUSPECT = "(?i)mishear|misheard|transcri|garbled|recogni"
#: Fixed value: a word begins with a letter or letter number and goes on with those, apostrophes and hyphens.
WORD = "[\\p{L}\\p{Nl}\\p{No}](?:[\\p{L}\\p{Nl}\\p{No}]|['’\\-])*"


def suspect(ok: Column, issue: Column) -> Column:
    return (~F.coalesce(ok, F.lit(True))) | F.coalesce(issue.rlike(SUSPECT), F.lit(False))


def score_summary(df: DataFrame, by: list[str], score: str, ok: str, issue: str) -> DataFrame:
    """Count, unjudged, mean, the number of each score from 1 to 5, source flags, and means where the source is good."""
    s, bad = F.col(score), suspect(F.col(ok), F.col(issue))
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(s.isNull()).alias("unjudged"), F.avg(s).alias("mean"), *[F.count_if(s == k).alias(f"score_{k}") for k in range(1, 6)],
        F.count_if(~F.col(ok)).alias("source_not_ok"), F.count_if(bad).alias("source_suspect"), F.avg(F.when(F.col(ok), s)).alias("mean_ok"), F.avg(F.when(~bad, s)).alias("mean_clean"),
    )


def nearest_rank(df: DataFrame, by: list[str], value: str, q: float) -> DataFrame:
    """The exact value at place floor((n - 1) q) of the sorted values, from counts of equal values, not from a list."""
    from pyspark.sql import Window

    x = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy(*by).orderBy(value)
    x = x.withColumn("to", F.sum("c").over(w)).withColumn("n", F.sum("c").over(Window.partitionBy(*by)))
    return x.where(F.col("to") > F.floor((F.col("n") - 1) * q)).groupBy(*by).agg(F.min(value).alias("value"), F.first("n").alias("n"))


def known_language(df: DataFrame, by: list[str], code: str, at: str) -> DataFrame:
    """The first and the last known language of each group in the order of ``at``; ``und`` is unknown."""
    known = F.when(F.col(code) != "und", F.col(code))
    return df.groupBy(*by).agg(F.min_by(code, F.when(known.isNotNull(), F.struct(at, code))).alias("first_known"), F.max_by(code, F.when(known.isNotNull(), F.struct(at, code))).alias("last_known"))


def word_cases(df: DataFrame, by: list[str], text: str) -> DataFrame:
    """Every word in small letters with how often it stands with a small first letter and with another one."""
    x = df.select(*by, F.explode(F.regexp_extract_all(F.col(text), F.lit(WORD), F.lit(0))).alias("w"))
    small = F.col("w").rlike("^\\p{Ll}")
    return x.groupBy(*by, F.lower("w").alias("word")).agg(F.count_if(small).alias("small"), F.count_if(~small).alias("other"))


def common_words(df: DataFrame, by: list[str], text: str) -> DataFrame:
    """Words that stand at least once, and at least as often as not, with a small first letter."""
    return word_cases(df, by, text).where("small >= 1 and small >= other")


#: A run of letters, of which every name and every text is a row for the join of :func:`hits`.
RUN = "[\\p{L}\\p{Nl}\\p{No}]+"


def hits(names: DataFrame, texts: DataFrame, keys: list[str], name: str, text: str, text_id: str, any_case: bool = False) -> DataFrame:
    """(keys, name, text_id, k): the texts that hold a name as a word, and how often.

    No letter may stand before or behind the name; other signs in it count as they are. ``names`` and ``texts`` share the
    key columns, in which ``text_id`` is one text. Names and texts meet by the name's first run of letters, ids only; a
    text is fetched for those pairs. Names without a letter are left out. With ``any_case`` case does not count.
    """
    small = F.lower if any_case else (lambda c: c)
    n = names.select(*keys, name).distinct().withColumn("_w", small(F.regexp_extract(F.col(name), f"({RUN})", 1))).where("_w <> ''")
    heads = n.select(*keys, "_w").distinct()
    t = texts.select(*keys, text_id, F.explode(F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(RUN), F.lit(0)))).alias("_w")).withColumn("_w", small(F.col("_w")))
    near = t.join(heads, [*keys, "_w"], "left_semi").distinct().join(n, [*keys, "_w"]).select(*keys, text_id, name)
    escaped = F.regexp_replace(F.col(name), "([\\\\.\\[\\]{}()*+?^$|])", "\\\\$1")
    edge = RUN[:-1]
    pattern = F.concat(F.lit(("(?iu)" if any_case else "") + f"(?<!{edge})"), escaped, F.lit(f"(?!{edge})"))
    return near.join(texts.select(*keys, text_id, text), [*keys, text_id]).withColumn("k", F.regexp_count(F.col(text), pattern)).where("k > 0").select(*keys, name, text_id, "k")


def mentions(names: DataFrame, texts: DataFrame, keys: list[str], name: str, text: str, text_id: str) -> DataFrame:
    """Per name: texts that hold it as a word, and occurrences; see :func:`hits`. Names never mentioned are left out."""
    return hits(names, texts, keys, name, text, text_id).groupBy(*keys, name).agg(F.count(F.lit(1)).alias("mentions"), F.sum("k").alias("occurrences"))
