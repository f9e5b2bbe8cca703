"""Queries of the general training-data operators: intervals (p2) and orphan references (p6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.operators import dyadic, orphans
from spanloom.sources.tables import key_of, load


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Periods and gaps of the chunks per profile and of the prepared ranges per session."""
    chunks = load(spark, folder, "chunks").select(F.lit("chunks").alias("tbl"), key_of("profile").alias("owner"), F.col("start_ms").alias("lo"), F.col("end_ms").alias("hi"))
    sessions = load(spark, folder, "sessions").where("session_id is not null").select("session_id", F.explode("prepared").alias("x")).select(F.lit("sessions").alias("tbl"), F.col("session_id").alias("owner"), F.col("x.start_ms").alias("lo"), F.col("x.end_ms").alias("hi"))
    return dyadic.between(chunks.unionByName(sessions))


def p2_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Per table and owner: the number of periods and gaps and the time they take."""
    x = p2_found(spark, folder).withColumn("ms", F.col("to_ms") - F.col("from_ms"))
    period = F.col("kind") == "period"
    return x.groupBy("tbl", "owner").agg(F.count_if(period).alias("periods"), F.count_if(~period).alias("gaps"), F.coalesce(F.sum(F.when(period, F.col("ms"))), F.lit(0)).alias("covered_ms"), F.coalesce(F.sum(F.when(~period, F.col("ms"))), F.lit(0)).alias("gap_ms"))


def _orphans(spark: SparkSession, folder: str) -> DataFrame:
    chunks = load(spark, folder, "chunks").select("seq", "profile", "updated").distinct()
    profiles = load(spark, folder, "profiles").select("profile", "media", "registered", "cleared").distinct()
    glossary = load(spark, folder, "glossary").select("seq", "media", "updated").distinct()
    media = load(spark, folder, "media")
    return orphans.orphans(
        [
            orphans.references(chunks, "chunks", "profiles", F.col("seq"), key_of("profile"), "updated"),
            orphans.references(profiles, "profiles", "media", F.col("profile"), key_of("media"), "registered"),
            orphans.references(glossary, "glossary", "media", F.col("seq"), key_of("media"), "updated"),
        ],
        [orphans.stays(profiles, "profiles", key_of("profile"), "registered", "cleared"), orphans.stays(media, "media", key_of("media"), "added", "removed")],
    )


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return _orphans(spark, folder).where("row_key is not null").select(F.col("child").alias("tbl"), "row_key").distinct()


def p6_by_month(spark: SparkSession, folder: str) -> DataFrame:
    return orphans.by_period(_orphans(spark, folder))


_ISLANDS = """
WITH raw AS (
  SELECT DISTINCT 'chunks' tbl, lower(trim(profile, {blanks})) owner, start_ms a, end_ms b FROM chunks
  UNION SELECT DISTINCT 'sessions', session_id, p.start_ms, p.end_ms FROM (SELECT session_id, unnest(prepared) p FROM sessions)),
r AS (SELECT * FROM raw WHERE owner <> '' AND a >= 0 AND a < b),
m AS (SELECT *, max(b) OVER (PARTITION BY tbl, owner ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) pm FROM r),
g AS (SELECT *, sum(CASE WHEN pm IS NULL OR a > pm THEN 1 ELSE 0 END) OVER (PARTITION BY tbl, owner ORDER BY a, b ROWS UNBOUNDED PRECEDING) g FROM m),
per AS (SELECT tbl, owner, min(a) a, max(b) b FROM g GROUP BY tbl, owner, g),
nx AS (SELECT *, lead(a) OVER (PARTITION BY tbl, owner ORDER BY a) n FROM per),
f AS (SELECT tbl, owner, 'period' kind, a from_ms, b to_ms FROM per UNION ALL SELECT tbl, owner, 'gap', b, n FROM nx WHERE n IS NOT NULL)
""".replace("{blanks}", "' ' || chr(9) || chr(10) || chr(13) || chr(160) || chr(12288)")

_ORPHANS = """
WITH c AS (
  SELECT DISTINCT 'chunks' child, 'profiles' parent, CAST(seq AS VARCHAR) row_key, lower(trim(profile, {blanks})) k, updated t FROM chunks
  UNION SELECT DISTINCT 'glossary', 'media', CAST(seq AS VARCHAR), lower(trim(media, {blanks})), updated FROM glossary),
pc AS (SELECT DISTINCT profile, lower(trim(media, {blanks})) k, registered t, cleared FROM profiles),
al AS (SELECT * FROM c UNION ALL SELECT 'profiles', 'media', profile, k, t FROM pc),
p AS (SELECT 'profiles' parent, lower(trim(profile, {blanks})) k, registered b, cleared e FROM profiles
  UNION ALL SELECT 'media', lower(trim(media, {blanks})), added, removed FROM media),
o AS (SELECT * FROM al WHERE k <> '' AND NOT EXISTS (SELECT 1 FROM p WHERE p.parent = al.parent AND p.k = al.k AND p.b <= al.t AND (p.e IS NULL OR p.e > al.t)))
""".replace("{blanks}", "' ' || chr(9) || chr(10) || chr(13) || chr(160) || chr(12288)")

QUERIES = {"p2_found": p2_found, "p2_totals": p2_totals, "p6_found": p6_found, "p6_by_month": p6_by_month}

ORACLES = {
    "p2_found": _ISLANDS + "SELECT tbl, owner, kind, from_ms, to_ms FROM f",
    "p2_totals": _ISLANDS
    + """SELECT tbl, owner, count(*) FILTER (WHERE kind = 'period') periods, count(*) FILTER (WHERE kind = 'gap') gaps,
 CAST(coalesce(sum(to_ms - from_ms) FILTER (WHERE kind = 'period'), 0) AS BIGINT) covered_ms, CAST(coalesce(sum(to_ms - from_ms) FILTER (WHERE kind = 'gap'), 0) AS BIGINT) gap_ms
 FROM f GROUP BY tbl, owner""",
    "p6_found": _ORPHANS + "SELECT DISTINCT child tbl, row_key FROM o WHERE row_key IS NOT NULL",
    "p6_by_month": _ORPHANS + "SELECT child, parent, strftime(t AT TIME ZONE 'UTC', '%Y-%m') AS month, count(*) orphans, count(DISTINCT k) keys FROM o GROUP BY ALL",
}
