"""The frames most queries begin with, in Spark and as DuckDB common table expressions of the same meaning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.sources.tables import key_of, load

_BLANKS = "' ' || chr(9) || chr(10) || chr(13) || chr(160) || chr(12288)"


def sql_key(col: str) -> str:
    return f"lower(trim({col}, {_BLANKS}))"


_BL = "[\\s\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x1c-\\x1f]"


def sql_strip(text: str) -> str:
    return f"regexp_replace({text}, '^{_BL}+|{_BL}+$', '', 'g')"


def sql_bare(text: str) -> str:
    """Without blanks at either end and without closing marks behind."""
    return f"regexp_replace({sql_strip(text)}, '[''\"”’)\\]}}】」』]+$', '')"


def sql_joined(texts: str) -> str:
    """Stripped texts joined by blanks, none between two ideographs or kana; two passes, for a match takes both neighbours."""
    tight = lambda t: f"regexp_replace({t}, '([\\x{{3000}}-\\x{{9fff}}]) ([\\x{{3000}}-\\x{{9fff}}])', '\\1\\2', 'g')"
    return tight(tight(f"array_to_string(list_filter({texts}, lambda x: x <> ''), ' ')"))


LETTER, OTHER = "[\\p{L}\\p{Nl}\\p{No}]", "[^\\p{L}\\p{Nl}\\p{No}]"


def sql_twice(text: str) -> str:
    """With every sign that is no letter twice."""
    return f"regexp_replace({text}, '({OTHER})', '\\1\\1', 'g')"


def sql_escaped(name: str) -> str:
    return f"regexp_replace({name}, '([\\\\.\\[\\]{{}}()*+?^$|])', '\\\\\\1', 'g')"


def sql_fold(text: str) -> str:
    return f"replace(replace(lower({text}), 'ß', 'ss'), 'ς', 'σ')"


def sql_edits(a: str, b: str) -> str:
    """Edits between two lists of letters, by the rows of the table: DuckDB's levenshtein counts bytes."""
    rows = f"""list_reduce(list_prepend(range(0, len({b}) + 1), [[i] for i in range(1, len({a}) + 1)]),
  lambda row, i: list_transform(range(0, len({b}) + 1), lambda j: list_min(list_transform(range(0, j + 1), lambda m: j - m + CASE WHEN m = 0 THEN i[1] ELSE least(row[m + 1] + 1, row[m] + CASE WHEN {a}[i[1]] = {b}[m] THEN 0 ELSE 1 END) END))))"""
    return f"list_last({rows})"


def sql_established(names: str, known: str, film: str) -> str:
    """CTEs that give in ``es`` (film, name, match) the known spelling (film, known, ord) of each of ``names`` (film, name)."""
    return f"""ea AS (SELECT n.*, k.known, k.ord, string_split({sql_fold('n.name')}, '') p, string_split({sql_fold('k.known')}, '') q FROM {names} n JOIN {known} k ON k.{film} = n.{film} WHERE k.known = n.name OR length(n.name) >= 4 AND {sql_fold('n.name')}[1] = {sql_fold('k.known[1]')}[1] AND abs(length({sql_fold('n.name')}) - length({sql_fold('k.known')})) <= 2),
 eb AS (SELECT {film}, name, known, ord, CASE WHEN known = name THEN -1 ELSE {sql_edits('p', 'q')} END d FROM ea),
 es AS (SELECT {film}, name, arg_min(known, (d, ord, known)) AS match FROM eb WHERE d <= CASE WHEN greatest(length(name), length(known)) <= 5 THEN 1 ELSE 2 END GROUP BY 1, 2)"""


def sql_clean(text: str) -> str:
    return sql_strip(f"regexp_replace(regexp_replace({text}, '<[^>]*>|\\{{[^}}]*\\}}', '', 'g'), '[\\x00-\\x1f\\x7f]', ' ', 'g')")


def sql_stamp(ms: str) -> str:
    return f"printf('%02d:%02d:%02d,%03d', {ms} // 3600000, {ms} // 60000 % 60, {ms} // 1000 % 60, {ms} % 1000)"


def cues(spark: SparkSession, folder: str) -> DataFrame:
    """Heard cues with a key, a text and a possible interval, each once."""
    x = load(spark, folder, "cues").select(key_of("profile").alias("profile"), key_of("media").alias("media"), "id", "start_ms", "end_ms", "text")
    return x.where("profile is not null and text is not null and start_ms >= 0 and start_ms < end_ms").distinct()


def chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks with a key and a possible interval, each once, without their payload."""
    x = load(spark, folder, "chunks").select(key_of("profile").alias("profile"), "seq", "start_ms", "end_ms", "updated")
    return x.where("profile is not null and start_ms >= 0 and start_ms < end_ms").distinct()


def sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Session snapshots with a key, position and rate, each once."""
    x = load(spark, folder, "sessions").select("session_id", "epoch", "seq", key_of("profile").alias("profile"), "position_ms", "rate", "revision")
    return x.where("profile is not null and position_ms >= 0 and rate > 0").distinct()


def durations(spark: SparkSession, folder: str) -> DataFrame:
    """(profile, duration_ms): the longest known duration of the profile's media."""
    p = load(spark, folder, "profiles").select(key_of("profile").alias("profile"), key_of("media").alias("media")).where("profile is not null and media is not null").distinct()
    m = load(spark, folder, "media").groupBy(key_of("media").alias("media")).agg(F.max("duration_ms").alias("duration_ms")).where("media is not null and duration_ms > 0")
    return p.join(m, "media").groupBy("profile").agg(F.max("duration_ms").alias("duration_ms"))


CUES = f"cu AS (SELECT DISTINCT {sql_key('profile')} profile, {sql_key('media')} media, id, start_ms, end_ms, text FROM cues WHERE {sql_key('profile')} <> '' AND text IS NOT NULL AND start_ms >= 0 AND start_ms < end_ms)"
CHUNKS = f"ch AS (SELECT DISTINCT {sql_key('profile')} profile, seq, start_ms, end_ms, updated FROM chunks WHERE {sql_key('profile')} <> '' AND start_ms >= 0 AND start_ms < end_ms)"
SESSIONS = f"se AS (SELECT DISTINCT session_id, epoch, seq, {sql_key('profile')} profile, position_ms, rate, revision FROM sessions WHERE {sql_key('profile')} <> '' AND position_ms >= 0 AND rate > 0)"
DURATIONS = f"""du AS (SELECT p.profile, max(m.d) duration_ms FROM (SELECT DISTINCT {sql_key('profile')} profile, {sql_key('media')} media FROM profiles) p
 JOIN (SELECT {sql_key('media')} media, max(duration_ms) d FROM media GROUP BY 1) m ON m.media = p.media WHERE p.profile <> '' AND m.media <> '' AND m.d > 0 GROUP BY 1)"""


def islands(name: str, source: str, owner: str = "profile") -> str:
    """CTEs that merge the ranges of ``source`` into ``name`` (owner, start_ms, end_ms, n)."""
    return f"""{name}_m AS (SELECT {owner}, start_ms a, end_ms b, max(end_ms) OVER (PARTITION BY {owner} ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) pm FROM {source}),
 {name}_g AS (SELECT *, sum(CASE WHEN pm IS NULL OR a > pm THEN 1 ELSE 0 END) OVER (PARTITION BY {owner} ORDER BY a, b ROWS UNBOUNDED PRECEDING) g FROM {name}_m),
 {name} AS (SELECT {owner}, min(a) start_ms, max(b) end_ms, count(*) n FROM {name}_g GROUP BY {owner}, g)"""
