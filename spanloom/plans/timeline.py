"""Coverage, planning and range-join queries over chunks, cues and sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.operators import joins, spans
from spanloom.plans import frames as fr
from spanloom.sources.tables import load

#: Bucket length of range joins: chunks are about 16 s long.
BUCKET = 32_000


def _islands(spark: SparkSession, folder: str) -> DataFrame:
    return spans.merge(fr.chunks(spark, folder), ["profile"])


def _prepared(spark: SparkSession, folder: str) -> DataFrame:
    s = load(spark, folder, "sessions").select(fr.key_of("profile").alias("profile"), F.explode("prepared").alias("x")).select("profile", "x.start_ms", "x.end_ms")
    return s.where("profile is not null and start_ms >= 0 and start_ms < end_ms").distinct()


def coverage_merge(spark: SparkSession, folder: str) -> DataFrame:
    return _islands(spark, folder)


def coverage_total(spark: SparkSession, folder: str) -> DataFrame:
    x = _islands(spark, folder)
    return x.groupBy("profile").agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("covered_ms"), F.count(F.lit(1)).alias("islands"))


def coverage_union(spark: SparkSession, folder: str) -> DataFrame:
    return spans.union([fr.chunks(spark, folder), _prepared(spark, folder)], ["profile"])


def coverage_subtract(spark: SparkSession, folder: str) -> DataFrame:
    return spans.subtract(fr.chunks(spark, folder), _prepared(spark, folder), ["profile"])


def coverage_holes(spark: SparkSession, folder: str) -> DataFrame:
    return spans.holes(_islands(spark, folder), fr.durations(spark, folder), ["profile"])


def completeness(spark: SparkSession, folder: str) -> DataFrame:
    """Whether chunks cover all of a profile's media; a profile without chunks is incomplete."""
    x = _islands(spark, folder).groupBy("profile").agg(F.count(F.lit(1)).alias("n"), F.min("start_ms").alias("a"), F.max("end_ms").alias("b"))
    done = (F.col("n") == 1) & (F.col("a") == 0) & (F.col("b") == F.col("duration_ms"))
    return fr.durations(spark, folder).join(x, "profile", "left").select("profile", F.coalesce(done, F.lit(False)).alias("complete"))


def _reached(spark: SparkSession, folder: str, islands: DataFrame, name: str) -> DataFrame:
    """Sessions with the end of the island that holds their position, else the position itself.

    Islands are disjoint, so only the last one that begins by then can hold a position.
    """
    marks = islands.select("profile", F.col("start_ms").alias("_a"), F.col("end_ms").cast("string").alias("_b"))
    x = joins.as_of(fr.sessions(spark, folder), marks, ["profile"], "position_ms", "_a", "_b")
    end = F.col("_b").cast("long")
    return x.withColumn(name, F.when(end > F.col("position_ms"), end).otherwise(F.col("position_ms"))).drop("_a", "_b")


def continuous_end(spark: SparkSession, folder: str) -> DataFrame:
    return _reached(spark, folder, _islands(spark, folder), "reached_ms").select("session_id", "epoch", "seq", "position_ms", "reached_ms")


def stabbing(spark: SparkSession, folder: str) -> DataFrame:
    """The chunk with the greatest start that holds the position."""
    x = joins.range_join(fr.sessions(spark, folder), fr.chunks(spark, folder).select("profile", F.col("seq").alias("chunk"), F.col("start_ms").alias("a"), F.col("end_ms").alias("b")), ["profile"], F.col("position_ms"), "a", "b", BUCKET)
    return x.groupBy("session_id", "epoch", "seq", "position_ms").agg(F.max_by("chunk", F.struct("a", "chunk")).alias("chunk"), F.max("a").alias("start_ms"))


def next_interval(spark: SparkSession, folder: str) -> DataFrame:
    """The smallest chunk start after the position."""
    marks = fr.chunks(spark, folder).select("profile", F.col("start_ms").alias("next_ms"), F.col("seq").cast("string").alias("chunk"))
    return joins.as_of(fr.sessions(spark, folder).select("session_id", "epoch", "seq", "profile", "position_ms"), marks, ["profile"], "position_ms", "next_ms", "chunk", forward=True, strict=True).select("session_id", "epoch", "seq", "position_ms", "next_ms")


def plan_window(spark: SparkSession, folder: str) -> DataFrame:
    x = _reached(spark, folder, _islands(spark, folder), "reached").join(fr.durations(spark, folder), "profile")
    marks = fr.chunks(spark, folder).select("profile", F.col("start_ms").alias("following"), F.col("seq").cast("string").alias("chunk"))
    x = joins.as_of(x, marks, ["profile"], "reached", "following", "chunk", forward=True, strict=True)
    w = spans.horizon_plan(F.col("position_ms"), F.col("reached"), F.col("duration_ms"), F.col("rate"), F.col("following"))
    return x.withColumn("w", w).where("w is not null").select("session_id", "epoch", "seq", "position_ms", "w.start_ms", "w.end_ms")


def buffer_ready(spark: SparkSession, folder: str) -> DataFrame:
    """Playback buffer from the chunks, settled from chunks and prepared ranges together."""
    keys = ["session_id", "epoch", "seq", "profile", "position_ms", "rate", "revision"]
    x = _reached(spark, folder, _islands(spark, folder), "reached").join(_reached(spark, folder, coverage_union(spark, folder), "settled"), keys).join(fr.durations(spark, folder), "profile").where("position_ms <= duration_ms")
    return x.select("session_id", "epoch", "seq", "position_ms", spans.buffered(F.col("position_ms"), F.col("reached"), F.col("settled"), F.col("duration_ms"), F.col("rate")).alias("b")).select("session_id", "epoch", "seq", "position_ms", "b.*")


def coverage_strip(spark: SparkSession, folder: str) -> DataFrame:
    """What of the 90 s after the position is loaded (chunks) and only prepared."""
    s = fr.sessions(spark, folder).select("session_id", "epoch", "seq", "profile", "position_ms")
    s = s.withColumn("k", F.concat_ws("/", "session_id", "epoch", "seq", "position_ms"))

    def window(islands: DataFrame) -> DataFrame:
        """Of disjoint islands the parts in each window: the one that holds its start, and those that begin in it."""
        marks = islands.select("profile", F.col("start_ms").alias("a"), F.col("end_ms").cast("string").alias("e"))
        first = joins.as_of(s, marks, ["profile"], "position_ms", "a", "e").select("k", "position_ms", "a", F.col("e").cast("long").alias("b"))
        near = s.withColumn("bucket", F.explode(F.array(F.floor(F.col("position_ms") / 90_000), F.floor(F.col("position_ms") / 90_000) + 1)))
        later = islands.select("profile", F.col("start_ms").alias("a"), F.col("end_ms").alias("b"), F.floor(F.col("start_ms") / 90_000).alias("bucket"))
        later = near.join(later, ["profile", "bucket"]).where("a > position_ms and a < position_ms + 90000").select("k", "position_ms", "a", "b")
        x = first.where("b > position_ms").unionByName(later).distinct()
        lo, hi = spans.clip(F.col("a"), F.col("b"), F.col("position_ms"), F.col("position_ms") + 90_000)
        return x.select("k", lo.alias("start_ms"), hi.alias("end_ms")).where("start_ms < end_ms")

    loaded = window(_islands(spark, folder))
    only = spans.subtract(window(spans.merge(_prepared(spark, folder), ["profile"])), loaded, ["k"])
    total = lambda df, name: df.groupBy("k").agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias(name), F.min("start_ms").alias(name + "_first"))
    x = s.join(total(loaded, "loaded"), "k", "left").join(total(only, "prepared"), "k", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c + "_ms")
    return x.select("session_id", "epoch", "seq", "position_ms", zero("loaded"), zero("prepared"), F.coalesce(F.col("loaded_first") <= F.col("position_ms"), F.lit(False)).alias("loaded_now"))


def hole_kind(spark: SparkSession, folder: str) -> DataFrame:
    """What is under a position: a failed hole (longest-pending chunk empty of cues) before a skipped one, else none."""
    c = load(spark, folder, "chunks").select(fr.key_of("profile").alias("profile"), "start_ms", "end_ms", F.when(F.col("payload.language.code") == "und", "skipped").when(F.size("payload.cues") == 0, "failed").alias("kind"))
    c = c.where("profile is not null and kind is not null and start_ms >= 0 and start_ms < end_ms").distinct()
    x = joins.range_join(fr.sessions(spark, folder), c.withColumnRenamed("start_ms", "a").withColumnRenamed("end_ms", "b"), ["profile"], F.col("position_ms"), "a", "b", BUCKET, "left")
    return x.groupBy("session_id", "epoch", "seq", "position_ms").agg(F.coalesce(F.min("kind"), F.lit("none")).alias("hole"))


def midpoint_owner(spark: SparkSession, folder: str) -> DataFrame:
    """Cues owned by the chunks whose range, end included, holds their midpoint."""
    c = fr.chunks(spark, folder).select("profile", F.col("seq").alias("chunk"), F.col("start_ms").alias("a"), F.col("end_ms").alias("b")).distinct()
    p = fr.cues(spark, folder).select("profile", "id", "start_ms", "end_ms").distinct()
    return joins.range_join(p, c, ["profile"], (F.col("start_ms") + F.col("end_ms")) / 2, "a", "b", BUCKET, upper=1).select("chunk", "id")


def uncovered_cues(spark: SparkSession, folder: str) -> DataFrame:
    """Cues whose midpoint no chunk of their profile holds."""
    c = fr.chunks(spark, folder).select("profile", F.col("start_ms").alias("a"), F.col("end_ms").alias("b")).distinct()
    p = fr.cues(spark, folder).select("profile", "id", "start_ms", "end_ms").distinct()
    return joins.range_join(p, c, ["profile"], (F.col("start_ms") + F.col("end_ms")) / 2, "a", "b", BUCKET, "left_anti").select("profile", "id")


def captions_at_midpoint(spark: SparkSession, folder: str) -> DataFrame:
    """Per cue: how many cues cached in chunk payloads hold its midpoint, end included, copies kept."""
    c = load(spark, folder, "chunks").select(fr.key_of("profile").alias("profile"), F.explode("payload.cues").alias("c")).select("profile", F.col("c.start_ms").alias("a"), F.col("c.end_ms").alias("b")).where("profile is not null and a >= 0 and a < b")
    p = fr.cues(spark, folder).select("profile", "id", "start_ms", "end_ms").distinct()
    x = joins.range_join(p, c, ["profile"], (F.col("start_ms") + F.col("end_ms")) / 2, "a", "b", 8_000, upper=1)
    return x.groupBy("profile", "id").agg(F.count(F.lit(1)).alias("captions"))


def containment_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Per chunk: cues that lie in it but for 80 ms at either end, and their joined length."""
    c = fr.chunks(spark, folder).select("profile", F.col("seq").alias("chunk"), F.col("start_ms").alias("a"), F.col("end_ms").alias("b")).distinct()
    p = fr.cues(spark, folder).select("profile", "id", "start_ms", "end_ms", "text").distinct()
    x = joins.contained(p, c, ["profile"], "start_ms", "end_ms", "a", "b", 80, BUCKET)
    return x.groupBy("chunk").agg(F.count(F.lit(1)).alias("cues"), F.sum(F.length("text")).alias("chars"), F.min("start_ms").alias("first_ms"))


def latest_profile(spark: SparkSession, folder: str) -> DataFrame:
    """Per media and target the profile with the latest chunk, ties by the greatest seq."""
    p = load(spark, folder, "profiles").select(fr.key_of("profile").alias("profile"), fr.key_of("media").alias("media"), "target").where("profile is not null and media is not null and target is not null").distinct()
    c = fr.chunks(spark, folder).groupBy("profile").agg(F.max(F.struct("updated", "seq")).alias("u"))
    return p.join(c, "profile").groupBy("media", "target").agg(F.max_by("profile", "u").alias("profile"), F.max("u.seq").alias("any_seq")).drop("any_seq")


def previous_context(spark: SparkSession, folder: str) -> DataFrame:
    """For every chunk: of the cues that end at or before its start, the last ten, as a count and the earliest start."""
    p = fr.cues(spark, folder).select("profile", F.col("id").alias("ref"), F.col("end_ms").alias("t"), "start_ms", "end_ms").distinct().withColumn("o", F.lit(0))
    c = fr.chunks(spark, folder).select("profile", F.col("seq").cast("string").alias("ref"), F.col("start_ms").alias("t")).distinct().withColumn("o", F.lit(1))
    x = p.unionByName(c, allowMissingColumns=True)
    w = Window.partitionBy("profile").orderBy("t", "o", "start_ms", "ref")
    n = x.withColumn("n", F.count(F.when(F.col("o") == 0, 1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    nth = n.where("o = 0").select("profile", F.col("n").alias("k"), F.col("start_ms").alias("s"))
    q = n.where("o = 1 and n > 0").select("profile", F.col("ref").cast("long").alias("chunk"), "n", F.explode(F.sequence(F.greatest(F.lit(1), F.col("n") - 9), F.col("n"))).alias("k"))
    return q.join(nth, ["profile", "k"]).groupBy("chunk").agg(F.count(F.lit(1)).alias("cues"), F.min("s").alias("first_ms"))


def range_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Cues that overlap the second to fifth minute."""
    return fr.cues(spark, folder).where("end_ms > 60000 and start_ms < 300000").select("profile", "id")


_I = fr.islands
_PREP = f"pr AS (SELECT DISTINCT profile, p.start_ms, p.end_ms FROM (SELECT {fr.sql_key('profile')} profile, unnest(prepared) p FROM sessions) WHERE profile <> '' AND p.start_ms >= 0 AND p.start_ms < p.end_ms)"
_UNI = "un0 AS (SELECT profile, start_ms, end_ms FROM ch UNION ALL SELECT profile, start_ms, end_ms FROM pr)"
_REACH = "re AS (SELECT se.*, coalesce((SELECT max(i.end_ms) FROM isl i WHERE i.profile = se.profile AND i.start_ms <= se.position_ms AND i.end_ms > se.position_ms), se.position_ms) reached FROM se)"


def _minus(name: str, a: str, b: str, key: str) -> str:
    """CTEs for a minus b by an edge sweep."""
    return f"""{name}_e AS (SELECT {key}, t, sum(x) x, sum(y) y FROM (SELECT {key}, start_ms t, 1 x, 0 y FROM {a} UNION ALL SELECT {key}, end_ms, -1, 0 FROM {a} UNION ALL SELECT {key}, start_ms, 0, 1 FROM {b} UNION ALL SELECT {key}, end_ms, 0, -1 FROM {b}) GROUP BY ALL),
 {name}_s AS (SELECT {key}, t, lead(t) OVER w n, sum(x) OVER w sx, sum(y) OVER w sy FROM {name}_e WINDOW w AS (PARTITION BY {key} ORDER BY t)),
 {name}_p AS (SELECT {key}, t start_ms, n end_ms FROM {name}_s WHERE sx > 0 AND sy = 0 AND n IS NOT NULL), {_I(name, name + '_p', key)}"""


QUERIES = {f.__name__: f for f in (coverage_merge, coverage_total, coverage_union, coverage_subtract, coverage_holes, completeness, continuous_end, stabbing, next_interval, plan_window, buffer_ready, coverage_strip, hole_kind, midpoint_owner, uncovered_cues, captions_at_midpoint, containment_pairs, latest_profile, previous_context, range_filter)}

ORACLES = {
    "coverage_merge": f"WITH {fr.CHUNKS}, {_I('isl', 'ch')} SELECT * FROM isl",
    "coverage_total": f"WITH {fr.CHUNKS}, {_I('isl', 'ch')} SELECT profile, CAST(sum(end_ms - start_ms) AS BIGINT) covered_ms, count(*) islands FROM isl GROUP BY 1",
    "coverage_union": f"WITH {fr.CHUNKS}, {_PREP}, {_UNI}, {_I('un', 'un0')} SELECT * FROM un",
    "coverage_subtract": f"WITH {fr.CHUNKS}, {_PREP}, {_minus('d', 'ch', 'pr', 'profile')} SELECT profile, start_ms, end_ms FROM d",
    "coverage_holes": f"WITH {fr.CHUNKS}, {fr.DURATIONS}, {_I('isl', 'ch')}, wh AS (SELECT profile, 0 start_ms, duration_ms end_ms FROM du), cl AS (SELECT isl.profile, isl.start_ms, least(isl.end_ms, du.duration_ms) end_ms FROM isl JOIN du USING (profile) WHERE isl.start_ms < du.duration_ms), {_minus('d', 'wh', 'cl', 'profile')} SELECT profile, start_ms, end_ms FROM d",
    "completeness": f"WITH {fr.CHUNKS}, {fr.DURATIONS}, {_I('isl', 'ch')} SELECT profile, coalesce(count(start_ms) = 1 AND min(start_ms) = 0 AND max(end_ms) = max(duration_ms), false) complete FROM du LEFT JOIN isl USING (profile) GROUP BY 1",
    "continuous_end": f"WITH {fr.CHUNKS}, {fr.SESSIONS}, {_I('isl', 'ch')}, {_REACH} SELECT session_id, epoch, seq, position_ms, reached reached_ms FROM re",
    "stabbing": f"WITH {fr.CHUNKS}, {fr.SESSIONS} SELECT session_id, se.epoch, se.seq, position_ms, arg_max(ch.seq, (ch.start_ms, ch.seq)) chunk, max(ch.start_ms) start_ms FROM se JOIN ch ON ch.profile = se.profile AND ch.start_ms <= position_ms AND ch.end_ms > position_ms GROUP BY 1, 2, 3, 4",
    "next_interval": f"WITH {fr.CHUNKS}, {fr.SESSIONS} SELECT session_id, epoch, seq, position_ms, (SELECT min(ch.start_ms) FROM ch WHERE ch.profile = se.profile AND ch.start_ms > se.position_ms) next_ms FROM se",
    "plan_window": f"""WITH {fr.CHUNKS}, {fr.SESSIONS}, {fr.DURATIONS}, {_I('isl', 'ch')}, {_REACH},
 n AS (SELECT re.*, duration_ms d, (SELECT min(ch.start_ms) FROM ch WHERE ch.profile = re.profile AND ch.start_ms > re.reached) f FROM re JOIN du USING (profile))
 SELECT session_id, epoch, seq, position_ms, reached start_ms, least(reached + CASE WHEN reached = position_ms THEN 10000 ELSE 16000 END, d, coalesce(f, d)) end_ms FROM n
 WHERE reached < least(d, position_ms + least(120000, CAST(floor(60000 * rate) AS BIGINT)))""",
    "buffer_ready": f"""WITH {fr.CHUNKS}, {fr.SESSIONS}, {fr.DURATIONS}, {_PREP}, {_UNI}, {_I('isl', 'ch')}, {_I('un', 'un0')}, {_REACH},
 n AS (SELECT re.*, duration_ms d, coalesce((SELECT max(u.end_ms) FROM un u WHERE u.profile = re.profile AND u.start_ms <= re.position_ms AND u.end_ms > re.position_ms), re.position_ms) st FROM re JOIN du USING (profile) WHERE position_ms <= duration_ms)
 SELECT session_id, epoch, seq, position_ms, reached - position_ms media_ms, CAST(floor((reached - position_ms) / rate) AS BIGINT) wall_ms, st - position_ms settled_ms, st - position_ms >= least(8000, d - position_ms) ready FROM n""",
    "coverage_strip": f"""WITH {fr.CHUNKS}, {fr.SESSIONS}, {_PREP}, {_I('isl', 'ch')}, {_I('pri', 'pr')}, s AS (SELECT DISTINCT session_id, epoch, seq, profile, position_ms, concat_ws('/', session_id, epoch, seq, position_ms) k FROM se),
 lo AS (SELECT k, greatest(i.start_ms, position_ms) start_ms, least(i.end_ms, position_ms + 90000) end_ms FROM s JOIN isl i USING (profile) WHERE i.end_ms > position_ms AND i.start_ms < position_ms + 90000),
 pw AS (SELECT k, greatest(i.start_ms, position_ms) start_ms, least(i.end_ms, position_ms + 90000) end_ms FROM s JOIN pri i USING (profile) WHERE i.end_ms > position_ms AND i.start_ms < position_ms + 90000),
 {_minus('d', 'pw', 'lo', 'k')}
 SELECT session_id, epoch, seq, position_ms, CAST(coalesce((SELECT sum(end_ms - start_ms) FROM lo WHERE lo.k = s.k), 0) AS BIGINT) loaded_ms, CAST(coalesce((SELECT sum(end_ms - start_ms) FROM d WHERE d.k = s.k), 0) AS BIGINT) prepared_ms,
 coalesce((SELECT min(start_ms) FROM lo WHERE lo.k = s.k) <= position_ms, false) loaded_now FROM s""",
    "hole_kind": f"""WITH {fr.SESSIONS}, c AS (SELECT DISTINCT {fr.sql_key('profile')} profile, start_ms, end_ms, CASE WHEN payload.language.code = 'und' THEN 'skipped' WHEN len(payload.cues) = 0 THEN 'failed' END kind FROM chunks)
 SELECT session_id, epoch, seq, position_ms, coalesce(min(kind), 'none') hole FROM se LEFT JOIN c ON c.profile = se.profile AND kind IS NOT NULL AND start_ms >= 0 AND start_ms <= position_ms AND end_ms > position_ms GROUP BY 1, 2, 3, 4""",
    "midpoint_owner": f"WITH {fr.CHUNKS}, {fr.CUES} SELECT ch.seq chunk, id FROM (SELECT DISTINCT profile, id, start_ms, end_ms FROM cu) cu JOIN (SELECT DISTINCT profile, seq, start_ms, end_ms FROM ch) ch ON ch.profile = cu.profile AND ch.start_ms <= (cu.start_ms + cu.end_ms) / 2 AND ch.end_ms + 1 > (cu.start_ms + cu.end_ms) / 2",
    "uncovered_cues": f"WITH {fr.CHUNKS}, {fr.CUES} SELECT DISTINCT profile, id FROM cu WHERE NOT EXISTS (SELECT 1 FROM ch WHERE ch.profile = cu.profile AND ch.start_ms <= (cu.start_ms + cu.end_ms) / 2 AND ch.end_ms > (cu.start_ms + cu.end_ms) / 2)",
    "captions_at_midpoint": f"WITH {fr.CUES}, c AS (SELECT profile, c.start_ms a, c.end_ms b FROM (SELECT {fr.sql_key('profile')} profile, unnest(payload.cues) c FROM chunks) WHERE profile <> '' AND c.start_ms >= 0 AND c.start_ms < c.end_ms) SELECT cu.profile, id, count(*) captions FROM (SELECT DISTINCT profile, id, start_ms, end_ms FROM cu) cu JOIN c ON c.profile = cu.profile AND a <= (start_ms + end_ms) / 2 AND b + 1 > (start_ms + end_ms) / 2 GROUP BY 1, 2",
    "containment_pairs": f"WITH {fr.CHUNKS}, {fr.CUES} SELECT ch.seq chunk, count(*) cues, CAST(sum(length(text)) AS BIGINT) chars, min(cu.start_ms) first_ms FROM (SELECT DISTINCT profile, id, start_ms, end_ms, text FROM cu) cu JOIN (SELECT DISTINCT profile, seq, start_ms, end_ms FROM ch) ch ON ch.profile = cu.profile AND cu.start_ms >= ch.start_ms - 80 AND cu.end_ms <= ch.end_ms + 80 GROUP BY 1",
    "latest_profile": f"""WITH {fr.CHUNKS}, p AS (SELECT DISTINCT {fr.sql_key('profile')} profile, {fr.sql_key('media')} media, target FROM profiles WHERE target IS NOT NULL), u AS (SELECT profile, max((updated, seq)) u FROM ch GROUP BY 1)
 SELECT media, target, arg_max(profile, u) profile FROM p JOIN u USING (profile) WHERE media <> '' GROUP BY 1, 2""",
    "previous_context": f"""WITH {fr.CHUNKS}, {fr.CUES}, c AS (SELECT DISTINCT profile, id, start_ms, end_ms FROM cu), k AS (SELECT DISTINCT profile, seq, start_ms t FROM ch),
 j AS (SELECT k.seq chunk, k.t, c.start_ms s, row_number() OVER (PARTITION BY k.seq, k.t ORDER BY c.end_ms DESC, c.start_ms DESC, c.id DESC) r FROM k JOIN c ON c.profile = k.profile AND c.end_ms <= k.t)
 SELECT chunk, count(*) cues, min(s) first_ms FROM j WHERE r <= 10 GROUP BY 1""",
    "range_filter": f"WITH {fr.CUES} SELECT profile, id FROM cu WHERE end_ms > 60000 AND start_ms < 300000",
}
