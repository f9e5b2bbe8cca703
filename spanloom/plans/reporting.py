"""Reports over heard cues and their captions, and the queries of sessions' requests and of work in windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.functions import text as tx
from spanloom.operators import joins, measures, prompt, store
from spanloom.plans import frames as fr
from spanloom.sources.tables import key_of, load

BUCKET = 32_000


def _mid():  # noqa: ANN202
    return (F.col("start_ms") + F.col("end_ms")) / 2


#: Bounds of a playback rate.
SLOWEST, FASTEST = 0.1, 8.0


def _cues(spark: SparkSession, folder: str) -> DataFrame:
    return fr.cues(spark, folder).select("profile", "id", "start_ms", "end_ms", "text").distinct()


def _chunks(spark: SparkSession, folder: str) -> DataFrame:
    return fr.chunks(spark, folder).select("profile", F.col("seq").alias("chunk"), F.col("start_ms").alias("a"), F.col("end_ms").alias("b")).distinct()


def _captions(spark: SparkSession, folder: str) -> DataFrame:
    """(profile, chunk, cap, a, b, caption): the cues cached in chunks, as captions."""
    x = load(spark, folder, "chunks").select(key_of("profile").alias("profile"), F.col("seq").alias("chunk"), "start_ms", "end_ms", F.explode("payload.cues").alias("c")).where("profile is not null and start_ms >= 0 and start_ms < end_ms")
    return x.select("profile", "chunk", F.col("c.id").alias("cap"), F.col("c.start_ms").alias("a"), F.col("c.end_ms").alias("b"), F.col("c.text").alias("caption")).where("cap is not null and a >= 0 and a < b and caption is not null").distinct()


def _glossary(spark: SparkSession, folder: str) -> DataFrame:
    """(media, target, source, rendering, ord): the first rendering learned for each source."""
    x = load(spark, folder, "glossary").select("seq", key_of("media").alias("media"), "target", "source", "rendering").where("media is not null and target is not null and source is not null and rendering is not null and source <> '' and seq is not null").distinct()
    return store.last_wins(x, ["media", "target", "source"], [F.asc("seq"), F.asc("rendering")]).withColumnRenamed("seq", "ord")


def side_by_side(spark: SparkSession, folder: str) -> DataFrame:
    """Every caption with the joined text of the cues whose midpoint it holds, its end included; a fragment has fewer than three words."""
    caps = _captions(spark, folder)
    x = joins.range_join(_cues(spark, folder), caps.drop("caption"), ["profile"], _mid(), "a", "b", 8000, upper=1)
    x = x.groupBy("profile", "chunk", "cap", "a", "b").agg(F.sort_array(F.collect_list(F.struct("start_ms", "end_ms", "id", "text"))).alias("s"))
    x = caps.join(x, ["profile", "chunk", "cap", "a", "b"], "left").withColumn("source", tx.join_texts(F.coalesce(F.col("s.text"), F.array().cast("array<string>"))))
    return x.select("profile", "chunk", "cap", F.col("a").alias("start_ms"), "caption", "source", (F.size(tx.tokens(F.col("source"))) < 3).alias("fragment"))


def uncaptioned_source(spark: SparkSession, folder: str) -> DataFrame:
    """Cues whose midpoint lies in a chunk and under none of that chunk's captions, their ends included."""
    inside = joins.range_join(_cues(spark, folder).drop("text"), _chunks(spark, folder), ["profile"], _mid(), "a", "b", BUCKET).select("profile", "chunk", "id", "start_ms", "end_ms")
    caps = _captions(spark, folder).select("profile", "chunk", "a", "b").distinct()
    return joins.range_join(inside, caps, ["profile", "chunk"], _mid(), "a", "b", 8000, "left_anti", upper=1).select("profile", "chunk", "id")


def pair_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Every caption with the joined text of the cues that lie in it but for 80 ms at either end; none without such a cue."""
    x = joins.contained(_cues(spark, folder), _captions(spark, folder), ["profile"], "start_ms", "end_ms", "a", "b", 80, 8000)
    x = x.groupBy("profile", "chunk", "cap", "a", "caption").agg(F.sort_array(F.collect_list(F.struct("start_ms", "end_ms", "id", "text"))).alias("s"))
    return x.select("profile", "chunk", "cap", F.col("a").alias("start_ms"), tx.join_texts(F.col("s.text")).alias("source"), "caption")


def previous_source(spark: SparkSession, folder: str) -> DataFrame:
    """For every chunk the cues before it that its last ten earlier captions cover, at most 60, or else the last cue.

    Cues are numbered by their end, so those that end by a moment are a count, looked up as of it.
    """
    first = fr.chunks(spark, folder).select("profile", "seq", "start_ms").distinct()
    caps = _captions(spark, folder).select("profile", "cap", "a", "b").groupBy("profile", "cap").agg(F.max(F.struct("a", "b")).alias("x")).select("profile", "cap", "x.a", "x.b")
    w = Window.partitionBy("profile").orderBy("b", "a", "cap")
    caps = caps.withColumn("n", F.row_number().over(w)).withColumn("tenth", F.min("a").over(w.rowsBetween(-9, 0)))
    caps = caps.groupBy("profile", "b").agg(F.max_by("tenth", "n").alias("tenth")).withColumn("tenth", F.col("tenth").cast("string"))
    v = Window.partitionBy("profile").orderBy("end_ms", "start_ms", "id")
    ends = _cues(spark, folder).withColumn("n", F.row_number().over(v)).groupBy("profile", F.col("end_ms").alias("e")).agg(F.max("n").cast("string").alias("upto"))
    x = joins.as_of(first, caps, ["profile"], "start_ms", "b", "tenth").drop("b").withColumn("from_ms", F.col("tenth").cast("long") - 80)
    x = joins.as_of(x, ends, ["profile"], "start_ms", "e", "upto").drop("e").withColumn("upto", F.coalesce(F.col("upto").cast("long"), F.lit(0)))
    # a cue that ends at that moment is covered, so only those strictly before it are left out
    before = joins.as_of(x.where("from_ms is not null"), ends.withColumnRenamed("upto", "less"), ["profile"], "from_ms", "e", "less", strict=True).withColumn("covered", F.col("upto") - F.coalesce(F.col("less").cast("long"), F.lit(0)))
    x = before.select("seq", "start_ms", "upto", "covered").unionByName(x.where("from_ms is null").select("seq", "start_ms", "upto", F.lit(0).cast("long").alias("covered")))
    n = F.when(F.col("covered") > 0, F.least(F.col("covered"), F.lit(60))).otherwise(F.least(F.col("upto"), F.lit(1)))
    return x.select("seq", "start_ms", n.alias("cues"))


def name_table(spark: SparkSession, folder: str) -> DataFrame:
    """Glossary names of every film and target: cues that mention them, captions of these, and captions that hold the rendering."""
    names = _glossary(spark, folder)
    cues = fr.cues(spark, folder).where("media is not null").groupBy("media", "id").agg(F.min(F.struct("profile", "start_ms", "end_ms", "text")).alias("c")).select("media", "id", "c.*")
    found = measures.hits(names, cues, ["media"], "source", "text", "id").drop("k")
    at = found.join(cues.drop("text"), ["media", "id"])
    caps = joins.range_join(at, _captions(spark, folder), ["profile"], _mid(), "a", "b", 8000, "left", upper=1).select("media", "source", "id", "start_ms", "cap", "a", "caption")
    x = names.select("media", "target", "source", "rendering").join(caps, ["media", "source"])
    holds = F.col("caption").isNotNull() & F.contains("caption", "rendering")
    g = x.groupBy("media", "target", "source", "rendering").agg(F.countDistinct("id").alias("mentions"), F.count("caption").alias("captions"), F.count_if(holds).alias("consistent"))
    order = Window.partitionBy("media", "target", "source").orderBy("start_ms", "id", "a", "cap")
    few = x.where("caption is not null").withColumn("r", F.row_number().over(order)).where("r <= 3").groupBy("media", "target", "source").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "caption"))), lambda s: s["caption"]), "|").alias("samples"))
    return g.join(few, ["media", "target", "source"], "left").select(*g.columns, F.coalesce("samples", F.lit("")).alias("samples"))


def ledger_reasons(spark: SparkSession, folder: str) -> DataFrame:
    """Why a reported name is kept out of the ledger: pinned, common, once or owned; the others are learned."""
    names = _glossary(spark, folder)
    pinned = load(spark, folder, "contexts").select(key_of("media").alias("media"), "target", F.explode("variants").alias("x", "source")).where("media is not null and source is not null").select("media", "target", "source").distinct()
    cues = fr.cues(spark, folder).where("media is not null").groupBy("media", "id").agg(F.min("text").alias("text"))
    common = measures.common_words(cues, ["media"], "text").select("media", F.col("word").alias("head"), F.lit(True).alias("common"))
    said = measures.mentions(names, cues, ["media"], "source", "text", "id").select("media", "source", "occurrences")
    x = names.withColumn("head", F.lower(F.split(tx.strip(F.col("source")), "\\s+")[0])).join(pinned.withColumn("pin", F.lit(True)), ["media", "target", "source"], "left").join(common, ["media", "head"], "left").join(said, ["media", "source"], "left")
    out = F.when(F.col("pin"), "pinned").when(F.col("common"), "common").when(F.coalesce("occurrences", F.lit(0)) < 2, "once")
    x = x.withColumn("reason", out).select("media", "target", "source", "rendering", "ord", "reason")
    held = store.ledger(x.where("reason is null"), ["media", "target"], "source", "rendering", "ord").select("media", "target", "source", F.lit("learned").alias("held"))
    return x.join(held, ["media", "target", "source"], "left").select("media", "target", "source", F.coalesce("reason", "held", F.lit("owned")).alias("reason"))


def _user(spark: SparkSession, folder: str) -> DataFrame:
    """Names that a translation window confirmed, as a user's entries in the order of their spelling."""
    pinned = load(spark, folder, "contexts").select(key_of("media").alias("media"), "target", F.explode("variants").alias("x", "source")).where("media is not null and source is not null").select("media", "target", "source").distinct()
    x = _glossary(spark, folder).join(pinned, ["media", "target", "source"], "left_semi")
    return x.withColumn("ord", F.row_number().over(Window.partitionBy("media", "target").orderBy("source")))


def prompt_entries(spark: SparkSession, folder: str) -> DataFrame:
    """For every translation window the glossary entries worth showing for the cues in it."""
    learned = _glossary(spark, folder)
    win = load(spark, folder, "contexts").select(key_of("media").alias("media"), "target", F.col("start_ms").alias("a"), F.col("end_ms").alias("b")).where("media is not null and target is not null and a >= 0 and a < b").distinct()
    cues = fr.cues(spark, folder).where("media is not null").select("media", "id", "start_ms", "text").distinct()
    x = joins.range_join(cues, win, ["media"], F.col("start_ms"), "a", "b", 600_000).groupBy("media", "target", F.col("a").alias("window_ms"), "b").agg(F.sort_array(F.collect_list(F.struct("start_ms", "id", "text"))).alias("s"))
    texts = x.groupBy("media", "target", "window_ms").agg(F.max_by("s", "b").alias("s")).withColumn("text", F.array_join("s.text", " "))
    return prompt.select_entries(_user(spark, folder), learned, texts, ["media", "target"], "window_ms")


def recogniser_hints(spark: SparkSession, folder: str) -> DataFrame:
    return prompt.names_hint(_user(spark, folder), _glossary(spark, folder), ["media", "target"])


def unique_profiles(spark: SparkSession, folder: str) -> DataFrame:
    """The profile of every film and target that has one only."""
    p = load(spark, folder, "profiles").select(key_of("profile").alias("profile"), key_of("media").alias("media"), "target").where("profile is not null and media is not null and target is not null")
    return p.groupBy("media", "target").agg(F.min("profile").alias("profile"), F.countDistinct("profile").alias("n")).where("n = 1").drop("n")


def source_languages(spark: SparkSession, folder: str) -> DataFrame:
    """Per profile: the language of the first chunk that knows one, English if none does, and the last chunk's, but for unknown ones after a known one."""
    x = load(spark, folder, "chunks").select("seq", key_of("profile").alias("profile"), F.struct("start_ms", "seq").alias("at"), F.col("payload.language.code").alias("code")).where("profile is not null and start_ms is not null").distinct()
    known = F.when(F.col("code") != "und", F.struct("at", "code"))
    g = x.groupBy("profile").agg(F.min(known).alias("first"), F.max(known).alias("last"))
    return g.select("profile", F.coalesce("first.code", F.lit("en")).alias("source"), F.coalesce("last.code", F.lit("und")).alias("language"))


def playback_requests(spark: SparkSession, folder: str) -> DataFrame:
    """Session snapshots as requests: a rate must be a number from 0.1 to 8, a position lie in the film, a number in the sequence be 1 or more."""
    s = load(spark, folder, "sessions").select("session_id", "epoch", "seq", key_of("profile").alias("profile"), "position_ms", "rate").where("session_id is not null").distinct()
    x = s.join(fr.durations(spark, folder), "profile", "left")
    rate = F.coalesce(F.col("rate").between(SLOWEST, FASTEST) & ~F.isnan("rate"), F.lit(False))
    place = F.coalesce((F.col("position_ms") >= 0) & (F.col("position_ms") <= F.coalesce("duration_ms", "position_ms")), F.lit(False))
    number = F.coalesce((F.col("seq") >= 1) & (F.col("epoch") >= 0), F.lit(False))
    return x.select("session_id", "epoch", "seq", "position_ms", F.when(~number, "SEQUENCE").when(~rate, "RATE").when(~place, "POSITION").otherwise("OK").alias("state"))


def run_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Per profile, chunks as the windows of a run: sums and means, the largest span, and how often each status came with each method."""
    x = load(spark, folder, "chunks").select("seq", key_of("profile").alias("profile"), "start_ms", "end_ms", F.size("payload.cues").alias("cues"), F.col("payload.language").alias("l")).where("profile is not null and start_ms >= 0 and start_ms < end_ms").select("*", "l.*").drop("l").distinct()
    what = F.concat_ws(" → ", F.coalesce("status", F.lit("?")), F.coalesce("method", F.lit("?")))
    kinds = x.groupBy("profile", what.alias("what")).agg(F.count(F.lit(1)).alias("n")).groupBy("profile").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(" ", "what", "n"))), ";").alias("kinds"))
    g = x.groupBy("profile").agg(F.count(F.lit(1)).alias("windows"), F.sum(F.greatest("cues", F.lit(0))).alias("cues"), F.sum(F.round(F.coalesce("score", F.lit(0.0)) * 1_000_000).cast("long")).alias("s"), F.max(F.col("end_ms") - F.col("start_ms")).alias("longest_ms"))
    return g.join(kinds, "profile").select("profile", "windows", "cues", (F.col("s") / F.greatest(F.lit(1), F.col("windows")) / 1_000_000).alias("score_mean"), "longest_ms", "kinds")


def bytes_needed(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines as the files of an asset: bytes in all, installed, partly there and still needed, and whether nothing is missing."""
    x = load(spark, folder, "lineitem").select("l_orderkey", (F.col("l_quantity") * 1000).cast("long").alias("bytes"), F.when(F.col("l_linestatus") == "F", "installed").when(F.col("l_returnflag") == "N", "partial").otherwise("missing").alias("state"))
    have = F.when(F.col("state") == "installed", F.col("bytes")).when(F.col("state") == "partial", F.floor(F.col("bytes") / 4)).otherwise(0)
    return x.groupBy("l_orderkey").agg(F.sum("bytes").alias("bytes_total"), F.sum(F.when(F.col("state") == "installed", F.col("bytes")).otherwise(0)).alias("bytes_installed"), F.sum(F.when(F.col("state") != "installed", F.col("bytes") - have).otherwise(0)).alias("bytes_needed"), F.sum(have).alias("bytes_done"), F.bool_and(F.col("state") == "installed").alias("ready"))


def signal_frames(spark: SparkSession, folder: str) -> DataFrame:
    """The values of each event type of a user as samples: frames of eight, the last one padded with zeros, each with the two samples before it; silent if all are zero."""
    x = load(spark, folder, "events").where("value is not null").withColumn("n", F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")) - 1)
    x = x.select("user_id", "event_type", "n", F.floor("value").cast("long").alias("v"), F.floor(F.col("n") / 8).alias("frame"))
    # the two samples before a frame are those at its places -2 and -1
    carried = x.where("n % 8 >= 6").withColumn("frame", F.col("frame") + 1).withColumn("p", F.col("n") % 8 - 8)
    rows = x.withColumn("p", F.col("n") % 8).unionByName(carried)
    frames = rows.groupBy("user_id", "event_type", "frame").agg(F.map_from_entries(F.collect_list(F.struct("p", "v"))).alias("m")).where("exists(map_keys(m), k -> k >= 0)")
    got = F.transform(F.sequence(F.lit(-2), F.lit(7)), lambda i: F.coalesce(F.element_at("m", i.cast("int")), F.lit(0)))
    return frames.withColumn("s", got).select("user_id", "event_type", "frame", F.array_join(F.transform("s", lambda v: v.cast("string")), ",").alias("samples"), F.forall("s", lambda v: v == 0).alias("silent"))


QUERIES = {f.__name__: f for f in (side_by_side, uncaptioned_source, pair_texts, previous_source, name_table, ledger_reasons, prompt_entries, recogniser_hints, unique_profiles, source_languages, playback_requests, run_summary, bytes_needed, signal_frames)}

_C = f"{fr.CUES}, c AS (SELECT DISTINCT profile, id, start_ms, end_ms, text FROM cu)"
_K = f"ca AS (SELECT DISTINCT profile, chunk, c.id cap, c.start_ms a, c.end_ms b, c.text caption FROM (SELECT {fr.sql_key('profile')} profile, seq chunk, unnest(payload.cues) c FROM chunks WHERE {fr.sql_key('profile')} <> '' AND start_ms >= 0 AND start_ms < end_ms) WHERE c.id IS NOT NULL AND c.start_ms >= 0 AND c.start_ms < c.end_ms AND c.text IS NOT NULL)"
_G = f"""g0 AS (SELECT DISTINCT seq, {fr.sql_key('media')} media, target, source, rendering FROM glossary WHERE {fr.sql_key('media')} <> '' AND target IS NOT NULL AND source <> '' AND rendering IS NOT NULL AND seq IS NOT NULL),
 gl AS (SELECT media, target, source, arg_min(rendering, (seq, rendering)) rendering, min(seq) ord FROM g0 GROUP BY 1, 2, 3)"""
_F = "fm AS (SELECT media, id, q.p profile, q.s s, q.e e, q.t AS text FROM (SELECT media, id, min({'p': profile, 's': start_ms, 'e': end_ms, 't': text}) q FROM cu WHERE media <> '' GROUP BY 1, 2))"
_HITS = f"""nm AS (SELECT DISTINCT media, source, {fr.sql_twice('source')} d, {fr.sql_escaped(fr.sql_twice('source'))} p FROM gl WHERE regexp_matches(source, '{fr.LETTER}')), tw AS (SELECT *, {fr.sql_twice('text')} t FROM fm),
 hi AS (SELECT nm.media, source, id, profile, s, e, len(regexp_extract_all(t, '(?:^|{fr.OTHER})' || p || '(?:$|{fr.OTHER})')) k FROM nm JOIN tw ON tw.media = nm.media AND contains(t, d)), ht AS (SELECT * FROM hi WHERE k > 0)"""
_PIN = f"pi AS (SELECT DISTINCT {fr.sql_key('media')} media, target, unnest(map_values(variants)) source FROM contexts)"
_WD = "[\\p{L}\\p{Nl}\\p{No}](?:[\\p{L}\\p{Nl}\\p{No}]|[''’\\-])*"
_SOURCES = f"list({fr.sql_strip('text')} ORDER BY start_ms, end_ms, id)"

ORACLES = {
    "side_by_side": f"""WITH {_C}, {_K}, j AS (SELECT ca.*, {_SOURCES} FILTER (WHERE id IS NOT NULL) s FROM ca LEFT JOIN c ON c.profile = ca.profile AND (start_ms + end_ms) / 2 >= a AND (start_ms + end_ms) / 2 < b + 1 GROUP BY ALL), x AS (SELECT *, coalesce({fr.sql_joined('s')}, '') source FROM j)
 SELECT profile, chunk, cap, a start_ms, caption, source, len(list_filter(regexp_split_to_array(source, '{fr._BL}+'), lambda t: t <> '')) < 3 fragment FROM x""",
    "uncaptioned_source": f"WITH {_C}, {_K}, {fr.CHUNKS} SELECT DISTINCT c.profile, ch.seq chunk, id FROM c JOIN ch ON ch.profile = c.profile AND (c.start_ms + c.end_ms) / 2 >= ch.start_ms AND (c.start_ms + c.end_ms) / 2 < ch.end_ms WHERE NOT EXISTS (SELECT 1 FROM ca WHERE ca.profile = c.profile AND ca.chunk = ch.seq AND (c.start_ms + c.end_ms) / 2 >= a AND (c.start_ms + c.end_ms) / 2 < b + 1)",
    "pair_texts": f"WITH {_C}, {_K}, j AS (SELECT ca.profile, chunk, cap, a, caption, {_SOURCES} s FROM ca JOIN c ON c.profile = ca.profile AND start_ms >= a - 80 AND end_ms <= b + 80 GROUP BY ALL) SELECT profile, chunk, cap, a start_ms, {fr.sql_joined('s')} source, caption FROM j",
    "previous_source": f"""WITH {_C}, {_K}, k AS (SELECT profile, cap, max({{'a': a, 'b': b}}) x FROM ca GROUP BY 1, 2), ck AS (SELECT DISTINCT {fr.sql_key('profile')} profile, seq, start_ms FROM chunks WHERE {fr.sql_key('profile')} <> '' AND start_ms >= 0 AND start_ms < end_ms),
 t AS (SELECT ck.*, k.x.a a, row_number() OVER (PARTITION BY ck.profile, seq, start_ms ORDER BY k.x.b DESC, k.x.a DESC, cap DESC) r FROM ck JOIN k ON k.profile = ck.profile AND k.x.b <= ck.start_ms), f AS (SELECT profile, seq, start_ms, min(a) f FROM t WHERE r <= 10 GROUP BY 1, 2, 3),
 n AS (SELECT ck.profile, ck.seq, ck.start_ms, count(c.id) n, count(c.id) FILTER (WHERE c.end_ms >= f.f - 80) m FROM ck LEFT JOIN f ON f.profile = ck.profile AND f.seq = ck.seq AND f.start_ms = ck.start_ms LEFT JOIN c ON c.profile = ck.profile AND c.end_ms <= ck.start_ms GROUP BY 1, 2, 3)
 SELECT seq, start_ms, CASE WHEN m > 0 THEN least(m, 60) ELSE least(n, 1) END cues FROM n""",
    "name_table": f"""WITH {fr.CUES}, {_G}, {_K}, {_F}, {_HITS}, x AS (SELECT gl.media, target, gl.source, rendering, id, s, cap, a, caption FROM gl JOIN ht ON ht.media = gl.media AND ht.source = gl.source LEFT JOIN ca ON ca.profile = ht.profile AND (s + e) / 2 >= a AND (s + e) / 2 < b + 1)
 SELECT media, target, source, rendering, count(DISTINCT id) mentions, count(caption) captions, count(*) FILTER (WHERE contains(caption, rendering)) consistent, coalesce(array_to_string(list_slice(list(caption ORDER BY s, id, a, cap) FILTER (WHERE caption IS NOT NULL), 1, 3), '|'), '') samples FROM x GROUP BY 1, 2, 3, 4""",
    "ledger_reasons": f"""WITH {fr.CUES}, {_G}, {_F}, {_HITS}, {_PIN}, w AS (SELECT media, unnest(regexp_extract_all(text, '{_WD}')) w FROM fm), k AS (SELECT media, lower(w) h FROM w GROUP BY 1, 2 HAVING count(*) FILTER (WHERE regexp_matches(w, '^\\p{{Ll}}')) >= greatest(1, count(*) FILTER (WHERE NOT regexp_matches(w, '^\\p{{Ll}}')))),
 o AS (SELECT media, source, sum(k) k FROM ht GROUP BY 1, 2),
 x AS (SELECT gl.*, CASE WHEN EXISTS (SELECT 1 FROM pi WHERE pi.media = gl.media AND pi.target = gl.target AND pi.source = gl.source) THEN 'pinned' WHEN EXISTS (SELECT 1 FROM k WHERE k.media = gl.media AND k.h = lower(regexp_split_to_array({fr.sql_strip('gl.source')}, '\\s+')[1])) THEN 'common' WHEN coalesce(o.k, 0) < 2 THEN 'once' END r FROM gl LEFT JOIN o ON o.media = gl.media AND o.source = gl.source),
 q AS (SELECT *, CASE WHEN r IS NULL THEN row_number() OVER (PARTITION BY media, target, rendering, r ORDER BY ord) END q FROM x) SELECT media, target, source, coalesce(r, CASE WHEN q = 1 THEN 'learned' ELSE 'owned' END) reason FROM q""",
    "prompt_entries": f"""WITH {fr.CUES}, {_G}, {_PIN}, us AS (SELECT gl.*, row_number() OVER (PARTITION BY media, target ORDER BY source) o FROM gl WHERE EXISTS (SELECT 1 FROM pi WHERE pi.media = gl.media AND pi.target = gl.target AND pi.source = gl.source)),
 en AS (SELECT (media, target) film, media, target, source, rendering, 0 tier, o FROM us UNION ALL SELECT (media, target), media, target, source, rendering, 2, -ord FROM gl WHERE (media, target, source) NOT IN (SELECT (media, target, source) FROM us)),
 kn AS (SELECT film, source known, row_number() OVER (PARTITION BY film ORDER BY tier, o, source) ord FROM en),
 wi AS (SELECT DISTINCT {fr.sql_key('media')} media, target, start_ms a, end_ms b FROM contexts WHERE {fr.sql_key('media')} <> '' AND target IS NOT NULL AND start_ms >= 0 AND start_ms < end_ms), dc AS (SELECT DISTINCT media, id, start_ms, text FROM cu WHERE media <> ''),
 tb AS (SELECT wi.media, target, a, b, string_agg(text, ' ' ORDER BY start_ms, id, text) s FROM wi JOIN dc ON dc.media = wi.media AND start_ms >= a AND start_ms < b GROUP BY 1, 2, 3, 4), tx AS (SELECT (media, target) film, media, target, a, arg_max(s, b) AS text FROM tb GROUP BY media, target, a),
 wd AS (SELECT DISTINCT film, a, regexp_replace(w, '[''’]s?$', '') AS name FROM (SELECT film, a, unnest(regexp_extract_all(text, '{_WD}')) w FROM tx)), nn AS (SELECT DISTINCT film, name FROM wd WHERE name <> ''), {fr.sql_established('nn', 'kn', 'film')},
 re AS (SELECT wd.film, a, match source FROM wd JOIN es ON es.film = wd.film AND es.name = wd.name UNION SELECT en.film, a, source FROM tx JOIN en ON en.film = tx.film WHERE regexp_matches(source, '{fr.LETTER}') AND regexp_matches({fr.sql_twice('text')}, '(?i)(?:^|{fr.OTHER})' || {fr.sql_escaped(fr.sql_twice('source'))} || '(?:$|{fr.OTHER})')),
 nw AS (SELECT *, row_number() OVER (PARTITION BY media, target ORDER BY ord DESC, source) r FROM gl),
 al AS (SELECT re.film, re.a, re.source, rendering, 0 part, tier, o FROM re JOIN en ON en.film = re.film AND en.source = re.source UNION ALL SELECT tx.film, a, source, rendering, 1, 2, -ord FROM tx JOIN nw ON nw.media = tx.media AND nw.target = tx.target AND r <= 10),
 un AS (SELECT *, row_number() OVER (PARTITION BY film, a, source ORDER BY part, tier, o) r FROM al), nt AS (SELECT *, row_number() OVER (PARTITION BY film, a ORDER BY part, tier, o, source) nth FROM un WHERE r = 1)
 SELECT film[1] media, film[2] target, a window_ms, source, rendering, nth FROM nt WHERE nth <= 40""",
    "recogniser_hints": f"""WITH {_G}, {_PIN}, u AS (SELECT gl.media, gl.target, gl.source, 0 t, source o, 0 n FROM gl WHERE EXISTS (SELECT 1 FROM pi WHERE pi.media = gl.media AND pi.target = gl.target AND pi.source = gl.source)),
 l AS (SELECT media, target, source, 1 t, '' o, -ord n FROM gl WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.media = gl.media AND u.target = gl.target AND u.source = gl.source)), b AS (SELECT * FROM u UNION ALL SELECT * FROM l), r AS (SELECT *, row_number() OVER (PARTITION BY media, target ORDER BY t, o, n, source) nth FROM b) SELECT media, target, source, nth FROM r WHERE nth <= 20""",
    "unique_profiles": f"SELECT {fr.sql_key('media')} media, target, min({fr.sql_key('profile')}) profile FROM profiles WHERE {fr.sql_key('media')} <> '' AND {fr.sql_key('profile')} <> '' AND target IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT {fr.sql_key('profile')}) = 1",
    "source_languages": f"WITH k AS (SELECT DISTINCT {fr.sql_key('profile')} profile, seq, start_ms, payload.language.code code FROM chunks WHERE {fr.sql_key('profile')} <> '' AND start_ms IS NOT NULL) SELECT profile, coalesce(arg_min(code, (start_ms, seq, code)) FILTER (WHERE code <> 'und'), 'en') source, coalesce(arg_max(code, (start_ms, seq, code)) FILTER (WHERE code <> 'und'), 'und') AS language FROM k GROUP BY 1",
    "playback_requests": f"""WITH {fr.DURATIONS}, s AS (SELECT DISTINCT session_id, epoch, seq, nullif({fr.sql_key('profile')}, '') profile, position_ms, rate FROM sessions WHERE session_id IS NOT NULL)
 SELECT session_id, epoch, seq, position_ms, CASE WHEN NOT coalesce(seq >= 1 AND epoch >= 0, false) THEN 'SEQUENCE' WHEN NOT coalesce(rate BETWEEN 0.1 AND 8 AND NOT isnan(rate), false) THEN 'RATE' WHEN NOT coalesce(position_ms >= 0 AND position_ms <= coalesce(duration_ms, position_ms), false) THEN 'POSITION' ELSE 'OK' END state FROM s LEFT JOIN du USING (profile)""",
    "run_summary": f"""WITH x AS (SELECT DISTINCT seq, {fr.sql_key('profile')} profile, start_ms, end_ms, greatest(coalesce(len(payload.cues), 0), 0) n, payload.language l FROM chunks WHERE {fr.sql_key('profile')} <> '' AND start_ms >= 0 AND start_ms < end_ms),
 k AS (SELECT profile, coalesce(l.status, '?') || ' → ' || coalesce(l.method, '?') w, count(*) n FROM x GROUP BY 1, 2), t AS (SELECT profile, array_to_string(list_sort(list(w || ' ' || n)), ';') kinds FROM k GROUP BY 1)
 SELECT x.profile, count(*) windows, CAST(sum(n) AS BIGINT) cues, CAST(sum(CAST(round(coalesce(l.score, 0) * 1000000) AS BIGINT)) AS BIGINT) / count(*) / 1000000 score_mean, max(end_ms - start_ms) longest_ms, any_value(kinds) kinds FROM x JOIN t ON t.profile = x.profile GROUP BY 1""",
    "bytes_needed": """WITH x AS (SELECT l_orderkey, CAST(l_quantity * 1000 AS BIGINT) b, CASE WHEN l_linestatus = 'F' THEN 'i' WHEN l_returnflag = 'N' THEN 'p' ELSE 'm' END s FROM lineitem), h AS (SELECT *, CASE s WHEN 'i' THEN b WHEN 'p' THEN b // 4 ELSE 0 END h FROM x)
 SELECT l_orderkey, CAST(sum(b) AS BIGINT) bytes_total, CAST(sum(CASE WHEN s = 'i' THEN b ELSE 0 END) AS BIGINT) bytes_installed, CAST(sum(CASE WHEN s <> 'i' THEN b - h ELSE 0 END) AS BIGINT) bytes_needed, CAST(sum(h) AS BIGINT) bytes_done, bool_and(s = 'i') ready FROM h GROUP BY 1""",
    "signal_frames": """WITH x AS (SELECT user_id, event_type, list(CAST(floor(value) AS BIGINT) ORDER BY ts, event_id) v FROM events WHERE value IS NOT NULL GROUP BY 1, 2), f AS (SELECT *, unnest(range(0, (len(v) + 7) // 8)) frame FROM x), s AS (SELECT user_id, event_type, frame, [CASE WHEN frame * 8 + i >= 0 THEN coalesce(v[frame * 8 + i + 1], 0) ELSE 0 END for i in range(-2, 8)] s FROM f)
 SELECT user_id, event_type, frame, array_to_string(s, ',') samples, len(list_filter(s, lambda q: q <> 0)) = 0 silent FROM s""",
}
