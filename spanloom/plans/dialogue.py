"""Windows, aggregates, stores and text rules over cues, chunks, glossary and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.functions import text as tx
from spanloom.operators import joins, measures, nouns, replies, store
from spanloom.plans import frames as fr
from spanloom.sources.tables import key_of, load

_ORDER = ["start_ms", "end_ms", "id"]


def _cues(spark: SparkSession, folder: str) -> DataFrame:
    return fr.cues(spark, folder).select("profile", "id", "start_ms", "end_ms", "text").distinct()


# --- windows -------------------------------------------------------------------------------------------------------


def neighbour_context(spark: SparkSession, folder: str) -> DataFrame:
    """Cues numbered from 0 per profile; of those with a letter, two neighbours on either side. Numbers keep their gaps."""
    x = _cues(spark, folder).withColumn("index", F.row_number().over(Window.partitionBy("profile").orderBy(*_ORDER)) - 1).where(F.col("text").rlike("\\p{L}"))
    x = joins.neighbours(x, ["profile"], ["index"], "text", 2, 2)
    return x.select("profile", "id", "index", F.array_join("before", "|").alias("before"), F.array_join("after", "|").alias("after"))


def previous_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """The last ten earlier (source, rendering) pairs of the same film and target, as they were learned."""
    g = _glossary(spark, folder)
    pair = F.concat_ws("=", "source", "rendering")
    w = Window.partitionBy("media", "target").orderBy("seq")
    return g.withColumn("pair", pair).select("seq", F.array_join(F.collect_list("pair").over(w.rowsBetween(-10, -1)), ";").alias("previous"))


def gap_split(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of cues without a gap above 1,500 ms."""
    w = Window.partitionBy("profile").orderBy(*_ORDER)
    x = _cues(spark, folder).withColumn("new", F.coalesce((F.col("start_ms") - F.lag("end_ms").over(w) > 1500).cast("int"), F.lit(1)))
    x = x.withColumn("part", F.sum("new").over(w))
    return x.groupBy("profile", "part").agg(F.count(F.lit(1)).alias("n"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))


def batches(spark: SparkSession, folder: str) -> DataFrame:
    """Cues in order, in batches of twelve."""
    w = Window.partitionBy("profile").orderBy(*_ORDER)
    x = _cues(spark, folder).withColumn("batch", F.floor((F.row_number().over(w) - 1) / 12))
    return x.groupBy("profile", "batch").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"), F.min("start_ms").alias("start_ms"))


def overlap_check(spark: SparkSession, folder: str) -> DataFrame:
    """Cues that begin before the cue before them has ended, or not before they end."""
    w = Window.partitionBy("profile").orderBy(*_ORDER)
    x = _cues(spark, folder).withColumn("before", F.lag("end_ms").over(w))
    return x.where("start_ms < before").select("profile", "id", (F.col("before") - F.col("start_ms")).alias("overlap_ms"))


def boundary_reconcile(spark: SparkSession, folder: str) -> DataFrame:
    """A cue that overlaps the one before by at most 160 ms is clipped; a larger overlap is an error, unless it would be empty."""
    w = Window.partitionBy("profile").orderBy(*_ORDER)
    x = _cues(spark, folder).withColumn("before", F.lag("end_ms").over(w)).withColumn("over", F.coalesce(F.col("before") - F.col("start_ms"), F.lit(0)))
    ok = (F.col("over") <= 160) & (F.col("before") < F.col("end_ms"))
    state = F.when(F.col("over") <= 0, "kept").when(ok, "clipped").otherwise("error")
    return x.select("profile", "id", state.alias("state"), F.when((F.col("over") > 0) & ok, F.col("before")).otherwise(F.col("start_ms")).alias("start_ms"))


def recent_terms(spark: SparkSession, folder: str) -> DataFrame:
    """The ten newest glossary rows of each film and target."""
    return joins.newest(_glossary(spark, folder), ["media", "target"], [F.desc("seq")], 10).select("media", "target", "seq", "source")


# --- aggregates ----------------------------------------------------------------------------------------------------


def _scored(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks judged by their language evidence: a score from 1 to 5, the source flag and an issue."""
    x = load(spark, folder, "chunks").select("seq", key_of("profile").alias("profile"), "start_ms", F.col("payload.language.score").alias("s"), F.col("payload.language.status").alias("issue")).where("profile is not null").distinct()
    return x.withColumn("score", F.when(F.col("s").isNotNull(), F.least(F.lit(5), F.floor(F.col("s") * 5) + 1))).withColumn("ok", F.coalesce(F.col("s") >= 0.7, F.lit(True)))


def score_summary(spark: SparkSession, folder: str) -> DataFrame:
    return measures.score_summary(_scored(spark, folder), ["profile"], "score", "ok", "issue")


def worst_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Per profile the twenty worst by score and start."""
    return joins.newest(_scored(spark, folder).where("score is not null"), ["profile"], [F.asc("score"), F.asc_nulls_first("start_ms"), F.asc("seq")], 20).select("profile", "seq", "score", "start_ms")


def verdict_zip(spark: SparkSession, folder: str) -> DataFrame:
    """The n-th cue of a profile meets the n-th judged chunk; cues without one stay unjudged."""
    c = _cues(spark, folder).withColumn("n", F.row_number().over(Window.partitionBy("profile").orderBy(*_ORDER)))
    v = _scored(spark, folder).where("score is not null").withColumn("n", F.row_number().over(Window.partitionBy("profile").orderBy("seq", F.asc_nulls_first("start_ms")))).select("profile", "n", "score")
    return c.join(v, ["profile", "n"], "left").select("profile", "id", "n", F.coalesce("score", F.lit(0)).alias("score"))


def verdict_validation(spark: SparkSession, folder: str) -> DataFrame:
    """Batches of eight chunks whose scores are all there, whole and unique; one bad row voids its batch."""
    x = _scored(spark, folder).withColumn("batch", F.floor((F.row_number().over(Window.partitionBy("profile").orderBy("seq", F.asc_nulls_first("start_ms"))) - 1) / 8))
    g = x.groupBy("profile", "batch").agg(F.count(F.lit(1)).alias("n"), F.count("score").alias("judged"), F.countDistinct("seq").alias("ids"))
    return g.select("profile", "batch", "n", ((F.col("judged") == F.col("n")) & (F.col("ids") == F.col("n"))).alias("valid"))


def fragment_count(spark: SparkSession, folder: str) -> DataFrame:
    """Per profile: cues, and those of fewer than three words; none counts too."""
    x = _cues(spark, folder).withColumn("k", F.size(tx.tokens(F.col("text"))))
    return x.groupBy("profile").agg(F.count(F.lit(1)).alias("captions"), F.count_if(F.col("k") < 3).alias("fragments"))


def word_case_stats(spark: SparkSession, folder: str) -> DataFrame:
    return measures.word_cases(_cues(spark, folder), ["profile"], "text")


def common_words(spark: SparkSession, folder: str) -> DataFrame:
    return measures.common_words(load(spark, folder, "documents").where("text is not null").withColumn("src", key_of("source")).where("src is not null"), ["src"], "text").select("src", "word", "small", "other")


def name_mentions(spark: SparkSession, folder: str) -> DataFrame:
    """Glossary names by mentions in the film's cues: cues that hold the name as a word, and how often it stands in them."""
    names = _glossary(spark, folder).select("media", "source")
    cues = fr.cues(spark, folder).where("media is not null").groupBy("media", "id").agg(F.min("text").alias("text"))
    return measures.mentions(names, cues, ["media"], "source", "text", "id")


def known_languages(spark: SparkSession, folder: str) -> DataFrame:
    x = load(spark, folder, "chunks").select("seq", key_of("profile").alias("profile"), F.struct("start_ms", "seq").alias("at"), F.col("payload.language.code").alias("code")).where("profile is not null and start_ms is not null").distinct()
    return measures.known_language(x, ["profile"], "code", "at").where("first_known is not null")


def latency_rank(spark: SparkSession, folder: str) -> DataFrame:
    return measures.nearest_rank(load(spark, folder, "events"), ["event_type"], "value", 0.95)


def realtime_factor(spark: SparkSession, folder: str) -> DataFrame:
    """Span of updates over the unique media time of the chunks, per profile."""
    from spanloom.operators import spans

    c = fr.chunks(spark, folder)
    wall = c.groupBy("profile").agg((F.unix_millis(F.max("updated")) - F.unix_millis(F.min("updated"))).alias("wall_ms"))
    media = spans.merge(c, ["profile"]).groupBy("profile").agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("media_ms"))
    return wall.join(media, "profile").select("profile", "wall_ms", "media_ms")


def cache_status(spark: SparkSession, folder: str) -> DataFrame:
    c = load(spark, folder, "chunks").select(F.struct(F.lit(0).alias("t"), F.col("seq").cast("string").alias("k")).alias("x")).where("x.k is not null")
    p = load(spark, folder, "profiles").select(F.struct(F.lit(1).alias("t"), F.col("profile").alias("k")).alias("x")).where("x.k is not null")
    x = c.unionByName(p).distinct()
    return x.agg(F.count_if(F.col("x.t") == 0).alias("chunks"), F.count_if(F.col("x.t") == 1).alias("profiles"))


# --- stores --------------------------------------------------------------------------------------------------------


def _glossary(spark: SparkSession, folder: str) -> DataFrame:
    x = load(spark, folder, "glossary").select("seq", key_of("media").alias("media"), "target", "source", "rendering", "first_ms").where("media is not null and source is not null and rendering is not null")
    return x.distinct()


def chunk_upsert(spark: SparkSession, folder: str) -> DataFrame:
    """The last writer of each profile and range."""
    return store.last_wins(fr.chunks(spark, folder), ["profile", "start_ms", "end_ms"], [F.desc_nulls_last("updated"), F.desc("seq")]).select("profile", "start_ms", "end_ms", "seq")


def profile_register(spark: SparkSession, folder: str) -> DataFrame:
    """Profiles registered before October 2025, then the others where the profile is new: first writer wins."""
    p = load(spark, folder, "profiles").select(key_of("profile").alias("profile"), key_of("media").alias("media"), "target", "registered").where("profile is not null and registered is not null").distinct()
    early = store.last_wins(p.where("registered < timestamp'2025-10-01'"), ["profile"], [F.asc("registered"), F.asc_nulls_first("media"), F.asc_nulls_first("target")])
    return store.first_wins(early, p.where("registered >= timestamp'2025-10-01'"), ["profile"], [F.asc("registered"), F.asc_nulls_first("media"), F.asc_nulls_first("target")]).select("profile", "media", "target")


def clear_media(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks left after all profiles of removed films are cleared."""
    gone = load(spark, folder, "media").where("removed is not null").select(key_of("media").alias("media")).where("media is not null")
    p = load(spark, folder, "profiles").select(key_of("profile").alias("profile"), key_of("media").alias("media")).where("profile is not null")
    return store.without(fr.chunks(spark, folder), p.join(gone, "media", "left_semi"), ["profile"]).select("profile", "seq", "start_ms").distinct()


def cleared_tables(spark: SparkSession, folder: str) -> DataFrame:
    """Rows left in each table after all removed films are cleared: their chunks, profiles and glossary go together."""
    gone = load(spark, folder, "media").where("removed is not null").select(key_of("media").alias("media")).where("media is not null")
    p = load(spark, folder, "profiles").select(key_of("profile").alias("profile"), key_of("media").alias("media"), "target").where("profile is not null").distinct()
    away = p.join(gone, "media", "left_semi")
    left = {"chunks": store.without(fr.chunks(spark, folder), away, ["profile"]).select("profile", "seq", "start_ms"), "profiles": p.join(gone, "media", "left_anti"), "glossary": store.without(_glossary(spark, folder), gone, ["media"])}
    counts = [x.distinct().agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("tbl"), "n") for t, x in left.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


def ledger_insert(spark: SparkSession, folder: str) -> DataFrame:
    return store.ledger(_glossary(spark, folder), ["media", "target"], "source", "rendering", "seq").select("media", "target", "source", "rendering", "seq")


def ledger_second_batch(spark: SparkSession, folder: str) -> DataFrame:
    """Rows learned late in a film that the ledger of its first half hour admits."""
    g = _glossary(spark, folder)
    held = store.ledger(g.where("first_ms < 1800000"), ["media", "target"], "source", "rendering", "seq")
    return store.ledger_add(held, g.where("first_ms >= 1800000"), ["media", "target"], "source", "rendering", "seq").select("media", "target", "source", "rendering", "seq")


def cue_dedupe(spark: SparkSession, folder: str) -> DataFrame:
    """Cues cached by several chunks: the copy of the chunk that starts last, ties by the greatest seq."""
    x = load(spark, folder, "chunks").select(key_of("profile").alias("profile"), "seq", F.col("start_ms").alias("chunk_ms"), F.explode("payload.cues").alias("c")).where("profile is not null and chunk_ms is not null and c.id is not null")
    return store.last_wins(x, ["profile", "c.id"], [F.desc("chunk_ms"), F.desc("seq")]).select("profile", F.col("c.id").alias("id"), "seq", F.col("c.start_ms").alias("start_ms"))


def glossary_precedence(spark: SparkSession, folder: str) -> DataFrame:
    """Renderings of a source in a film and target: confirmed by a context window, else learned."""
    c = load(spark, folder, "contexts").select(key_of("media").alias("media"), "target", F.explode("variants").alias("source", "rendering")).where("media is not null and rendering is not null").distinct()
    c = c.groupBy("media", "target", "source").agg(F.min("rendering").alias("rendering"))
    g = _glossary(spark, folder).groupBy("media", "target", "source").agg(F.min_by("rendering", F.struct("seq", "rendering")).alias("rendering"))
    return store.precedence([c, g], ["media", "target", "source"], ["rendering"])


def ledger_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Why a glossary row may not enter the ledger: pinned by a context window, or its first word is a common one."""
    g = _glossary(spark, folder).withColumn("head", F.lower(F.regexp_extract("source", f"^({measures.WORD})", 1)))
    pinned = load(spark, folder, "contexts").select(key_of("media").alias("media"), "target", F.explode("variants").alias("x", "source")).where("media is not null and source is not null").select("media", "target", "source").distinct().withColumn("pin", F.lit(True))
    common = measures.common_words(fr.cues(spark, folder).where("media is not null").select("media", "id", "text").distinct(), ["media"], "text").select("media", F.col("word").alias("head"), F.lit(True).alias("common"))
    x = g.join(pinned, ["media", "target", "source"], "left").join(common, ["media", "head"], "left")
    return x.select("seq", "media", "source", F.when(F.col("pin"), "pinned").when(F.col("common"), "common").otherwise("candidate").alias("reason"))


def _asked(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks as batches that a model was asked about: (seq, n, cues), numbered within seq."""
    x = load(spark, folder, "chunks").select("seq", "start_ms", "end_ms", "payload.cues").where("size(cues) > 0").distinct()
    return x.withColumn("n", F.row_number().over(Window.partitionBy("seq").orderBy("start_ms", "end_ms", F.size("cues")))).select("seq", "n", "cues")


#: Ways to spoil a reply: (name, what of the good reply is replaced, by what), in Spark's and RE2's common patterns.
SPOILT = [
    ("good", "^$", ""),
    ("fenced", "(?s)^(.*)$", "```json\n$1\n```"),
    ("talk", "^", "Here it is: "),
    ("number", '"text":"[^"\\\\]*"', '"text":5'),
    ("extra", '\\},\\{', ',"start":1},{'),
    ("tags", '"text":"[^"\\\\]*"', '"text":" <i></i>{x} "'),
    ("thinking", '"text":"', '"text":"<think '),
    ("renamed", '"text":', '"Text":'),
    ("cut", "\\]$", ""),
]


def reply_validation(spark: SparkSession, folder: str) -> DataFrame:
    """Replies to chunks' cues, good and spoilt: valid if each of the distinct ids is answered once, all or nothing."""
    x = _asked(spark, folder).withColumn("good", F.to_json(F.transform("cues", lambda c: F.struct(c["id"].alias("id"), c["text"].alias("text")))))
    tries = F.array(*[F.struct(F.lit(name).alias("kind"), F.regexp_replace("good", pattern, to).alias("reply")) for name, pattern, to in SPOILT])
    x = x.select("seq", "n", F.array_distinct("cues.id").alias("ids"), F.explode(tries).alias("t"))
    return x.select("seq", "n", "t.kind", replies.translations(F.col("t.reply"), F.col("ids")).isNotNull().alias("valid"))


#: Verdicts whose score, flag and issue are these JSON literals, and whether they are valid.
VERDICTS = [("4", "false", '"misheard"', True), ("5", "true", '""', True), ('"4"', "true", '""', False), ("4.0", "true", '""', False), ("true", "true", '""', False), ("0", "true", '""', False), ("6", "true", '""', False), ("3", '"true"', '""', False), ("3", "1", '""', False), ("3", "true", "null", False), ("3", "true", "7", False)]


def verdict_replies(spark: SparkSession, folder: str) -> DataFrame:
    """Verdicts on chunks' cues, one kind for each batch of distinct ids: the number judged and the sum of the scores, null if void."""
    kinds = F.array(*[F.struct(F.lit(i).alias("kind"), *[F.lit(v).alias(k) for v, k in zip(x, ("score", "ok", "issue"))]) for i, x in enumerate(VERDICTS)])
    x = _asked(spark, folder).select("seq", "n", F.array_distinct(F.filter("cues.id", lambda i: i.isNotNull())).alias("ids"), F.explode(kinds).alias("k")).where("size(ids) > 0")
    one = F.transform("ids", lambda i: F.concat(F.lit('{"id":"'), i, F.lit('","score":'), F.col("k.score"), F.lit(',"source_ok":'), F.col("k.ok"), F.lit(',"issue":'), F.col("k.issue"), F.lit(',"more":[]}')))
    x = x.withColumn("v", replies.verdicts(F.concat(F.lit(" ["), F.array_join(F.reverse(one), ","), F.lit("]\n")), F.col("ids")))
    return x.select("seq", "n", "k.kind", F.when(F.col("v").isNotNull(), F.size("v")).alias("judged"), F.aggregate("v", F.lit(0), lambda a, r: a + r["score"]).alias("scores"))


# --- text ----------------------------------------------------------------------------------------------------------


def clean_lengths(spark: SparkSession, folder: str) -> DataFrame:
    d = load(spark, folder, "documents").where("text is not null").select("doc_id", tx.clean_text(F.regexp_replace("text", "\\n", " <b>\n{x}")).alias("t")).distinct()
    return d.select("doc_id", F.length("t").alias("chars"), F.md5("t").alias("hash"))


def ending_flags(spark: SparkSession, folder: str) -> DataFrame:
    x = _cues(spark, folder)
    t = F.col("text")
    return x.select("profile", "id", tx.sentence_end(t).alias("sentence"), tx.clause_end(t).alias("clause"), tx.weak_ending(t).alias("weak"))


def subtitle_width(spark: SparkSession, folder: str) -> DataFrame:
    return _cues(spark, folder).groupBy("profile").agg(F.sum(tx.width(F.col("text"))).alias("columns"), F.max(tx.width(F.col("text"))).alias("widest"))


def joined_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Every cue's text joined with the next one's."""
    w = Window.partitionBy("profile").orderBy(*_ORDER)
    x = _cues(spark, folder).withColumn("next", F.lead("text").over(w)).where("next is not null")
    return x.select("profile", "id", F.md5(tx.join_texts(F.array("text", "next"))).alias("hash"))


def srt_stamps(spark: SparkSession, folder: str) -> DataFrame:
    return _cues(spark, folder).select("profile", "id", F.concat(tx.stamp(F.col("start_ms")), F.lit(" --> "), tx.stamp(F.col("end_ms"))).alias("stamp"))


def digest_ids(spark: SparkSession, folder: str) -> DataFrame:
    return _cues(spark, folder).select("profile", "id", F.substring(tx.digest(tx.json_string(F.col("profile")), F.col("start_ms"), F.col("end_ms"), tx.json_string(F.col("text"))), 1, 24).alias("digest"))


def name_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Words of documents that look like names or acronyms, without a possessive ending, with how often they stand."""
    x = load(spark, folder, "documents").where("text is not null").select(tx.shouting(F.col("text")).alias("loud"), F.explode(F.regexp_extract_all("text", F.lit(measures.WORD), F.lit(0))).alias("w")).select("loud", tx.without_possessive(F.col("w")).alias("w"))
    return x.where(~F.col("w").isin(nouns.STOP) & (tx.looks_like_name(F.col("w")) | tx.is_acronym(F.col("w")) & ~F.col("loud"))).groupBy("w").agg(F.count(F.lit(1)).alias("n"), F.any_value(tx.is_acronym(F.col("w"))).alias("acronym"))


def safe_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Glossary sources as keys without blanks, and as letters and digits only."""
    return _glossary(spark, folder).select("seq", tx.safe_key(F.col("source")).alias("key"), tx.signs(F.col("source")).alias("signs"))


def fuzzy_names(spark: SparkSession, folder: str) -> DataFrame:
    """Glossary sources of four or more characters against the film's earlier ones of any length with the same first letter.

    The nearest within one or two edits counts, the first learned of equally near ones.
    """
    x = _glossary(spark, folder).groupBy("media", "target", F.col("source").alias("known")).agg(F.min("seq").alias("ord")).withColumn("film", F.struct("media", "target"))
    names = x.select("film", F.col("known").alias("name"), F.col("ord").alias("mine"))
    found = nouns.near_names(names, x.select("film", "known", "ord"), "film", later=True)
    return found.select("film.media", "film.target", "name", "known", "d")


def script_check(spark: SparkSession, folder: str) -> DataFrame:
    """Per film and target: does any rendering show the target's script, and no Chinese or Korean one kana."""
    g = _glossary(spark, folder).withColumn("base", F.substring_index("target", "-", 1))
    shows = F.lit(False)
    for code, pattern in tx.SCRIPTS.items():
        shows = shows | ((F.col("base") == code) & F.col("rendering").rlike(pattern))
    bad = F.col("base").isin("zh", "ko") & tx.has_kana(F.col("rendering"))
    return g.groupBy("media", "target").agg(F.bool_or(shows).alias("shows"), F.bool_or(bad).alias("kana"))


_G = f"gl AS (SELECT DISTINCT seq, {fr.sql_key('media')} media, target, source, rendering, first_ms FROM glossary WHERE {fr.sql_key('media')} <> '' AND source IS NOT NULL AND rendering IS NOT NULL)"
_C = f"{fr.CUES}, c AS (SELECT DISTINCT profile, id, start_ms, end_ms, text FROM cu)"
_S = f"sc0 AS (SELECT DISTINCT seq, {fr.sql_key('profile')} profile, start_ms, payload.language.score s, payload.language.status issue FROM chunks WHERE {fr.sql_key('profile')} <> ''), sc AS (SELECT *, least(5, CAST(floor(s * 5) AS BIGINT) + 1) score0, CASE WHEN s IS NOT NULL THEN least(5, CAST(floor(s * 5) AS BIGINT) + 1) END score, coalesce(s >= 0.7, true) ok FROM sc0)"
_BAD = "(NOT ok OR coalesce(regexp_matches(issue, '(?i)mishear|misheard|transcri|garbled|recogni'), false))"
_O = "(PARTITION BY profile ORDER BY start_ms, end_ms, id)"
_ST, _BARE = fr.sql_strip("text"), fr.sql_bare("text")
_WD = "[\\p{L}\\p{Nl}\\p{No}](?:[\\p{L}\\p{Nl}\\p{No}]|[''’\\-])*"

_LETTERS = lambda c: f"length(regexp_replace(text, '[^\\p{{{c}}}]', '', 'g'))"
_LOUD = f"{_LETTERS('Lu')} * 2 > {_LETTERS('L')}"
_STOP = ", ".join("'" + w.replace("'", "''") + "'" for w in nouns.STOP)


_fold = fr.sql_fold
_ASKED = "ak0 AS (SELECT DISTINCT seq, start_ms, end_ms, payload.cues cues FROM chunks WHERE len(payload.cues) > 0), ak AS (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY start_ms NULLS FIRST, end_ms NULLS FIRST, len(cues)) n FROM ak0)"
_JT = fr.sql_clean("json_extract_string(o, '$.text')")


def _spoil(pattern: str, to: str) -> str:
    quote = lambda v: "'" + v.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    return f"regexp_replace(g, {quote(pattern)}, {quote(to.replace('$1', chr(92) + '1'))}, 'g')"


def _json(x: str) -> str:
    """A JSON string as json.dumps writes it, of texts whose only control characters are these."""
    for c, e in (("'\\'", "'\\\\'"), ("'\"'", "'\\\"'"), ("chr(10)", "'\\n'"), ("chr(13)", "'\\r'"), ("chr(9)", "'\\t'")):
        x = f"replace({x}, {c}, {e})"
    return f"'\"' || {x} || '\"'"


QUERIES = {
    f.__name__: f
    for f in (
        neighbour_context, previous_pairs, gap_split, batches, overlap_check, boundary_reconcile, recent_terms, score_summary, worst_scores, verdict_zip, verdict_validation, fragment_count, word_case_stats, common_words, name_mentions, known_languages,
        latency_rank, realtime_factor, cache_status, chunk_upsert, profile_register, clear_media, cleared_tables, ledger_insert, ledger_second_batch, cue_dedupe, glossary_precedence, ledger_candidates, reply_validation, verdict_replies, clean_lengths, ending_flags, subtitle_width, joined_texts, srt_stamps, digest_ids, name_tokens, safe_keys, fuzzy_names, script_check,
    )
}

ORACLES = {
    "neighbour_context": f"""WITH {_C}, n AS (SELECT *, row_number() OVER {_O} - 1 AS index FROM c), k AS (SELECT * FROM n WHERE regexp_matches(text, '\\p{{L}}'))
 SELECT profile, id, index, coalesce(array_to_string(list(text) OVER (PARTITION BY profile ORDER BY index ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), '|'), '') AS before,
 coalesce(array_to_string(list(text) OVER (PARTITION BY profile ORDER BY index ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING), '|'), '') AS after FROM k""",
    "previous_pairs": f"WITH {_G} SELECT seq, coalesce(array_to_string(list(source || '=' || rendering) OVER (PARTITION BY media, target ORDER BY seq ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), ';'), '') previous FROM gl",
    "gap_split": f"WITH {_C}, a AS (SELECT *, CASE WHEN lag(end_ms) OVER {_O} IS NULL OR start_ms - lag(end_ms) OVER {_O} > 1500 THEN 1 ELSE 0 END nw FROM c), b AS (SELECT *, CAST(sum(nw) OVER (PARTITION BY profile ORDER BY start_ms, end_ms, id ROWS UNBOUNDED PRECEDING) AS BIGINT) part FROM a) SELECT profile, part, count(*) n, min(start_ms) start_ms, max(end_ms) end_ms FROM b GROUP BY 1, 2",
    "batches": f"WITH {_C}, a AS (SELECT *, (row_number() OVER {_O} - 1) // 12 batch FROM c) SELECT profile, batch, count(*) n, CAST(sum(length(text)) AS BIGINT) chars, min(start_ms) start_ms FROM a GROUP BY 1, 2",
    "overlap_check": f"WITH {_C}, a AS (SELECT *, lag(end_ms) OVER {_O} b FROM c) SELECT profile, id, b - start_ms overlap_ms FROM a WHERE start_ms < b",
    "boundary_reconcile": f"WITH {_C}, a AS (SELECT *, lag(end_ms) OVER {_O} b FROM c), o AS (SELECT *, coalesce(b - start_ms, 0) ov FROM a) SELECT profile, id, CASE WHEN ov <= 0 THEN 'kept' WHEN ov <= 160 AND b < end_ms THEN 'clipped' ELSE 'error' END state, CASE WHEN ov > 0 AND ov <= 160 AND b < end_ms THEN b ELSE start_ms END start_ms FROM o",
    "recent_terms": f"WITH {_G}, r AS (SELECT *, row_number() OVER (PARTITION BY media, target ORDER BY seq DESC) r FROM gl) SELECT media, target, seq, source FROM r WHERE r <= 10",
    "score_summary": f"""WITH {_S} SELECT profile, count(*) n, count(*) FILTER (WHERE score IS NULL) unjudged, avg(score) mean, {', '.join(f'count(*) FILTER (WHERE score = {k}) score_{k}' for k in range(1, 6))},
 count(*) FILTER (WHERE NOT ok) source_not_ok, count(*) FILTER (WHERE {_BAD}) source_suspect, avg(score) FILTER (WHERE ok) mean_ok, avg(score) FILTER (WHERE NOT {_BAD}) mean_clean FROM sc GROUP BY 1""",
    "worst_scores": f"WITH {_S}, r AS (SELECT *, row_number() OVER (PARTITION BY profile ORDER BY score, start_ms NULLS FIRST, seq) r FROM sc WHERE score IS NOT NULL) SELECT profile, seq, score, start_ms FROM r WHERE r <= 20",
    "verdict_zip": f"WITH {_C}, {_S}, a AS (SELECT *, row_number() OVER {_O} n FROM c), v AS (SELECT profile, score, row_number() OVER (PARTITION BY profile ORDER BY seq, start_ms NULLS FIRST) n FROM sc WHERE score IS NOT NULL) SELECT a.profile, id, a.n, coalesce(v.score, 0) score FROM a LEFT JOIN v ON v.profile = a.profile AND v.n = a.n",
    "verdict_validation": f"WITH {_S}, b AS (SELECT *, (row_number() OVER (PARTITION BY profile ORDER BY seq, start_ms NULLS FIRST) - 1) // 8 batch FROM sc) SELECT profile, batch, count(*) n, count(score) = count(*) AND count(DISTINCT seq) = count(*) AS valid FROM b GROUP BY 1, 2",
    "fragment_count": f"WITH {_C} SELECT profile, count(*) captions, count(*) FILTER (WHERE len(list_filter(regexp_split_to_array(text, '{fr._BL}+'), lambda x: x <> '')) < 3) fragments FROM c GROUP BY 1",
    "word_case_stats": f"WITH {_C}, w AS (SELECT profile, unnest(regexp_extract_all(text, '{_WD}')) w FROM c) SELECT profile, lower(w) word, count(*) FILTER (WHERE regexp_matches(w, '^\\p{{Ll}}')) small, count(*) FILTER (WHERE NOT regexp_matches(w, '^\\p{{Ll}}')) other FROM w GROUP BY 1, 2",
    "common_words": f"WITH w AS (SELECT {fr.sql_key('source')} src, unnest(regexp_extract_all(text, '{_WD}')) w FROM documents WHERE text IS NOT NULL), g AS (SELECT src, lower(w) word, count(*) FILTER (WHERE regexp_matches(w, '^\\p{{Ll}}')) small, count(*) FILTER (WHERE NOT regexp_matches(w, '^\\p{{Ll}}')) other FROM w WHERE src <> '' GROUP BY 1, 2) SELECT * FROM g WHERE small >= 1 AND small >= other",
    # every sign that is no letter stands twice, so that neighbours don't share the sign between them
    "name_mentions": f"""WITH {fr.CUES}, {_G}, n AS (SELECT DISTINCT media, source, {fr.sql_escaped(fr.sql_twice('source'))} p FROM gl WHERE regexp_matches(source, '{fr.LETTER}')), c AS (SELECT media, id, {fr.sql_twice('min(text)')} t FROM cu WHERE media <> '' GROUP BY 1, 2),
 h AS (SELECT n.media, source, len(regexp_extract_all(t, '(?:^|{fr.OTHER})' || p || '(?:$|{fr.OTHER})')) k FROM n JOIN c ON c.media = n.media AND contains(t, {fr.sql_twice('source')}))
 SELECT media, source, count(*) mentions, CAST(sum(k) AS BIGINT) occurrences FROM h WHERE k > 0 GROUP BY 1, 2""",
    "known_languages": f"WITH k AS (SELECT DISTINCT {fr.sql_key('profile')} profile, seq, start_ms, payload.language.code code FROM chunks WHERE start_ms IS NOT NULL) SELECT profile, arg_min(code, ((start_ms, seq), code)) first_known, arg_max(code, ((start_ms, seq), code)) last_known FROM k WHERE profile <> '' AND code <> 'und' GROUP BY 1",
    "latency_rank": "SELECT event_type, list_sort(list(value))[CAST(floor((count(*) - 1) * 0.95) AS BIGINT) + 1] AS value, count(*) n FROM events WHERE value IS NOT NULL GROUP BY 1",
    "realtime_factor": f"WITH {fr.CHUNKS}, {fr.islands('isl', 'ch')} SELECT a.profile, wall_ms, media_ms FROM (SELECT profile, epoch_us(max(updated)) // 1000 - epoch_us(min(updated)) // 1000 wall_ms FROM ch GROUP BY 1) a JOIN (SELECT profile, CAST(sum(end_ms - start_ms) AS BIGINT) media_ms FROM isl GROUP BY 1) b ON a.profile = b.profile",
    "cache_status": "SELECT (SELECT count(DISTINCT seq) FROM chunks) chunks, (SELECT count(DISTINCT profile) FROM profiles) profiles",
    "chunk_upsert": f"WITH {fr.CHUNKS}, r AS (SELECT *, row_number() OVER (PARTITION BY profile, start_ms, end_ms ORDER BY updated DESC NULLS LAST, seq DESC) r FROM ch) SELECT profile, start_ms, end_ms, seq FROM r WHERE r = 1",
    "profile_register": f"WITH p AS (SELECT DISTINCT {fr.sql_key('profile')} profile, nullif({fr.sql_key('media')}, '') media, target, registered FROM profiles WHERE {fr.sql_key('profile')} <> '' AND registered IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY profile ORDER BY registered, media NULLS FIRST, target NULLS FIRST) r FROM p) SELECT profile, media, target FROM r WHERE r = 1",
    "clear_media": f"WITH {fr.CHUNKS}, g AS (SELECT DISTINCT {fr.sql_key('profile')} profile FROM profiles WHERE {fr.sql_key('media')} IN (SELECT {fr.sql_key('media')} FROM media WHERE removed IS NOT NULL AND {fr.sql_key('media')} <> '')) SELECT DISTINCT profile, seq, start_ms FROM ch WHERE profile NOT IN (SELECT profile FROM g WHERE profile IS NOT NULL)",
    "cleared_tables": f"""WITH {fr.CHUNKS}, {_G}, o AS (SELECT DISTINCT {fr.sql_key('media')} media FROM media WHERE removed IS NOT NULL AND {fr.sql_key('media')} <> ''), p AS (SELECT DISTINCT {fr.sql_key('profile')} profile, nullif({fr.sql_key('media')}, '') media, target FROM profiles WHERE {fr.sql_key('profile')} <> ''),
 a AS (SELECT DISTINCT profile FROM p JOIN o USING (media)) SELECT 'chunks' tbl, count(*) n FROM (SELECT DISTINCT profile, seq, start_ms FROM ch WHERE profile NOT IN (SELECT profile FROM a)) UNION ALL SELECT 'profiles', count(*) FROM p WHERE media IS NULL OR media NOT IN (SELECT media FROM o) UNION ALL SELECT 'glossary', count(*) FROM gl WHERE media NOT IN (SELECT media FROM o)""",
    "ledger_insert": f"WITH {_G}, a AS (SELECT *, row_number() OVER (PARTITION BY media, target, source ORDER BY seq) r FROM gl), b AS (SELECT *, row_number() OVER (PARTITION BY media, target, rendering ORDER BY seq) q FROM a WHERE r = 1) SELECT media, target, source, rendering, seq FROM b WHERE q = 1",
    "ledger_second_batch": f"""WITH {_G}, a AS (SELECT *, row_number() OVER (PARTITION BY media, target, source ORDER BY seq) r FROM gl WHERE first_ms < 1800000), b AS (SELECT *, row_number() OVER (PARTITION BY media, target, rendering ORDER BY seq) q FROM a WHERE r = 1), h AS (SELECT * FROM b WHERE q = 1),
 n AS (SELECT * FROM gl WHERE first_ms >= 1800000 AND NOT EXISTS (SELECT 1 FROM h WHERE h.media = gl.media AND h.target IS NOT DISTINCT FROM gl.target AND (h.source = gl.source OR h.rendering = gl.rendering))),
 d AS (SELECT *, row_number() OVER (PARTITION BY media, target, source ORDER BY seq) r FROM n), e AS (SELECT *, row_number() OVER (PARTITION BY media, target, rendering ORDER BY seq) q FROM d WHERE r = 1) SELECT media, target, source, rendering, seq FROM e WHERE q = 1""",
    "cue_dedupe": f"WITH x AS (SELECT {fr.sql_key('profile')} profile, seq, start_ms ms, unnest(payload.cues) c FROM chunks), r AS (SELECT *, row_number() OVER (PARTITION BY profile, c.id ORDER BY ms DESC, seq DESC) r FROM x WHERE profile <> '' AND ms IS NOT NULL AND c.id IS NOT NULL) SELECT profile, c.id AS id, seq, c.start_ms start_ms FROM r WHERE r = 1",
    "glossary_precedence": f"""WITH {_G}, e AS (SELECT {fr.sql_key('media')} media, target, unnest(map_entries(variants)) v FROM contexts), c AS (SELECT media, target, v.key source, min(v.value) rendering FROM e WHERE media <> '' AND v.value IS NOT NULL GROUP BY 1, 2, 3),
 g AS (SELECT media, target, source, arg_min(rendering, (seq, rendering)) rendering FROM gl GROUP BY 1, 2, 3), u AS (SELECT *, 0 AS rank FROM c UNION ALL SELECT *, 1 FROM g) SELECT media, target, source, arg_min(rendering, rank) rendering, min(rank) AS rank FROM u GROUP BY 1, 2, 3""",
    "ledger_candidates": f"""WITH {fr.CUES}, {_G}, t AS (SELECT DISTINCT media, id, text FROM cu WHERE media <> ''), w AS (SELECT media, unnest(regexp_extract_all(text, '{_WD}')) w FROM t),
 k AS (SELECT media, lower(w) h FROM w GROUP BY 1, 2 HAVING count(*) FILTER (WHERE regexp_matches(w, '^\\p{{Ll}}')) >= greatest(1, count(*) FILTER (WHERE NOT regexp_matches(w, '^\\p{{Ll}}')))),
 p AS (SELECT DISTINCT {fr.sql_key('media')} media, target, unnest(map_values(variants)) v FROM contexts)
 SELECT seq, media, source, CASE WHEN EXISTS (SELECT 1 FROM p WHERE p.media = gl.media AND p.target = gl.target AND p.v = gl.source) THEN 'pinned' WHEN EXISTS (SELECT 1 FROM k WHERE k.media = gl.media AND k.h = lower(regexp_extract(gl.source, '^{_WD}'))) THEN 'common' ELSE 'candidate' END reason FROM gl""",
    "reply_validation": f"""WITH {_ASKED}, x AS (SELECT seq, n, to_json([{{'id': c.id, 'text': c.text}} for c in cues]) g, list_distinct([c.id for c in cues]) ids, cues FROM ak), t AS (SELECT seq, n, ids, unnest([{', '.join(f"{{'kind': '{k}', 'reply': {_spoil(a, b)}}}" for k, a, b in SPOILT)}]) t FROM x),
 u AS (SELECT seq, n, ids, t.kind, CASE WHEN starts_with(t.reply, '```json') THEN t.reply[8:-4] ELSE t.reply END r FROM t), j AS (SELECT *, CASE WHEN json_valid(r) AND json_type(r) = 'ARRAY' THEN json_extract(r, '$[*]') END v FROM u)
 SELECT seq, n, kind, coalesce(len(v) = len(ids) AND len(list_distinct([json_extract_string(o, '$.id') for o in v])) = len(ids) AND list_has_all(ids, [json_extract_string(o, '$.id') for o in v])
 AND len([1 for o in v if json_type(o) = 'OBJECT' AND list_sort(json_keys(o)) = ['id', 'text'] AND json_type(o, '$.text') = 'VARCHAR' AND length({_JT}) BETWEEN 1 AND 1000 AND NOT regexp_matches({_JT}, '<think|\\[THOUGHT\\]')]) = len(ids), false) AS valid FROM j""",
    "verdict_replies": f"""WITH {_ASKED}, x AS (SELECT seq, n, len(list_distinct([c.id for c in cues if c.id IS NOT NULL])) m FROM ak), k AS (SELECT * FROM (VALUES {', '.join(f"({i}, {v[0] if v[3] else 'NULL'})" for i, v in enumerate(VERDICTS))}) k(kind, score))
 SELECT seq, n, kind, CASE WHEN score IS NOT NULL THEN CAST(m AS INTEGER) END judged, CAST(m * score AS INTEGER) scores FROM x, k WHERE m > 0""",
    "clean_lengths": f"WITH d AS (SELECT DISTINCT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\\n', ' <b>' || chr(10) || '{{x}}', 'g'), '<[^>]*>|\\{{[^}}]*\\}}', '', 'g'), '[\\x00-\\x1f\\x7f]', ' ', 'g'), '^{fr._BL}+|{fr._BL}+$', '', 'g') t FROM documents WHERE text IS NOT NULL) SELECT doc_id, length(t) chars, md5(t) AS hash FROM d",
    "ending_flags": f"""WITH {_C} SELECT profile, id, regexp_matches({_BARE}, '[.!?。！？]$') AND NOT regexp_matches({_BARE}, '(?i)(?:^|[^\\p{{L}}\\p{{N}}_])(?:mr|mrs|ms|dr|prof|sr|jr|st|vs|[a-z])\\.$') sentence, regexp_matches({_BARE}, '[,;:，、；：]$') clause,
 regexp_matches({_ST}, '[''’\\-‐]$') OR list_contains(string_split('a an the and or but to of for with from in on at by as is are was were have has had will would can could should not i', ' '), lower(regexp_extract({_ST}, '([A-Za-z]+)[^A-Za-z]*$', 1))) weak FROM c""",
    "subtitle_width": f"WITH {_C}, w AS (SELECT profile, length(text) + length(regexp_replace(text, '[^\\x{{1100}}-\\x{{115f}}\\x{{2e80}}-\\x{{303e}}\\x{{3041}}-\\x{{4dbf}}\\x{{4e00}}-\\x{{a4cf}}\\x{{a960}}-\\x{{a97f}}\\x{{ac00}}-\\x{{d7a3}}\\x{{f900}}-\\x{{faff}}\\x{{fe30}}-\\x{{fe6f}}\\x{{ff00}}-\\x{{ff60}}\\x{{ffe0}}-\\x{{ffe6}}\\x{{1f300}}-\\x{{1f64f}}\\x{{1f900}}-\\x{{1f9ff}}\\x{{20000}}-\\x{{3fffd}}]', '', 'g')) w FROM c) SELECT profile, CAST(sum(w) AS BIGINT) AS columns, max(w) widest FROM w GROUP BY 1",
    "joined_texts": f"WITH {_C}, n AS (SELECT *, lead(text) OVER {_O} nx FROM c) SELECT profile, id, md5({fr.sql_joined(f'[{_ST}, {fr.sql_strip(chr(110) + chr(120))}]')}) AS hash FROM n WHERE nx IS NOT NULL",
    "srt_stamps": f"WITH {_C} SELECT profile, id, printf('%02d:%02d:%02d,%03d', start_ms // 3600000, start_ms // 60000 % 60, start_ms // 1000 % 60, start_ms % 1000) || ' --> ' || printf('%02d:%02d:%02d,%03d', end_ms // 3600000, end_ms // 60000 % 60, end_ms // 1000 % 60, end_ms % 1000) stamp FROM c",
    "digest_ids": f"WITH {_C} SELECT profile, id, substr(sha256('[' || {_json('profile')} || ', ' || start_ms || ', ' || end_ms || ', ' || {_json('text')} || ']'), 1, 24) digest FROM c",
    "name_tokens": f"""WITH d AS MATERIALIZED (SELECT {_LOUD} loud, regexp_extract_all(text, '{_WD}') ws FROM documents WHERE text IS NOT NULL), w AS (SELECT loud, unnest(ws) w FROM d), p AS (SELECT regexp_replace(w, '[''’]s?$', '') w, loud FROM w)
 SELECT w, count(*) n, any_value(regexp_matches(w, '^\\p{{Lu}}{{2,5}}$')) acronym FROM p WHERE w NOT IN ({_STOP}) AND (regexp_matches(w, '^\\p{{Lu}}\\p{{Ll}}[\\p{{L}}''’\\-]+$') OR regexp_matches(w, '^\\p{{Lu}}{{2,5}}$') AND NOT loud) GROUP BY 1""",
    # DuckDB's levenshtein counts bytes, so the rows of the table are made here, one per letter
    "fuzzy_names": f"""WITH {_G}, k AS (SELECT media, target, source, min(seq) ord, {_fold('any_value(source)')} f, {_fold('any_value(source)[1]')} h FROM gl GROUP BY 1, 2, 3),
 x AS (SELECT a.media, a.target, a.source AS name, b.source known, b.ord, string_split(a.f, '') p, string_split(b.f, '') q FROM k a JOIN k b ON a.media = b.media AND a.target = b.target AND length(a.source) >= 4 AND a.f[1] = b.h[1] AND b.ord < a.ord AND abs(length(a.f) - length(b.f)) <= 2),
 e AS (SELECT media, target, name, known, ord, {fr.sql_edits('p', 'q')} d FROM x)
 SELECT media, target, name, arg_min(known, (d, ord)) known, CAST(min(d) AS INTEGER) d FROM e WHERE d <= CASE WHEN greatest(length(name), length(known)) <= 5 THEN 1 ELSE 2 END GROUP BY 1, 2, 3""",
    "safe_keys": f"WITH {_G} SELECT seq, regexp_replace(source, '{fr._BL}+', '_', 'g') AS key, regexp_replace({_fold('source')}, '[^\\p{{L}}\\p{{N}}]', '', 'g') signs FROM gl",
    "script_check": f"""WITH {_G}, b AS (SELECT *, split_part(target, '-', 1) base FROM gl) SELECT media, target, bool_or(CASE base WHEN 'zh' THEN regexp_matches(rendering, '[\\x{{4e00}}-\\x{{9fff}}]') WHEN 'ja' THEN regexp_matches(rendering, '[\\x{{3041}}-\\x{{30ff}}\\x{{4e00}}-\\x{{9fff}}]') WHEN 'ko' THEN regexp_matches(rendering, '[\\x{{ac00}}-\\x{{d7a3}}]')
 WHEN 'ru' THEN regexp_matches(rendering, '[\\x{{400}}-\\x{{4ff}}]') WHEN 'en' THEN regexp_matches(rendering, '[A-Za-z]') ELSE false END) shows, bool_or(base IN ('zh', 'ko') AND regexp_matches(rendering, '[\\x{{3041}}-\\x{{30ff}}]')) kana FROM b GROUP BY 1, 2""",
}
