"""Queries of ordered rules: greedy groups, names of whole films and session state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.operators import folds, models, nouns
from spanloom.plans import frames as fr
from spanloom.session import materialize, unsent
from spanloom.sources import captions
from spanloom.sources.tables import key_of, load
from spanloom.streaming import sessions

_ORDER = ["start_ms", "end_ms", "id"]
#: No rule reaches across a longer pause.
PAUSE = 7000
#: Languages of Latin script that films are heard in.
_LATIN = "en eng de deu ger es spa fr fra fre it ita pt por".split()


def _blocks(spark: SparkSession, folder: str) -> DataFrame:
    x = fr.cues(spark, folder).select("profile", "id", "start_ms", "end_ms", "text").distinct()
    return folds.blocks(x, ["profile"], _ORDER, PAUSE)


def sentence_groups(spark: SparkSession, folder: str) -> DataFrame:
    schema = "profile string, block long, id string, start_ms long, end_ms long, text string, unit long, unit_id string, continues boolean"
    w = Window.partitionBy("profile").orderBy(*_ORDER)
    x = _blocks(spark, folder).withColumn("before", F.when(F.lag("block").over(w) < F.col("block"), F.lag("text").over(w)))
    return folds.fold(x, ["profile", "block"], _ORDER, folds.sentence_units, schema)


def _words(rows: list[dict]) -> list[dict]:
    """Words with times in proportion to their letters."""
    out = []
    for r in rows:
        words = r["text"].split() or [r["text"]]
        total, at = sum(map(len, words)) or 1, 0
        for w in words:
            a, b = r["start_ms"] + (r["end_ms"] - r["start_ms"]) * at // total, r["start_ms"] + (r["end_ms"] - r["start_ms"]) * (at + len(w)) // total
            at += len(w)
            out.append({"start_ms": a, "end_ms": b, "text": w})
    return out


def assembled_captions(spark: SparkSession, folder: str) -> DataFrame:
    rule = lambda rows: folds.assemble(folds.coalesce_instant(_words(rows))[0], key=rows[0]["profile"])
    return folds.fold(_blocks(spark, folder), ["profile", "block"], _ORDER, rule, "profile string, block long, id string, start_ms long, end_ms long, text string")


def cache_conflicts(spark: SparkSession, folder: str) -> DataFrame:
    """Cues of a profile that a reader keeps, up to the first conflict, which is marked and ends the profile."""
    x = folds.fold(_blocks(spark, folder), ["profile", "block"], _ORDER, folds.keep_unless_overlap, "profile string, block long, id string, start_ms long, end_ms long, text string, conflict boolean")
    end = F.min(F.when(F.col("conflict"), F.col("block"))).over(Window.partitionBy("profile"))
    return x.withColumn("_end", end).where("_end is null or block <= _end").select("profile", "id", "start_ms", "end_ms", "text", "conflict")


def _windows(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks as windows: (seq, profile, from_ms, to_ms, cues), their possible cues in order."""
    c = load(spark, folder, "chunks").select("seq", key_of("profile").alias("profile"), F.col("start_ms").alias("from_ms"), F.col("end_ms").alias("to_ms"), F.col("payload.cues").alias("cues"))
    good = F.filter("cues", lambda c: (c["start_ms"] < c["end_ms"]) & c["text"].isNotNull() & c["id"].isNotNull())
    ordered = F.array_sort(F.transform(F.array_distinct(good), lambda c: F.struct(c["start_ms"].alias("start_ms"), c["end_ms"].alias("end_ms"), c["id"].alias("id"), c["text"].alias("text"))))
    return c.where("profile is not null and from_ms >= 0 and from_ms < to_ms").withColumn("cues", ordered).where("size(cues) > 0").distinct()


def held_back(spark: SparkSession, folder: str) -> DataFrame:
    """Per chunk: how many of its cues are ready, how many wait for the next window, and where that begins."""

    def rule(rows: list[dict]) -> list[dict]:
        r = rows[0]
        kept = folds.hold_back(r["cues"], r["from_ms"], r["to_ms"], 2000)
        n, end = (len(kept[0]), kept[1]) if kept else (len(r["cues"]), r["to_ms"])
        return [{"ready": n, "held": len(r["cues"]) - n, "next_ms": end}]

    return folds.fold(_windows(spark, folder), ["seq", "from_ms", "to_ms"], ["profile"], rule, "seq long, from_ms long, to_ms long, ready long, held long, next_ms long")


def window_frontier(spark: SparkSession, folder: str) -> DataFrame:
    """Per chunk: up to where its cues may be committed. A cue across that place stays out whole; null is no progress."""
    x = _windows(spark, folder).join(fr.durations(spark, folder), "profile", "left")
    at = F.when(F.col("to_ms") == F.col("duration_ms"), F.col("to_ms")).otherwise(F.col("to_ms") - 1000)
    x = x.withColumn("at", at)
    across = F.array_min(F.transform(F.filter("cues", lambda c: (c["start_ms"] < F.col("at")) & (c["end_ms"] > F.col("at"))), lambda c: c["start_ms"]))
    x = x.withColumn("at", F.coalesce(across, "at"))
    return x.select("seq", "from_ms", "to_ms", F.when(F.col("at") > F.col("from_ms"), F.col("at")).alias("committed_ms"))


def window_seams(spark: SparkSession, folder: str) -> DataFrame:
    """Per chunk with cues, against the chunk with cues before it: how the first cue meets the last committed one.

    kept (no overlap), clipped (by at most 160 ms, then it begins where the other ends) or error.
    """
    w = Window.partitionBy("profile").orderBy("from_ms", "to_ms", "seq")
    x = _windows(spark, folder).withColumn("prior", F.lag(F.element_at("cues", -1)["end_ms"]).over(w)).withColumn("first", F.col("cues")[0])
    over = F.coalesce(F.col("prior") - F.col("first.start_ms"), F.lit(0))
    good = (over <= 160) & (F.col("prior") < F.col("first.end_ms"))
    state = F.when(over <= 0, "kept").when(good, "clipped").otherwise("error")
    return x.select("seq", "from_ms", F.col("first.id").alias("first_id"), state.alias("state"), F.when((over > 0) & good, F.col("prior")).otherwise(F.col("first.start_ms")).alias("start_ms"))


def _frames(spark: SparkSession, folder: str) -> DataFrame:
    """The values of each user's events as probabilities, one frame each; a user's day is a group."""
    return load(spark, folder, "events").select("user_id", F.to_date("ts").alias("day"), "ts", "event_id", F.least(F.lit(1.0), F.col("value") / 100).alias("p"))


def speech_segments(spark: SparkSession, folder: str) -> DataFrame:
    rule = lambda rows: [{"start": a, "end": b} for a, b in folds.hysteresis([r["p"] for r in rows], len(rows) * 512)]
    return folds.fold(_frames(spark, folder), ["user_id", "day"], ["ts", "event_id"], rule, "user_id long, day date, start long, end long")


def speech_detail(spark: SparkSession, folder: str) -> DataFrame:
    """Per user and day the largest value and the milliseconds inside segments."""
    rule = lambda rows: [folds.speech_detail([r["p"] for r in rows], len(rows) * 512)]
    return folds.fold(_frames(spark, folder), ["user_id", "day"], ["ts", "event_id"], rule, "user_id long, day date, top double, speech_ms long")


def _latin_films(spark: SparkSession, folder: str, x: DataFrame) -> DataFrame:
    """Profiles most of whose chunks of known language are in one of Latin script or, as labels may be wrong, most of whose letters in ``x`` are."""
    c = load(spark, folder, "chunks").select(key_of("profile").alias("profile"), "seq", F.regexp_extract(F.lower("payload.language.code"), "[a-z]+", 0).alias("code")).where("profile is not null").distinct()
    c = c.where(~F.col("code").isin("", "und", "auto")).groupBy("profile").agg((F.count_if(F.col("code").isin(_LATIN)) * 2 > F.count(F.lit(1))).alias("said"))
    n = lambda letters: F.sum(F.length(F.regexp_replace("text", f"[^{letters}]", "")))
    t = x.groupBy("profile").agg((n("\\p{IsLatin}") * 2 > n("\\p{L}")).alias("shown"))
    return t.join(unsent(c), "profile", "left").where(F.col("shown") | F.coalesce("said", F.lit(False))).select("profile")


def _latin_texts(spark: SparkSession, folder: str) -> DataFrame:
    x = _blocks(spark, folder).select("profile", "block", "text")
    return x.join(unsent(_latin_films(spark, folder, x)), "profile", "left_semi")


def film_names(spark: SparkSession, folder: str) -> DataFrame:
    """Names that cues of films in a language of Latin script bring up, per block of a profile.

    A word that begins a sentence counts if it stands inside one anywhere in the film.
    """
    found = materialize(nouns.film_runs(_latin_texts(spark, folder), ["profile", "block"]), "runs")
    return nouns.settled(found, "profile").select("profile", "block", F.array_join("words", " ").alias("name")).distinct()


def film_variants(spark: SparkSession, folder: str) -> DataFrame:
    """New names of every film in a language of Latin script, and misspellings of its glossary's with the name meant."""
    texts = _latin_texts(spark, folder)
    texts = materialize(texts, "texts")
    found = materialize(nouns.settled(materialize(nouns.film_runs(texts, ["profile", "block"]), "runs"), "profile"), "settled")
    films = fr.cues(spark, folder).where("media is not null").select("profile", "media").distinct()
    learned = load(spark, folder, "glossary").select(key_of("media").alias("media"), F.col("source").alias("known"), "seq").where("media is not null and source is not null and rendering is not null and source <> ''")
    known = films.join(unsent(learned), "media").groupBy("profile", "known").agg(F.min("seq").alias("ord"))
    return nouns.new_and_variants(found, texts, known, "profile")


def srt_files(spark: SparkSession, folder: str) -> DataFrame:
    return captions.srt_blocks(fr.cues(spark, folder).select("profile", "id", "start_ms", "end_ms", "text").distinct(), ["profile"])


def export_states(spark: SparkSession, folder: str) -> DataFrame:
    return captions.export_state(fr.chunks(spark, folder), fr.durations(spark, folder), ["profile"])


class _Stand:
    """A stand-in: answers with the length of a text, and refuses batches that hold '?!'."""

    def __call__(self, batch: list[str]) -> list[str]:
        if any("?!" in t for t in batch):
            raise ValueError("refused")
        return [str(len(t)) for t in batch]


def model_boundary(spark: SparkSession, folder: str) -> DataFrame:
    """A stand-in model over cue texts in batches of eight; texts it refuses stay without an answer."""
    x = fr.cues(spark, folder).select("profile", "id", "text").distinct()
    return models.apply_model(x, "text", "answer", _Stand)


def session_fence(spark: SparkSession, folder: str) -> DataFrame:
    return sessions.run_to_end(sessions.fence(sessions.control_log(spark, folder)), "fence")


def session_creations(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions by client, each created once however often its request comes."""
    log = sessions.session_stream(spark, folder).where("client is not null and session_id is not null").select("client", "session_id", F.col("last_seen").cast("timestamp").alias("at"))
    return sessions.run_to_end(sessions.first_requests(log, ["client", "session_id"], "at", "3650 days").select("client", "session_id"), "created")


def window_retries(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks of one profile and start as attempts at a window: one of unknown language was uncertain, one without cues of a heard track failed."""
    x = load(spark, folder, "chunks").select("seq", key_of("profile").alias("profile"), "start_ms", "end_ms", "updated", F.when(F.col("payload.language.code") == "und", "LANGUAGE_UNCERTAIN").when(F.size("payload.cues") == 0, "ASR_FAILED").alias("code"))
    x = x.where("profile is not null and start_ms >= 0 and start_ms < end_ms").distinct()
    return sessions.retries(x, ["profile", "start_ms"], ["updated", "seq"], "code", "start_ms", "end_ms").select("seq", "profile", "start_ms", "end_ms", "code", "attempt", "action", "next_end")


QUERIES = {f.__name__: f for f in (session_creations, window_retries, sentence_groups, assembled_captions, cache_conflicts, held_back, window_frontier, window_seams, speech_segments, speech_detail, film_names, film_variants, srt_files, export_states, model_boundary, session_fence)}

_OC = "(PARTITION BY profile ORDER BY start_ms, end_ms, id)"
_WIDE = "[^\\x{1100}-\\x{115f}\\x{2e80}-\\x{303e}\\x{3041}-\\x{4dbf}\\x{4e00}-\\x{a4cf}\\x{a960}-\\x{a97f}\\x{ac00}-\\x{d7a3}\\x{f900}-\\x{faff}\\x{fe30}-\\x{fe6f}\\x{ff00}-\\x{ff60}\\x{ffe0}-\\x{ffe6}\\x{1f300}-\\x{1f64f}\\x{1f900}-\\x{1f9ff}\\x{20000}-\\x{3fffd}]"
_CASELESS = "^[\\x{3040}-\\x{30ff}\\x{3400}-\\x{4dbf}\\x{4e00}-\\x{9fff}\\x{f900}-\\x{faff}]"
_BLOCKED = f"""{fr.CUES}, c AS (SELECT DISTINCT profile, id, start_ms, end_ms, text FROM cu),
 bm AS (SELECT *, max(end_ms) OVER (PARTITION BY profile ORDER BY start_ms, end_ms, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) m, row_number() OVER {_OC} i FROM c),
 bl AS (SELECT *, CAST(sum(CASE WHEN m IS NULL OR start_ms - m > 7000 THEN 1 ELSE 0 END) OVER (PARTITION BY profile ORDER BY i) AS BIGINT) block FROM bm)"""
_WINDOWS = f"""wi AS (SELECT DISTINCT seq, {fr.sql_key('profile')} profile, start_ms from_ms, end_ms to_ms, list_sort(list_distinct([{{'start_ms': c.start_ms, 'end_ms': c.end_ms, 'id': c.id, 'text': c.text}} for c in payload.cues if c.start_ms < c.end_ms AND c.text IS NOT NULL AND c.id IS NOT NULL])) cues
 FROM chunks WHERE {fr.sql_key('profile')} <> '' AND start_ms >= 0 AND start_ms < end_ms), ww AS (SELECT * FROM wi WHERE len(cues) > 0)"""


def _finished(t: str) -> str:
    return f"(regexp_matches({fr.sql_bare(t)}, '[.!?。！？]$') AND NOT regexp_matches({fr.sql_bare(t)}, '(?i)(?:^|[^\\p{{L}}\\p{{N}}_])(?:mr|mrs|ms|dr|prof|sr|jr|st|vs|[a-z])\\.$'))"


def _width(t: str) -> str:
    return f"(length({t}) + length(regexp_replace({t}, '{_WIDE}', '', 'g')))"


_FRAMES = """fr0 AS (SELECT user_id, CAST(ts AS DATE) AS day, least(1.0, value / 100) p, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) - 1 n, count(*) OVER (PARTITION BY user_id, CAST(ts AS DATE)) * 512 total FROM events),
 fs AS (SELECT user_id, day, n, total, CASE WHEN p >= 0.5 THEN 0 END begun, CAST(NULL AS BIGINT) quiet, CAST(NULL AS BIGINT) a, CAST(NULL AS BIGINT) b FROM fr0 WHERE n = 0
 UNION ALL SELECT f.user_id, f.day, f.n, f.total, CASE WHEN f.p >= 0.5 THEN coalesce(s.begun, f.n * 512) WHEN shut THEN NULL ELSE s.begun END, CASE WHEN f.p >= 0.5 OR shut THEN NULL WHEN f.p < 0.35 AND s.begun IS NOT NULL THEN coalesce(s.quiet, f.n * 512) ELSE s.quiet END, CASE WHEN shut THEN s.begun END, CASE WHEN shut THEN s.quiet END
 FROM fs s JOIN fr0 f ON f.user_id = s.user_id AND f.day = s.day AND f.n = s.n + 1, LATERAL (SELECT coalesce(f.p < 0.35 AND s.begun IS NOT NULL AND f.n * 512 - s.quiet >= 1600, false) shut)),
 fd AS (SELECT user_id, day, a AS start, b AS "end" FROM fs WHERE b - a > 4000 UNION ALL SELECT user_id, day, begun, total FROM fs WHERE (n + 1) * 512 = total AND total - begun > 4000)"""

_STOP = ", ".join("'" + w.replace("'", "''") + "'" for w in nouns.STOP)
_OPENERS = nouns.OPENERS.replace("'", "''").replace("[", "\\\\[").replace("-", "\\\\-")
_WORD = "[\\p{L}\\p{Nl}\\p{No}](?:[\\p{L}\\p{Nl}\\p{No}]|[''’\\-])*"
_NAMED = f"""(w NOT IN ({_STOP}) AND (regexp_matches(w, '^\\p{{Lu}}\\p{{Ll}}[\\p{{L}}''’\\-]+$') OR regexp_matches(w, '^\\p{{Lu}}{{2,5}}$') AND NOT loud))"""
_LATIN_FILMS = f"""lc AS (SELECT DISTINCT {fr.sql_key('profile')} profile, seq, regexp_extract(lower(payload.language.code), '[a-z]+') code FROM chunks WHERE {fr.sql_key('profile')} <> ''),
 ls AS (SELECT profile, 2 * count(*) FILTER (WHERE code IN ({', '.join(f"'{x}'" for x in _LATIN)})) > count(*) said FROM lc WHERE code NOT IN ('', 'und', 'auto') GROUP BY 1),
 lt AS (SELECT profile, 2 * sum(length(regexp_replace(text, '[^\\p{{Latin}}]', '', 'g'))) > sum(length(regexp_replace(text, '[^\\p{{L}}]', '', 'g'))) shown FROM bl GROUP BY 1),
 lf AS (SELECT lt.profile FROM lt LEFT JOIN ls ON ls.profile = lt.profile WHERE shown OR coalesce(said, false))"""
# pieces of a text are words and what stands between them, in turn; a run is broken by anything but blanks, and is of three words at most
_RUNS = f"""tx AS (SELECT profile, block, id, start_ms, end_ms, regexp_extract_all(text, '{_WORD}|[^\\p{{L}}\\p{{Nl}}\\p{{No}}]+') ps, 2 * length(regexp_replace(text, '[^\\p{{Lu}}]', '', 'g')) > length(regexp_replace(text, '[^\\p{{L}}]', '', 'g')) loud FROM bl WHERE profile IN (SELECT profile FROM lf)),
 pc AS (SELECT *, unnest(range(1, len(ps) + 1)) i FROM tx), wd AS (SELECT *, regexp_replace(ps[i], '[''’]s?$', '') w, i > 1 AND NOT regexp_matches(ps[i - 1], '^{fr.LETTER}') AND regexp_full_match(ps[i - 1], '{fr._BL}+') near, row_number() OVER (PARTITION BY profile, id, start_ms, end_ms ORDER BY i) n FROM pc WHERE regexp_matches(ps[i], '^{fr.LETTER}')),
 nm AS (SELECT *, {_NAMED} AS name FROM wd), br AS (SELECT *, sum(CASE WHEN name AND near AND coalesce(lag_name, false) THEN 0 ELSE 1 END) OVER (PARTITION BY profile, id, start_ms, end_ms ORDER BY n ROWS UNBOUNDED PRECEDING) g FROM (SELECT *, lag(name) OVER (PARTITION BY profile, id, start_ms, end_ms ORDER BY n) lag_name FROM nm)),
 nr AS (SELECT *, (row_number() OVER (PARTITION BY profile, id, start_ms, end_ms, g ORDER BY n) - 1) // 3 h FROM br WHERE name),
 ru AS (SELECT profile, block, id, start_ms, end_ms, g, h, list(w ORDER BY n) ws, {fr.sql_strip("array_to_string(list_slice(any_value(ps), 1, min(i) - 1), '')")} b FROM nr GROUP BY ALL),
 rb AS (SELECT *, regexp_replace(b, '[{_OPENERS}]+$', '') bare FROM ru),
 ri AS (SELECT *, regexp_matches(b, '[{_OPENERS}]$') OR {fr.sql_strip('bare')} = '' OR regexp_matches({fr.sql_strip('bare')}, '…$') OR {_finished(fr.sql_strip('bare'))} first FROM rb),
 ins AS (SELECT DISTINCT profile, unnest(CASE WHEN first THEN ws[2:] ELSE ws END) w FROM ri),
 kept AS (SELECT ri.*, CASE WHEN first AND ins.w IS NULL THEN ws[2:] ELSE ws END k FROM ri LEFT JOIN ins ON ins.profile = ri.profile AND ins.w = ws[1])"""

_VARIANTS = f"""kn AS (SELECT p.profile, source known, min(seq) ord FROM (SELECT DISTINCT profile, media FROM cu WHERE media <> '') p JOIN glossary g ON {fr.sql_key('g.media')} = p.media WHERE source <> '' AND rendering IS NOT NULL GROUP BY 1, 2),
 ph AS (SELECT DISTINCT profile, k, array_to_string(k, ' ') phrase FROM kept WHERE len(k) > 0), cn AS (SELECT DISTINCT profile, unnest(list_append(k, phrase)) AS name FROM ph), {fr.sql_established('cn', 'kn', 'profile')},
 pw AS (SELECT ph.profile, phrase, len(k) c, x.w AS name, es.match FROM ph, LATERAL (SELECT unnest(k) w) x LEFT JOIN es ON es.profile = ph.profile AND es.name = x.w), hi AS (SELECT profile, phrase, max(match IS NOT NULL AND c > 1) hit FROM pw GROUP BY 1, 2),
 pa AS (SELECT pw.profile, name, match FROM pw JOIN hi ON hi.profile = pw.profile AND hi.phrase = pw.phrase WHERE hit), wh AS (SELECT hi.profile, phrase AS name, match FROM hi LEFT JOIN es ON es.profile = hi.profile AND es.name = phrase WHERE NOT hit),
 cw AS (SELECT profile, unnest(regexp_extract_all(text, '{_WORD}')) w FROM bl WHERE profile IN (SELECT profile FROM lf)), co AS (SELECT profile, lower(w) h FROM cw GROUP BY 1, 2 HAVING count(*) FILTER (WHERE regexp_matches(w, '^\\p{{Ll}}')) >= greatest(1, count(*) FILTER (WHERE NOT regexp_matches(w, '^\\p{{Ll}}')))),
 pe AS (SELECT * FROM pa WHERE match IS NULL UNION ALL SELECT * FROM wh WHERE match IS NULL OR match <> name)"""

ORACLES = {
    "film_variants": f"WITH {_BLOCKED}, {_LATIN_FILMS}, {_RUNS}, {_VARIANTS} SELECT profile, name, match FROM pa WHERE match <> name UNION SELECT profile, name, match FROM pe WHERE NOT EXISTS (SELECT 1 FROM co WHERE co.profile = pe.profile AND co.h = lower(split_part(name, ' ', 1)))",
    "film_names": f"WITH {_BLOCKED}, {_LATIN_FILMS}, {_RUNS} SELECT DISTINCT profile, block, array_to_string(k, ' ') AS name FROM kept WHERE len(k) > 0",
    "export_states": f"""WITH {fr.CHUNKS}, {fr.DURATIONS}, {fr.islands('isl', 'ch')}, g AS (SELECT profile, count(*) n, min(start_ms) a, max(end_ms) b, list_sort(list([start_ms, end_ms])) r FROM isl GROUP BY 1),
 x AS (SELECT du.profile, duration_ms d, coalesce(n = 1 AND a = 0 AND b = duration_ms, false) complete, coalesce(replace(CAST(r AS VARCHAR), ' ', ''), '[]') r FROM du LEFT JOIN g USING (profile))
 SELECT profile, complete, CASE WHEN complete THEN '.srt' ELSE '.partial.srt' END suffix, '{{"duration_ms":' || d || ',"coverage":' || r || '}}' sidecar FROM x""",
    # one step per cue of a block: s is where the unit that holds the n-th cue begins
    "sentence_groups": f"""WITH RECURSIVE {_BLOCKED}, k AS (SELECT *, row_number() OVER (PARTITION BY profile, block ORDER BY i) n, lag(text) OVER (PARTITION BY profile ORDER BY i) prev FROM bl),
 li AS (SELECT profile, block, list(start_ms ORDER BY n) a, list(end_ms ORDER BY n) b, list(text ORDER BY n) t, list({fr.sql_strip('text')} ORDER BY n) w, count(*) m FROM k GROUP BY ALL),
 r AS (SELECT profile, block, CAST(1 AS BIGINT) n, CAST(1 AS BIGINT) s FROM li
 UNION ALL SELECT profile, block, i, CASE WHEN NOT goes THEN i WHEN b[i] - a[s] <= 7000 AND {_width(fr.sql_joined('list_slice(w, s, i)'))} <= 84 THEN s WHEN tail AND s < i - 1 AND b[i] - a[i - 1] <= 7000 AND {_width(fr.sql_joined('list_slice(w, i - 1, i)'))} <= 84 THEN i - 1 ELSE i END
 FROM (SELECT *, NOT {_finished('t[i - 1]')} AND a[i] - b[i - 1] <= CASE WHEN tail THEN 7000 WHEN regexp_matches(t[i], '^\\p{{Ll}}') OR regexp_matches(t[i], '{_CASELESS}') THEN 3000 ELSE 1500 END goes
 FROM (SELECT r.profile, r.block, r.n + 1 i, s, a, b, t, w, regexp_matches(t[r.n + 1], '{_CASELESS}') AND {_finished('t[r.n + 1]')} AND length(regexp_replace(t[r.n + 1], '[^\\p{{L}}\\p{{N}}]', '', 'g')) <= 4 tail FROM r JOIN li USING (profile, block) WHERE r.n < m))),
 st AS (SELECT DISTINCT profile, block, s FROM r), u AS (SELECT *, row_number() OVER (PARTITION BY profile, block ORDER BY s) - 1 unit FROM st),
 x AS (SELECT k.*, u.unit, u.s FROM k ASOF JOIN u ON k.profile = u.profile AND k.block = u.block AND k.n >= u.s)
 SELECT profile, block, id, start_ms, end_ms, text, unit, substr(sha256('["", ' || string_agg('"' || id || '"', ', ') OVER (PARTITION BY profile, block, unit ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) || ']'), 1, 24) unit_id, n = s AND prev IS NOT NULL AND NOT {_finished('prev')} AS continues FROM x""",
    # one step per cue of a profile: the last kept cue goes along
    "cache_conflicts": f"""WITH RECURSIVE {_BLOCKED}, r AS (SELECT profile, i, start_ms a, end_ms b, text t, true keep, false bad FROM bl WHERE i = 1
 UNION ALL SELECT profile, i, CASE WHEN keep AND NOT bad THEN start_ms ELSE a END, CASE WHEN keep AND NOT bad THEN end_ms ELSE b END, CASE WHEN keep AND NOT bad THEN text ELSE t END, keep, bad
 FROM (SELECT bl.*, a, b, t, NOT (start_ms < b AND text = t AND abs(start_ms - a) < 300) keep, start_ms < b AND NOT (text = t AND abs(start_ms - a) < 300) bad FROM r JOIN bl ON bl.profile = r.profile AND bl.i = r.i + 1 WHERE NOT r.bad))
 SELECT bl.profile, id, start_ms, end_ms, text, bad conflict FROM r JOIN bl ON bl.profile = r.profile AND bl.i = r.i WHERE keep""",
    "held_back": f"""WITH {_WINDOWS}, f AS (SELECT *, coalesce(list_max([i for c, i in cues if {_finished('c.text')}]), 0) k FROM ww), h AS (SELECT *, cues[k + 1].start_ms e FROM f), g AS (SELECT *, coalesce(to_ms - e <= 5000 AND e - from_ms >= 2000, false) w FROM h)
 SELECT seq, from_ms, to_ms, CASE WHEN w THEN k ELSE len(cues) END ready, CASE WHEN w THEN len(cues) - k ELSE 0 END held, CASE WHEN w THEN e ELSE to_ms END next_ms FROM g""",
    "window_frontier": f"""WITH {_WINDOWS}, {fr.DURATIONS}, a AS (SELECT ww.*, CASE WHEN to_ms = duration_ms THEN to_ms ELSE to_ms - 1000 END t FROM ww LEFT JOIN du USING (profile)), b AS (SELECT *, coalesce(list_min([c.start_ms for c in cues if c.start_ms < t AND c.end_ms > t]), t) u FROM a)
 SELECT seq, from_ms, to_ms, CASE WHEN u > from_ms THEN u END committed_ms FROM b""",
    "window_seams": f"""WITH {_WINDOWS}, p AS (SELECT *, lag(cues[len(cues)].end_ms) OVER (PARTITION BY profile ORDER BY from_ms, to_ms, seq) e FROM ww), o AS (SELECT *, cues[1] f, coalesce(e - cues[1].start_ms, 0) v FROM p), g AS (SELECT *, coalesce(v <= 160 AND e < f.end_ms, false) ok FROM o)
 SELECT seq, from_ms, f.id first_id, CASE WHEN v <= 0 THEN 'kept' WHEN ok THEN 'clipped' ELSE 'error' END state, CASE WHEN v > 0 AND ok THEN e ELSE f.start_ms END start_ms FROM g""",
    "speech_segments": f"WITH RECURSIVE {_FRAMES} SELECT * FROM fd",
    "speech_detail": f"WITH RECURSIVE {_FRAMES}, t AS (SELECT user_id, day, round(max(p), 4) top FROM fr0 GROUP BY 1, 2), s AS (SELECT user_id, day, sum(\"end\" - start) v FROM fd GROUP BY 1, 2) SELECT t.user_id, t.day, top, CAST(round(coalesce(v, 0) * 1000 / 16000) AS BIGINT) speech_ms FROM t LEFT JOIN s ON s.user_id = t.user_id AND s.day = t.day",
    "srt_files": f"""WITH {fr.CUES}, c AS (SELECT DISTINCT profile, id, start_ms, end_ms, text FROM cu), x AS (SELECT *, row_number() OVER {_OC} n, lag(end_ms) OVER {_OC} e FROM c)
 SELECT profile, n, CASE WHEN e IS NULL OR start_ms >= e THEN n || chr(10) || {fr.sql_stamp('start_ms')} || ' --> ' || {fr.sql_stamp('end_ms')} || chr(10) || {fr.sql_clean('text')} || chr(10) END block, CASE WHEN start_ms < e THEN 'OVERLAP' END error FROM x""",
    "model_boundary": f"WITH {fr.CUES} SELECT DISTINCT profile, id, text, CASE WHEN NOT contains(text, '?!') THEN CAST(length(text) AS VARCHAR) END answer FROM cu",
    "session_creations": "SELECT DISTINCT client, session_id FROM sessions WHERE client IS NOT NULL AND session_id IS NOT NULL AND last_seen IS NOT NULL",
    "window_retries": f"""WITH x AS (SELECT DISTINCT seq, {fr.sql_key('profile')} profile, start_ms, end_ms, updated, CASE WHEN payload.language.code = 'und' THEN 'LANGUAGE_UNCERTAIN' WHEN len(payload.cues) = 0 THEN 'ASR_FAILED' END code FROM chunks WHERE {fr.sql_key('profile')} <> '' AND start_ms >= 0 AND start_ms < end_ms),
 n AS (SELECT *, row_number() OVER (PARTITION BY profile, start_ms ORDER BY updated NULLS FIRST, seq) - 1 attempt FROM x), a AS (SELECT *, CASE WHEN code IS NULL THEN 'done' WHEN code = 'LANGUAGE_UNCERTAIN' THEN CASE WHEN attempt = 0 THEN 'longer' ELSE 'skip' END WHEN attempt = 0 AND end_ms - start_ms >= 8000 THEN 'half' ELSE 'hole' END act FROM n),
 l AS (SELECT *, CASE WHEN EXISTS (SELECT 1 FROM a b WHERE b.profile = a.profile AND b.start_ms = a.start_ms AND b.attempt < a.attempt AND b.act NOT IN ('longer', 'half')) THEN 'late' ELSE act END AS action FROM a)
 SELECT seq, profile, start_ms, end_ms, code, attempt, action, CASE action WHEN 'longer' THEN start_ms + least(24000, greatest(20000, 2 * (end_ms - start_ms))) WHEN 'half' THEN start_ms + (end_ms - start_ms) // 2 END next_end FROM l""",
    # one step per log row of a session
    "session_fence": """WITH RECURSIVE lg AS (SELECT session_id, epoch, seq, coalesce(position_ms, 0) pos, revision ack, epoch_us(last_seen) // 1000 now, row_number() OVER (PARTITION BY session_id ORDER BY epoch_us(last_seen) // 1000, epoch, seq, coalesce(position_ms, 0), revision NULLS FIRST) i FROM sessions WHERE session_id IS NOT NULL AND epoch IS NOT NULL AND seq IS NOT NULL AND last_seen IS NOT NULL),
 r AS (SELECT session_id, i, epoch e, seq s, now t, CAST(1 AS BIGINT) v, pos p, 'OPENED' verdict, epoch, seq, now FROM lg WHERE i = 1
 UNION ALL SELECT session_id, i, CASE WHEN stale THEN e ELSE epoch END, CASE WHEN stale THEN s ELSE seq END, CASE WHEN stale THEN t ELSE now END, CASE WHEN verdict IN ('EXPIRED', 'SEEK') THEN 1 WHEN verdict = 'ACCEPTED' AND pos <> p THEN v + 1 ELSE v END, CASE WHEN stale OR verdict = 'STALE_ACK' THEN p ELSE pos END, verdict, epoch, seq, now
 FROM (SELECT *, verdict IN ('STALE_EPOCH', 'STALE_SEQUENCE') stale FROM (SELECT lg.*, r.e, r.s, r.t, r.v, r.p, CASE WHEN lg.now - t > 45000 THEN 'EXPIRED' WHEN lg.epoch < e THEN 'STALE_EPOCH' WHEN lg.epoch > e THEN 'SEEK' WHEN lg.seq <= s THEN 'STALE_SEQUENCE' WHEN ack IS NOT NULL AND NOT (v - 8 < ack AND ack <= v) THEN 'STALE_ACK' ELSE 'ACCEPTED' END verdict FROM r JOIN lg ON lg.session_id = r.session_id AND lg.i = r.i + 1)))
 SELECT session_id, epoch, seq, now now_ms, verdict, v revision FROM r""",
}
