"""Named queries of the training-data operators on text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import language, lines, mixing, names, packing, sentences, spans, tokens
from spanloom.plans import frames as fr
from spanloom.sources.tables import key_of, load


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return sentences.sentence_ends(load(spark, folder, "cues"), key_of("profile")).select(F.col("owner").alias("profile"), "cue_id", "end_pos")


def p1_sentences(spark: SparkSession, folder: str) -> DataFrame:
    """Every sentence of every profile with the cues and times it covers."""
    return sentences.sentences(load(spark, folder, "cues"), key_of("profile")).withColumnRenamed("owner", "profile")


def p3_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Every run of one line: its first and last cue, count and duration."""
    return lines.runs(load(spark, folder, "cues"), key_of("profile")).withColumnRenamed("owner", "profile")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return p3_runs(spark, folder).select("profile", "first_id", "last_id")


def _network(spark: SparkSession, folder: str) -> language.Network:
    """Fitted on documents by their label, and on cues by the label of their profile's chunks."""
    lines = load(spark, folder, "cues").select(key_of("profile").alias("owner"), "id", "text")
    labels = load(spark, folder, "chunks").select(key_of("profile").alias("owner"), F.col("payload.language.code").alias("lang"))
    return language.fitted(load(spark, folder, "documents"), lines, labels)


def _languages(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents, foreign cues and sessions with their languages: (doc_id, label, ...), (id, ...), (session_id, label, ...)."""
    docs = load(spark, folder, "documents")
    net = _network(spark, folder)
    cues = language.classified_cues(load(spark, folder, "cues"), key_of("profile"), net)
    owners = language.of_owners(cues)
    texts = language.languages(docs.withColumnRenamed("lang", "label"), net, ["doc_id", "label"])
    sessions = load(spark, folder, "sessions").select("session_id", key_of("profile").alias("owner"), F.col("language.code").alias("label")).join(owners, "owner")
    return texts, language.foreign(cues, owners), sessions.select("session_id", "label", F.col("main").alias("lang"), F.col("share").alias("confidence"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    texts, cues, sessions = _languages(spark, folder)
    rows = [
        sessions.where(language.mislabelled(sessions, F.col("label"))).select(F.lit("sessions").alias("tbl"), F.col("session_id").alias("row_key"), "lang"),
        texts.where(language.mislabelled(texts, F.col("label"))).select(F.lit("documents").alias("tbl"), F.col("doc_id").cast("string").alias("row_key"), "lang"),
        cues.select(F.lit("cues").alias("tbl"), F.col("id").alias("row_key"), "lang"),
    ]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).where("row_key is not null").distinct()


def p4_languages(spark: SparkSession, folder: str) -> DataFrame:
    """The language of each session, document and foreign cue, with a confidence."""
    texts, cues, sessions = _languages(spark, folder)
    x = sessions.select(F.lit("sessions").alias("tbl"), F.col("session_id").alias("row_key"), "lang", F.col("confidence").cast("double").alias("confidence"))
    x = x.unionByName(texts.select(F.lit("documents").alias("tbl"), F.col("doc_id").cast("string").alias("row_key"), "lang", F.col("confidence").cast("double").alias("confidence")))
    x = x.unionByName(cues.select(F.lit("cues").alias("tbl"), F.col("id").alias("row_key"), "lang", F.col("confidence").cast("double").alias("confidence")))
    return x.groupBy("tbl", "row_key").agg(F.max_by("lang", F.struct("confidence", "lang")).alias("lang"), F.max("confidence").alias("confidence"))


def p4_stretches(spark: SparkSession, folder: str) -> DataFrame:
    """Stretches of cues in another language than their profile's, with a confidence."""
    return language.stretches(_languages(spark, folder)[1], load(spark, folder, "cues"), key_of("profile")).withColumnRenamed("owner", "profile")


def p4_segments(spark: SparkSession, folder: str) -> DataFrame:
    """The stretches of every document in one language, with a confidence."""
    docs = load(spark, folder, "documents").select("doc_id", "text").distinct()
    return language.segments(docs, _network(spark, folder), "doc_id")


def p5_names(spark: SparkSession, folder: str) -> DataFrame:
    """Every glossary row with the number of the one it names."""
    glossary, contexts, nick = (load(spark, folder, t) for t in ("glossary", "contexts", "nicknames"))
    return names.same_names(glossary, key_of("media"), contexts, key_of("media"), nick)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return names.pairs_of(p5_names(spark, folder))


def p7_boxes(spark: SparkSession, folder: str) -> DataFrame:
    """A container of every box for every document, sizes in tokens."""
    return packing.pack(tokens.sized(load(spark, folder, "documents")), load(spark, folder, "capacities"))


def p7_fill(spark: SparkSession, folder: str) -> DataFrame:
    return packing.fill(p7_boxes(spark, folder))


def p8_mix(spark: SparkSession, folder: str) -> DataFrame:
    """The chosen documents of each plan with their repeats."""
    return mixing.mix(tokens.sized(load(spark, folder, "documents")), load(spark, folder, "mix_plan"))[0]


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.shares(*mixing.mix(tokens.sized(load(spark, folder, "documents")), load(spark, folder, "mix_plan")))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return spans.pairs(load(spark, folder, "documents"))


def p9_shared(spark: SparkSession, folder: str) -> DataFrame:
    """Of every document with a shared span: how much of it stands elsewhere too."""
    docs = load(spark, folder, "documents")
    sizes = docs.groupBy("doc_id").agg(F.max(F.length("text")).alias("chars"))
    return spans.shares(docs).join(sizes, "doc_id").withColumn("share", F.col("shared_chars") / F.col("chars"))


def p9_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Every repeat that several documents hold, with all its places: what pairs would say, in rows that grow with the places."""
    return spans.repeats(load(spark, folder, "documents")).withColumnRenamed("repeat", "group")


QUERIES = {"p1_found": p1_found, "p1_sentences": p1_sentences, "p3_found": p3_found, "p3_runs": p3_runs, "p4_found": p4_found, "p4_languages": p4_languages, "p4_stretches": p4_stretches, "p4_segments": p4_segments, "p5_found": p5_found, "p5_names": p5_names, "p7_boxes": p7_boxes, "p7_fill": p7_fill, "p8_mix": p8_mix, "p8_shares": p8_shares, "p9_found": p9_found, "p9_shared": p9_shared, "p9_groups": p9_groups}

#: Full-width signs and their usual ones, and Cyrillic letters as one byte each, for DuckDB counts edits in bytes.
_WIDE, _USUAL = "".join(map(chr, range(0xFF01, 0xFF5F))), "".join(map(chr, range(0x21, 0x7F))).replace("'", "''")
_CYRILLIC, _BYTES = "".join(map(chr, range(0x430, 0x450))), "ABCDEFGHIJKLMNOPQRSTUVWXYZ[]^{|}"
_LINES = f"""cu0 AS (SELECT {fr.sql_key('profile')} profile, id, start_ms, end_ms, regexp_extract_all(regexp_replace(replace(lower(strip_accents(translate(text, '{_WIDE}', '{_USUAL}'))), 'ß', 'ss'), '[''’‘ʼ`´]', '', 'g'), '[\\p{{L}}\\p{{N}}]+') w FROM cues WHERE {fr.sql_key('profile')} <> '' AND id IS NOT NULL AND start_ms IS NOT NULL AND text IS NOT NULL),
 cu1 AS (SELECT DISTINCT profile, id, start_ms, end_ms, w FROM cu0 WHERE len(w) > 0), cu AS (SELECT *, row_number() OVER o i, lag(w) OVER o v FROM cu1 WINDOW o AS (PARTITION BY profile ORDER BY start_ms, end_ms NULLS FIRST, id)),
 od AS (SELECT *, CASE WHEN len(v) = len(w) THEN [{{'a': w[j], 'b': v[j]}} for j in range(1, len(w) + 1) if w[j] <> v[j]] END d FROM cu),
 sm AS (SELECT *, v IS NOT NULL AND (array_to_string(w, '') = array_to_string(v, '') OR coalesce(len(d) = 1 AND greatest(length(d[1].a), length(d[1].b)) >= 5 AND regexp_full_match(d[1].a, '[A-Za-zÀ-ɏḀ-ỿ]+|[Ѐ-ԯ]+') AND regexp_full_match(d[1].b, '[A-Za-zÀ-ɏḀ-ỿ]+|[Ѐ-ԯ]+') AND damerau_levenshtein(translate(d[1].a, '{_CYRILLIC}', '{_BYTES}'), translate(d[1].b, '{_CYRILLIC}', '{_BYTES}')) = 1, false)) s FROM od),
 rn AS (SELECT *, sum(CASE WHEN s THEN 0 ELSE 1 END) OVER (PARTITION BY profile ORDER BY i ROWS UNBOUNDED PRECEDING) r FROM sm),
 ru AS (SELECT profile, arg_min(id, i) first_id, arg_max(id, i) last_id, count(*) n, min(start_ms) start_ms, max(greatest(start_ms, coalesce(end_ms, start_ms))) end_ms FROM rn GROUP BY profile, r HAVING count(*) > 1)"""
# windows of 200 code points, cut from pieces of 1,199 so that no long text is counted through for each of them
_SPANS = """dt AS (SELECT doc_id, min(text) AS text FROM documents WHERE doc_id IS NOT NULL AND length(text) >= 200 GROUP BY 1), pc AS (SELECT doc_id, unnest(range(0, length(text) - 199, 1000)) o, text, length(text) - 199 n FROM dt), pi AS (SELECT doc_id, o, n, substr(text, o + 1, 1199) s FROM pc),
 wi AS (SELECT doc_id, o + i p, md5(substr(s, i + 1, 200)) h FROM (SELECT *, unnest(range(0, least(1000, n - o))) i FROM pi)), dh AS (SELECT DISTINCT h, doc_id FROM wi), sh AS (SELECT h FROM dh GROUP BY 1 HAVING count(*) > 1)"""

ORACLES: dict[str, str] = {
    "p3_runs": f"WITH {_LINES} SELECT *, end_ms - start_ms duration_ms FROM ru",
    "p3_found": f"WITH {_LINES} SELECT profile, first_id, last_id FROM ru",
    "p9_found": f"WITH {_SPANS}, k AS (SELECT dh.* FROM dh JOIN sh USING (h)) SELECT DISTINCT a.doc_id doc_a, b.doc_id doc_b FROM k a JOIN k b ON a.h = b.h AND a.doc_id < b.doc_id",
    "p9_shared": f"""WITH {_SPANS}, q AS (SELECT DISTINCT doc_id, p FROM wi JOIN sh USING (h)), g AS (SELECT *, CASE WHEN p - lag(p) OVER o <= 200 THEN 0 ELSE 1 END x, CASE WHEN lag(p) OVER o IS NULL THEN 200 ELSE least(200, p - lag(p) OVER o) END more FROM q WINDOW o AS (PARTITION BY doc_id ORDER BY p))
 SELECT doc_id, sum(x)::BIGINT spans, sum(more)::BIGINT shared_chars, any_value(c) chars, sum(more) / any_value(c) AS share FROM g JOIN (SELECT doc_id, max(length(text)) c FROM documents GROUP BY 1) USING (doc_id) GROUP BY 1""",
}
