"""Sentence ends in running text that is cut into timed cues, for many languages and scripts, in SQL expressions.

The cues of a profile between two pauses are one text, with a separator between cues. Marks that end no sentence - in
decimals, times, versions, file names and addresses, initials, abbreviations, ordinals, names with a mark, broken-off
and quoted parts after which the sentence goes on - are replaced by private-use placeholders of the same length; the
marks that remain end sentences, together with closing quotes and brackets. Placeholders are as long as what they
stand for, so positions in the raw text are kept, and :func:`restored` gives the text back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A pause of so many milliseconds after a cue ends the sentence.
PAUSE_MS = 2000
#: Length of a chunk of a time line, in which cues are put in order by one task.
CHUNK_MS = 600_000

# private-use characters: between cues; masked . ! ? and others inside words; masked at the end of a quoted part; end
_SEP, _DOT, _BANG, _ASK, _MORE, _END = "", "", "", "", "", ""
_PRIVATE = "".join(map(chr, range(0xE000, 0xE010)))
_MASKS = _DOT + _BANG + _ASK + _MORE
_WS = "[\\s\\u00a0\\u2007\\u202f\\u3000]"
_T = ".!?…。！？｡．‼⁉⁈"
_OPEN = "“„«‹「『\"＂｢"
_CLOSE = "”»›」』’'\\)\\]）］】〉》｣"
_CJK = "\\p{IsHan}\\p{IsHiragana}\\p{IsKatakana}\\p{IsHangul}"
# a straight or low-high quote closes only where no word begins after it
_CLOSERS = f"(?:[\\u00a0\\u202f ]?»|[{_CLOSE}]|[\"“＂](?={_WS}|$|[,;:.!?…。，、\\)\\]）］{_MASKS}{_CLOSE}]))"

# Abbreviations, in lower case without the final full stop.
#: never the last word of a sentence
BEFORE_NAME = (
    "mr mrs ms dr drs prof sgt st mt ft capt lt cpt col gen maj rev hon pres gov sen rep messrs vs approx "  # en
    "hr fr hrn dipl ing ca bzw evtl ggf inkl zzgl "  # de
    "mm mme mmes mlle mgr env "  # fr
    "sr sra srta sres ud uds vd vds dña aprox "  # es
    "sig sigra sig.ra sigg dott dott.ssa avv arch geom on egr "  # it
    "dra exmo exma profa eng "  # pt
    "проф ок ул им тов акад гр напр"  # ru
).split()
#: an abbreviation if a number follows
BEFORE_NUMBER = "no nos nr vol vols fig figs p pp pg pag pág págs ch cap chap sec art núm num n nº bd jg kap abb stk zz стр рис гл №".split()
#: the last word of a sentence if no small letter, number or comma follows; those of a list only inside a cue
MAY_END = "inc ltd co corp bros jr sr esq seq".split()
LIST_END = "etc usw ecc u.a u.s.w".split()
MONTHS_DE = "Januar Jänner Februar März April Mai Juni Juli August September Oktober November Dezember".split()
BEFORE_ORDINAL_DE = "am zum vom dem den der des die das im beim ab bis".split()
#: after a closing quote the sentence goes on with these (Japanese and Korean quotative particles)
QUOTATIVES = "と って という 라고 라며 라는 하고 하며 이라고 고".split()


def _words(words: list[str] | tuple[str, ...]) -> str:
    return "|".join(w.replace(".", f"[.{_DOT}]") for w in sorted(words, key=len, reverse=True))


#: Code points that a rule looks back or ahead inside a quoted part, and inside an address or a name.
QUOTED, ADDRESS, NAME = 2000, 2000, 100
_ALONE = "(?<![\\p{L}\\p{N}])"
_ON = f"{_WS}*[\\p{{Ll}}\\p{{N}}{_CJK}]"

#: What makes a full stop no end, tried at each full stop
DOTS = [
    # decimals, times, versions, grouped numbers
    "(?=\\p{N})(?<=\\p{N}.)",
    # file names and dotted abbreviations: a letter or digit straight before, a small letter after
    "(?=\\p{Ll}|[ºª°])(?<=[\\p{L}\\p{N}&&[^\\p{IsHan}\\p{IsHiragana}\\p{IsKatakana}\\p{IsHangul}]]\\.)",
    # a single letter: an initial or part of an abbreviation; 'a.m.' and the like end a sentence before a capital
    f"(?={_WS}+[\\p{{Ll}}\\p{{N}},;])(?<=[.{_DOT}]{_WS}?[dmдп]\\.)",
    f"(?={_WS}*[\\p{{L}}\\p{{N}}-])(?<={_ALONE}\\p{{Lu}}\\.)(?<!т[.{_DOT}]{_WS}{{0,2}}.\\.|[ap][.{_DOT}].\\.)",
    f"(?={_WS}*(?:\\p{{Ll}}|\\p{{Lu}}[.{_DOT}]))(?<={_ALONE}\\p{{Ll}}\\.)(?<![ap][.{_DOT}].\\.)",
    f"(?={_WS}*B)(?<={_ALONE}[zZ]\\.)",
    f"(?={_WS}*[\\p{{L}}\\p{{N}}])(?<={_ALONE}[pP][.{_DOT}]{_WS}{{0,2}}(?i:ex|ej|es)\\.)",
    # abbreviations
    f"(?={_WS}*[\\p{{L}}\\p{{N}}“«„\"])(?<={_ALONE}(?iu:{_words(BEFORE_NAME)})\\.)",
    f"(?={_WS}*\\p{{N}})(?<={_ALONE}(?iu:{_words(BEFORE_NUMBER)})\\.)",
    f"(?={_WS}*(?:[\\p{{Ll}}\\p{{N}},;:]|\\p{{Lu}}{{2}}))(?<={_ALONE}(?iu:{_words(MAY_END)})\\.)",
    f"(?=[\\s\\u00a0]*[\\p{{Ll}}\\p{{N}},;:])(?<={_ALONE}(?iu:{_words(LIST_END)})\\.)",
    # German ordinals
    f"(?={_WS}+\\p{{L}})(?<=\\p{{N}}\\.)(?<={_ALONE}(?:{'|'.join(BEFORE_ORDINAL_DE)}){_WS}\\p{{N}}{{1,4}}\\.)",
    f"(?={_WS}+(?:{'|'.join(MONTHS_DE)})\\b)(?<=\\p{{N}}\\.)",
]

#: (what a text must hold for the rule to be tried, pattern, what it becomes), in order. Each replacement is as long as
#: its match, and each pattern begins with the mark itself, so that a scan stops only at marks.
MASKS: list[tuple[str, str, str]] = [
    (".", f"[.．](?:{'|'.join(DOTS)})", _DOT),
    # addresses
    ("://", f"[.?!](?=[^\\s{_SEP}])(?<=://[^\\s{_SEP}]{{1,{ADDRESS}}}.)", _DOT),
    # broken off: a word begun again, or going on with a small letter, a number or a script without capitals
    ("..", f"\\.(?:(?<=\\.\\.)(?={_ON})|(?<!\\.\\.)(?=\\.+{_ON}))", _MORE),
    ("…", f"…(?=…*{_ON})", _MORE),
    ("...", f"(?iu)\\b(\\p{{L}}++)\\.\\.\\.(?={_WS}+\\1\\b)", f"$1{_MORE * 3}"),
    ("…", f"(?iu)\\b(\\p{{L}}++)…(?={_WS}+\\1\\b)", f"$1{_MORE}"),
    ("..", f"[.](?=\\.*{_WS}+\\p{{Lu}}{{2}})(?<=\\p{{Lu}}{{2}}\\.{{1,3}})(?=\\.|(?<=\\.\\.))", _MORE),
    # a name with a mark of its own, inside a sentence
    ("!", f"!(?={_WS}+\\p{{Ll}})(?<=[\\p{{L}}\\p{{N}}]{_WS}\\p{{Lu}}[\\p{{L}}\\p{{N}}]{{0,{NAME}}}!)", _BANG),
    # after the closing quote, or after a dash, the sentence goes on
    ("", f"[{_T}](?=[{_T}]*{_CLOSERS}+{_WS}*(?:[,;，、]|[–—]{_WS}*\\p{{Ll}}))", _ASK),
    ("", f"[{_T}](?=[{_T}]*{_CLOSERS}+{_WS}*\\p{{Ll}})(?<![:：]{_WS}{{0,3}}[{_OPEN}][^{_OPEN}{_CLOSE}]{{0,{QUOTED}}})", _ASK),
    ("", f"[{_T}](?=[{_T}]*{_WS}*[–—]{_WS}*\\p{{Ll}})", _BANG),
    ("", f"[{_T}](?=[{_T}]*[」』”\"’｣]+{_WS}?(?:{'|'.join(QUOTATIVES)}))", _ASK),
    # a quoted part at the start of a sentence, with the speaker after it
    ("", f"([{_OPEN}](?<=(?:^|[{_T}{_CLOSE}\"][\\s\\u00a0{_SEP}]{{0,3}}|[-–—－]\\s{{0,2}})[{_OPEN}])[^{_OPEN}{_CLOSE}]{{1,{QUOTED}}}?)[{_T}](?=[”»」』\"“｣]{_WS}*(?:\\p{{Lu}}[\\p{{L}}’'-]*(?:{_WS}+\\p{{Lu}}[\\p{{L}}’'-]*)?{_WS}+\\p{{Ll}}|[{_CJK}]))", f"$1{_ASK}"),
    # marks before that one in such a part
    (_ASK, f"[{_T}](?=[^{_OPEN}{_CLOSE}{_ASK}]{{0,{QUOTED}}}{_ASK}[{_T}{_ASK}]*(?:{_CLOSERS}|[{_CLOSE}\"]))(?<=[{_OPEN}][^{_OPEN}{_CLOSE}]{{0,{QUOTED}}})", _ASK),
]

_MARK = f"[{_T}]++(?![{_MASKS}])(?:{_CLOSERS})*+(?:{_SEP}[{_CLOSE}]++(?=[{_SEP}\\s]|$))?"
_BRACKETED = "^[\\s\\u00a0\\u3000]*(?:[\\(（﹙][^\\(\\)（）﹙﹚]*[\\)）﹚]|[\\[［][^\\[\\]［］]*[\\]］])[\\s\\u00a0\\u3000]*$"
_WORD = "[\\p{L}\\p{N}]"


def _where_held(needs: str, pattern: str, to: str):  # noqa: ANN202
    return lambda t: F.when(F.contains(t, F.lit(needs)), F.regexp_replace(t, pattern, to)).otherwise(t)


def masked(text: Column) -> Column:
    """The text, as long as before, without the marks that end no sentence."""
    for needs, pattern, to in MASKS:
        if needs in ("", ".", "!"):
            text = F.regexp_replace(text, pattern, to)
        else:  # the lambda holds the text so far, which would otherwise stand in the expression twice
            text = F.transform(F.array(text), _where_held(needs, pattern, to))[0]
    return text


def marked(text: Column) -> Column:
    """The masked text with a sign after each sentence's last character."""
    return F.regexp_replace(masked(text), f"({_MARK})", f"$1{_END}")


def restored(masked_text: Column, raw: Column, at: int | Column = 1) -> Column:
    """The raw text's characters in place of the placeholders, from the place ``at`` on: both are as long."""
    return F.substring(raw, F.lit(at) if isinstance(at, int) else at, F.length(masked_text))


def _marked_cues(df: DataFrame, owner: Column, pause_ms: int, chunk_ms: int) -> DataFrame:
    """(owner, block, n, k, cue, last, bits): every cue's text cut behind the signs, in blocks between pauses and brackets."""
    x = df.select(owner.alias("owner"), "id", F.col("start_ms").cast("long").alias("start_ms"), F.col("end_ms").cast("long").alias("end_ms"), "text")
    x = x.where(F.col("owner").isNotNull() & F.col("id").isNotNull() & F.col("start_ms").isNotNull() & F.col("text").rlike(_WORD))
    x = x.withColumn("chunk", F.floor(F.col("start_ms") / chunk_ms)).withColumn("alone", F.col("text").rlike(_BRACKETED))
    # order and pauses inside a chunk of the time line
    w = Window.partitionBy("owner", "chunk").orderBy("start_ms", "end_ms", "id")
    twin = (F.lag("id").over(w) == F.col("id")) & (F.lag("start_ms").over(w) == F.col("start_ms"))
    x = x.withColumn("twin", F.coalesce(twin, F.lit(False))).where("not twin")
    cut = F.col("alone") | F.lag("alone").over(w) | (F.col("start_ms") - F.lag("end_ms").over(w) >= pause_ms)
    x = x.withColumn("nth", F.row_number().over(w)).withColumn("cut", F.when(F.col("nth") == 1, 0).otherwise(F.coalesce(cut.cast("int"), F.lit(0)))).withColumn("block", F.sum("cut").over(w))
    x = x.withColumn("cue", F.struct("start_ms", F.coalesce("end_ms", F.lit(-(1 << 62))).alias("end_ms"), "id", "text", "alone"))
    # the first block of a chunk may go on from the chunk before: chunks are few, so one window per owner settles it
    ends = x.groupBy("owner", "chunk").agg(F.min_by(F.struct("start_ms", "alone"), "nth").alias("a"), F.max_by(F.struct("end_ms", "alone"), "nth").alias("z"), F.max("block").alias("blocks"))
    v = Window.partitionBy("owner").orderBy("chunk")
    fresh = F.coalesce(F.col("a.alone") | F.lag("z.alone").over(v) | (F.col("a.start_ms") - F.lag("z.end_ms").over(v) >= pause_ms), F.lag("chunk").over(v).isNull())
    ends = ends.withColumn("fresh", fresh).withColumn("closed", F.lead("fresh").over(v))
    # where the chunk's last block began: here, unless the whole chunk is one block that goes on from before
    ends = ends.withColumn("tail", F.when(F.col("fresh") | (F.col("blocks") > 0), F.struct("chunk", "blocks")))
    ends = ends.withColumn("root", F.when(F.col("fresh"), F.struct("chunk", F.lit(0).cast("long").alias("blocks"))).otherwise(F.last("tail", True).over(v.rowsBetween(Window.unboundedPreceding, -1))))
    # cues are already together by chunk; only blocks that cross a chunk's border are moved again
    parts = x.groupBy("owner", "chunk", "block").agg(F.collect_list("cue").alias("cues")).join(ends.select("owner", "chunk", "fresh", "closed", "blocks", "root"), ["owner", "chunk"])
    crosses = ((F.col("block") == 0) & ~F.col("fresh")) | ((F.col("block") == F.col("blocks")) & ~F.coalesce("closed", F.lit(True)))
    key = F.when(F.col("block") == 0, F.col("root")).otherwise(F.struct("chunk", F.col("block").alias("blocks")))
    crossing = parts.where(crosses).withColumn("key", key).groupBy("owner", "key").agg(F.flatten(F.collect_list("cues")).alias("cues"))
    texts = parts.where(~crosses).select("owner", "cues").unionByName(crossing.select("owner", "cues")).withColumn("cues", F.array_sort("cues"))
    # placeholders in the text itself would be taken for ours; the raw text stays in the cue
    whole = F.array_join(F.transform("cues.text", lambda t: F.translate(t, _PRIVATE, "�" * len(_PRIVATE))), _SEP)
    texts = texts.withColumn("parts", F.split(F.when(F.col("cues")[0]["alone"], whole).otherwise(marked(whole)), _SEP))
    texts = texts.withColumn("block", F.struct(F.col("cues")[0]["start_ms"].alias("at"), F.col("cues")[0]["id"].alias("id")))
    each = texts.select("owner", "block", F.size("cues").alias("n"), F.posexplode(F.arrays_zip("cues", "parts")).alias("k", "x"))
    return each.select("owner", "block", "k", F.col("x.cues").alias("cue"), (F.col("k") + 1 == F.col("n")).alias("last"), F.split("x.parts", _END).alias("bits"))


def _places(bits: str) -> Column:
    """Where each bit of a cue's text ends."""
    return F.aggregate(bits, F.array().cast("array<int>"), lambda a, b: F.array_append(a, F.coalesce(F.get(a, F.size(a) - 1), F.lit(0)) + F.length(b)))


def sentence_ends(df: DataFrame, owner: Column, pause_ms: int = PAUSE_MS, chunk_ms: int = CHUNK_MS) -> DataFrame:
    """One row per sentence end: (owner, cue_id, end_pos, start_ms, end_ms), of cues (id, start_ms, end_ms, text).

    ``end_pos`` counts the code points of the cue's raw text up to the sentence's last character. Cues are read in the
    order start_ms, end_ms, id. A sentence also ends before a pause of ``pause_ms`` (an unknown end_ms makes no
    pause), before and after a cue wholly in brackets, and where no cue follows.

    Rows with a null owner, id, start or text, or without a letter or digit, are left out first; rows delivered twice
    (same owner, id, start) count once. Further columns are ignored; an empty input gives an empty result. A text of
    any length is read whole.
    """
    each = _marked_cues(df, owner, pause_ms, chunk_ms)
    # the text after the last sign ends a sentence where the block ends
    tail = F.when(F.col("last") & F.element_at("bits", -1).rlike(_WORD), F.array(F.length(F.regexp_replace(F.array_join("bits", ""), "[\\s\\u00a0\\u3000]+$", "")))).otherwise(F.array().cast("array<int>"))
    inner = F.slice(_places("bits"), F.lit(1), F.size("bits") - 1)
    real_end = F.when(F.col("cue.end_ms") > -(1 << 62), F.col("cue.end_ms"))
    return each.select("owner", F.col("cue.id").alias("cue_id"), F.explode(F.concat(inner, tail)).alias("end_pos"), F.col("cue.start_ms").alias("start_ms"), real_end.alias("end_ms"))


def sentences(df: DataFrame, owner: Column, pause_ms: int = PAUSE_MS, chunk_ms: int = CHUNK_MS) -> DataFrame:
    """Whole sentences: (owner, first_id, last_id, cues, start_ms, end_ms, text), cut as by :func:`sentence_ends`.

    A sentence over several cues is joined by blanks, by nothing between two letters of a script without them. Times
    are those of its first and last cue. Cases as in :func:`sentence_ends`.
    """
    each = _marked_cues(df, owner, pause_ms, chunk_ms)
    # placeholders are as long as what they stand for, so each bit is given back from its place in the raw text
    each = each.withColumn("ends", _places("bits")).withColumn("bits", F.transform("bits", lambda b, i: restored(b, F.col("cue.text"), F.coalesce(F.get("ends", i - 1), F.lit(0)) + 1)))
    w = Window.partitionBy("owner", "block").orderBy("k")
    before = F.coalesce(F.sum(F.size("bits") - 1).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    x = each.withColumn("before", before).select("owner", "block", "k", "cue", "before", F.posexplode("bits").alias("j", "bit")).where(F.col("bit").rlike("\\S"))
    x = x.groupBy("owner", "block", (F.col("before") + F.col("j")).alias("nth")).agg(F.array_sort(F.collect_list(F.struct("k", "bit", "cue"))).alias("parts"))
    text = F.regexp_replace(F.array_join(F.transform("parts.bit", lambda b: F.regexp_replace(b, "^[\\s\\u00a0\\u3000]+|[\\s\\u00a0\\u3000]+$", "")), " "), "(?<=[\\p{IsHan}\\p{IsHiragana}\\p{IsKatakana}。、！？「」，：；]) (?=[\\p{IsHan}\\p{IsHiragana}\\p{IsKatakana}。、！？「」，：；])", "")
    first, last = F.col("parts")[0]["cue"], F.element_at("parts", -1)["cue"]
    return x.select("owner", first["id"].alias("first_id"), last["id"].alias("last_id"), F.size("parts").alias("cues"), first["start_ms"].alias("start_ms"), F.when(last["end_ms"] > -(1 << 62), last["end_ms"]).alias("end_ms"), text.alias("text"))
