"""Model replies as JSON: all of a reply is valid or none of it.

Replies are parsed to VARIANT, so that types and keys are judged as they stand: a number is no text, and a key too many
is one too many. A key that stands twice in one object makes a reply invalid.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanloom.functions import text as tx

#: What shows that a model thought aloud instead of answering.
THINKING = "<think|\\[THOUGHT\\]"


def unfenced(reply: Column) -> Column:
    """A reply without blanks around it and, if it is wholly inside one, without a JSON code fence."""
    bare = tx.strip(reply)
    inner = tx.strip(F.substring(bare, F.lit(8), F.length(bare) - 10))
    return F.when(F.startswith(bare, F.lit("```json")) & F.endswith(bare, F.lit("```")) & (F.length(bare) >= 10), inner).otherwise(bare)


def _objects(text: Column) -> Column:
    """array<map<string,variant>> of a JSON array of objects; null for anything else.

    The parser stops behind the first value. So the text is parsed inside an array and inside an object: what follows
    the value breaks one of the two, or makes a second element.
    """
    inside = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), "$", "array<variant>")
    whole = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}"))).isNotNull()
    items = _let(inside, lambda x: F.when(F.size(x) == 1, F.try_variant_get(x[0], "$", "array<variant>")))
    return F.transform(F.when(whole, items), lambda x: F.try_variant_get(x, "$", "map<string,variant>"))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it stands there."""
    return F.transform(F.array(value), use)[0]


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def _said(v: Column) -> Column:
    return F.when(_kind(v) == "STRING", F.try_variant_get(v, "$", "string"))


def _answers(rows: Column, ids: Column) -> Column:
    """Whether the rows' ids are the wanted ones, each once."""
    got = F.transform(rows, lambda r: r["id"])
    return (F.size(rows) == F.size(ids)) & (F.size(F.array_distinct(got)) == F.size(ids)) & (F.size(F.array_except(got, ids)) == 0)


def _all_good(rows: Column, ids: Column) -> Column:
    """Rows that are structs if none of them is null and they answer the ids, else null."""
    return _let(rows, lambda x: F.when(F.coalesce(~F.exists(x, lambda r: r.isNull()) & _answers(x, ids), F.lit(False)), x))


def translations(reply: Column, ids: Column, most: int = 1000) -> Column:
    """array<struct<id, text>> of a reply to distinct ``ids``, null unless it answers each once.

    A reply may stand in one JSON code fence but in no other talk; its objects have the keys id and text only, both
    strings. A text is cleaned first; then it must have 1 to ``most`` characters and show no thinking aloud.
    """
    read = lambda m: F.when(F.array_sort(F.map_keys(m)) == F.array(F.lit("id"), F.lit("text")), F.struct(_said(m["id"]).alias("id"), tx.clean_text(_said(m["text"])).alias("text")))
    good = lambda r: F.when(r["id"].isNotNull() & F.length(r["text"]).between(1, most) & ~r["text"].rlike(THINKING), r)
    return _all_good(F.transform(F.transform(_objects(unfenced(reply)), read), good), ids)


def verdicts(reply: Column, ids: Column) -> Column:
    """array<struct<id, score, source_ok, issue>> in the order of distinct ``ids``, null unless each has one verdict.

    A score is a whole number from 1 to 5 - no boolean, fraction or text -, source_ok a boolean, and the issue a string,
    which is cleaned and cut to 120 characters. Further keys don't matter.
    """
    typed = lambda v, kind, to: F.when(_kind(v) == kind, F.try_variant_get(v, "$", to))
    read = lambda m: F.struct(_said(m["id"]).alias("id"), typed(m["score"], "BIGINT", "int").alias("score"), typed(m["source_ok"], "BOOLEAN", "boolean").alias("source_ok"), F.substring(tx.clean_text(_said(m["issue"])), 1, 120).alias("issue"))
    good = lambda r: F.when(r["id"].isNotNull() & r["score"].between(1, 5) & r["source_ok"].isNotNull() & r["issue"].isNotNull(), r)
    found = _all_good(F.transform(F.transform(_objects(tx.strip(reply)), read), good), ids)
    place = lambda r: F.struct(F.array_position(ids, r["id"]).alias("at"), r.alias("r"))
    return F.transform(F.array_sort(F.transform(found, place)), lambda r: r["r"])
