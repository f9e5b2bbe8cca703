"""Caption files, exports with a coverage sidecar, and user glossaries."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.functions import text as tx
from spanloom.operators import spans


def srt_blocks(cues: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, block): one numbered SRT block per cue in the order start_ms, end_ms, id; ``error`` names a bad cue.

    A cue that begins before the one before it ends, or doesn't last, is an error of its own row, not of the job.
    """
    w = Window.partitionBy(*by).orderBy("start_ms", "end_ms", "id")
    x = cues.withColumn("n", F.row_number().over(w)).withColumn("_before", F.lag("end_ms").over(w))
    error = F.when(F.col("start_ms") >= F.col("end_ms"), "EMPTY").when(F.col("start_ms") < F.col("_before"), "OVERLAP")
    block = F.format_string("%d\n%s --> %s\n%s\n", "n", tx.stamp(F.col("start_ms")), tx.stamp(F.col("end_ms")), tx.clean_text(F.col("text")))
    return x.select(*by, "n", F.when(error.isNull(), block).alias("block"), error.alias("error"))


def write_srt(cues: DataFrame, by: list[str], folder: str) -> None:
    """One folder of text parts per group, blocks in order; fails if the folder exists."""
    x = srt_blocks(cues, by).where("error is null")
    x.repartition(*by).sortWithinPartitions(*by, "n").select(*by, F.col("block").alias("value")).write.partitionBy(*by).mode("errorifexists").text(folder)


def export_state(ranges: DataFrame, lengths: DataFrame, owner: list[str]) -> DataFrame:
    """Per owner: whether coverage is exactly [0, duration), the file suffix, and the sidecar's JSON."""
    merged = spans.merge(ranges, owner)
    g = merged.groupBy(*owner).agg(F.array_sort(F.collect_list(F.array("start_ms", "end_ms"))).alias("ranges"))
    x = lengths.join(g, owner, "left").withColumn("ranges", F.coalesce("ranges", F.array().cast("array<array<bigint>>")))
    only = F.get("ranges", F.lit(0))
    done = F.coalesce((F.size("ranges") == 1) & (F.get(only, F.lit(0)) == 0) & (F.get(only, F.lit(1)) == F.col("duration_ms")), F.lit(False))
    return x.select(*owner, done.alias("complete"), F.when(done, ".srt").otherwise(".partial.srt").alias("suffix"), F.to_json(F.struct("duration_ms", F.col("ranges").alias("coverage"))).alias("sidecar"))


def user_glossary(spark: SparkSession, paths: list[str], target: str, most_bytes: int = 256 * 1024, most_rows: int = 1000) -> DataFrame:
    """(source, rendering, rank) of user files {target: {source: rendering}}, later files first.

    A file that is too large, no JSON, or holds a bad entry counts as empty: more than ``most_rows``, a key or value
    outside 1 to 64 characters, or kana for a Chinese or Korean target. Files are small by rule, so the driver reads them.
    """
    rows: dict[str, tuple[str, int]] = {}
    for rank, path in enumerate(reversed(paths)):
        try:
            raw = open(path, "rb").read(most_bytes + 1)
            section = json.loads(raw.decode())[target] if len(raw) <= most_bytes else {}
            bad = len(section) > most_rows or any(not (isinstance(v, str) and 1 <= len(k) <= 64 and 1 <= len(v) <= 64) for k, v in section.items())
            if bad or target[:2] in ("zh", "ko") and any("ぁ" <= c <= "ヿ" for v in section.values() for c in v):
                section = {}
        except (OSError, ValueError, KeyError, AttributeError, TypeError):
            section = {}
        for k, v in section.items():
            rows.setdefault(k, (v, rank))
    return spark.createDataFrame([(k, v, r) for k, (v, r) in rows.items()], "source string, rendering string, rank int")
