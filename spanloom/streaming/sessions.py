"""Viewer sessions from a control log: sequence and epoch fences, leases, acknowledgements and retries.

Time comes from the log (``now_ms``), never from the clock, so a replay gives the same decisions.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from spanloom.session import shared_dir

#: A lease that isn't renewed for longer than this ends the session.
LEASE_MS = 45_000
#: The end of a coverage step is published as a new revision; so many are kept for late acknowledgements.
KEPT_REVISIONS = 8

LOG = "session_id string, epoch long, seq long, position_ms long, revision long, now_ms long"
_OUT = "session_id string, epoch long, seq long, now_ms long, verdict string, revision long"
_LOG_INTS = ["epoch", "seq", "position_ms", "revision", "now_ms"]
_STATE = "epoch long, seq long, now_ms long, revision long, position_ms long"


def decide(state: tuple[int, int, int, int, int] | None, row: dict) -> tuple[tuple[int, int, int, int, int], str, int]:
    """New state, verdict and revision for one log row; the state is (epoch, seq, now_ms, revision, position_ms).

    EXPIRED begins anew after a lapsed lease; STALE_SEQUENCE and STALE_EPOCH change nothing; SEEK begins an epoch and
    drops its revisions; STALE_ACK names a revision that is unknown or no longer kept; else ACCEPTED, with a new
    revision when the position moved.
    """
    lapsed = state is not None and row["now_ms"] - state[2] > LEASE_MS
    if state is None or lapsed:
        return (row["epoch"], row["seq"], row["now_ms"], 1, row["position_ms"]), "EXPIRED" if lapsed else "OPENED", 1
    epoch, seq, _, revision, position = state
    if row["epoch"] < epoch:
        return state, "STALE_EPOCH", revision
    if row["epoch"] > epoch:
        return (row["epoch"], row["seq"], row["now_ms"], 1, row["position_ms"]), "SEEK", 1
    if row["seq"] <= seq:
        return state, "STALE_SEQUENCE", revision
    ack = row["revision"]
    if ack is not None and not revision - KEPT_REVISIONS < ack <= revision:
        return (epoch, row["seq"], row["now_ms"], revision, position), "STALE_ACK", revision
    moved = row["position_ms"] != position
    return (epoch, row["seq"], row["now_ms"], revision + moved, row["position_ms"]), "ACCEPTED", revision + moved


class SessionFence(StatefulProcessor):
    """One state row per session; a batch's rows are taken by time, epoch and sequence."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("session", _STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802
        # a session's rows of one batch are put in order; their number is bounded by the trigger, not by the session
        log = sorted((tuple(None if v != v else int(v) for v in r) for b in rows for r in b[_LOG_INTS].itertuples(index=False)), key=lambda r: tuple(-1 if v is None else v for v in (r[4], r[0], r[1], *r[2:4])))
        state = tuple(self.state.get()) if self.state.exists() else None
        out = []
        for r in log:
            state, verdict, revision = decide(state, dict(zip(_LOG_INTS, r)))
            out.append((key[0], r[0], r[1], r[4], verdict, revision))
        if state is not None:
            self.state.update(state)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in _OUT.split(", ")])

    def close(self) -> None:
        pass


def fence(log: DataFrame) -> DataFrame:
    """A streaming log with the columns of ``LOG`` to verdicts. Needs the RocksDB state store.

    Decisions take their time from the log, never from the clock. With a time to live by the clock a run over what is
    there would not end, so a session's state, one row, stays.
    """
    return log.groupBy("session_id").transformWithStateInPandas(statefulProcessor=SessionFence(), outputStructType=_OUT, outputMode="Append", timeMode="None")


def run_to_end(stream: DataFrame, name: str) -> DataFrame:
    """Run a streaming frame over what is there, into the shared folder, and read the result."""
    spark = stream.sparkSession
    at = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    key, store = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(key)
    spark.conf.set(key, store)
    try:
        stream.writeStream.format("parquet").option("checkpointLocation", at + "/state").option("path", at + "/rows").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(key, before)
    return spark.read.schema(stream.schema).parquet(at + "/rows")


def first_requests(stream: DataFrame, keys: list[str], at: str, horizon: str) -> DataFrame:
    """Idempotent creation: the first of equal requests within the watermark's horizon."""
    return stream.withWatermark(at, horizon).dropDuplicatesWithinWatermark(keys)


def session_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The sessions table as a stream."""
    schema = spark.read.parquet(f"{folder}/sessions.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{folder}/sessions.parque[t]").where("last_seen is not null")


def control_log(spark: SparkSession, folder: str) -> DataFrame:
    """The sessions table as a stream of log rows."""
    x = session_stream(spark, folder).where("session_id is not null and epoch is not null and seq is not null")
    return x.select("session_id", "epoch", "seq", F.coalesce("position_ms", F.lit(0).cast("long")).alias("position_ms"), "revision", F.unix_millis("last_seen").alias("now_ms"))


# Failures of one window, after which a hole is left and work goes on.
WINDOW_FAILURES = ("ALIGNMENT_FAILED", "ASR_FAILED", "TRANSLATION_FAILED")


def retry(code: str, attempt: int, length_ms: int) -> tuple[str, int]:
    """What follows a failed window: (action, next length). Actions: longer, half, skip, hole, stop."""
    if code == "LANGUAGE_UNCERTAIN":
        return ("longer", min(24_000, max(20_000, 2 * length_ms))) if attempt == 0 else ("skip", 0)
    if code in WINDOW_FAILURES[:2] and attempt == 0 and length_ms >= 8000:
        return "half", length_ms // 2
    return ("hole", 0) if code in WINDOW_FAILURES else ("stop", 0)


def retries(attempts: DataFrame, by: list[str], order: list[str], code: str, start: str, end: str) -> DataFrame:
    """Adds (attempt, action, next_end) to a log of windows: what follows each one, as :func:`retry` says.

    Attempts of one window are numbered from 0 in ``order``; a null ``code`` is a success. Rows after the attempt that
    ended a window - a success, a skip, a hole or a stop - are late and change nothing: their action is ``late``.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    c, length = F.col(code), F.col(end) - F.col(start)
    first = F.col("attempt") == 0
    action = (
        F.when(c.isNull(), "done").when((c == "LANGUAGE_UNCERTAIN") & first, "longer").when(c == "LANGUAGE_UNCERTAIN", "skip")
        .when(c.isin(*WINDOW_FAILURES[:2]) & first & (length >= 8000), "half").when(c.isin(*WINDOW_FAILURES), "hole").otherwise("stop")
    )
    x = attempts.withColumn("attempt", F.row_number().over(w) - 1).withColumn("action", action)
    over = F.max((~F.col("action").isin("longer", "half")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    x = x.withColumn("action", F.when(F.coalesce(over, F.lit(0)) == 1, "late").otherwise(F.col("action")))
    after = F.when(F.col("action") == "longer", F.col(start) + F.least(F.lit(24_000), F.greatest(F.lit(20_000), length * 2))).when(F.col("action") == "half", F.col(start) + F.floor(length / 2))
    return x.withColumn("next_end", after)
