"""Streams: documents that arrive over time, and sessions that expire."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

IDLE = "6 hours"
LATENESS = "10 minutes"
#: Seconds without a touch after which a session may be swept away, and between sweeps.
IDLE_S, SWEEP_S = 6 * 3600, 600


def incremental_convert(spark: SparkSession, source: str, schema, checkpoint: str, job: Callable[[DataFrame], DataFrame], target: str):
    """Start a query that converts the files now in ``source`` and ends; a later call takes up new files only.

    Every document must lie in one file; a batch is converted by ``job`` as in batch mode
    and written under its batch number, so that a repeated batch replaces its own output.
    """

    def convert(batch: DataFrame, number: int) -> None:
        job(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(convert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def session_expiry(touches: DataFrame, idle: str = IDLE, lateness: str = LATENESS) -> DataFrame:
    """touches(token, ts), batch or stream -> token, first_touch, last_touch, n_touches of each session.

    A session ends after more than ``idle`` without a touch; a touch exactly ``idle`` later
    still belongs to it. State is bounded by the watermark.
    """
    seen = touches.withWatermark("ts", lateness) if touches.isStreaming else touches
    s = seen.groupBy("token", F.session_window("ts", idle)).agg(F.min("ts").alias("first_touch"), F.max("ts").alias("last_touch"), F.count("*").alias("n_touches"))
    return s.drop("session_window")


SESSIONS = "token string, kind string, first_touch timestamp, last_touch timestamp, n_touches long, expired_at timestamp"


def swept_at(last: float, idle: int = IDLE_S, sweep: int = SWEEP_S) -> int:
    """Second of the first sweep that finds a session idle for more than ``idle``; sweeps are at multiples of ``sweep``."""
    return (int((last + idle) // sweep) + 1) * sweep


def _swept(last: Column, idle: int, sweep: int) -> Column:
    return F.timestamp_seconds((F.floor((last.cast("double") + idle) / sweep) + 1) * sweep)


def review_sessions(touches: DataFrame, idle: int = IDLE_S, sweep: int = SWEEP_S, lateness: str = LATENESS) -> DataFrame:
    """touches(token, ts, opens), batch or stream -> token, kind, first_touch, last_touch, n_touches, expired_at.

    A touch that opens begins a session, or is a touch of one that lives. Others keep a
    session alive; one that comes after the sweep that took its session away, or of a token
    never opened, is refused: a row of kind ``refused`` (its time in first_touch and
    last_touch). A session gives a row of kind ``session`` with the sweep that ended it.

    As a stream each token's session is keyed state with a timer at its sweep, so state is
    no more than the sessions that live; a session's row comes when the watermark has passed
    its sweep. Rows of one micro-batch are taken in order of time, an earlier row of a later
    one counts as a touch. In batch mode all sessions are given.
    """
    if not touches.isStreaming:
        w = W.partitionBy("token").orderBy("ts", F.desc("opens"))
        x = touches.withColumn("_late", ~F.col("opens") & (F.col("ts") >= _swept(F.lag("ts").over(w), idle, sweep)))
        # an opening begins a session unless the one before it lives
        x = x.withColumn("_o", F.sum(F.col("opens").cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)))
        own = W.partitionBy("token", "_o").orderBy("ts", F.desc("opens")).rowsBetween(W.unboundedPreceding, 0)
        x = x.withColumn("refused", (F.col("_o") == 0) | F.max(F.coalesce("_late", F.lit(False))).over(own))
        lost = x.where("refused").select("token", F.lit("refused").alias("kind"), F.col("ts").alias("first_touch"), F.col("ts").alias("last_touch"), F.lit(1).cast("long").alias("n_touches"), F.lit(None).cast("timestamp").alias("expired_at"))
        kept = x.where("not refused")
        begins = F.col("opens") & F.coalesce(F.col("ts") >= _swept(F.lag("ts").over(w), idle, sweep), F.lit(True))
        kept = kept.withColumn("_s", F.sum(begins.cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)))
        made = kept.groupBy("token", "_s").agg(F.min("ts").alias("first_touch"), F.max("ts").alias("last_touch"), F.count("*").alias("n_touches"))
        return made.select("token", F.lit("session").alias("kind"), "first_touch", "last_touch", "n_touches", _swept(F.col("last_touch"), idle, sweep).alias("expired_at")).unionByName(lost)

    def at(seconds: float) -> pd.Timestamp:
        return pd.Timestamp(round(seconds * 1_000_000), unit="us")

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows: list[tuple] = []
        first, last, n = state.get if state.exists else (0.0, 0.0, 0)

        def end() -> None:
            rows.append((key[0], "session", at(first), at(last), n, at(swept_at(last, idle, sweep))))

        if state.hasTimedOut:
            end()
            state.remove()
        else:
            new = pd.concat(list(batches)).sort_values(["ts", "opens"], ascending=[True, False])
            for ts, opens in zip(new["ts"], new["opens"], strict=True):
                t = ts.value / 1_000_000_000 if ts.unit == "ns" else ts.timestamp()
                if n and t >= swept_at(last, idle, sweep):
                    end()
                    n = 0
                if not n and not opens:
                    rows.append((key[0], "refused", at(t), at(t), 1, pd.NaT))
                    continue
                first, last, n = (min(first, t), max(last, t), n + 1) if n else (t, t, 1)
            due = swept_at(last, idle, sweep) * 1000 if n else 0
            if n and due <= state.getCurrentWatermarkMs():
                end()
                n = 0
            if n:
                state.update((first, last, n))
                state.setTimeoutTimestamp(due)
            elif state.exists:
                state.remove()
        yield pd.DataFrame(rows, columns=["token", "kind", "first_touch", "last_touch", "n_touches", "expired_at"])

    seen = touches.withWatermark("ts", lateness)
    return seen.groupBy("token").applyInPandasWithState(run, SESSIONS, "first double, last double, n long", "append", GroupStateTimeout.EventTimeTimeout)
