"""The dead-letter alert as a live stream: fires after minutes of a high rate, clears when the rate falls.

Dead letters are counted per source and minute by an aggregation, so a source with many of them sends the stateful operator one row a
minute. That operator keeps the last minutes' counts, and an event-time timer closes the windows that no further row falls into.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tapewright.operators.quality import ALERT_MINUTES, ALERT_RATE, per_minute, windows_of_minutes
from tapewright.streaming.monitors import WATERMARK

MINUTE = 60
SPAN = 5
_CLOSED = "source string, second long, rejects long, rate double, held int, firing boolean, cleared boolean"
_COLUMNS = [field.split()[0] for field in _CLOSED.split(", ")]
WINDOWS = "source string, window_end timestamp, rejects long, rate double, held int, firing boolean, cleared boolean"


class AlertState(StatefulProcessor):
    """Five-minute windows ending at every minute, closed in order; `held` counts those above the threshold in a row."""

    def __init__(self, threshold: float, minutes: int):
        self.threshold, self.minutes = threshold, minutes

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # Epoch minutes and their counts, the end of the last closed window, the run of high windows.
        self.state = handle.getValueState("alert", "minutes array<long>, counts array<long>, closed long, held int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        arrived = {second // MINUTE: n for part in rows for second, n in zip(part["second"].tolist(), part["n"].tolist())}
        counts, closed, held = self._load()
        if closed is None:
            closed = min(arrived)
        counts.update(arrived)
        # A minute that arrived is over, so is every one before it.
        yield self._close(key, counts, closed, held, max(arrived) + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # All windows behind the watermark at once; another timer would wait for the next batch.
        counts, closed, held = self._load()
        yield self._close(key, counts, closed, held, timerValues.getCurrentWatermarkInMs() // 1000 // MINUTE)

    def close(self) -> None:
        pass

    def _load(self) -> tuple[dict[int, int], int | None, int]:
        if not self.state.exists():
            return {}, None, 0
        minutes, counts, closed, held = self.state.get()
        return dict(zip(minutes, counts)), closed, held

    def _close(self, key, counts: dict[int, int], closed: int, held: int, until: int) -> pd.DataFrame:
        """Close the windows that end after `closed`, up to `until` (epoch minutes)."""
        rows = []
        for end in range(closed + 1, until + 1):
            rejects = sum(counts.get(minute, 0) for minute in range(end - SPAN, end))
            rate, before = rejects / (SPAN * MINUTE), held
            held = held + 1 if rejects and rate > self.threshold else 0
            cleared = before >= self.minutes > held
            if rejects or cleared:
                rows.append((key[0], end * MINUTE, rejects, rate, held, held >= self.minutes, cleared))
            counts = {minute: n for minute, n in counts.items() if minute > end - SPAN}
            if not counts and not held:
                # Nothing is left that a later window could hold.
                closed = until
                break
            closed = end
        self.state.update((list(counts), list(counts.values()), closed, held))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if counts or held:
            self.handle.registerTimer((closed + 1) * MINUTE * 1000)
        return pd.DataFrame(rows, columns=_COLUMNS)


def live_alerts(classified: DataFrame, source: str, threshold: float = ALERT_RATE, minutes: int = ALERT_MINUTES, delay: str = WATERMARK) -> DataFrame:
    """Every closed window of a source with its rate, whether the alert fires there, and whether it clears."""
    bad = classified.where(F.col("reason").isNotNull()).select(F.lit(source).alias("source"), F.col("ingest_time").alias("rejected_at"))
    counts = (
        bad.withWatermark("rejected_at", delay)
        .groupBy("source", F.window("rejected_at", "1 minute").alias("w"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select("source", F.unix_seconds(F.col("w.start")).alias("second"), "n", F.window_time("w").alias("at"))
    )
    closed = counts.groupBy("source").transformWithStateInPandas(AlertState(threshold, minutes), _CLOSED, "Append", "EventTime")
    return closed.select("source", F.timestamp_seconds("second").alias("window_end"), "rejects", "rate", "held", "firing", "cleared")


def fired(windows: DataFrame) -> DataFrame:
    return windows.where("firing").select("source", "window_end", "rejects", "rate")


def complete_windows(closed: DataFrame, rejects: DataFrame, threshold: float = ALERT_RATE, minutes: int = ALERT_MINUTES) -> DataFrame:
    """The windows a stream has closed, and those the watermark still holds open, from the dead letters since.

    Of the letters only those that the open windows and the run before them can need are read.
    """
    last = closed.groupBy("source").agg(F.max("window_end").alias("last"))
    first = last.agg(F.min("last")).first()[0]
    if first is not None:
        rejects = rejects.where(F.col("rejected_at") >= F.lit(first) - F.expr(f"INTERVAL {SPAN + minutes} MINUTES"))
    windows = windows_of_minutes(per_minute(rejects)).withColumn("second", F.unix_seconds(F.col("window_end").cast("timestamp")))
    high = F.when(F.col("rate") > threshold, 1).otherwise(0)
    run = Window.partitionBy("source").orderBy("second").rangeBetween(-(minutes - 1) * MINUTE, 0)
    windows = windows.withColumn("firing", F.sum(high).over(run) >= minutes)
    columns = ["source", "window_end", "rejects", "rate", "firing"]
    both = closed.select(*columns, F.lit(True).alias("streamed")).unionByName(windows.select(*columns, F.lit(False).alias("streamed")))
    # A source's windows are as many as the minutes it was read for.
    seen = F.max(F.when(F.col("streamed"), F.col("window_end"))).over(Window.partitionBy("source"))
    kept = both.withColumn("last", seen).where("CASE WHEN streamed THEN rejects > 0 ELSE last IS NULL OR window_end > last END")
    return kept.select(columns)
