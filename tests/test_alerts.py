"""The live alert against the batch form, with late rows, quiet minutes and a replayed batch."""

from datetime import timedelta

from helpers import at, rows
from pyspark.sql import functions as F

from tapewright.operators.quality import rejection_alerts, rejection_windows
from tapewright.streaming import alerts, runner
from tapewright.streaming.runner import Job

ROWS = "reason string, ingest_time timestamp"
START = at("2024-01-30 10:00:00")
RATE = 0.1


def letters(spark, path, name, *minutes):
    """(minute, number of dead letters) from START on."""
    data = [("bad", START + timedelta(minutes=m, seconds=k % 60)) for m, n in minutes for k in range(n)]
    spark.createDataFrame([*data, *((None, t) for _, t in data[:5])], ROWS).coalesce(1).write.parquet(f"{path}/{name}")


def drained(spark, work, batches):
    path = f"{work}/in"
    for k, batch in enumerate(batches):
        letters(spark, path, f"{k}", *batch)
    reader = spark.readStream.schema(ROWS).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1)
    job = Job("alerts", alerts.live_alerts(reader.parquet(path), "candles", RATE), "1 minute", path=f"{work}/out")
    started = runner.drain(spark, [job], f"{work}/cp")
    assert not started.failures
    bad = spark.read.schema(ROWS).option("recursiveFileLookup", "true").parquet(path).where("reason IS NOT NULL")
    return spark.read.schema(alerts.WINDOWS).parquet(f"{work}/out"), bad.select(F.lit("candles").alias("source"), F.col("ingest_time").alias("rejected_at"))


# High for a while, quiet, high again; a gap of hours; a short burst that never holds; rows out of order within the watermark.
BATCHES = [
    [(m, 40) for m in range(0, 9)],
    [(12, 1), (10, 3), (9, 40)],
    [(m, 50) for m in range(30, 36)] + [(29, 2)],
    [(300, 200)],
    [(m, 31) for m in range(306, 330, 2)],
    [(400, 1)],
]


def test_the_stream_fires_and_clears_as_the_batch_does(spark, work):
    windows, bad = drained(spark, work, BATCHES)
    batch = rejection_windows(bad)
    want = rows(rejection_alerts(batch, RATE), "source", "window_end", "rejects", "rate")
    assert rows(alerts.fired(alerts.complete_windows(windows, bad, RATE))) == want and len(want) > 20
    # All but the last minutes were closed by the stream itself.
    streamed = rows(alerts.fired(windows))
    assert streamed == want
    ends = {r[1] for r in want}
    cleared = sorted(e + timedelta(minutes=1) for e in ends if e + timedelta(minutes=1) not in ends)
    assert sorted(r[0] for r in rows(windows.where("cleared"), "window_end")) == cleared and len(cleared) >= 3
    closed = rows(windows.where("rejects > 0"), "source", "window_end", "rejects", "rate")
    assert closed == rows(batch.where(F.col("window_end") <= F.lit(windows.agg(F.max("window_end")).first()[0])), "source", "window_end", "rejects", "rate")


def test_windows_still_open_come_from_the_letters(spark, work):
    windows, bad = drained(spark, work, [[(m, 40) for m in range(0, 20)]])
    want = rows(rejection_alerts(rejection_windows(bad), RATE), "source", "window_end", "rejects", "rate")
    whole = alerts.complete_windows(windows, bad, RATE)
    assert rows(alerts.fired(whole)) == want and len(want) > len(rows(alerts.fired(windows)))
