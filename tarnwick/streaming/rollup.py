"""Roll-ups whose parts are sums, kept up to date over a stream of measurements.

The batch engine needs no streaming; these are the operators that can run on one without change: every aggregate is a sum, a count or a
population moment, so Structured Streaming keeps one state row per key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_stats(events: DataFrame, ts: str, keys: list[str], value: str, window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Per window and key: n, mean, population deviation; events later than ``late`` are left out and their windows' state is dropped."""
    return (
        events.withWatermark(ts, late).groupBy(F.window(ts, window).alias("window"), *keys)
        .agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))
        .select(F.col("window.start").alias("start"), *keys, "n", "mean", "std")
    )


def running_rollup(long: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean, population deviation and n per key over all that has arrived; for output mode complete."""
    v = F.when(~F.isnan(value), F.col(value))
    return long.groupBy(*keys).agg(F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.count(v).alias("n"))


def collect_stream(df: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """What a stream over files that are already there yields, as a table in memory."""
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)
