"""Live logs with Structured Streaming; an extension, as the batch engine has no streams of its own."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

PULL = "log_id long, begin_at long, end_at long, low double, high double, n long"


def live_statistics(samples: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Least, greatest and mean value of each channel and window; samples later than ``late`` are dropped."""
    return samples.withWatermark("ts", late).groupBy(F.window("ts", window), "channel").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.avg("value").alias("mean"), F.count("*").alias("n"))


def live_pulls(samples: DataFrame, threshold: float, least_rise: float, least_time: int) -> DataFrame:
    """Stretches of (log_id, t, value) that do not fall while at or above a fixed threshold, when they end.

    State per log is one open stretch. A session's own maximum isn't known live, so the threshold is given.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        begin, end, low, high, n, last = state.get if state.exists else (0, 0, 0.0, 0.0, 0, float("nan"))
        found = []
        rows = pd.concat(list(batches)).sort_values("t", kind="stable")
        for t, value in zip(rows["t"], rows["value"], strict=True):
            if value >= threshold and value >= last:
                begin, low, n = (t, value, 0) if n == 0 else (begin, low, n)
                end, high, n = t, value, n + 1
            else:
                if n and high - low >= least_rise and t - begin >= least_time:
                    found.append((key[0], begin, end, low, high, n))
                n = 0
            last = value
        state.update((int(begin), int(end), float(low), float(high), int(n), float(last)))
        yield pd.DataFrame(found, columns=["log_id", "begin_at", "end_at", "low", "high", "n"])

    kinds = "begin long, end long, low double, high double, n long, last double"
    return samples.groupBy("log_id").applyInPandasWithState(run, PULL, kinds, "append", GroupStateTimeout.NoTimeout)
