"""Event windows over a stream. An extension: the batch operators are the reference for results."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def event_rates(events: DataFrame, by: list[str], t: str = "ts", window: str = "2 days", hop: str = "1 day", late: str = "1 day") -> DataFrame:
    """Events, and their mean value, in sliding time windows; rows later than `late` are left out by the watermark."""
    return events.withWatermark(t, late).groupBy(*by, F.window(t, window, hop)).agg(F.count(F.lit(1)).alias("n_events"), F.avg("value").alias("mean_value")).select(*by, F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n_events", "mean_value")


def unwrap_stream(samples: DataFrame, key: str, raw: str = "raw") -> DataFrame:
    """Counters unwrapped as they arrive (in order within a key): the state is the last reading and the rollovers so far."""
    kind = samples.schema[key].dataType.simpleString()

    def run(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last, turns = state.get if state.exists else (None, 0)
        for rows in batches:
            out = []
            for x in rows[raw]:
                if last is not None and x - last < -(2**31):
                    turns += 1
                last = int(x)
                out.append((k[0], last, float(last) + turns * 2.0**32))
            yield pd.DataFrame(out, columns=[key, raw, "unwrapped"])
        state.update((last, turns))

    return samples.select(key, F.col(raw).cast("long").alias(raw)).groupBy(key).applyInPandasWithState(run, f"`{key}` {kind}, `{raw}` long, unwrapped double", "last long, turns long", "append", "NoTimeout")
