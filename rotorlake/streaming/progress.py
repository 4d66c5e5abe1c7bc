"""Counters of a sweep while its stages run (A26), and crossings on a live stream of samples."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def observed(status: DataFrame) -> tuple[DataFrame, Observation]:
    """``status`` with counters that are filled as it is first computed, without a pass of their own."""
    seen = Observation("progress")
    out = status.observe(seen, F.count("*").alias("modes"), F.min("freq_hz").alias("min_hz"), F.max("freq_hz").alias("max_hz"), F.bool_and("converged").alias("converged"))
    return out, seen


def live_crossings(samples: DataFrame, threshold: float) -> DataFrame:
    """W3 on a stream of (track, ts, value): sign changes so far of each track, outside a dead band.

    State is the last sign and the count of each track. Samples of a batch are put in order
    by ts; later batches must not go back in time.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, count = state.get if state.exists else (0, 0)
        rows = pd.concat(list(parts)).sort_values("ts")
        for v in rows["value"]:
            if abs(v) > threshold:
                sign = 1 if v > 0 else -1
                count += last not in (0, sign)
                last = sign
        state.update((last, count))
        yield pd.DataFrame({"track": [key[0]], "crossings": [count]})

    return samples.groupBy("track").applyInPandasWithState(step, "track long, crossings long", "last int, count long", "update", GroupStateTimeout.NoTimeout)
