"""Target liveness by the clock: state with a processing-time timeout.

State that follows event time (counters, alerts, gaps, job progress) is in ``carried``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def liveness(samples: DataFrame, max_gap_ms: int = 60_000) -> DataFrame:
    """``series, up`` changes: down by timeout, up again with the next sample."""
    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.update((False,))
            yield pd.DataFrame({"series": [key[0]], "up": [False]})
            return
        for _ in batches:
            pass
        was_up = state.get[0] if state.exists else False
        state.update((True,))
        state.setTimeoutDuration(max_gap_ms)
        yield pd.DataFrame({"series": [] if was_up else [key[0]], "up": [] if was_up else [True]})

    return samples.groupBy("series").applyInPandasWithState(
        step, "series STRING, up BOOLEAN", "up BOOLEAN", "append",
        GroupStateTimeout.ProcessingTimeTimeout)
