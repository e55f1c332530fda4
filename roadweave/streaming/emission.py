"""Snapshots that are emitted at most every few ticks, the latest winning."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "run_id int, frame_seq long, tick long, payload string, n_dropped long, forced boolean"
STATE = "frame_seq long, last_tick long, pending_tick long, pending string, n_dropped long"


def _fold(interval: int):
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seq, last, at, held, dropped = state.get if state.exists else (0, -1, -1, "", 0)
        out = []
        rows = pd.concat(list(batches)).sort_values(["tick", "payload"])
        for tick, payload, force in zip(rows["tick"].tolist(), rows["payload"].tolist(), rows["force"].tolist(), strict=True):
            dropped += at >= 0
            at, held = tick, payload
            if force or last < 0 or tick - last >= interval:
                out.append((key[0], seq, at, held, dropped, bool(force)))
                seq, last, at, held, dropped = seq + 1, tick, -1, "", 0
        state.update((seq, last, at, held, dropped))
        yield pd.DataFrame(out, columns=["run_id", "frame_seq", "tick", "payload", "n_dropped", "forced"])

    return run


def throttled(offers: DataFrame, interval: int) -> DataFrame:
    """Frames of each run from offers (run_id, tick, payload, force), streamed or not: the latest offer once `interval` ticks have passed, or at once if forced.

    An offer that a later one replaces before it is emitted counts as dropped. A run's state is one pending offer and four numbers; ticks arrive in order.
    """
    return offers.groupBy("run_id").applyInPandasWithState(_fold(interval), OUT, STATE, "append", GroupStateTimeout.NoTimeout)
