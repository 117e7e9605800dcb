"""A rate limit whose window opens at a subject's first attempt and closes a fixed time later."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def rate_limit(events: DataFrame, most: int, seconds: int) -> DataFrame:
    """user_id, event_id, allowed; events: user_id, event_id, s (epoch seconds), ts.

    Rows of a subject come in time order to one task in Arrow batches, which is gone through from window to window, not row by
    row; state is a subject's open window, so memory doesn't grow with its events. A rejected attempt uses nothing up.
    """

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        who, opened, used = None, 0, 0
        for frame in frames:
            users, s = frame["user_id"].to_numpy(), frame["s"].to_numpy()
            allowed = np.zeros(len(s), bool)
            edges = [0, *(np.flatnonzero(users[1:] != users[:-1]) + 1).tolist(), len(s)] if len(s) else [0]
            for a, b in zip(edges, edges[1:], strict=False):
                at = a
                while at < b:  # from window to window
                    if users[a] != who or s[at] >= opened + seconds:
                        who, opened, used = users[a], s[at], 0
                    end = at + int(np.searchsorted(s[at:b], opened + seconds))
                    take = min(max(0, most - used), end - at)
                    allowed[at : at + take] = True
                    used, at = used + take, end
            yield pd.DataFrame({"user_id": frame["user_id"], "event_id": frame["event_id"], "allowed": allowed})

    ordered = events.repartition("user_id").sortWithinPartitions("user_id", "ts", "event_id")
    return ordered.select("user_id", "event_id", "s").mapInPandas(work, "user_id long, event_id long, allowed boolean")
