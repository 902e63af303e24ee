"""Cache entries as keyed state with a lifetime in a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "content_hash string, cache_name string, hit boolean, ts timestamp"


def cache_hits(requests: DataFrame, ttl_seconds: int) -> DataFrame:
    """content_hash, cache_name, hit, ts of a stream of requests (content_hash, cache_name, ts).

    The first request of a hash registers its name; later ones within the lifetime hit it and get that name; past the
    lifetime the next one registers anew. One small state a hash; a hot hash's requests are only counted through.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        name, expires = state.get if state.exists else (None, None)
        for pdf in frames:
            rows = []
            for r in pdf.sort_values(["ts", "cache_name"]).itertuples(index=False):
                at = pd.Timestamp(r.ts).timestamp()
                hit = name is not None and at < expires
                if not hit:
                    name, expires = r.cache_name, at + ttl_seconds
                rows.append((key[0], name, hit, r.ts))
            yield pd.DataFrame(rows, columns=["content_hash", "cache_name", "hit", "ts"])
        state.update((name, expires))
        state.setTimeoutDuration(ttl_seconds * 1000)

    return requests.groupBy("content_hash").applyInPandasWithState(step, OUT, "name string, expires double", "append", GroupStateTimeout.ProcessingTimeTimeout)
