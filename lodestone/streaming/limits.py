"""Token bucket on a stream, one state a tenant."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def admit_stream(requests: DataFrame, tenant: str, ts: str, rate: float, burst: float) -> DataFrame:
    """(tenant, ts, admitted, tokens) in the order of arrival within a batch sorted by time."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tokens, last = state.get if state.exists else (burst, None)
        rows = pd.concat(list(batches)).sort_values(ts)
        ok, left = [], []
        for t in rows[ts]:
            now = t.timestamp()
            tokens = tokens if last is None else min(burst, tokens + max(0.0, now - last) * rate)
            last = now if last is None else max(last, now)
            ok.append(tokens >= 1)
            tokens -= ok[-1]
            left.append(tokens)
        state.update((tokens, last))
        yield pd.DataFrame({tenant: [key[0]] * len(rows), ts: rows[ts].to_numpy(), "admitted": ok, "tokens": left})

    kind = requests.schema[tenant].dataType.simpleString()
    return requests.groupBy(tenant).applyInPandasWithState(step, f"{tenant} {kind}, {ts} timestamp, admitted boolean, tokens double", "tokens double, last double", "append", GroupStateTimeout.NoTimeout)
