"""Counted visits over a stream, with the rule of ``operators.usage.counted_visits``."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.usage import GAP_SECONDS, micros


def visit_stream(events: DataFrame, key: str, ts: str, task: str) -> DataFrame:
    """A row (key, visits, tasks, last_us) whenever a key's counts change; update mode.

    Events are taken in order of time within a micro-batch; one older than the last
    counted use is late and, unless a task, does not count."""
    rows = events.where(F.col(ts).isNotNull()).select(key, micros(events, ts).alias("us"), F.coalesce(F.col(task), F.lit(False)).alias("is_task"))
    kind = rows.schema[key].dataType.simpleString()

    def fold(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        visits, tasks, last = state.get if state.exists else (0, 0, 0)
        seen = pd.concat(list(batches)).sort_values(["us", "is_task"], ascending=[True, False])
        before = visits, tasks
        for us, is_task in zip(seen["us"].tolist(), seen["is_task"].tolist()):
            if is_task:
                tasks, last = tasks + 1, max(last, us)
            elif visits == 0 or us - last >= GAP_SECONDS * 1_000_000:
                visits, last = visits + 1, max(last, us)
        state.update((visits, tasks, last))
        if (visits, tasks) != before:
            yield pd.DataFrame({key: [k[0]], "visits": [visits], "tasks": [tasks], "last_us": [last]})

    return rows.groupBy(key).applyInPandasWithState(fold, f"`{key}` {kind}, visits bigint, tasks bigint, last_us bigint", "visits bigint, tasks bigint, last bigint", "update", GroupStateTimeout.NoTimeout)
