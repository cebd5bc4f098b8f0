"""Pulling frames from a stream of samples: numbering and timing carry over micro-batches.

State is one row for each track (samples so far, ticks so far), so it doesn't
grow with a track's length. Samples of a micro-batch are taken in the order of
their own index; late ones are numbered when they come.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pixelloom.session import ship


def timed(samples: DataFrame, track: str = "track", order: str = "ord", duration: str = "duration") -> DataFrame:
    """Streaming (track, ord, duration), longs -> (track, ord, sample_idx, decode_time), appended."""
    ship(samples.sparkSession)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, ticks = state.get if state.exists else (0, 0)
        rows = pd.concat(list(batches)).sort_values(order, kind="stable")
        before = rows[duration].cumsum() - rows[duration]
        out = pd.DataFrame({track: key[0], order: rows[order].to_numpy(), "sample_idx": range(n, n + len(rows)), "decode_time": (ticks + before).to_numpy()})
        state.update((n + len(rows), int(ticks + rows[duration].sum())))
        yield out

    schema = f"{track} long, {order} long, sample_idx long, decode_time long"
    return samples.select(track, order, duration).groupBy(track).applyInPandasWithState(run, schema, "n long, ticks long", "append", GroupStateTimeout.NoTimeout)
