"""The replica's append state machine, as a batch fold and as a streaming state processor."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: pid, arrival, epoch, base_seq, n, sealed_end (null while open) -> status and offset
OUT = "pid int, arrival long, status string, offset long"


class State:
    """What a replica knows of one partition: highest epoch, and per epoch the last sequence number."""

    def __init__(self, highest: int = -1, last: dict[int, int] | None = None):
        self.highest, self.last = highest, dict(last or {})

    def append(self, epoch: int, base: int, n: int, sealed_end: int | None) -> tuple[str, int]:
        """Status and acknowledged offset of records base .. base + n - 1.

        Epochs below the highest seen are stale; records past a sealed end are refused; records already held are
        acknowledged again; a gap is not ready; an overlapping prefix is skipped; no records acknowledge base - 1.
        """
        if epoch < self.highest:
            return "INVALID_REQUEST", -1
        self.highest = epoch
        last = self.last.get(epoch, -1)
        end = base + n - 1
        if n == 0:
            return "SUCCESS", base - 1
        if sealed_end is not None and end > sealed_end:
            return "NOT_READY", last
        if end <= last:
            return "SUCCESS", last
        if base > last + 1:
            return "NOT_READY", last
        self.last[epoch] = end
        return "SUCCESS", end


def append(requests: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Status of every append request in arrival order: pid, arrival, status, offset.

    requests: pid, arrival, topic, epoch, base_seq, n, sealed_end. Topics outside `known` are invalid and leave no
    trace. A partition is one ordered fold: its requests pass through one task, sorted, a batch at a time, and what is
    held is the state, one number an epoch.
    """
    if known is not None:
        named = known.select("topic").distinct().withColumn("_known", F.lit(True))
        requests = requests.join(named, "topic", "left")
    else:
        requests = requests.withColumn("_known", F.lit(True))
    requests = requests.select("pid", "arrival", "epoch", "base_seq", "n", "sealed_end", F.coalesce("_known", F.lit(False)).alias("known"))

    def fold(frames):
        of, state = None, State()
        for pdf in frames:
            rows = []
            for r in pdf.itertuples(index=False):
                if r.pid != of:
                    of, state = r.pid, State()
                rows.append((r.pid, r.arrival, *answer(state, r)))
            yield pd.DataFrame(rows, columns=["pid", "arrival", "status", "offset"])

    return requests.repartition("pid").sortWithinPartitions("pid", "arrival").mapInPandas(fold, OUT)


def answer(state: State, r) -> tuple[str, int]:
    """Status and offset of a request; one of an unknown topic leaves no trace."""
    if not r.known:
        return "INVALID_REQUEST", -1
    return state.append(r.epoch, r.base_seq, r.n, None if pd.isna(r.sealed_end) else int(r.sealed_end))


def append_stream(requests: DataFrame) -> DataFrame:
    """The same over a stream of requests (pid, arrival, epoch, base_seq, n, sealed_end, known), with state per partition.

    Requests of a micro-batch are taken in the order of arrival; a micro-batch is what is held of them.
    """
    from pyspark.sql.streaming.state import GroupStateTimeout

    def fold(key, frames, state):
        highest, epochs, lasts = state.get if state.exists else (-1, [], [])
        own = State(highest, dict(zip(epochs, lasts)))
        pdf = pd.concat(list(frames)).sort_values("arrival", kind="stable")
        rows = []
        for r in pdf.itertuples(index=False):
            rows.append((key[0], r.arrival, *answer(own, r)))
        state.update((own.highest, list(own.last), list(own.last.values())))
        yield pd.DataFrame(rows, columns=["pid", "arrival", "status", "offset"])

    return requests.groupBy("pid").applyInPandasWithState(fold, OUT, "highest long, epochs array<long>, lasts array<long>", "append", GroupStateTimeout.NoTimeout)
