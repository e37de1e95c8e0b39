"""The credit ledger as a stream: keyed state, and timers that wait for late movements."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql import types as T

from docketry.operators.ledger import _judge

OUT = "user_id bigint, id bigint, success boolean, balance_before bigint, balance_after bigint"


class Ledger(StatefulProcessor):
    """A user's balance, and the movements that wait until no earlier one can come: the watermark has passed them."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.balance = handle.getValueState("balance", "amount bigint")
        self.waiting = handle.getListState("waiting", T.StructType([T.StructField("at", T.LongType()), T.StructField("id", T.LongType()), T.StructField("amount", T.LongType())]))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for batch in rows:
            at = [int(t.timestamp() * 1000) for t in batch["ts"]]
            for when, one, amount in zip(at, batch["id"].tolist(), batch["amount"].tolist()):
                self.waiting.appendValue((when, int(one), int(amount)))
            for when in set(at):
                self.handle.registerTimer(when)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        due = expiredTimerInfo.getExpiryTimeInMs()
        rows = sorted(tuple(r) for r in self.waiting.get())
        now = self.balance.get()[0] if self.balance.exists() else 0
        out = []
        for at, one, amount in rows:
            if at <= due:
                before = now
                now, moved = _judge(before, amount)
                out.append((key[0], one, moved, before, now))
        left = [r for r in rows if r[0] > due]
        self.waiting.put(left) if left else self.waiting.clear()
        self.balance.update((now,))
        yield pd.DataFrame(out, columns=["user_id", "id", "success", "balance_before", "balance_after"]) if out else pd.DataFrame()

    def close(self) -> None:
        pass


def ledger(requests: DataFrame, late: str) -> DataFrame:
    """Movements of the stream ``requests`` (user_id, id, amount, ts) judged in the order of ts and id, each once.

    A movement waits until the watermark, ``late`` behind the newest ts, has passed it; one that comes later still is
    dropped by the watermark, so choose ``late`` for the source. The session needs the RocksDB state store.
    """
    held = requests.select("user_id", "id", "amount", "ts").withWatermark("ts", late)
    return held.groupBy("user_id").transformWithStateInPandas(Ledger(), OUT, "Append", "EventTime")
