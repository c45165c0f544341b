"""Keyed state over event streams: the newest items of an entity, and entities that fall silent.

Both are stateful processors of the engine: state lies in the state store per entity and survives lost executors with
the checkpoint of the query, a batch reads and writes the state of its own entities only, and timers run on event time.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import islice
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from panelkite.operators.sessions import HISTORY_LENGTH, SESSION_GAP_SECONDS, STALE_SECONDS

STORE = "spark.sql.streaming.stateStore.providerClass"
CHUNK_ROWS = 100_000  # of an entity and one batch held at a time
NEVER = -(2**63)
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state_store(spark) -> None:
    """Keyed state with lists, maps and timers needs the store that holds them on disk."""
    spark.conf.set(STORE, ROCKS)


def _fields(df: DataFrame, names: list[str]) -> list[T.StructField]:
    return [T.StructField(c, df.schema[c].dataType) for c in names]


class NewestItems(StatefulProcessor):
    """Keeps the newest ``n`` rows of an entity as a list and gives them out anew when a batch changes them.

    ``ttl_ms`` lets the list of an entity without events expire, by processing time.
    """

    def __init__(self, schema: T.StructType, by: list[str], n: int, ts: str, tie: str, ttl_ms: int | None):
        self.schema, self.by, self.n, self.order, self.ttl_ms = schema, by, n, [ts, tie], ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.items = handle.getListState("items", self.schema, self.ttl_ms)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        names = self.schema.names
        before = [tuple(r) for r in self.items.get()]
        kept = pd.DataFrame(before, columns=names)
        for part in rows:  # never more than the newest n of an entity and one batch are held
            both = pd.concat([kept, part[names]], ignore_index=True) if len(kept) else part[names]
            kept = both.sort_values(self.order, ascending=False, kind="stable").head(self.n)
        after = [tuple(r) for r in kept.astype(object).where(kept.notna(), None).itertuples(index=False, name=None)]
        if after != before:
            self.items.put([tuple(v.to_pydatetime() if isinstance(v, pd.Timestamp) else v for v in r) for r in after])
            yield kept
        else:
            yield kept.iloc[:0]

    def close(self) -> None:
        pass


def newest_items(
    events: DataFrame, by: list[str], n: int = HISTORY_LENGTH, ts: str = "ts", tie: str = "event_id", ttl_ms: int | None = None
) -> DataFrame:
    """In update mode, the newest ``n`` rows of every entity that a batch changed; ties in ``ts`` go to the larger ``tie``."""
    use_state_store(events.sparkSession)
    schema = T.StructType(_fields(events, events.columns))
    return events.groupBy(*by).transformWithStateInPandas(
        NewestItems(schema, by, n, ts, tie, ttl_ms), outputStructType=schema, outputMode="Update", timeMode="None" if ttl_ms is None else "ProcessingTime")


class Silence(StatefulProcessor):
    """Emits an entity once when it turns stale and once when it expires, as the watermark passes.

    Events no further apart than the shorter limit make one span, of which only the first and last time are kept. All spans of an
    entity are one value, read and written once a batch, with the watermark up to which silences were called stale. A timer stands
    at the next time that needs a look; it settles all that the watermark has passed, and drops spans that may have expired, so
    the state of an entity is bounded by the limits and the lateness.
    """

    def __init__(self, names: list[str], stale: int, expired: int):
        self.made, self.stale, self.expired = Row(*names), stale * 1_000_000, expired * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.spans = handle.getValueState("spans", "first array<long>, last array<long>, looked long")

    def _read(self) -> tuple[np.ndarray, np.ndarray, int]:
        held = self.spans.get()
        if held is None:
            return np.empty(0, "int64"), np.empty(0, "int64"), NEVER
        return np.array(held[0], "int64"), np.array(held[1], "int64"), int(held[2])

    def _merged(self, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Spans no further apart than the shorter limit become one."""
        order = np.argsort(first, kind="stable")
        first, last = first[order], np.maximum.accumulate(last[order])
        apart = first[1:] > last[:-1] + self.stale
        return first[np.append(True, apart)], last[np.append(apart, True)]

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        first, last, looked = self._read()
        while len(t := np.fromiter((r["micros"] for r in islice(rows, CHUNK_ROWS)), "int64")):
            first, last = self._merged(np.append(first, t), np.append(last, t))
        self.spans.update((first.tolist(), last.tolist(), looked))
        self._look_at(last, looked)
        return iter(())

    def _look_at(self, last: np.ndarray, looked: int) -> None:
        """A timer for the next time that needs a look; timers have milliseconds, so at the first one not before it."""
        due = int(np.where(last + self.stale > looked, last + self.stale, last + self.expired).min())
        self.handle.registerTimer(-(-due // 1000))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        first, last, looked = self._read()
        if not len(last):  # settled by an earlier timer
            return
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        called = (last + self.stale <= passed) & (last + self.stale > looked)
        over = last + self.expired <= passed
        silent = np.append(first[1:] > last[:-1] + self.expired, True)
        if over.all():
            self.spans.clear()
        else:
            left = last[~over]
            self.spans.update((first[~over].tolist(), left.tolist(), passed))
            self._look_at(left, passed)
        yield self.made(*key, last[called].tolist(), last[over & silent].tolist())

    def close(self) -> None:
        pass


def _silence(status: str, seconds: int, last: Column) -> Column:
    at = F.timestamp_micros(last + seconds * 1_000_000)
    return F.struct(F.lit(status).alias("status"), F.timestamp_micros(last).alias("last_seen"), at.alias("at"))


def silent_entities(
    events: DataFrame, by: list[str], ts: str = "ts", stale_seconds: int = STALE_SECONDS, timeout_seconds: int = SESSION_GAP_SECONDS,
    late: str = "1 day",
) -> DataFrame:
    """``by, status, last_seen, at`` in append mode: each silence of an entity that lasts longer than a limit, once.

    ``at`` is the last event plus the limit. Rows later than ``late`` are dropped by the watermark; a silence is emitted when
    the watermark has passed ``at``, so no event that is still accepted can undo it.
    """
    if not 0 < stale_seconds <= timeout_seconds:
        raise ValueError("the stale limit must lie above 0 and not above the timeout")
    use_state_store(events.sparkSession)
    rows = events.withWatermark(ts, late).filter(F.col(ts).isNotNull()).select(*by, ts, F.unix_micros(F.col(ts)).alias("micros"))
    # One row an entity and look, and not one a silence, comes out of the processor.
    times = T.ArrayType(T.LongType())
    schema = T.StructType([*_fields(events, by), T.StructField("stale", times), T.StructField("expired", times)])
    made = rows.groupBy(*by).transformWithState(
        Silence(schema.names, stale_seconds, timeout_seconds), outputStructType=schema, outputMode="Append", timeMode="EventTime")
    limits = (("stale", stale_seconds), ("expired", timeout_seconds))
    silences = [F.transform(status, partial(_silence, status, seconds)) for status, seconds in limits]
    return made.select(*by, F.inline(F.concat(*silences)))
