"""A moving-window limit of requests, decided request by request, over a table or a stream.

A request is admitted if fewer than `limit` requests of its client, admitted or not, came before it within the window. Requests
stand in the order of time, then id. Requests without a time are left out; those without a client are one client's.

The stream holds a request back until the watermark has passed its time, so requests that come late, but within the lateness, are
judged in their place, and the answers equal the table's. Its state is the requests held back and, for each client, at most `limit`
times; a timer settles what the watermark has passed, and another drops what has run out of the window. Clients are dealt into buckets that
are judged as a whole, since Python is called, and the state asked, once for each key: that is then bounded by the buckets, not by the clients.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BinaryType, StructField, StructType

from .serving import LATENESS, REQUEST_LIMIT

MINUTE = 60
#: Into so many parts a stream's clients are dealt; fixed for a stream's life.
BUCKETS = 4096
HELD = pa.schema([("client", pa.string()), ("request", pa.string()), ("us", pa.int64())])
#: transformWithState needs this provider; it has to be set before a stream with state starts.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


@contextmanager
def state_store(spark: SparkSession):
    """The session with STATE_STORE set; streams keep what is set when they start."""
    name, provider = STATE_STORE
    before = spark.conf.get(name)
    spark.conf.set(name, provider)
    try:
        yield spark
    finally:
        spark.conf.set(name, before)


def _requests(events: DataFrame, client: str, request: str, ts: str) -> DataFrame:
    return events.select(F.col(client).cast("string").alias("client"), F.col(request).cast("string").alias("request"), F.col(ts).cast("timestamp").alias("ts")).filter("ts is not null")


def decided(events: DataFrame, client: str, request: str, limit: int = REQUEST_LIMIT, ts: str = "ts", seconds: int = MINUTE) -> DataFrame:
    """(client, request, ts, earlier, admitted) of every request of a table.

    Every request is judged in its own stretch of time and counted in the next one too, since a window reaches into one stretch
    before its own. So a client's requests meet in one task by stretches only, however many there are.
    """
    width = seconds * 1_000_000
    rows = _requests(events, client, request, ts).withColumn("us", F.unix_micros("ts"))
    own = F.floor(F.col("us") / width)
    rows = rows.withColumn("own", own).withColumn("stretch", F.explode(F.array(F.col("own"), F.col("own") + 1)))
    stretch = Window.partitionBy("client", "stretch")
    before = F.row_number().over(stretch.orderBy("us", "request")) - 1
    gone = F.count("*").over(stretch.orderBy("us").rangeBetween(Window.unboundedPreceding, -width))
    counted = rows.withColumn("earlier", (before - gone).cast("long")).filter("own = stretch")
    return counted.select("client", "request", "ts", "earlier", (F.col("earlier") < limit).alias("admitted"))


def _packed(rows: pa.Table) -> tuple[bytes]:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, HELD) as out:
        out.write_table(rows)
    return (sink.getvalue().to_pybytes(),)


def _unpacked(state) -> pa.Table:
    parts = [pa.ipc.open_stream(bytes(batch)).read_all() for (batch,) in state.get()] if state.exists() else []
    return pa.concat_tables([HELD.empty_table(), *parts])


class MovingWindow(StatefulProcessor):
    """Decisions for a bucket of clients at a time: `held` are requests that the watermark has not passed, `last` each client's latest of those it has, as Arrow streams."""

    def __init__(self, limit: int, seconds: int):
        self.limit, self.width = limit, seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, batches = handle, StructType([StructField("batch", BinaryType())])
        self.held, self.last = handle.getListState("held", batches), handle.getListState("last", batches)

    def _wake(self, us: int) -> None:
        """Exactly one timer, at the millisecond that holds a time."""
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(us // 1000 + 1)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        fresh = pa.concat_tables([pa.Table.from_pandas(part[HELD.names], schema=HELD, preserve_index=False) for part in rows])
        if fresh.num_rows:
            self.held.appendValue(_packed(fresh))
            first = pc.min(fresh["us"]).as_py()
            if not any(timer <= first // 1000 for timer in self.handle.listTimers()):  # one that fires earlier sets the next
                self._wake(first)
        return iter(())

    def _judged(self, last: pa.Table, ready: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray]:
        """(both in order of client, time and request; which were ready, which of them are admitted, which are among their client's latest)."""
        both = pa.concat_tables([last, ready]).combine_chunks()
        now = pa.array(np.arange(both.num_rows) >= last.num_rows)
        order = pc.sort_indices(both.append_column("now", now), sort_keys=[(c, "ascending") for c in ("client", "us", "now", "request")], null_placement="at_start")
        both, now = both.take(order), np.asarray(now.take(order))
        client = both["client"].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        us, n = both["us"].to_numpy(), both.num_rows
        full, latest = np.zeros(n, bool), np.ones(n, bool)
        if n > self.limit:
            same = client[self.limit :] == client[: -self.limit]
            full[self.limit :] = same & (us[: -self.limit] > us[self.limit :] - self.width)
            latest[: -self.limit] = ~same
        return both, now, ~full, latest

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        held = _unpacked(self.held)
        ready = pc.less_equal(held["us"], passed)
        both, now, admitted, latest = self._judged(_unpacked(self.last), held.filter(ready))
        rest, last = held.filter(pc.invert(ready)), both.filter(pa.array(latest & (both["us"].to_numpy() > passed - self.width)))
        for state, values in ((self.held, rest), (self.last, last)):
            if values.num_rows:
                state.put([_packed(values)])
            else:
                state.clear()
        if rest.num_rows:
            self._wake(pc.min(rest["us"]).as_py())
        elif last.num_rows:
            self._wake(pc.max(last["us"]).as_py() + self.width)
        if now.any():
            yield both.append_column("admitted", pa.array(admitted)).filter(pa.array(now)).to_pandas()

    def close(self) -> None:
        pass


def decided_stream(events: DataFrame, client: str, request: str, limit: int = REQUEST_LIMIT, ts: str = "ts", seconds: int = MINUTE, lateness: str = LATENESS, buckets: int = BUCKETS) -> DataFrame:
    """(client, request, ts, admitted) of a stream, each request once the watermark has passed it. Needs STATE_STORE."""
    if limit < 1:
        raise ValueError("a limit admits at least one request")
    rows = _requests(events, client, request, ts).withWatermark("ts", lateness)
    rows = rows.select(F.pmod(F.xxhash64("client"), F.lit(buckets)).alias("bucket"), "client", "request", "ts", F.unix_micros("ts").alias("us"))
    out = rows.groupBy("bucket").transformWithStateInPandas(MovingWindow(limit, seconds), "client string, request string, us long, admitted boolean", "append", "EventTime")
    return out.select("client", "request", F.timestamp_micros("us").alias("ts"), "admitted")
