"""Bars of trading sessions on a clock of fixed intervals, from a stream or a table, empty intervals filled.

A stock-day's bars run from the interval of its first trade to the end of its session. In a stream each open interval
is a few numbers, into which trades are merged as they come (first and last by time, weighted mean and sum of squared
deviations), whatever their number; a timer at the interval's end gives the bar out when the watermark has passed it,
with the last known VWAP where no trade fell into it. The open intervals of a stock-day lie between the watermark and
its newest trade, so its state has a bound given by how late trades may be, and it is cleared at the session's end.
Trades that come after the watermark are dropped. The table's bars are those of the batch operators.

The stream needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``).
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import book as B
from ..operators.bars import aggregate_bars, fill_bars
from ..operators.clean import DAY, normal_trades
from ..operators.scan import Hot

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SECOND = 1_000_000
OUT = "stock_id string, date date, at long, open double, close double, high double, low double, vwap double, vwps double, quantity long"


def merged(bar: tuple | None, at: int, order: int, price: float, quantity: int) -> tuple:
    """A bar (first and last place and price, high, low, quantity, mean, m2) with one more trade."""
    if bar is None:
        return (at, order, price, at, order, price, price, price, quantity, price if quantity else 0.0, 0.0)
    t0, o0, first, t1, o1, last, high, low, held, mean, m2 = bar
    if (at, order) < (t0, o0):
        t0, o0, first = at, order, price
    if (at, order) >= (t1, o1):
        t1, o1, last = at, order, price
    total = held + quantity
    if quantity and not held:
        mean, m2 = price, 0.0
    elif quantity and total:
        apart = price - mean
        mean += apart * quantity / total
        m2 += quantity * apart * (price - mean)
    return (t0, o0, first, t1, o1, last, max(high, price), min(low, price), total, mean, m2)


class SessionBars(StatefulProcessor):
    """Bars of one stock-day; times are microseconds."""

    def __init__(self, interval: int):
        self.interval = interval

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # what is open, by interval's end
        self.bars = handle.getMapState("bars", "at long", "t0 long, o0 long, first double, t1 long, o1 long, last double, high double, low double, quantity long, mean double, m2 double")
        # the next interval to give out, the session's end, the last known VWAP
        self.clock = handle.getValueState("clock", "next long, until long, vwap double")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held: dict[int, tuple | None] = {}
        until = None
        for r in rows:
            end = -(-r["us"] // self.interval) * self.interval
            if end not in held:
                held[end] = tuple(self.bars.getValue((end,))) if self.bars.containsKey((end,)) else None
            held[end] = merged(held[end], r["us"], r["ord"], r["price"], r["quantity"])
            until = r["until"]
        for end, bar in held.items():
            self.bars.updateValue((end,), bar)
        if held:
            clock = tuple(self.clock.get()) if self.clock.exists() else None
            first = min(held) if clock is None or clock[2] is None and min(held) < clock[0] else clock[0]
            self.clock.update((first, until, clock[2] if clock else None))
            self.handle.registerTimer(first // 1000)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if not self.clock.exists():
            return
        at, until, vwap = tuple(self.clock.get())
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        while at <= min(passed, until):
            bar = tuple(self.bars.getValue((at,))) if self.bars.containsKey((at,)) else None
            if bar is not None:
                self.bars.removeKey((at,))
            if bar is not None and bar[8]:
                vwap = bar[9]
                yield Row(stock_id=key[0], date=key[1], at=at, open=bar[2], close=bar[5], high=bar[6], low=bar[7], vwap=vwap, vwps=(max(bar[10], 0.0) / max(bar[8] - 1, 1)) ** 0.5, quantity=bar[8])
            else:
                yield Row(stock_id=key[0], date=key[1], at=at, open=vwap, close=vwap, high=vwap, low=vwap, vwap=vwap, vwps=0.0, quantity=0)
            at += self.interval
        if at > until:
            self.clock.clear()
            self.bars.clear()
        else:
            self.clock.update((at, until, vwap))
            self.handle.registerTimer(at // 1000)

    def close(self) -> None:
        pass


def session_bars(trades: DataFrame, interval: int = 60, session_end: int = 86_400, late: str = "5 minutes") -> DataFrame:
    """(stock_id, date, t, open, close, high, low, vwap, vwps, quantity): bars of ``interval`` seconds of the NORMAL trades.

    t is an interval's end, which belongs to it; bars before a day's first volume have no prices. ``session_end`` counts
    seconds from midnight; later trades are left out. A stream gives the bars in append mode.
    """
    step = interval * SECOND
    midnight = F.unix_micros(F.col("date").cast("timestamp"))
    rows = normal_trades(trades).withColumns({"us": F.unix_micros("t"), "until": midnight + F.lit(session_end * SECOND)})
    rows = rows.filter(F.ceil(F.col("us") / step) * step <= F.col("until"))
    if trades.isStreaming:
        own = rows.withWatermark("t", late).select(*DAY, "t", "us", F.col("ord").cast("long").alias("ord"), F.col("price").cast("double").alias("price"), F.col("quantity").cast("long").alias("quantity"), "until")
        out = own.groupBy(*DAY).transformWithState(SessionBars(step), OUT, "Append", "EventTime")
    else:
        binned = rows.withColumn("bar_t", F.timestamp_micros((F.ceil(F.col("us") / step) * step).cast("long")))
        bars = aggregate_bars(binned.drop("us", "until"))
        first = rows.groupBy(*DAY).agg((F.ceil(F.min("us") / step) * step).cast("long").alias("first"), F.max("until").alias("until"))
        clock = first.select(*DAY, F.explode(F.sequence("first", "until", F.lit(step))).alias("at")).select(*DAY, F.timestamp_micros("at").alias("t"))
        # a day has no more intervals than its seconds
        return fill_bars(clock.join(bars, [*DAY, "t"], "left"), Hot()).select(*DAY, "t", *B.BARS)
    return out.select(*DAY, F.timestamp_micros("at").alias("t"), *B.BARS)
