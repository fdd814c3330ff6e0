"""Column names of a five-level limit order book and of trade bars, and expressions over them by name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import numeric as N

LEVELS = 5
BID_PRICES = [f"bb{i}" for i in range(1, LEVELS + 1)]
ASK_PRICES = [f"ba{i}" for i in range(1, LEVELS + 1)]
PRICES = BID_PRICES + ASK_PRICES
VOLUMES = [f"{side}vol{i}" for side in ("bb", "ba") for i in range(1, LEVELS + 1)]
#: Block layout: price and volume of each bid level, then of each ask level.
BOOK = [c for side in ("bb", "ba") for i in range(1, LEVELS + 1) for c in (f"{side}{i}", f"{side}vol{i}")]
BAR_PRICES = ["open", "close", "high", "low", "vwap"]
BARS = [*BAR_PRICES, "vwps", "quantity"]

BOOK_FEATURES = [f"ret_{p}" for p in PRICES] + [f"rvol_{p}" for p in PRICES] + ["mid_chg", "tvol_chg"]
TRADE_FEATURES = [f"ret_{p}" for p in BAR_PRICES] + ["cumvol_chg", "vwps"]
CLOSING_FEATURES = BOOK_FEATURES + TRADE_FEATURES
#: Intraday: price return and relative volume of each level side by side, then the two changes.
INTRADAY_FEATURES = [c for p in [x for i in (BID_PRICES, ASK_PRICES) for x in i] for c in (f"ret_{p}", f"rvol_{p}")] + ["mid_chg", "tvol_chg"]

TRADES_SCHEMA = T.StructType([T.StructField("t", T.StringType()), T.StructField("price", T.DoubleType()), T.StructField("quantity", T.LongType()), T.StructField("flag", T.StringType())])
BOOK_COLUMNS_MOCK = [c for i in range(1, LEVELS + 1) for c in (f"bb{i}", f"bbvol{i}", f"ba{i}", f"bavol{i}")]


def mid_price() -> Column:
    return N.mid(F.col("bb1"), F.col("ba1"))


def total_volume() -> Column:
    return N.total([F.col(v) for v in VOLUMES])


def price_return(price: str) -> Column:
    """ln(price / mid)."""
    return N.log_return(F.col(price), mid_price())


def relative_volume(volume: str) -> Column:
    """Share of the row's total volume; NaN where the total is zero."""
    return N.ieee_div(F.col(volume), total_volume())


def volume_of(price: str) -> str:
    return f"{price[:2]}vol{price[2:]}"


def prev_business_day(date: Column) -> Column:
    """Monday gives Friday; any other day, weekends included, the day before."""
    return F.when(F.dayofweek(date) == 2, F.date_sub(date, 3)).otherwise(F.date_sub(date, 1))
