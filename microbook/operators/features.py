"""Closing-auction features, label and previous-day inputs, in long form (one row per snapshot) and as samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions import book as B
from ..functions import numeric as N
from .clean import DAY
from .scan import HOT_ROWS, Hot, find_hot, running


def clock() -> WindowSpec:
    """A stock-day in time order."""
    return Window.partitionBy(*DAY).orderBy("t")


def backwards() -> WindowSpec:
    return Window.partitionBy(*DAY).orderBy(F.desc("t"))


def join_book_bars(book: DataFrame, bars: DataFrame) -> DataFrame:
    """Full outer join on the clock; equal to an inner one when the bars came from the same book."""
    return book.join(bars, [*DAY, "t"], "full")


def with_auctions(rows: DataFrame, auctions: DataFrame) -> DataFrame:
    """Rows of the stock-days that have auctions, with their prices and quantities."""
    return rows.join(auctions, DAY)


def fill_from_open(rows: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Missing values (bars before the first trade) take the opening auction's price."""
    return rows.withColumns({c: F.coalesce(F.col(c), F.col("open_price")) for c in columns or B.BARS})


def with_changes(rows: DataFrame, hot: Hot, first: Column | None = None, traded: bool = False) -> DataFrame:
    """Adds the log changes of a stock-day's rows in time order, from one scan over them.

    ``mid_chg``: ln(mid / mid before); the day's first row compares with ``first`` (the opening price), and is 0
    without one. ``tvol_chg``: of the book's total volume, 0 on the first row. With ``traded``, ``cumvol_chg``: of the
    volume traded so far plus the opening auction's; the first row compares with the auction alone.
    """
    values = {"__no": ("number", None), "__mid": ("lag", F.col("mid")), "__tvol": ("lag", F.col("tvol"))}
    if traded:
        values["__traded"] = ("sum", F.col("quantity"))
    is_first = F.col("__no") == 1
    opening = F.lit(0.0) if first is None else F.when(first.isNull(), F.lit(0.0)).otherwise(N.log_return(F.col("mid"), first))
    out = {
        "mid_chg": F.when(is_first, opening).otherwise(N.log_return(F.col("mid"), F.col("__mid"))),
        "tvol_chg": F.when(is_first, F.lit(0.0)).otherwise(N.log_return(F.col("tvol"), F.col("__tvol"))),
    }
    if traded:
        now = F.col("__traded") + F.col("open_qty")
        out["cumvol_chg"] = N.log_return(now.cast("double"), (now - F.col("quantity")).cast("double"))
    return running(rows, DAY, [F.col("t")], values, hot).withColumns(out).drop(*values)


def closing_rows(book: DataFrame, bars: DataFrame, auctions: DataFrame, most: int = HOT_ROWS) -> DataFrame:
    """All 29 closing features of every snapshot, by name; book, bars and auctions meet on one partitioning by stock-day.

    Stock-days of over ``most`` snapshots are scanned by several tasks.
    """
    rows = fill_from_open(with_auctions(join_book_bars(book, bars), auctions))
    rows = rows.withColumns({"mid": B.mid_price(), "tvol": B.total_volume()})
    returns = {f"ret_{p}": N.log_return(F.col(p), F.col("mid")) for p in [*B.PRICES, *B.BAR_PRICES]}
    shares = {f"rvol_{p}": N.ieee_div(F.col(B.volume_of(p)), F.col("tvol")) for p in B.PRICES}
    changed = with_changes(rows, find_hot([book], DAY, most), F.col("open_price"), traded=True)
    return changed.withColumns({**returns, **shares}).select(*DAY, "t", *B.CLOSING_FEATURES)


def last_rows(rows: DataFrame, n: int) -> DataFrame:
    """The last n rows of the stock-days that have at least n."""
    day = Window.partitionBy(*DAY)
    kept = rows.withColumns({"__back": F.row_number().over(backwards()), "__n": F.count("*").over(day)})
    return kept.filter((F.col("__n") >= n) & (F.col("__back") <= n)).drop("__back", "__n")


def has_gap(columns: list[str]) -> Column:
    """NULL or NaN in any of the columns; infinities pass."""
    return F.exists(F.array(*[F.col(c).cast("double") for c in columns]), lambda v: v.isNull() | F.isnan(v))


def complete_days(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of the stock-days without a missing value in any row."""
    gap = F.bool_or(has_gap(columns)).over(Window.partitionBy(*DAY))
    return rows.withColumn("__gap", gap).filter("not __gap").drop("__gap")


def closing_features(book: DataFrame, bars: DataFrame, auctions: DataFrame, sequence: int) -> DataFrame:
    """The last ``sequence`` feature rows of each stock-day that has as many and no missing value in them."""
    return complete_days(last_rows(closing_rows(book, bars, auctions), sequence), B.CLOSING_FEATURES)


def as_samples(rows: DataFrame, columns: list[str], keys: list[str] | None = None, time: str = "t") -> DataFrame:
    """One row per sample with ``x``: float32 steps by features, in time order."""
    keys = keys or DAY
    step = F.struct(F.col(time), F.array(*[F.col(c).cast("float") for c in columns]).alias("v"))
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_list(step)).alias("s")).select(*keys, F.col("s.v").alias("x"))


def closing_label(book: DataFrame, auctions: DataFrame, horizon: int) -> DataFrame:
    """y = ln(closing price / mean mid of the last ``horizon`` snapshots); stock-days with fewer snapshots have no label."""
    rows = last_rows(book.withColumn("mid", B.mid_price()).select(*DAY, "t", "mid"), horizon)
    means = rows.groupBy(*DAY).agg(F.avg("mid").alias("mean_mid"))
    return means.join(auctions, DAY).select(*DAY, N.log_return(F.col("close_price"), F.col("mean_mid")).alias("y"))


def exogenous(labels: DataFrame, auctions: DataFrame) -> DataFrame:
    """z1 = the previous business day's label; z2 = ln(opening price / previous day's closing price). No earlier day is searched."""
    before = labels.select("stock_id", F.col("date").alias("prev_date"), F.col("y").alias("z1"))
    prices = auctions.select("stock_id", F.col("date").alias("prev_date"), F.col("close_price").alias("prev_close"))
    today = auctions.select(*DAY, "open_price").withColumn("prev_date", B.prev_business_day(F.col("date")))
    joined = today.join(before, ["stock_id", "prev_date"]).join(prices, ["stock_id", "prev_date"])
    return joined.select(*DAY, "z1", N.log_return(F.col("open_price"), F.col("prev_close")).alias("z2"))


def closing_samples(book: DataFrame, bars: DataFrame, auctions: DataFrame, sequence: int = 360, horizon: int = 5) -> DataFrame:
    """(stock_id, date, x, y, z1, z2) of every stock-day that has all of them without a missing value."""
    x = as_samples(closing_features(book, bars, auctions, sequence), B.CLOSING_FEATURES)
    labels = closing_label(book, auctions, horizon)
    z = exogenous(labels, auctions)
    out = x.join(labels, DAY).join(z, DAY)
    return out.filter(~has_gap(["y", "z1", "z2"]))
