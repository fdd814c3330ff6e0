"""Intraday features and labels: interleaved book features, rolling mid labels, sliding sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import book as B
from ..functions import numeric as N
from .clean import DAY
from .features import backwards, clock, has_gap, with_changes
from .scan import HOT_ROWS, find_hot


def intraday_rows(book: DataFrame, most: int = HOT_ROWS) -> DataFrame:
    """The 22 intraday features of every snapshot; changes are 0 on a day's first row. Prices stay untouched for the labels."""
    rows = book.withColumns({"mid": B.mid_price(), "tvol": B.total_volume()})
    level = {f"ret_{p}": N.log_return(F.col(p), F.col("mid")) for p in B.PRICES} | {f"rvol_{p}": N.ieee_div(F.col(B.volume_of(p)), F.col("tvol")) for p in B.PRICES}
    return with_changes(rows, find_hot([book], DAY, most)).withColumns(level).select(*DAY, "t", "mid", *B.INTRADAY_FEATURES)


def rolling_mid(rows: DataFrame, horizon: int) -> DataFrame:
    """``avg_mid``: mean of the last ``horizon`` mids, NULL before there are as many."""
    frame = clock().rowsBetween(-(horizon - 1), Window.currentRow)
    return rows.withColumn("avg_mid", F.when(F.count("mid").over(frame) == horizon, F.avg("mid").over(frame)))


def rolling_label(rows: DataFrame, horizon: int) -> DataFrame:
    """``y`` = ln(mean mid of the next ``horizon`` rows / of the last ``horizon`` rows); NULL where either is incomplete."""
    return rolling_mid(rows, horizon).withColumn("y", N.log_return(F.lead("avg_mid", horizon).over(clock()), F.col("avg_mid")))


def anchors(rows: DataFrame, horizon: int, sequence: int, keep: int) -> DataFrame:
    """``is_anchor``: the last ``keep`` rows of a day at which a whole sequence ends and a whole horizon follows."""
    numbered = rows.withColumns({"__at": F.row_number().over(clock()), "__back": F.row_number().over(backwards())})
    is_anchor = (F.col("__at") >= sequence) & (F.col("__back") > horizon) & (F.col("__back") <= horizon + keep)
    return numbered.withColumn("is_anchor", is_anchor).drop("__at", "__back")


def sliding_sequences(rows: DataFrame, columns: list[str], horizon: int, sequence: int, keep: int) -> DataFrame:
    """One row per anchor with ``x``: the ``sequence`` rows up to it, float32.

    Rows that no kept sequence reaches are dropped; the others of a stock-day make one ordered list, which is sliced
    at each anchor, so a stock-day needs ``sequence + keep + horizon`` rows of memory and each anchor its own sequence.
    """
    back = F.row_number().over(backwards())
    near = anchors(rows, horizon, sequence, keep).withColumn("__near", back).filter(F.col("__near") <= horizon + keep + sequence).drop("__near")
    others = [c for c in rows.columns if c == "y"]
    step = F.struct("t", "is_anchor", *others, F.array(*[F.col(c).cast("float") for c in columns]).alias("v"))
    tail = near.groupBy(*DAY).agg(F.array_sort(F.collect_list(step)).alias("__tail"))
    at = F.filter(F.sequence(F.lit(1), F.size("__tail")), lambda i: F.get("__tail", i - 1)["is_anchor"])
    ends = tail.withColumn("__end", F.explode(at))
    own = F.element_at("__tail", F.col("__end"))
    return ends.select(*DAY, own["t"].alias("anchor_t"), F.slice(F.col("__tail.v"), F.col("__end") - sequence + 1, F.lit(sequence)).alias("x"), *[own[c].alias(c) for c in others])


def intraday_samples(book: DataFrame, sequence: int = 360, horizon: int = 5, keep: int = 1) -> DataFrame:
    """(stock_id, date, anchor_t, x, y) of all anchors without a missing value in x or y."""
    rows = rolling_label(intraday_rows(book), horizon)
    upto = clock().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("__no", F.row_number().over(clock()))
    last_gap = F.last(F.when(has_gap(B.INTRADAY_FEATURES), F.col("__no")), ignorenulls=True).over(upto)
    whole = F.col("__no") - F.coalesce(last_gap, F.lit(0)) >= sequence
    rows = rows.withColumn("y", F.when(whole, F.col("y"))).drop("__no")
    out = sliding_sequences(rows, B.INTRADAY_FEATURES, horizon, sequence, keep)
    return out.filter(~has_gap(["y"])).withColumn("y", F.col("y").cast("float").cast("double"))
