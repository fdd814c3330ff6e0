"""Running values within ordered groups, whatever the size of a group.

A window keeps a group (a stock-day, mostly) in one task. Groups of more than HOT_ROWS rows are scanned on two levels
instead: their rows are range-partitioned in order, each part is scanned by itself, the last row of each part makes a
summary, and the summaries, a row per group and part, are scanned to give each part what it takes over from those
before it. Parts come from the data's own order and hold about as many rows each, so no task has more than its share,
even if all rows of a group have one time. The other groups take the window, with one shuffle.

Values: ``last`` (the last non-null value up to the row), ``sum`` (of the values up to the row), ``lag`` (the value of
the row before) and ``number`` (the row's number from 1). Both ways give the same rows; sums of floating-point values
may differ in their last bits.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.io import stored

#: Rows of a group that one task scans.
HOT_ROWS = 2_000_000
#: Rows for which a part of its own is planned, at least.
PART_ROWS = 10_000

Values = dict[str, tuple[str, Column | None]]


@dataclass
class Hot:
    """The groups that are scanned on two levels: their keys (None: there are none) and all their rows together."""

    keys: DataFrame | None = None
    rows: int = 0
    most: int = HOT_ROWS


def find_hot(frames: list[DataFrame], keys: list[str], most: int = HOT_ROWS) -> Hot:
    """The groups with more than ``most`` rows in all ``frames`` together; only the keys are read.

    There are at most as many as all rows divided by ``most``, so they may be broadcast.
    """
    counts = [df.groupBy(*keys).agg(F.count("*").alias("__rows")) for df in frames]
    total = reduce(DataFrame.unionByName, counts).groupBy(*keys).agg(F.sum("__rows").alias("__rows")).filter(F.col("__rows") > most)
    held = total.agg(F.sum("__rows")).first()[0]
    return Hot(stored(total.select(*keys), "hot"), held, most) if held else Hot()


def _matched(rows: DataFrame, keys: list[str], other: DataFrame, how: str) -> DataFrame:
    renamed = other.select(*[F.col(c).alias(f"__{c}") for c in keys])
    return rows.join(F.broadcast(renamed), reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in keys]), how)


def _over(kind: str, value: Column | None, window) -> Column:
    upto = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return {"last": lambda: F.last(value, ignorenulls=True).over(upto), "sum": lambda: F.sum(value).over(upto), "lag": lambda: F.lag(value).over(window), "number": lambda: F.row_number().over(window).cast("long")}[kind]()


def _two_levels(rows: DataFrame, keys: list[str], order: list[Column], values: Values, parts: int) -> DataFrame:
    ranged = rows.repartitionByRange(parts, *keys, *order).sortWithinPartitions(*keys, *order)
    placed = ranged.withColumns({"__at": F.monotonically_increasing_id(), "__part": F.spark_partition_id()})
    # each part to a task of its own, in which windows over it need no further exchange
    spread = placed.repartitionById(parts, "__part")
    own = Window.partitionBy(*keys, "__part").orderBy("__at")
    columns = {f"__own_{name}": _over(kind, value, own) for name, (kind, value) in values.items()}
    # what the next part takes over: the value of the last row for ``lag``, the running one otherwise
    columns |= {f"__end_{name}": value for name, (kind, value) in values.items() if kind == "lag"}
    local = stored(spread.withColumns({**columns, "__first": F.row_number().over(own) == 1, "__last": F.lead("__at").over(own).isNull()}), "scan_parts")
    ends = local.filter("__last").select(*[F.col(c).alias(f"__{c}") for c in keys], F.col("__part").alias("__p"), *[F.col(f"__{'end' if kind == 'lag' else 'own'}_{name}").alias(f"__to_{name}") for name, (kind, _) in values.items()])
    chain = Window.partitionBy(*[f"__{c}" for c in keys]).orderBy("__p")
    before = chain.rowsBetween(Window.unboundedPreceding, -1)
    taken = {}
    for name, (kind, _) in values.items():
        held = F.col(f"__to_{name}")
        taken[f"__to_{name}"] = F.last(held, ignorenulls=True).over(before) if kind == "last" else F.lag(held).over(chain) if kind == "lag" else F.sum(held).over(before)
    # a row for each part, and for each group that a part holds: no more than the parts and the groups together
    carried = F.broadcast(ends.withColumns(taken))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in keys], F.col("__part") == F.col("__p"))
    out = {}
    for name, (kind, _) in values.items():
        here, from_before = F.col(f"__own_{name}"), F.col(f"__to_{name}")
        if kind == "last":
            out[name] = F.coalesce(here, from_before)
        elif kind == "lag":
            out[name] = F.when(F.col("__first"), from_before).otherwise(here)
        else:
            out[name] = F.coalesce(here + from_before, here, from_before)
    names = [c for c in rows.columns if c not in values]
    return local.join(carried, same).select(*names, *[v.alias(c) for c, v in out.items()])


def running(rows: DataFrame, keys: list[str], order: list[Column], values: Values, hot: Hot) -> DataFrame:
    """``rows`` with a column for each of ``values``, name -> (kind, column), over the groups of ``keys`` in ``order``.

    A name that ``rows`` has is replaced. ``order`` should leave no ties where a value depends on them.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    names = [c for c in rows.columns if c not in values]

    def plain(df: DataFrame) -> DataFrame:
        return df.select(*names, *[_over(kind, value, window).alias(name) for name, (kind, value) in values.items()])

    if hot.keys is None:
        return plain(rows)
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-hot.rows // max(hot.most, PART_ROWS)))
    large = _two_levels(_matched(rows, keys, hot.keys, "left_semi"), keys, order, values, parts)
    return plain(_matched(rows, keys, hot.keys, "left_anti")).unionByName(large)
