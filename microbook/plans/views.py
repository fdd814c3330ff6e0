"""Order-book inputs made from the driver's tables: each view once for Spark and once as SQL text for DuckDB.

trades: from ``events``; stock = user modulo 10, quantity from ``props``, file order = (t, event_id).
session_trades: the same, with the first and last two rows of each stock-day as auction rows.
book: hourly snapshots of every stock-day with trades, by formula, exact in binary, with gaps and zeros to repair.
samples: from ``embeddings``, 8 steps of 8 features. predictions: from ``lineitem``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import book as B

REJECT = "(sid + dom) % 17 = 0"


def _level(side: str, i: int) -> tuple[str, str]:
    sign = "-" if side == "bb" else "+"
    price = f"cast(m {sign} {0.5 * i} as double)"
    volume = f"cast({10 if side == 'bb' else 12} * {i} + h as double)"
    if i == 1:
        return (f"case when {REJECT} then cast(0 as double) else {price} end" if side == "bb" else price), volume
    k = f"(h + {i} + sid)"
    return f"case when {k} % 6 = 0 then null when {k} % 7 = 0 then cast(0 as double) else {price} end", f"case when {k} % 8 = 0 then null else {volume} end"


BOOK_COLUMNS_SQL = ", ".join(f"{p} as {side}{i}, {v} as {side}vol{i}" for side in ("bb", "ba") for i in range(1, B.LEVELS + 1) for p, v in [_level(side, i)])


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    flag = F.when(F.col("event_type") == "signup", "AUCTION").when(F.col("event_type") == "error", "OTHER").otherwise("NORMAL")
    return e.select(
        (F.col("user_id") % 10).cast("string").alias("stock_id"), F.col("event_id").alias("ord"), F.col("ts").alias("t"), F.to_date("ts").alias("date"),
        F.col("value").alias("price"), F.get_json_object("props", "$.k").cast("long").alias("quantity"), flag.alias("flag"),
    )


def session_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = Window.partitionBy("stock_id", "date")
    rows = trades(spark, sf_dir).withColumns({"__a": F.row_number().over(day.orderBy("t", "ord")), "__b": F.row_number().over(day.orderBy(F.desc("t"), F.desc("ord")))})
    return rows.withColumn("flag", F.when((F.col("__a") <= 2) | (F.col("__b") <= 2), "AUCTION").otherwise("NORMAL")).drop("__a", "__b")


def book(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = trades(spark, sf_dir).select("stock_id", "date").distinct()
    hours = days.select("stock_id", "date", F.explode(F.sequence(F.lit(1), F.lit(23))).alias("h"), F.col("stock_id").cast("int").alias("sid"), F.dayofmonth("date").alias("dom"))
    hours = hours.withColumns({"t": F.expr("cast(date as timestamp_ntz) + make_interval(0, 0, 0, 0, h, 0, 0)"), "m": F.expr("100 + sid * 10 + ((h * 7 + dom * 3) % 11) - 5")})
    return hours.selectExpr("stock_id", "date", "t", "'q' as nature", *[x.strip() for x in BOOK_COLUMNS_SQL.split(", ")])


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    x = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda s: F.slice(F.col("embedding"), s * 8 + 1, F.lit(8)))
    return e.select((F.col("vec_id") % 10).cast("int").alias("date"), F.col("vec_id").alias("stock_id"), x.alias("x"), F.when(F.col("label") > 4, 1.0).otherwise(-1.0).alias("y"), F.get("embedding", 0).cast("double").alias("z1"), F.get("embedding", 1).cast("double").alias("z2"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return rows.select(F.to_date("l_shipdate").alias("date"), (F.col("l_discount") * 20 - 1).alias("logit"), ((F.col("l_tax") - 0.04) / 10).alias("y"), "l_orderkey", "l_linenumber")


TRADES_SQL = """trades as (select cast(user_id % 10 as varchar) as stock_id, event_id as ord, ts as t, cast(ts as date) as date, value as price,
  cast(regexp_extract(props, '"k": *(-?[0-9]+)', 1) as bigint) as quantity,
  case event_type when 'signup' then 'AUCTION' when 'error' then 'OTHER' else 'NORMAL' end as flag from events)"""

SESSION_SQL = (
    TRADES_SQL
    + """, session as (select stock_id, ord, t, date, price, quantity, case when row_number() over (partition by stock_id, date order by t, ord) <= 2
  or row_number() over (partition by stock_id, date order by t desc, ord desc) <= 2 then 'AUCTION' else 'NORMAL' end as flag from trades)"""
)

BOOK_SQL = f"""hours as (select stock_id, date, h, cast(stock_id as int) as sid, day(date) as dom, date + to_hours(cast(h as int)) as t
  from (select distinct stock_id, date from trades), range(1, 24) r(h)),
marked as (select *, 100 + sid * 10 + ((h * 7 + dom * 3) % 11) - 5 as m from hours),
book as (select stock_id, date, t, {BOOK_COLUMNS_SQL} from marked)"""


def _repaired() -> str:
    out = []
    for side in ("bb", "ba"):
        last = f"{side}1"
        out.append(f"{side}1, {side}vol1")
        for i in range(2, B.LEVELS + 1):
            last = f"coalesce(nullif({side}{i}, 0), {last})"
            out.append(f"{last} as {side}{i}, coalesce({side}vol{i}, 0) as {side}vol{i}")
    return ", ".join(out)


REPAIR_SQL = f"repaired as (select stock_id, date, t, {_repaired()} from book)"
_BAD = " or ".join(f"{p} is null or {p} <= 0 or {p} > 1e6" for p in B.PRICES)
CLEAN_SQL = f"{BOOK_SQL}, {REPAIR_SQL}, rejected as (select distinct stock_id, date from repaired where {_BAD}), clean as (select r.* from repaired r anti join rejected x on r.stock_id = x.stock_id and r.date = x.date)"


def bars_sql(source: str) -> str:
    """CTEs binned, bars, filled: NORMAL rows of ``source`` on the clock of ``clean``."""
    return f"""binned as (select a.*, b.t as bar_t from (select * from {source} where flag = 'NORMAL') a asof join clean b on a.stock_id = b.stock_id and a.date = b.date and a.t <= b.t),
vw as (select *, sum(price * quantity) over w / nullif(sum(quantity) over w, 0) as mean from binned window w as (partition by stock_id, date, bar_t)),
agg as (select stock_id, date, bar_t as t, arg_min(price, (t, ord)) as open, arg_max(price, (t, ord)) as close, max(price) as high, min(price) as low,
  sum(price * quantity order by t, ord) / nullif(sum(quantity), 0) as vwap, sqrt(sum(quantity * (price - mean) * (price - mean) order by t, ord) / greatest(sum(quantity) - 1, 1)) as vwps, cast(sum(quantity) as bigint) as quantity
  from vw group by stock_id, date, bar_t),
traded as (select stock_id, date, t, quantity, {", ".join(f"case when quantity <> 0 then {c} end as {c}" for c in ("open", "close", "high", "low", "vwap", "vwps"))} from agg),
bars as (select c.stock_id, c.date, c.t, open, close, high, low, vwap, vwps, coalesce(quantity, 0) as quantity from clean c left join traded a on c.stock_id = a.stock_id and c.date = a.date and c.t = a.t),
ffill as (select *, last_value(vwap ignore nulls) over (partition by stock_id, date order by t rows between unbounded preceding and current row) as fv from bars),
filled as (select stock_id, date, t, coalesce(open, fv) as open, coalesce(close, fv) as close, coalesce(high, fv) as high, coalesce(low, fv) as low, fv as vwap, coalesce(vwps, 0) as vwps, quantity from ffill)"""


def auctions_sql(source: str) -> str:
    """CTEs phases, auctions."""
    return f"""numbered as (select *, row_number() over (partition by stock_id, date order by t, ord) as rn from {source} where flag in ('NORMAL', 'AUCTION')),
edged as (select *, min(case when flag = 'NORMAL' then rn end) over d as f, max(case when flag = 'NORMAL' then rn end) over d as l, count(*) over d as n from numbered window d as (partition by stock_id, date)),
phases as (select *, case when rn < f then 'open' when rn > l then 'close' end as phase from edged where f > 1 and l < n),
auctions as (select stock_id, date, arg_min(price, rn) filter (phase = 'open') as open_price, cast(sum(quantity) filter (phase = 'open') as bigint) as open_qty,
  arg_min(price, rn) filter (phase = 'close') as close_price, cast(sum(quantity) filter (phase = 'close') as bigint) as close_qty from phases group by stock_id, date)"""


SAMPLES_SQL = """samples as (select cast(vec_id % 10 as int) as date, vec_id as stock_id, embedding as e, case when label > 4 then 1.0 else -1.0 end as y from embeddings)"""
PREDICTIONS_SQL = "predictions as (select cast(l_shipdate as date) as date, l_discount * 20 - 1 as logit, (l_tax - 0.04) / 10 as y, l_orderkey, l_linenumber from lineitem)"
