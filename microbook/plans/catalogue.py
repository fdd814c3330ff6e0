"""Queries over the driver's tables, by name, with the same result as DuckDB SQL in ``ORACLE_SQL``.

Times and dates are returned as text, floating-point results are rounded to six decimals.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import book as B
from ..functions import numeric as N
from ..models import scoring, search
from ..operators import auction, bars, clean, dataset, features, intraday, metrics, normalize, scan
from ..sources import fixtures, io
from ..sources.studies import Study
from ..streaming import sessions
from . import views as V

SEQUENCE, HORIZON, KEEP, DAYS = 10, 3, 2, 3
THRESHOLD = 0.6

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def _shown(df: DataFrame) -> DataFrame:
    """Times and dates as text, doubles rounded."""

    def one(name: str, kind: str) -> Column:
        if kind in ("timestamp_ntz", "timestamp"):
            return F.date_format(name, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(name)
        if kind == "date":
            return F.col(name).cast("string").alias(name)
        if kind in ("double", "float"):
            return (F.round(F.col(name).cast("double"), 6) + 0.0).alias(name)
        return F.col(name)

    return df.select(*[one(n, k) for n, k in df.dtypes])


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: _shown(f(spark, sf_dir))
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


_TS = "strftime({0}, '%Y-%m-%d %H:%M:%S.%f') as {1}"
_KEY = "stock_id, cast(date as varchar) as date"
_T = _TS.format("t", "t")
_BOOK = ", ".join(f"round({c}, 6) as {c}" for c in B.BOOK)


def r(*names: str) -> str:
    return ", ".join(f"round({c}, 6) + 0.0 as {c}" for c in names)


# scans and pruning


@query("scan_trades", f"with {V.TRADES_SQL} select {_KEY}, {_T}, ord, round(price, 6) as price, quantity, flag from trades")
def scan_trades(spark, d):
    return V.trades(spark, d).select("stock_id", "date", "t", "ord", "price", "quantity", "flag")


@query("scan_book", f"with {V.TRADES_SQL}, {V.BOOK_SQL} select {_KEY}, {_T}, {_BOOK} from book")
def scan_book(spark, d):
    return V.book(spark, d).drop("nature")


@query("month_prune", f"with {V.TRADES_SQL} select {_KEY}, count(*) as n from trades where strftime(date, '%Y-%m') in ('2024-01', '2024-02') and stock_id in ('1', '2', '7') group by all")
def month_prune(spark, d):
    rows = io.in_months(V.trades(spark, d), (2024, 1), (2024, 2), ["1", "2", "7"])
    return rows.groupBy("stock_id", "date").agg(F.count("*").alias("n"))


@query("month_range", "select strftime(m, '%Y-%m') as month from (select unnest(generate_series(date '2023-11-01', date '2024-03-01', interval 1 month)) as m)")
def month_range(spark, d):
    return io.month_range(spark, (2023, 11), (2024, 3))


@query("time_formats", f"select event_id, {_TS.format('case event_id % 5 when 0 then ts when 2 then ts when 4 then null else make_timestamp(epoch_us(ts) // 1000000 * 1000000) end', 't')} from events")
def time_formats(spark, d):
    rows = V.events(spark, d).select("event_id", F.col("ts").alias("s"))
    patterns = ["yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'", "yyyy-MM-dd'T'HH:mm:ss'+00:00'", "yyyy-MM-dd HH:mm:ss.SSSSSS", "yyyy-MM-dd HH:mm:ss", "dd.MM.yyyy HH:mm"]
    text = F.coalesce(*[F.when(F.col("event_id") % 5 == i, F.date_format("s", p)) for i, p in enumerate(patterns)])
    return rows.select("event_id", io.parse_time(text).alias("t"))


@query("stock_of_file", r"select event_id, user_id % 10 || case when event_id % 2 = 0 then 'x' else '-1' end as stock_id from events")
def stock_of_file(spark, d):
    stock = F.concat((F.col("user_id") % 10).cast("string"), F.when(F.col("event_id") % 2 == 0, "x").otherwise("-1"))
    path = F.concat(F.lit("/raw_a/b.c/2024_stock_"), stock, F.when(F.col("event_id") % 3 == 0, ".csv.gz").otherwise(".gz"))
    return V.events(spark, d).select("event_id", io.stock_of_file(path).alias("stock_id"))


@query(
    "day_table",
    f"with {V.TRADES_SQL} select {_KEY}, {_T}, ord, round(price, 6) as price, quantity, flag from trades where strftime(date, '%Y-%m') in ('2024-01', '2024-02') and stock_id in ('1', '2', '7')",
)
def day_table(spark, d):
    path = io.fresh_path(spark, "days")
    io.write_days(V.trades(spark, d), path)
    return io.read_days(spark, path, (2024, 1), (2024, 2), ["1", "2", "7"]).select("stock_id", "date", "t", "ord", "price", "quantity", "flag")


# cleaning


@query("lob_repair_levels", f"with {V.TRADES_SQL}, {V.BOOK_SQL}, {V.REPAIR_SQL} select {_KEY}, {_T}, {_BOOK} from repaired")
def lob_repair_levels(spark, d):
    return clean.repair_levels(V.book(spark, d)).select("stock_id", "date", "t", *B.BOOK)


@query("lob_reject_days", f"with {V.TRADES_SQL}, {V.CLEAN_SQL} select {_KEY} from rejected")
def lob_reject_days(spark, d):
    return clean.rejected_days(V.book(spark, d))


@query("lob_clean", f"with {V.TRADES_SQL}, {V.CLEAN_SQL} select {_KEY}, {_T}, {_BOOK} from clean")
def lob_clean(spark, d):
    return _clean(spark, d).select("stock_id", "date", "t", *B.BOOK)


def _clean(spark, d):
    return clean.clean_book(V.book(spark, d))


_CAP = 400.0


@query(
    "trades_normal_capped",
    f"with {V.TRADES_SQL}, n as (select * from trades where flag = 'NORMAL'), x as (select distinct stock_id, date from n where price > {_CAP}) select n.stock_id, cast(n.date as varchar) as date, ord, round(price, 6) as price, quantity from n anti join x on n.stock_id = x.stock_id and n.date = x.date",
)
def trades_normal_capped(spark, d):
    return clean.capped_trades(V.trades(spark, d), _CAP).select("stock_id", "date", "ord", "price", "quantity")


@query("trades_semi_lob_days", f"with {V.TRADES_SQL}, {V.CLEAN_SQL} select t.stock_id, cast(t.date as varchar) as date, ord from trades t semi join clean c on t.stock_id = c.stock_id and t.date = c.date")
def trades_semi_lob_days(spark, d):
    return clean.on_book_days(V.trades(spark, d), _clean(spark, d)).select("stock_id", "date", "ord")


# bars

_BARS = f"with {V.SESSION_SQL}, {V.CLEAN_SQL}, {V.bars_sql('trades')}"


@query("asof_forward_bin", f"{_BARS} select {_KEY}, ord, {_TS.format('bar_t', 'bar_t')} from binned")
def asof_forward_bin(spark, d):
    return bars.asof_forward(clean.normal_trades(V.trades(spark, d)), _clean(spark, d)).select("stock_id", "date", "ord", "bar_t")


def _bar_columns() -> str:
    return f"{_KEY}, {_T}, {r('open', 'close', 'high', 'low', 'vwap', 'vwps')}, quantity"


@query("vwap_bars", f"{_BARS} select {_bar_columns()} from bars")
def vwap_bars(spark, d):
    return bars.bars_on_clock(clean.normal_trades(V.trades(spark, d)), _clean(spark, d)).select("stock_id", "date", "t", *B.BARS)


@query("vwap_bars_filled", f"{_BARS} select {_bar_columns()} from filled")
def vwap_bars_filled(spark, d):
    return bars.trade_bars(clean.normal_trades(V.trades(spark, d)), _clean(spark, d), check_unique=True)


#: Rows of a stock-day above which the queries named ``split`` scan it in parts; most stock-days have more.
_SPLIT = 30


@query("asof_forward_split", f"{_BARS} select {_KEY}, ord, {_TS.format('bar_t', 'bar_t')} from binned")
def asof_forward_split(spark, d):
    trades, book = clean.normal_trades(V.trades(spark, d)), _clean(spark, d)
    return bars.asof_forward(trades, book, scan.find_hot([trades, book], clean.DAY, _SPLIT)).select("stock_id", "date", "ord", "bar_t")


@query("vwap_bars_split", f"{_BARS} select {_bar_columns()} from filled")
def vwap_bars_split(spark, d):
    return bars.trade_bars(clean.normal_trades(V.trades(spark, d)), _clean(spark, d), check_unique=True, most=_SPLIT)


_STEP, _END = 7200, 79_200


@query(
    "session_bars",
    f"""with {V.TRADES_SQL}, placed as (select *, make_timestamp(cast(ceil(epoch_us(t) / {_STEP}000000.0) as bigint) * {_STEP}000000) as bar_t, date + to_seconds({_END}) as until from trades where flag = 'NORMAL'),
kept as (select * from placed where bar_t <= until),
vw as (select *, sum(price * quantity) over w / nullif(sum(quantity) over w, 0) as mean from kept window w as (partition by stock_id, date, bar_t)),
agg as (select stock_id, date, bar_t as t, arg_min(price, (t, ord)) as open, arg_max(price, (t, ord)) as close, max(price) as high, min(price) as low, sum(price * quantity order by t, ord) / nullif(sum(quantity), 0) as vwap,
  sqrt(sum(quantity * (price - mean) * (price - mean) order by t, ord) / greatest(sum(quantity) - 1, 1)) as vwps, cast(sum(quantity) as bigint) as quantity from vw group by stock_id, date, bar_t),
clock as (select stock_id, date, unnest(generate_series(min(bar_t), any_value(until), to_seconds({_STEP}))) as t from kept group by stock_id, date),
bars as (select c.stock_id, c.date, c.t, coalesce(a.quantity, 0) as quantity, {', '.join(f"case when a.quantity <> 0 then a.{c} end as {c}" for c in ('open', 'close', 'high', 'low', 'vwap', 'vwps'))} from clock c left join agg a on c.stock_id = a.stock_id and c.date = a.date and c.t = a.t),
ffill as (select *, last_value(vwap ignore nulls) over (partition by stock_id, date order by t rows between unbounded preceding and current row) as fv from bars)
select {_KEY}, {_T}, {', '.join(f"round(coalesce({c}, fv), 6) as {c}" for c in ('open', 'close', 'high', 'low'))}, round(fv, 6) as vwap, round(coalesce(vwps, 0), 6) as vwps, quantity from ffill""",
)
def session_bars(spark, d):
    return sessions.session_bars(V.trades(spark, d).withColumn("t", F.col("t").cast("timestamp")), _STEP, _END)


# auctions


@query("auction_phases", f"with {V.TRADES_SQL}, {V.auctions_sql('trades')} select {_KEY}, ord, rn, phase from phases where phase is not null")
def auction_phases(spark, d):
    return auction.auction_phases(V.trades(spark, d)).filter("phase is not null").select("stock_id", "date", "ord", F.col("rn").cast("long").alias("rn"), "phase")


_AUCTION = "select stock_id, cast(date as varchar) as date, round(open_price, 6) as open_price, open_qty, round(close_price, 6) as close_price, close_qty from auctions"


@query("auction_prices", f"with {V.TRADES_SQL}, {V.auctions_sql('trades')} {_AUCTION}")
def auction_prices(spark, d):
    return auction.auction_prices(V.trades(spark, d))


@query("auction_prices_session", f"with {V.SESSION_SQL}, {V.auctions_sql('session')} {_AUCTION}")
def auction_prices_session(spark, d):
    return auction.auction_prices(V.session_trades(spark, d))


# features of the book

_CLEAN = f"with {V.TRADES_SQL}, {V.CLEAN_SQL}"
_MID = "((bb1 + ba1) / 2)"
_TVOL = "(" + " + ".join(B.VOLUMES) + ")"


@query("mid_price", f"{_CLEAN} select {_KEY}, {_T}, round({_MID}, 6) as mid, round({_TVOL}, 6) as tvol from clean")
def mid_price(spark, d):
    return _clean(spark, d).select("stock_id", "date", "t", B.mid_price().alias("mid"), B.total_volume().alias("tvol"))


@query("price_returns", f"{_CLEAN} select {_KEY}, {_T}, {', '.join(f'round(ln({p} / {_MID}), 6) + 0.0 as ret_{p}' for p in B.PRICES)} from clean")
def price_returns(spark, d):
    return _clean(spark, d).select("stock_id", "date", "t", *[B.price_return(p).alias(f"ret_{p}") for p in B.PRICES])


@query("relative_volume", f"{_CLEAN} select {_KEY}, {_T}, {', '.join(f'round({B.volume_of(p)} / {_TVOL}, 6) + 0.0 as rvol_{p}' for p in B.PRICES)} from clean")
def relative_volume(spark, d):
    return _clean(spark, d).select("stock_id", "date", "t", *[B.relative_volume(B.volume_of(p)).alias(f"rvol_{p}") for p in B.PRICES])


_CLOSE = f"""with {V.SESSION_SQL}, {V.CLEAN_SQL}, {V.bars_sql('session')}, {V.auctions_sql('session')},
joined as (select c.*, {', '.join(f'coalesce(b.{x}, open_price) as {x}' for x in B.BARS)}, open_price, open_qty, close_price, {_MID} as mid, {_TVOL} as tvol,
  row_number() over (partition by c.stock_id, c.date order by c.t) as rn, row_number() over (partition by c.stock_id, c.date order by c.t desc) as back, count(*) over (partition by c.stock_id, c.date) as n
  from clean c join filled b on c.stock_id = b.stock_id and c.date = b.date and c.t = b.t join auctions a on c.stock_id = a.stock_id and c.date = a.date),
rows_ as (select stock_id, date, t, back, n, {', '.join(f'ln({p} / mid) as ret_{p}' for p in B.PRICES + B.BAR_PRICES)}, {', '.join(f'{B.volume_of(p)} / tvol as rvol_{p}' for p in B.PRICES)},
  ln(mid / coalesce(lag(mid) over w, open_price)) as mid_chg, coalesce(ln(tvol / lag(tvol) over w), 0) as tvol_chg,
  ln(cast(sum(quantity) over c + open_qty as double) / cast(sum(quantity) over c + open_qty - quantity as double)) as cumvol_chg, vwps
  from joined window w as (partition by stock_id, date order by t), c as (partition by stock_id, date order by t rows between unbounded preceding and current row))"""


def _closing(spark, d):
    rows, book = V.session_trades(spark, d), _clean(spark, d)
    return book, bars.trade_bars(clean.normal_trades(rows), book), auction.auction_prices(rows)


@query("mid_change_closing", f"{_CLOSE} select {_KEY}, {_T}, {r('mid_chg')} from rows_")
def mid_change_closing(spark, d):
    return features.closing_rows(*_closing(spark, d)).select("stock_id", "date", "t", "mid_chg")


#: Finite values are compared as numbers, all others by name.
_KIND = "case when v is null then 'null' when isnan(v) then 'nan' when isinf(v) then case when v > 0 then '+inf' else '-inf' end else 'finite' end as kind, case when isfinite(v) then round(v, 6) + 0.0 end as cumvol_chg"


@query("cum_volume_change", f"""{_CLOSE}, v_ as (select stock_id, date, t, case when total = 0 and total = quantity then 'nan'::double when total = quantity then 'infinity'::double when total = 0 then '-infinity'::double else ln(total::double / (total - quantity)::double) end as v
  from (select stock_id, date, t, quantity, sum(quantity) over c + open_qty as total from joined window c as (partition by stock_id, date order by t rows between unbounded preceding and current row)))
select {_KEY}, {_T}, {_KIND} from v_""")
def cum_volume_change(spark, d):
    rows = features.closing_rows(*_closing(spark, d)).select("stock_id", "date", "t", F.col("cumvol_chg").alias("v"))
    v = F.col("v")
    finite = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    kind = F.when(v.isNull(), "null").when(F.isnan(v), "nan").when(finite, "finite").when(v > 0, "+inf").otherwise("-inf")
    return rows.select("stock_id", "date", "t", kind.alias("kind"), F.when(finite, v).alias("cumvol_chg"))


@query("changes_split", f"{_CLOSE} select {_KEY}, {_T}, {r('mid_chg', 'tvol_chg')}, case when isfinite(cumvol_chg) then round(cumvol_chg, 6) + 0.0 end as cumvol_chg from (select * replace (case when total - quantity > 0 and total > 0 then cumvol_chg end as cumvol_chg) from rows_ join (select stock_id as s_, date as d_, t as t_, quantity, sum(quantity) over c + open_qty as total from joined window c as (partition by stock_id, date order by t rows between unbounded preceding and current row)) on stock_id = s_ and date = d_ and t = t_)")
def changes_split(spark, d):
    rows = features.closing_rows(*_closing(spark, d), most=_SPLIT // 2)
    finite = F.col("cumvol_chg").isNotNull() & ~F.isnan("cumvol_chg") & (F.abs("cumvol_chg") < float("inf"))
    return rows.select("stock_id", "date", "t", "mid_chg", "tvol_chg", F.when(finite, F.col("cumvol_chg")).alias("cumvol_chg"))


@query("volume_change", f"{_CLOSE} select {_KEY}, {_T}, {r('tvol_chg')} from rows_")
def volume_change(spark, d):
    return features.closing_rows(*_closing(spark, d)).select("stock_id", "date", "t", "tvol_chg")


_INTRA = f"""{_CLEAN}, mids as (select *, {_MID} as mid, {_TVOL} as tvol, row_number() over (partition by stock_id, date order by t) as rn,
  row_number() over (partition by stock_id, date order by t desc) as back from clean),
changes as (select *, coalesce(ln(mid / lag(mid) over w), 0) as mid_chg, coalesce(ln(tvol / lag(tvol) over w), 0) as tvol_chg,
  case when rn >= {HORIZON} then avg(mid) over (partition by stock_id, date order by t rows between {HORIZON - 1} preceding and current row) end as avg_mid from mids window w as (partition by stock_id, date order by t)),
labels as (select *, ln(lead(avg_mid, {HORIZON}) over (partition by stock_id, date order by t) / avg_mid) as y from changes)"""


@query("mid_change_intraday", f"{_INTRA} select {_KEY}, {_T}, {r('mid_chg', 'tvol_chg')} from changes")
def mid_change_intraday(spark, d):
    return intraday.intraday_rows(_clean(spark, d)).select("stock_id", "date", "t", "mid_chg", "tvol_chg")


@query("bars_join_book", f"{_BARS} select c.stock_id, cast(c.date as varchar) as date, {_TS.format('c.t', 't')}, round(bb1, 6) as bb1, round(ba1, 6) as ba1, {r('vwap')}, quantity from clean c join filled f on c.stock_id = f.stock_id and c.date = f.date and c.t = f.t")
def bars_join_book(spark, d):
    book = _clean(spark, d)
    joined = features.join_book_bars(book, bars.trade_bars(clean.normal_trades(V.trades(spark, d)), book))
    return joined.select("stock_id", "date", "t", "bb1", "ba1", "vwap", "quantity")


@query("open_price_fill", f"{_CLOSE} select {_KEY}, {_T}, {r('open', 'close', 'high', 'low', 'vwap')} from joined")
def open_price_fill(spark, d):
    book, own, auctions = _closing(spark, d)
    rows = features.fill_from_open(features.with_auctions(features.join_book_bars(book, own), auctions))
    return rows.select("stock_id", "date", "t", *B.BAR_PRICES)


_GAP = " or ".join(f"{c} is null or isnan({c})" for c in B.CLOSING_FEATURES)


@query(
    "closing_features",
    f"{_CLOSE}, kept as (select * from rows_ where n >= {SEQUENCE} and back <= {SEQUENCE}), gaps as (select distinct stock_id, date from kept where {_GAP}) select {_KEY}, {_T}, {r(*B.CLOSING_FEATURES)} from kept k where not exists (select 1 from gaps g where g.stock_id = k.stock_id and g.date = k.date)",
)
def closing_features(spark, d):
    return features.closing_features(*_closing(spark, d), SEQUENCE)


_LABEL = f"""{_CLOSE}, mids as (select stock_id, date, {_MID} as mid, row_number() over (partition by stock_id, date order by t desc) as back, count(*) over (partition by stock_id, date) as n from clean),
label as (select m.stock_id, m.date, ln(any_value(close_price) / avg(mid)) as y from mids m join auctions a on m.stock_id = a.stock_id and m.date = a.date where back <= {HORIZON} and n >= {HORIZON} group by m.stock_id, m.date),
prev as (select *, date - case when isodow(date) = 1 then 3 else 1 end as prev_date from auctions),
exo as (select p.stock_id, p.date, l.y as z1, ln(p.open_price / q.close_price) as z2 from prev p join label l on p.stock_id = l.stock_id and p.prev_date = l.date join auctions q on p.stock_id = q.stock_id and p.prev_date = q.date)"""


@query("closing_label", f"{_LABEL} select {_KEY}, {r('y')} from label")
def closing_label(spark, d):
    return features.closing_label(_clean(spark, d), auction.auction_prices(V.session_trades(spark, d)), HORIZON)


@query("prev_business_day", f"{_LABEL} select {_KEY}, cast(cast(prev_date as date) as varchar) as prev_date from prev")
def prev_business_day(spark, d):
    rows = auction.auction_prices(V.session_trades(spark, d)).select("stock_id", "date")
    return rows.withColumn("prev_date", B.prev_business_day(F.col("date")))


@query("exogenous", f"{_LABEL} select {_KEY}, {r('z1', 'z2')} from exo")
def exogenous(spark, d):
    auctions = auction.auction_prices(V.session_trades(spark, d))
    return features.exogenous(features.closing_label(_clean(spark, d), auctions, HORIZON), auctions)


def _steps(rows: DataFrame, names: list[str], *others: str) -> DataFrame:
    """A row for each step of ``x``, its values by name."""
    steps = rows.select(*others, F.posexplode("x").alias("step", "v"))
    return steps.select(*others, F.col("step").cast("long").alias("step"), *[F.get("v", i).alias(c) for i, c in enumerate(names)])


def _cells(names: list[str], of: str) -> str:
    return ", ".join(f"round(cast(cast({of}.{c} as real) as double), 6) + 0.0 as {c}" for c in names)


@query(
    "closing_samples",
    f"""{_LABEL}, kept as (select * from rows_ where n >= {SEQUENCE} and back <= {SEQUENCE}), gaps as (select distinct stock_id, date from kept where {_GAP})
select k.stock_id, cast(k.date as varchar) as date, {SEQUENCE} - k.back as step, {_cells(B.CLOSING_FEATURES, 'k')}, {r('y', 'z1', 'z2')} from kept k
  join label l on k.stock_id = l.stock_id and k.date = l.date join exo e on k.stock_id = e.stock_id and k.date = e.date
  where not exists (select 1 from gaps g where g.stock_id = k.stock_id and g.date = k.date)""",
)
def closing_samples(spark, d):
    rows = features.closing_samples(*_closing(spark, d), SEQUENCE, HORIZON)
    return _steps(rows, B.CLOSING_FEATURES, "stock_id", "date", "y", "z1", "z2")


# intraday labels and sequences


@query("rolling_mid_label", f"{_INTRA} select {_KEY}, {_T}, {r('avg_mid', 'y')} from labels where y is not null")
def rolling_mid_label(spark, d):
    rows = intraday.rolling_label(intraday.intraday_rows(_clean(spark, d)), HORIZON)
    return rows.filter("y is not null").select("stock_id", "date", "t", "avg_mid", "y")


@query(
    "sliding_sequences",
    f"{_INTRA}, seq as (select *, list(mid) over (partition by stock_id, date order by t rows between {SEQUENCE - 1} preceding and current row) as x from labels) select {_KEY}, {_TS.format('t', 'anchor_t')}, array_to_string([cast(cast(v * 2 as bigint) as varchar) for v in x], ',') as mids, {r('y')} from seq where rn >= {SEQUENCE} and back > {HORIZON} and back <= {HORIZON + KEEP}",
)
def sliding_sequences(spark, d):
    rows = intraday.rolling_label(intraday.intraday_rows(_clean(spark, d)), HORIZON)
    out = intraday.sliding_sequences(rows, ["mid"], HORIZON, SEQUENCE, KEEP)
    mids = F.array_join(F.transform("x", lambda v: (F.get(v, 0) * 2).cast("long").cast("string")), ",")
    return out.select("stock_id", "date", "anchor_t", mids.alias("mids"), "y")


_INTRA_GAP = " or ".join(f"{c} is null or isnan({c})" for c in B.INTRADAY_FEATURES)


@query(
    "intraday_samples",
    f"""{_INTRA}, cells as (select *, {', '.join(f'ln({p} / mid) as ret_{p}, {B.volume_of(p)} / tvol as rvol_{p}' for p in B.PRICES)} from labels),
checked as (select *, max(case when {_INTRA_GAP} then 1 else 0 end) over (partition by stock_id, date order by t rows between {SEQUENCE - 1} preceding and current row) as gap from cells),
ends as (select stock_id, date, t as anchor_t, rn as last_rn, y from checked where rn >= {SEQUENCE} and back > {HORIZON} and back <= {HORIZON + KEEP} and gap = 0 and y is not null and not isnan(y))
select c.stock_id, cast(c.date as varchar) as date, {_TS.format('anchor_t', 'anchor_t')}, rn - last_rn + {SEQUENCE} - 1 as step, {_cells(B.INTRADAY_FEATURES, 'c')}, round(cast(cast(e.y as real) as double), 6) + 0.0 as y
  from ends e join cells c on c.stock_id = e.stock_id and c.date = e.date and c.rn between last_rn - {SEQUENCE - 1} and last_rn""",
)
def intraday_samples(spark, d):
    return _steps(intraday.intraday_samples(_clean(spark, d), SEQUENCE, HORIZON, KEEP), B.INTRADAY_FEATURES, "stock_id", "date", "anchor_t", "y")


# normalisation

_LONG = f"with {V.SAMPLES_SQL}, long as (select date, stock_id, s as step, f as feature, cast(e[s * 8 + f + 1] as double) as value from samples, range(8) a(s), range(8) b(f))"
_PAST = f"""d as (select distinct date from long), near as (select a.date, b.date as past from d a join d b on b.date < a.date and b.date >= a.date - {DAYS} where a.date >= {DAYS})"""


@query(
    "trailing_normalize",
    f"{_LONG}, {_PAST}, st as (select n.date, feature, avg(value) as mu, stddev_samp(value) as sd from near n join long l on n.past = l.date group by n.date, feature) select l.date, stock_id, cast(step as bigint) as step, cast(l.feature as bigint) as feature, round((value - mu) / sd, 6) + 0.0 as value from long l join st on l.date = st.date and l.feature = st.feature",
)
def trailing_normalize(spark, d):
    values = normalize.long_steps(V.samples(spark, d), ["date", "stock_id"])
    out = normalize.trailing_normalize(values, DAYS, ["feature"])
    return out.select("date", "stock_id", F.col("step").cast("long").alias("step"), F.col("feature").cast("long").alias("feature"), "value")


@query(
    "trailing_normalize_exog",
    f"with {V.SAMPLES_SQL}, long as (select date, stock_id, cast(e[1] as double) as value from samples), {_PAST}, st as (select n.date, avg(value) as mu, stddev_samp(value) as sd from near n join long l on n.past = l.date group by n.date) select l.date, stock_id, round((value - mu) / sd, 6) + 0.0 as value from long l join st on l.date = st.date",
)
def trailing_normalize_exog(spark, d):
    return normalize.trailing_normalize(V.samples(spark, d).select("date", "stock_id", F.col("z1").alias("value")), DAYS, [])


def _z_moments(n: int) -> str:
    """CTE st{n}: the trailing moments of z{n}."""
    return f"st{n} as (select n.date, avg(l.z{n}) as mu, stddev_samp(l.z{n}) as sd from near n join zs l on n.past = l.date group by n.date)"


@query(
    "normalize_samples",
    f"""{_LONG}, {_PAST}, zs as (select date, stock_id, y, cast(e[1] as double) as z1, cast(e[2] as double) as z2 from samples), {_z_moments(1)}, {_z_moments(2)},
st as (select n.date, feature, avg(value) as mu, stddev_samp(value) as sd from near n join long l on n.past = l.date group by n.date, feature)
select l.date, l.stock_id, l.step, {', '.join(f"round(cast(cast(max(case when l.feature = {i} then (value - st.mu) / st.sd end) as real) as double), 6) + 0.0 as x{i}" for i in range(8))},
  round(any_value(zs.y), 6) as y, round(any_value((zs.z1 - st1.mu) / st1.sd), 6) + 0.0 as z1, round(any_value((zs.z2 - st2.mu) / st2.sd), 6) + 0.0 as z2
  from long l join st on l.date = st.date and l.feature = st.feature join zs on l.date = zs.date and l.stock_id = zs.stock_id join st1 on l.date = st1.date join st2 on l.date = st2.date group by l.date, l.stock_id, l.step""",
)
def normalize_samples(spark, d):
    return _steps(normalize.normalize_samples(V.samples(spark, d), DAYS), [f"x{i}" for i in range(8)], "date", "stock_id", "y", "z1", "z2")


@query(
    "sample_store",
    f"with {V.SAMPLES_SQL}, steps as (select *, unnest(range(6)) as step from samples where date in (1, 4, 7)) select date, stock_id, step, {', '.join(f'round(cast(e[step * 8 + {i + 1}] as double), 6) + 0.0 as x{i}' for i in range(8))}, y from steps",
)
def sample_store(spark, d):
    path = io.fresh_path(spark, "samples")
    io.write_samples(V.samples(spark, d), path)
    rows = io.read_samples(spark, path, [1, 4, 7], ["date", "stock_id", "x", "y"], horizon=2)
    return _steps(rows, [f"x{i}" for i in range(8)], "date", "stock_id", "y")


# datasets


@query("date_split", f"with {V.SAMPLES_SQL} select date, stock_id, case when date < 5 then 'train' when date < 7 then 'validation' else 'test' end as split from samples where date >= 1 and date < 9")
def date_split(spark, d):
    return dataset.date_split(V.samples(spark, d), 4, 2, 2, start=1).select("date", "stock_id", "split")


@query("feature_select", f"with {V.SAMPLES_SQL} select stock_id, array_to_string([cast(cast(floor(v * 1000) as bigint) as varchar) for v in e[25:48]], ',') as x from samples")
def feature_select(spark, d):
    rows = dataset.select_features(V.samples(spark, d), sequence=3, horizon=2)
    return rows.select("stock_id", F.array_join(F.transform(F.flatten("x"), lambda v: F.floor(v * F.lit(1000.0).cast("float")).cast("string")), ",").alias("x"))


@query("binary_target", f"with {V.SAMPLES_SQL} select stock_id, case when y > 0 then 1.0 else 0.0 end as target from samples")
def binary_target(spark, d):
    return dataset.with_target(V.samples(spark, d)).select("stock_id", "target")


# strategy and metrics

_PRED = f"with {V.PREDICTIONS_SQL}, placed as (select *, case when 1 / (1 + exp(-logit)) > {THRESHOLD} then 1 when 1 / (1 + exp(-logit)) < -{THRESHOLD} then -1 else 0 end as pos from predictions)"
_RET = f"{_PRED}, daily as (select date, case when bool_and(pos = 0) then 1.0 else sum(y * pos / n) end as ret, case when bool_and(pos = 0) then 1.0 else 1 + sum(y * pos / n) end as gross from (select *, count(*) over (partition by date) as n from placed) group by date)"
_SOFT = f"{_PRED}, soft as (select *, case when pos <> 0 then exp(abs(logit)) end / sum(case when pos <> 0 then exp(abs(logit)) end) over (partition by date) as w from placed)"


@query("positions", f"{_PRED} select l_orderkey, cast(l_linenumber as bigint) as l_linenumber, round(logit, 6) as logit, pos from placed")
def positions(spark, d):
    rows = metrics.positions(V.predictions(spark, d), THRESHOLD, parity=True)
    return rows.select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), "logit", "pos")


@query("positions_weighted", f"{_SOFT} select l_orderkey, cast(l_linenumber as bigint) as l_linenumber, round(coalesce(w, 0), 6) as w from soft")
def positions_weighted(spark, d):
    rows = metrics.weights(metrics.positions(V.predictions(spark, d), THRESHOLD, parity=True), weighted=True)
    return rows.select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), "w")


# the default, intended positions: short below 1 - threshold
_SHORT = f"with {V.PREDICTIONS_SQL}, placed as (select *, case when 1 / (1 + exp(-logit)) > {THRESHOLD} then 1 when 1 / (1 + exp(-logit)) < {1 - THRESHOLD} then -1 else 0 end as pos from predictions), soft as (select *, case when pos <> 0 then exp(abs(logit)) end / sum(case when pos <> 0 then exp(abs(logit)) end) over (partition by date) as w from placed)"


@query("positions_short", f"{_SHORT} select l_orderkey, cast(l_linenumber as bigint) as l_linenumber, round(logit, 6) as logit, pos from placed")
def positions_short(spark, d):
    rows = metrics.positions(V.predictions(spark, d), THRESHOLD)
    return rows.select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), "logit", "pos")


@query("daily_returns_short", f"{_SHORT} select cast(date as varchar) as date, round(case when bool_and(pos = 0) then 1.0 else sum(y * pos / n) end, 6) + 0.0 as ret from (select *, count(*) over (partition by date) as n from placed) group by date")
def daily_returns_short(spark, d):
    return metrics.daily_returns(V.predictions(spark, d), THRESHOLD)


@query("daily_returns_short_weighted", f"{_SHORT} select cast(date as varchar) as date, round(case when bool_and(pos = 0) then 1.0 else sum(y * pos * coalesce(w, 0)) end, 6) + 0.0 as ret from soft group by date")
def daily_returns_short_weighted(spark, d):
    return metrics.daily_returns(V.predictions(spark, d), THRESHOLD, weighted=True)


@query("daily_returns", f"{_RET} select cast(date as varchar) as date, round(ret, 6) + 0.0 as ret from daily")
def daily_returns(spark, d):
    return metrics.daily_returns(V.predictions(spark, d), THRESHOLD, parity=True)


@query("daily_returns_weighted", f"{_SOFT} select cast(date as varchar) as date, round(case when bool_and(pos = 0) then 1.0 else sum(y * pos * coalesce(w, 0)) end, 6) + 0.0 as ret from soft group by date")
def daily_returns_weighted(spark, d):
    return metrics.daily_returns(V.predictions(spark, d), THRESHOLD, weighted=True, parity=True)


def _gross(spark, d):
    return metrics.daily_returns(V.predictions(spark, d), THRESHOLD, gross=True, parity=True)


@query("win_rate", f"{_RET} select round(avg(case when gross > 1 then 1.0 else 0.0 end), 6) as win_rate from daily")
def win_rate(spark, d):
    return metrics.win_rate(_gross(spark, d))


@query("expected_return", f"{_RET} select round(avg(ln(gross)), 6) + 0.0 as expected_return from daily")
def expected_return(spark, d):
    return metrics.expected_return(_gross(spark, d))


@query("sharpe", f"{_RET} select round(avg(ln(gross)) / stddev_samp(ln(gross)), 6) + 0.0 as sharpe from daily")
def sharpe(spark, d):
    return metrics.sharpe_ratio(_gross(spark, d))


_CUM = f"{_RET}, cum as (select date, sum(ln(gross)) over (order by date) as c, gross from daily)"


@query("drawdown", f"{_CUM} select round(max(m - c), 6) + 0.0 as max_drawdown from (select c, max(c) over (order by date) as m from cum)")
def drawdown(spark, d):
    return metrics.maximum_drawdown(_gross(spark, d))


@query("total_return", f"{_RET} select round(product(gross) - 1, 6) + 0.0 as total_return from daily")
def total_return(spark, d):
    return metrics.total_return(_gross(spark, d))


@query("cumulative_return", f"{_RET} select cast(date as varchar) as date, round(product(gross) over (order by date) - 1, 6) + 0.0 as cum_return from daily")
def cumulative_return(spark, d):
    return metrics.cumulative_return(_gross(spark, d))


@query("bce_loss", f"with {V.PREDICTIONS_SQL} select round(avg(greatest(logit, 0) - logit * (case when y > 0 then 1 else 0 end) + ln(1 + exp(-abs(logit)))), 6) as loss from predictions")
def bce_loss(spark, d):
    return metrics.mean_loss(V.predictions(spark, d))


@query("accuracy", f"with {V.PREDICTIONS_SQL} select round(avg(case when (logit > 0) = (y > 0) then 1.0 else 0.0 end) * 100, 6) as accuracy from predictions")
def accuracy(spark, d):
    return metrics.accuracy(V.predictions(spark, d))


_LOSSES = "losses as (select l_linenumber as epoch, avg(abs(l_extendedprice - 30000 - 500 * l_linenumber)) as loss from lineitem group by l_linenumber)"


@query(
    "early_stop_replay",
    f"""with {_LOSSES}, m as (select *, min(loss) over (order by epoch) as best_loss from losses), b as (select *, (select min(epoch) from losses x where x.loss = m.best_loss and x.epoch <= m.epoch) as best_epoch from m),
s as (select *, epoch - best_epoch as waited from b) select cast(epoch as bigint) as epoch, round(loss, 6) as loss, cast(best_epoch as bigint) as best_epoch, round(best_loss, 6) as best_loss, cast(waited as bigint) as waited from s where not exists (select 1 from s y where y.epoch < s.epoch and y.waited >= 2)""",
)
def early_stop_replay(spark, d):
    rows = spark.read.parquet(f"{d}/lineitem.parquet")
    losses = rows.groupBy(F.col("l_linenumber").cast("long").alias("epoch")).agg(F.avg(F.abs(F.col("l_extendedprice") - 30000 - 500 * F.col("l_linenumber"))).alias("loss"))
    return metrics.early_stopping(losses, 2)


@query("union_days", f"with {V.TRADES_SQL} select stock_id, cast(date as varchar) as date, count(*) as n from (select * from trades where day(date) <= 15 union all select * from trades where day(date) > 10) group by all")
def union_days(spark, d):
    rows = V.trades(spark, d)
    both = rows.filter(F.dayofmonth("date") <= 15).unionByName(rows.filter(F.dayofmonth("date") > 10))
    return both.groupBy("stock_id", "date").agg(F.count("*").alias("n"))


@query("ordered_dates", f"with {V.TRADES_SQL}, d as (select distinct date from trades) select cast(date as varchar) as date, row_number() over (order by date) - 1 as rank from d")
def ordered_dates(spark, d):
    return io.ordered_dates(V.trades(spark, d)).withColumn("rank", F.col("rank").cast("long"))


# models


@query("linear_score")
def linear_score(spark, d):
    return scoring.score(V.samples(spark, d), scoring.seeded("linear", features=8, sequence=8, seed=1)).select("stock_id", "logit")


@query("linear_dot", "select vec_id as stock_id, round(0.25 + sum(cast(v as double) * ((i % 3) - 1) / 8), 6) + 0.0 as logit from (select vec_id, unnest(embedding) as v, unnest(range(64)) as i from embeddings) group by vec_id")
def linear_dot(spark, d):
    return scoring.linear_logit(V.samples(spark, d), [((i % 3) - 1) / 8 for i in range(64)], 0.25).select("stock_id", "logit")


@query("cnn_score")
def cnn_score(spark, d):
    return scoring.score(V.samples(spark, d), scoring.seeded("cnn", features=8, sequence=8, seed=2, conv_channels=[4, 3], kernel_size=[3, 2])).select("stock_id", "logit")


def _ruled(model: dict) -> dict:
    """A model whose weights follow a rule, for which its SQL is written out."""
    for k, w in sorted(model["weights"].items()):
        model["weights"][k] = (((np.arange(w.size) * 7 + len(k)) % 11 - 5) / 10).reshape(w.shape)
    return model


_CNN = _ruled(scoring.seeded("cnn", features=8, sequence=8, conv_channels=[2, 2], kernel_size=[3, 2], stride=1, dilation=2))


def _sum(terms: list[str]) -> str:
    return "(" + " + ".join(terms) + ")"


def _cnn_sql() -> str:
    """Two layers of convolutions, written out: every second step, two channels, then the head."""
    w = _CNN["weights"]
    inputs, names, ctes, source = 8, [[f"cast(embedding[{t * 8 + f + 1}] as double)" for t in range(8)] for f in range(8)], [], "embeddings"
    for i, k in enumerate((3, 2)):
        steps = len(names[0]) - 2 * (k - 1)
        cells = {f"c{i}_{o}_{t}": _sum([repr(float(w[f"conv{i}.b"][o]))] + [f"{float(w[f'conv{i}.w'][o, f, j])!r} * {names[f][t + 2 * j]}" for f in range(inputs) for j in range(k)]) for o in range(2) for t in range(steps)}
        ctes.append(f"layer{i} as (select vec_id, {', '.join(f'greatest({e}, 0.0) as {n}' for n, e in cells.items())} from {source})")
        names, inputs, source = [[f"c{i}_{o}_{t}" for t in range(steps)] for o in range(2)], 2, f"layer{i}"
    flat = [n for row in names for n in row]
    head = _sum([repr(float(w["head.b"][0]))] + [f"{float(v)!r} * {n}" for v, n in zip(w["head.w"], flat, strict=True)])
    return f"with {', '.join(ctes)} select vec_id as stock_id, round({head}, 6) + 0.0 as logit from {source}"


@query("cnn_small", _cnn_sql())
def cnn_small(spark, d):
    return scoring.score(V.samples(spark, d), _CNN).select("stock_id", "logit")


_LSTM = _ruled(scoring.seeded("lstm", features=8, sequence=8, exogenous=2, hidden_size=2, lstm_size=1))


def _lstm_sql() -> str:
    """Eight steps of a layer with two cells, a common table each: gates in the order input, forget, cell, output."""
    w = _LSTM["weights"]
    logistic = "1 / (1 + exp(-{0}))".format
    ctes = ["s0 as (select vec_id, embedding, 0.0::double as h0, 0.0::double as h1, 0.0::double as c0, 0.0::double as c1 from embeddings)"]
    for t in range(8):
        gates = [_sum([repr(float(w["lstm0.b"][g]))] + [f"{float(w['lstm0.x'][g, f])!r} * cast(embedding[{t * 8 + f + 1}] as double)" for f in range(8)] + [f"{float(w['lstm0.h'][g, j])!r} * h{j}" for j in range(2)]) for g in range(8)]
        ctes.append(f"g{t} as (select vec_id, embedding, c0, c1, {', '.join(f'{e} as g{i}' for i, e in enumerate(gates))} from s{t})")
        ctes.append(f"n{t} as (select *, {', '.join(f'{logistic(f'g{2 + j}')} * c{j} + {logistic(f'g{j}')} * tanh(g{4 + j}) as d{j}' for j in range(2))} from g{t})")
        ctes.append(f"s{t + 1} as (select vec_id, embedding, {', '.join(f'{logistic(f'g{6 + j}')} * tanh(d{j}) as h{j}' for j in range(2))}, d0 as c0, d1 as c1 from n{t})")
    inputs = ["h0", "h1", "cast(embedding[1] as double)", "cast(embedding[2] as double)"]
    head = _sum([repr(float(w["head.b"][0]))] + [f"{float(v)!r} * {n}" for v, n in zip(w["head.w"], inputs, strict=True)])
    return f"with {', '.join(ctes)} select vec_id as stock_id, round({head}, 6) + 0.0 as logit from s8"


@query("lstm_small", _lstm_sql())
def lstm_small(spark, d):
    return scoring.score(V.samples(spark, d), _LSTM).select("stock_id", "logit")


@query("lstm_score")
def lstm_score(spark, d):
    return scoring.score(V.samples(spark, d), scoring.seeded("lstm", features=8, sequence=8, seed=3, exogenous=2, hidden_size=6, lstm_size=2)).select("stock_id", "logit")


@query("transformer_score")
def transformer_score(spark, d):
    model = scoring.seeded("transformer", features=8, sequence=8, seed=4, embedding_size=8, num_heads=2, dim_feedforward=16, num_layers=2)
    return scoring.score(V.samples(spark, d), model).select("stock_id", "logit")


@query("linear_train")
def linear_train(spark, d):
    return scoring.train_linear(dataset.date_split(V.samples(spark, d), 6, 2, 2), features=8, sequence=8, epochs=5)


@query("walk_forward_trials")
def walk_forward_trials(spark, d):
    space = {"learning_rate": [0.001, 0.01, 0.003], "epochs": [2, 4, 2]}
    return search.walk_forward(V.samples(spark, d), space, trials=4, sets=2, train=3, validation=1, features=8, sequence=8)


@query("study_trials")
def study_trials(spark, d):
    """A search over a study of its own, by the Parzen estimator."""
    space = {"learning_rate": [0.001, 0.05, 0.007], "epochs": [1, 3, 1]}
    study = Study(spark, io.fresh_path(spark, "study"))
    return search.optimize(V.samples(spark, d), study, space, trials=6, sets=2, train=3, validation=1, features=8, sequence=8, batch=3).drop("owner")


@query("mock_trades")
def mock_trades(spark, d):
    return fixtures.mock_trades(spark)


@query("mock_book")
def mock_book(spark, d):
    return fixtures.mock_book(spark)
