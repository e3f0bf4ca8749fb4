"""Windows over periods (WN), time series and change (TS)."""

from __future__ import annotations

from itertools import product

from pyspark.sql import functions as F

from queries.base import load, query, r, rounded
from tablewise.operators import change, forecast, series as ts
from tablewise.operators.ordered import value_ranks

MONTHS = "(select date_trunc('month', o_orderdate) as p, sum(o_totalprice) as v from orders group by 1)"
STATUS_MONTHS = "(select o_orderstatus as s, date_trunc('month', o_orderdate) as p, sum(o_totalprice) as v from orders group by 1, 2)"


def months(spark, sf, by=()):
    return ts.period_values(load(spark, sf, "orders"), "o_orderdate", "o_totalprice", "sum", "month", by)


def shown(df, digits=4, **special):
    for c in ("period", "peak"):
        if c in df.columns:
            df = df.withColumn(c, F.col(c).cast("date"))
    return rounded(df, digits, **special)


@query("wn01_midrank", """
    select l_extendedprice as v, count(*) as cnt, min(rk) + (count(*) - 1) / 2.0 as midrank
    from (select l_extendedprice, rank() over (order by l_extendedprice) as rk from lineitem) group by 1""")
def wn01(spark, sf):
    lines = load(spark, sf, "lineitem").select(F.col("l_extendedprice").alias("v"))
    return value_ranks(lines, "v").select("v", "cnt", "midrank")


@query("wn01_midrank_ranges", """
    select l_returnflag, l_extendedprice as v, min(rk) + (count(*) - 1) / 2.0 as midrank
    from (select l_returnflag, l_extendedprice, rank() over (partition by l_returnflag order by l_extendedprice) as rk from lineitem) group by 1, 2""")
def wn01b(spark, sf):
    """Ranks per flag by the many-range plan that large tables take."""
    lines = load(spark, sf, "lineitem").select("l_returnflag", F.col("l_extendedprice").alias("v"))
    return value_ranks(lines, "v", ["l_returnflag"], ranges=8).select("l_returnflag", "v", "midrank")


@query("wn02_period_change", f"select cast(p as date) as period, {r('v', 2)} as value, {r('v / nullif(lag(v) over (order by p), 0) - 1')} as change from {MONTHS}")
def wn02(spark, sf):
    return shown(ts.period_change(months(spark, sf)), value=2)


@query("wn02_change_per_series", f"""
    select s as o_orderstatus, cast(p as date) as period, {r('v / nullif(lag(v) over (partition by s order by p), 0) - 1')} as change from {STATUS_MONTHS}""")
def wn02b(spark, sf):
    return shown(ts.period_change(months(spark, sf, ["o_orderstatus"]), ["o_orderstatus"]).drop("value"))


@query("wn03_yoy_change", f"select cast(p as date) as period, {r('v / nullif(lag(v, 12) over (order by p), 0) - 1')} as yoy from {MONTHS}")
def wn03(spark, sf):
    return shown(ts.yoy_change(months(spark, sf), "month").drop("value"))


@query("wn04_rolling_mean", f"""
    select cast(p as date) as period, {r('case when count(*) over w = 3 then avg(v) over w end', 2)} as rolling from {MONTHS} window w as (order by p rows between 2 preceding and current row)""")
def wn04(spark, sf):
    return shown(ts.rolling_mean(months(spark, sf), 3).drop("value"), 2)


STREAK = """max(i) - coalesce(max(case when b is null or v <= b then i end), 0) as streak
    from (select *, row_number() over ({part} order by p) - 1 as i, lag(v) over ({part} order by p) as b from {frame})"""


@query("wn05_growth_streak", "select " + STREAK.format(part="", frame=MONTHS))
def wn05(spark, sf):
    return ts.growth_streak(months(spark, sf)).withColumn("streak", F.col("streak").cast("long"))


@query("wn05_streak_per_series", "select s as o_orderstatus, " + STREAK.format(part="partition by s", frame=STATUS_MONTHS) + " group by 1")
def wn05b(spark, sf):
    return ts.growth_streak(months(spark, sf, ["o_orderstatus"]), ["o_orderstatus"]).withColumn("streak", F.col("streak").cast("long"))


JUMP = f"""with c as (select p, v, lag(v) over (order by p) as b from {MONTHS}), d as (select p, v / b - 1 as ch from c where b is not null)
    select cast(p as date) as period, {r('ch')} as change, {r('(select stddev_samp(ch) from d)')} as sd_change,
           abs(ch) > 0.15 and abs(ch) > 1.8 * (select stddev_samp(ch) from d) as flagged from d order by abs(ch) desc, p limit 1"""


@query("wn06_largest_jump", JUMP)
def wn06(spark, sf):
    return shown(ts.largest_jump(months(spark, sf)))


HALVES = """with i as (select *, row_number() over (order by p) - 1 as i, count(*) over () as n from {frame}),
    h as (select avg(case when i < n // 2 then v end) as a, avg(case when i >= n - n // 2 then v end) as b from i)"""


@query("wn07_half_split", HALVES.format(frame=MONTHS) + f" select {r('a', 2)} as first_half, {r('b', 2)} as second_half, {r('b / a - 1')} as change from h")
def wn07(spark, sf):
    return rounded(ts.half_split_change(months(spark, sf)), 4, first_half=2, second_half=2)


@query("wn08_drop_partial_tail", f"""
    with i as (select *, row_number() over (order by p) - 1 as i, count(*) over () as n, avg(v) over (order by p rows between 3 preceding and 1 preceding) as m from {MONTHS})
    select cast(p as date) as period, {r('v', 2)} as value from i where not coalesce(i = n - 1 and n > 4 and v < m * 0.5, false)""")
def wn08(spark, sf):
    return shown(ts.drop_partial_tail(months(spark, sf)), 2)


@query("ts01_time_series", f"""
    select cast(p as date) as period, {r('v', 2)} as value, {r('v / nullif(lag(v) over (order by p), 0) - 1')} as change, {r('v / nullif(lag(v, 12) over (order by p), 0) - 1')} as yoy,
           {r('case when count(*) over w = 3 then avg(v) over w end', 2)} as rolling from {MONTHS} window w as (order by p rows between 2 preceding and current row)""")
def ts01(spark, sf):
    return shown(ts.time_series(load(spark, sf, "orders"), "o_orderdate", "o_totalprice", "month", "sum"), 4, value=2, rolling=2)


@query("ts01_trend_fit", f"""
    with i as (select p, v, row_number() over (order by p) - 1 as i from {MONTHS})
    select count(*) as n, {r('corr(i, v)')} as r, {r('regr_slope(v, i)', 2)} as slope, {r('regr_intercept(v, i)', 2)} as intercept,
           cast((select p from i order by v desc, p limit 1) as date) as peak from i""")
def ts01b(spark, sf):
    return shown(ts.trend_fit(months(spark, sf)), 4, slope=2, intercept=2)


def _rows(columns, rows):
    return f"(values {', '.join(str(row) for row in rows)}) as t({columns})"


def _forecast_sql(source, m, h=6):
    """CTEs that rate every model on a held-out tail and fit the best again: smoothing is a recursion over the periods, a row a lane.
    source has s (series), p (period) and v; m is the season's length."""
    holt = [(i, x, y) for i, (x, y) in enumerate(product(forecast.HOLT_ALPHA, forecast.HOLT_BETA))]
    winters = [(i, *g) for i, g in enumerate(product(forecast.HW_ALPHA, forecast.HW_BETA, forecast.HW_GAMMA))]
    return f"""with recursive w0 as (select s, p, v, row_number() over (partition by s order by p) - 1 as i, count(*) over (partition by s) as n,
                                      avg(v) over (partition by s order by p rows between 3 preceding and 1 preceding) as before from {source}),
    w as (select s, p, v, i, count(*) over (partition by s) as n from w0 where not coalesce(i = n - 1 and n > 6 and v < before * 0.5, false)),
    d as (select *, greatest(1, least({h}, n // 4)) as hold from w where n >= 6),
    u as (select 'train' as k, s, i, v, n - hold as n, hold as h from d where i < n - hold union all select 'full', s, i, v, n, {h} from d),
    z as (select k, s, any_value(n) as n, any_value(h) as h, list(cast(v as double) order by i) as y from u group by k, s),
    holt as (select k, s, lane, a, b, 1 as i, y[1] as l, y[2] - y[1] as t, cast(0 as double) as e from z, {_rows('lane, a, b', holt)}
             union all select k, s, lane, a, b, i + 1, nl, b * (nl - l) + (1 - b) * t, e + (v - l - t) * (v - l - t)
                       from (select holt.*, y[i + 1] as v, a * y[i + 1] + (1 - a) * (l + t) as nl from holt join z using (k, s) where i < n)),
    hw as (select k, s, lane, a, b, g, {m} as i, list_avg(y[1:{m}]) as l, (list_avg(y[{m + 1}:{2 * m}]) - list_avg(y[1:{m}])) / {m} as t, list_transform(y[1:{m}], lambda x: x - list_avg(y[1:{m}])) as q, cast(0 as double) as e
           from z, {_rows('lane, a, b, g', winters)} where n >= {2 * m}
           union all select k, s, lane, a, b, g, i + 1, nl, b * (nl - l) + (1 - b) * t, list_append(q[2:], g * (v - nl) + (1 - g) * q[1]), e + (v - l - t - q[1]) * (v - l - t - q[1])
                     from (select hw.*, y[i + 1] as v, a * (y[i + 1] - q[1]) + (1 - a) * (l + t) as nl from hw join z using (k, s) where i < n)),
    bh as (select holt.*, n, h from holt join z using (k, s) where i = n qualify row_number() over (partition by k, s order by e, lane) = 1),
    bw as (select hw.*, n, h from hw join z using (k, s) where i = n qualify row_number() over (partition by k, s order by e, lane) = 1),
    line as (select k, s, any_value(n) as n, any_value(h) as h, regr_slope(v, i) as b, regr_intercept(v, i) as a from u group by k, s),
    f as (select k, s, 0 as mi, j, y[n] as x from (select *, unnest(range(1, h + 1)) as j from z)
          union all select k, s, 1, j, list_avg(y[n - 2:n]) from (select *, unnest(range(1, h + 1)) as j from z)
          union all select k, s, 2, j, a + b * (n + j - 1) from (select *, unnest(range(1, h + 1)) as j from line)
          union all select k, s, 3, j, l + j * t from (select *, unnest(range(1, h + 1)) as j from bh)
          union all select k, s, 4, j, l + j * t + q[(j - 1) % {m} + 1] from (select *, unnest(range(1, h + 1)) as j from bw)),
    rms as (select s, 0 as mi, sqrt(avg((v - before) ** 2)) as rms from (select *, lag(v) over (partition by s order by i) as before from u where k = 'full') where i >= 1 group by s
            union all select s, 1, sqrt(avg(case when i < 3 then 0 else (v - m3) ** 2 end)) from (select *, avg(v) over (partition by s order by i rows between 3 preceding and 1 preceding) as m3 from u where k = 'full') where i >= 1 group by s
            union all select s, 2, sqrt(avg((v - a - b * i) ** 2)) from u join line using (k, s) where k = 'full' and i >= 1 group by s
            union all select s, 3, sqrt(e / (n - 1)) from bh where k = 'full' union all select s, 4, sqrt(e / (n - {m})) from bw where k = 'full'),
    named as (select * from (values (0, '{forecast.NAIVE}'), (1, '{forecast.AVERAGE}'), (2, '{forecast.TREND}'), (3, '{forecast.HOLT.replace("'", "''")}'), (4, '{forecast.HOLT_WINTERS}')) t(mi, method)),
    rated as (select s, mi, sqrt(avg((v - x) ** 2)) as rmse, avg(case when v <> 0 then abs((v - x) / v) else 0 end) as mape
              from f join d using (s) where k = 'train' and d.i = d.n - d.hold + j - 1 and (mi < 4 or d.n >= {2 * m + max(3, h)}) group by s, mi),
    ranked as (select s, method, mi, rmse, mape, row_number() over (partition by s order by rmse, mi) as rank from rated join named using (mi)),
    made as (select s, method, j, x, last_p, lowest, case when greatest(rms, rmse) > 0 then greatest(rms, rmse) else sd * 0.1 end * sqrt(j) as width
             from ranked join rms using (s, mi) join f using (s, mi) join (select s, max(p) as last_p, min(v) as lowest, stddev_samp(v) as sd from d group by s) using (s) where rank = 1 and k = 'full')"""


def _bands(digits=2):
    low = lambda z: r(f"case when lowest >= 0 then greatest(0, x - {z} * width) else x - {z} * width end", digits)
    return f"{low(forecast.Z80)} as lo80, {r(f'x + {forecast.Z80} * width', digits)} as hi80, {low(forecast.Z95)} as lo95, {r(f'x + {forecast.Z95} * width', digits)} as hi95"


@query("ts02_forecast", _forecast_sql(f"(select 0 as s, p, v from {MONTHS})", 12) + f"""
    select cast(last_p + to_months(cast(j as integer)) as date) as period, cast(j as integer) as step, method, {r('x', 2)} as yhat, {_bands()} from made""")
def ts02(spark, sf):
    return shown(forecast.forecast(load(spark, sf, "orders"), "o_orderdate", "o_totalprice", 6, "month", agg="sum"), 2)


PER_SERIES = """(select {'c_nationkey': c_nationkey, 'o_orderpriority': o_orderpriority} as s, date_trunc('month', o_orderdate) as p, sum(o_totalprice) as v
                from orders join customer on o_custkey = c_custkey group by 1, 2)"""


@query("ts02_forecast_per_series", _forecast_sql(PER_SERIES, 12) + f"""
    select s.c_nationkey as c_nationkey, s.o_orderpriority as o_orderpriority, cast(last_p + to_months(cast(j as integer)) as date) as period, cast(j as integer) as step, method, {r('x', 2)} as yhat, {_bands()} from made""")
def ts02b(spark, sf):
    orders, customers = load(spark, sf, "orders"), load(spark, sf, "customer")
    joined = orders.join(customers, orders.o_custkey == customers.c_custkey)
    return shown(forecast.forecast(joined, "o_orderdate", "o_totalprice", 6, "month", ["c_nationkey", "o_orderpriority"], "sum"), 2)


@query("ts05_intervals", _forecast_sql("(select o_orderstatus as s, date_trunc('quarter', o_orderdate) as p, sum(o_totalprice) as v from orders group by 1, 2)", 4, 8) + f"""
    select s as o_orderstatus, cast(j as integer) as step, {_bands()} from made""")
def ts05(spark, sf):
    """Bands of eight quarters ahead; they widen with the root of the step and stop at zero."""
    made = forecast.forecast(load(spark, sf, "orders"), "o_orderdate", "o_totalprice", 8, "quarter", ["o_orderstatus"], "sum")
    return rounded(made.select("o_orderstatus", "step", "lo80", "hi80", "lo95", "hi95"), 2)


@query("ts03_simple_forecasts", f"""
    with i as (select p, v, row_number() over (order by p) - 1 as i, count(*) over () as n from {MONTHS}),
    f as (select max(n) as n, max_by(v, i) as naive, avg(case when i >= n - 3 then v end) as average3, regr_slope(v, i) as b, regr_intercept(v, i) as a from i)
    select cast(step as integer) as step, {r('naive', 2)} as naive, {r('average3', 2)} as average3, {r('a + b * (n + step - 1)', 2)} as trend from f, (select unnest(range(1, 7)) as step)""")
def ts03(spark, sf):
    return rounded(forecast.simple_forecasts(months(spark, sf), 6), 2)


@query("ts03_simple_per_series", f"""
    with i as (select s, p, v, row_number() over (partition by s order by p) - 1 as i, count(*) over (partition by s) as n from {STATUS_MONTHS}),
    f as (select s, max(n) as n, max_by(v, i) as naive, avg(case when i >= n - 3 then v end) as average3, regr_slope(v, i) as b, regr_intercept(v, i) as a from i group by s)
    select s as o_orderstatus, cast(step as integer) as step, {r('naive', 2)} as naive, {r('average3', 2)} as average3, {r('a + b * (n + step - 1)', 2)} as trend
    from f, (select unnest(range(1, 7)) as step)""")
def ts03b(spark, sf):
    return rounded(forecast.simple_forecasts(months(spark, sf, ["o_orderstatus"]), 6, ["o_orderstatus"]), 2)


HOLDOUT = f"""
    with w as (select p, v, row_number() over (order by p) - 1 as i, count(*) over () as n, avg(v) over (order by p rows between 3 preceding and 1 preceding) as m from {MONTHS}),
    i as (select v, i, count(*) over () as n from w where not coalesce(i = n - 1 and n > 6 and v < m * 0.5, false)),
    tr as (select * from i where i < n - 6), te as (select * from i where i >= n - 6),
    f as (select max_by(v, i) as naive, avg(case when i >= n - 9 then v end) as average3, regr_slope(v, i) as b, regr_intercept(v, i) as a from tr)
    select 'Naive (last value)' as method, {r('sqrt(avg((v - naive) ** 2))', 2)} as rmse from te, f
    union all select 'Moving average (3)', {r('sqrt(avg((v - average3) ** 2))', 2)} from te, f
    union all select 'Linear trend', {r('sqrt(avg((v - (a + b * i)) ** 2))', 2)} from te, f"""


@query("ts04_holdout_scores", HOLDOUT)
def ts04(spark, sf):
    """Holdout error of the closed-form candidates, after dropping a partial last month."""
    scored = forecast.compare_models(load(spark, sf, "orders"), "o_orderdate", "o_totalprice", 6, "month", agg="sum")
    return rounded(scored.where(~F.col("method").startswith("Holt")).select("method", "rmse"), 2)


PRIORITY_MONTHS = "(select o_orderpriority as s, date_trunc('month', o_orderdate) as p, sum(o_totalprice) as v from orders group by 1, 2)"


@query("ts04_model_comparison", _forecast_sql(PRIORITY_MONTHS, 12) + f" select s as o_orderpriority, cast(rank as integer) as rank, method, {r('rmse', 2)} as rmse, {r('mape')} as mape from ranked")
def ts04b(spark, sf):
    return rounded(forecast.compare_models(load(spark, sf, "orders"), "o_orderdate", "o_totalprice", 6, "month", ["o_orderpriority"], "sum"), 4, rmse=2)


@query("ts06_periods", "select distinct cast(date_trunc('week', ts) as date) as period from events")
def ts06(spark, sf):
    return shown(ts.periods(load(spark, sf, "events"), "ts", "week"))


YEARS = """y as (select date_trunc('year', o_orderdate) as p, sum(o_totalprice) as v from orders group by 1),
    g as (select p, v, lag(p) over (order by p) as p0, lag(v) over (order by p) as v0 from y), c as (select * from g where p0 is not null order by abs(v - v0) desc, p limit 1)"""


@query("ts07_explain_change", f"""
    with {YEARS},
    l as (select 'o_orderstatus' as dim, o_orderstatus as value, o_orderdate, o_totalprice from orders union all select 'o_orderpriority', o_orderpriority, o_orderdate, o_totalprice from orders),
    m as (select dim, value, coalesce(sum(case when date_trunc('year', o_orderdate) = p0 then o_totalprice end), 0) as prev,
                 coalesce(sum(case when date_trunc('year', o_orderdate) = p then o_totalprice end), 0) as cur from l, c where date_trunc('year', o_orderdate) in (p, p0) group by 1, 2),
    k as (select *, cur - prev as delta, row_number() over (partition by dim order by abs(cur - prev) desc, value) as rank from m),
    s as (select dim, max(abs(delta)) / sum(abs(delta)) - 1.0 / count(*) as concentration from k group by 1)
    select dim, value, {r('prev', 2)} as prev, {r('cur', 2)} as cur, {r('delta', 2)} as delta, cast(rank as integer) as rank, {r('concentration')} as concentration from k join s using (dim) where rank <= 4""")
def ts07(spark, sf):
    out = change.explain_change(load(spark, sf, "orders"), "o_orderdate", "o_totalprice", ["o_orderstatus", "o_orderpriority"], "year", "sum")
    return rounded(out, 2, concentration=4)


@query("ts08_waterfall", f"""
    with {YEARS},
    m as (select o_orderpriority as label, coalesce(sum(case when date_trunc('year', o_orderdate) = p then o_totalprice end), 0) - coalesce(sum(case when date_trunc('year', o_orderdate) = p0 then o_totalprice end), 0) as d
          from orders, c group by 1),
    k as (select *, row_number() over (order by abs(d) desc, label) as rk from m)
    select cast(0 as integer) as step, 'start' as label, {r('v0', 2)} as amount from c union all select cast(rk as integer), label, {r('d', 2)} from k where rk <= 3
    union all select 4, 'Other', {r('sum(d)', 2)} from k where rk > 3 union all select 5, 'end', {r('v', 2)} from c""")
def ts08(spark, sf):
    return rounded(change.waterfall(load(spark, sf, "orders"), "o_orderdate", "o_totalprice", "o_orderpriority", "year", "sum", top=3), 2)


@query("ts09_resample", f"""
    with d as (select date_trunc('day', o_orderdate) as p, sum(o_totalprice) as v from orders where o_orderpriority = '1-URGENT' and o_orderstatus = 'P' group by 1)
    select cast(p as date) as period, {r('coalesce(v, 0)', 2)} as value from (select unnest(generate_series((select min(p) from d), (select max(p) from d), interval 1 day)) as p) left join d using (p)""")
def ts09(spark, sf):
    urgent = load(spark, sf, "orders").where("o_orderpriority = '1-URGENT' and o_orderstatus = 'P'")
    return shown(ts.resample(urgent, "o_orderdate", "o_totalprice", "day"), 2)


@query("ts09_resample_all", f"""
    with d as (select date_trunc('day', ts) as p, sum(value) as v from events group by 1)
    select cast(p as date) as period, {r('coalesce(v, 0)', 2)} as value from (select unnest(generate_series((select min(p) from d), (select max(p) from d), interval 1 day)) as p) left join d using (p)""")
def ts09b(spark, sf):
    """All events a day on a complete calendar."""
    return shown(ts.resample(load(spark, sf, "events"), "ts", "value", "day"), 2)
