"""Queries over monthly and daily series."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import series, windows
from plumbline.plans.registry import Registry
from plumbline.session import cut_lineage
from plumbline.sources.tables import table

q = Registry()
QUERIES, SQL = q.queries, q.sql

_M = "SELECT cast(date_trunc('month', o_orderdate) AS TIMESTAMP) AS m, o_orderpriority AS g, sum(o_totalprice) AS v FROM orders GROUP BY 1, 2"


def _monthly(s, d):
    return table(s, d, "orders").groupBy(F.date_trunc("month", "o_orderdate").alias("m"), F.col("o_orderpriority").alias("g")).agg(F.sum("o_totalprice").alias("v"))


def _batches(s, d):
    m = table(s, d, "orders").select(F.date_trunc("month", "o_orderdate").alias("m"), (F.col("o_custkey") % 3).alias("b"), F.col("o_orderpriority").alias("g"), "o_totalprice")
    return m.groupBy("b", "m", "g").agg(F.sum("o_totalprice").alias("v"))


@q("anchor_rescale", """
    WITH x AS (SELECT o_custkey % 3 AS b, cast(date_trunc('month', o_orderdate) AS TIMESTAMP) AS m, o_orderpriority AS g, sum(o_totalprice) AS v FROM orders GROUP BY 1, 2, 3),
    k AS (SELECT b, avg(v) AS mean FROM x WHERE g = '1-URGENT' GROUP BY 1), f AS (SELECT b, (SELECT arg_min(mean, b) FROM k) / mean AS f FROM k), o AS (SELECT g, min(b) AS b FROM x GROUP BY 1)
    SELECT x.m, x.g, x.v * f.f AS v FROM x JOIN f ON f.b = x.b JOIN o ON o.g = x.g AND o.b = x.b""")
def anchor_rescale(s, d):
    return series.rescale(_batches(s, d), "b", "m", "g", "v", "1-URGENT")


_TREND = f"""WITH i AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY m) - 1 AS i, row_number() OVER (PARTITION BY g ORDER BY m DESC) AS z FROM ({_M})),
    t AS (SELECT g, regr_slope(v, i) AS slope, quantile_cont(v, 0.5) FILTER (i < 12) AS head, quantile_cont(v, 0.5) FILTER (z <= 12) AS tail, avg(v) FILTER (i < 12) AS head1, avg(v) FILTER (z <= 12) AS tail1,
      quantile_cont(v, 0.5) AS mid FROM i GROUP BY 1)"""


@q("trend_class", f"""{_TREND} SELECT g, round(slope, 4) AS slope, (tail / head - 1) * 100 AS pct_change, CASE WHEN tail / head >= 1.1 THEN 'rising' WHEN tail / head <= 0.9 THEN 'declining' ELSE 'stable' END AS class, mid < 1000 AS low_volume FROM t""")
def trend_class(s, d):
    return series.trend_class(_monthly(s, d), ["g"], "m", "v", 12, low=1000.0).withColumn("slope", F.round("slope", 4))


@q("trend_class_means", f"""{_TREND} SELECT g, (tail1 / head1 - 1) * 100 AS pct_change FROM t""")
def trend_class_means(s, d):
    return series.trend_class(_monthly(s, d), ["g"], "m", "v", 12, robust=False).select("g", "pct_change")


@q("threshold_sensitivity", f"""{_TREND} SELECT g, count(DISTINCT CASE WHEN (tail / head - 1) * 100 >= p THEN 'r' WHEN (tail / head - 1) * 100 <= -p THEN 'd' ELSE 's' END) AS classes,
    count(DISTINCT CASE WHEN (tail / head - 1) * 100 >= p THEN 'r' WHEN (tail / head - 1) * 100 <= -p THEN 'd' ELSE 's' END) = 1 AS stable FROM t, (VALUES (5.0), (10.0), (15.0), (20.0)) x(p) GROUP BY 1""")
def threshold_sensitivity(s, d):
    return series.sensitivity(series.trend_class(_monthly(s, d), ["g"], "m", "v", 12), ["g"], [5, 10, 15, 20])


@q("series_agreement", f"SELECT a.g AS a, b.g AS b, round(corr(a.v, b.v), 9) AS r, avg(a.v) / avg(b.v) AS ratio FROM ({_M}) a JOIN ({_M}) b ON a.m = b.m AND a.g < b.g GROUP BY 1, 2")
def series_agreement(s, d):
    return series.pairwise_agreement(_monthly(s, d), "g", "m", "v").withColumn("r", F.round("r", 9))


@q("mann_kendall", f"""WITH i AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY m) AS i FROM ({_M})) SELECT a.g, cast(sum(sign(b.v - a.v)) AS BIGINT) AS s, quantile_cont((b.v - a.v) / (b.i - a.i), 0.5) AS sen_slope FROM i a JOIN i b ON a.g = b.g AND a.i < b.i GROUP BY 1""")
def mann_kendall(s, d):
    return series.mann_kendall(_monthly(s, d), ["g"], "m", "v").select("g", "s", "sen_slope")


def _backtest(s, d):
    return series.backtest(_monthly(s, d), ["g"], "m", "v", 36, 3, 6, 12)


@q("naive_backtest", f"""
    WITH i AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY m) AS i, count(*) OVER (PARTITION BY g) AS n, lag(v) OVER (PARTITION BY g ORDER BY m) AS p FROM ({_M})),
    o AS (SELECT g, i AS o, v AS f, n FROM i WHERE i >= 36 AND (i - 36) % 6 = 0 AND i + 3 <= n),
    c AS (SELECT o.g, o.o, o.f, avg(abs(i.v - i.p)) AS scale FROM o JOIN i ON i.g = o.g AND i.i <= o.o AND i.p IS NOT NULL GROUP BY 1, 2, 3)
    SELECT c.g, avg(abs(i.v - c.f) / abs(i.v)) * 100 AS mape, avg(2 * abs(i.v - c.f) / (abs(i.v) + abs(c.f))) * 100 AS smape, avg(abs(i.v - c.f) / c.scale) AS mase
    FROM c JOIN i ON i.g = c.g AND i.i BETWEEN c.o + 1 AND c.o + 3 GROUP BY 1""")
def naive_backtest(s, d):
    return series.forecast_errors(_backtest(s, d), ["g"]).filter("method = 'naive'").drop("method")


@q("backtest_all")
def backtest_all(s, d):
    return series.forecast_errors(_backtest(s, d), ["g"])


@q("beats_naive")
def beats_naive(s, d):
    return series.beats(series.forecast_errors(_backtest(s, d), ["g"]), ["g"], "mape")


@q("best_method")
def best_method(s, d):
    e = series.forecast_errors(_backtest(s, d), ["g"])
    return e.groupBy("g").agg(F.min(F.struct("mape", "method")).alias("b")).select("g", "b.method", "b.mape")


@q("signed_rank", """
    WITH d AS (SELECT l_extendedprice * l_discount - l_extendedprice * l_tax AS d FROM lineitem WHERE l_discount <> l_tax), r AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2 AS r FROM d WHERE d <> 0)
    SELECT count(*) AS n, sum(CASE WHEN d > 0 THEN r ELSE 0 END) AS w FROM r""")
def signed_rank(s, d):
    x = table(s, d, "lineitem").filter("l_discount <> l_tax").select((F.col("l_extendedprice") * F.col("l_discount")).alias("a"), (F.col("l_extendedprice") * F.col("l_tax")).alias("b"))
    return series.signed_rank(x, "a", "b").select("n", "w")


@q("seasonal_strength")
def seasonal_strength(s, d):
    return series.strengths(series.decompose(_monthly(s, d), ["g"], "m", "v", 12), ["g"])


@q("stl_strength")
def stl_strength(s, d):
    return series.strengths(series.stl(_monthly(s, d), ["g"], "m", "v", 12), ["g"])


@q("moving_trend", f"""
    WITH i AS (SELECT g, m, v, count(*) OVER w AS n, sum(v) OVER (PARTITION BY g ORDER BY m ROWS BETWEEN 6 PRECEDING AND 5 FOLLOWING) AS a, sum(v) OVER (PARTITION BY g ORDER BY m ROWS BETWEEN 5 PRECEDING AND 6 FOLLOWING) AS b
      FROM ({_M}) WINDOW w AS (PARTITION BY g ORDER BY m ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING)) SELECT g, m, CASE WHEN n = 13 THEN (a + b) / 24 END AS trend FROM i""")
def moving_trend(s, d):
    return series.decompose(_monthly(s, d), ["g"], "m", "v", 12).select("g", "m", "trend")


@q("interrupted_series")
def interrupted_series(s, d):
    import datetime

    return series.interrupted(_monthly(s, d), ["g"], "m", "v", datetime.datetime(1998, 7, 1))


def _nation_months(s, d):
    o = table(s, d, "orders").join(table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return o.filter("c_nationkey is not null").groupBy(F.col("c_nationkey").cast("string").alias("u"), F.date_trunc("month", "o_orderdate").alias("m")).agg(F.sum("o_totalprice").alias("v"))


_CHANGE = """SELECT cast(c_nationkey AS VARCHAR) AS u, avg(v) FILTER (m >= TIMESTAMP '1998-07-01') - avg(v) FILTER (m < TIMESTAMP '1998-07-01') AS change FROM
    (SELECT c_nationkey, date_trunc('month', o_orderdate) AS m, sum(o_totalprice) AS v FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey IS NOT NULL GROUP BY 1, 2) GROUP BY 1"""


def _placebo(months):
    x = months.withColumn("event", F.explode(F.expr("sequence(timestamp'1997-01-01', timestamp'1999-01-01', interval 6 months)")))
    c = x.groupBy("event", "u").agg((F.avg(F.when(F.col("m") >= F.col("event"), F.col("v"))) - F.avg(F.when(F.col("m") < F.col("event"), F.col("v")))).alias("change"))
    inside = F.col("u").cast("int") < 5
    return c.groupBy("event").agg((F.avg(F.when(inside, F.col("change"))) - F.avg(F.when(~inside, F.col("change")))).alias("did"))


_TREATED = ("0", "3", "5", "7", "11")


def _nation_changes(s, d):
    return series.changes(_nation_months(s, d), "u", "m", "v", F.lit("1998-07-01").cast("timestamp"))


@q("did_effect", f"SELECT avg(change) FILTER (u IN {_TREATED}) - avg(change) FILTER (u NOT IN {_TREATED}) AS did FROM ({_CHANGE})")
def did_effect(s, d):
    return series.difference_in_differences(_nation_changes(s, d), "u", _TREATED)


@q("did_randomisation", f"""
    WITH c AS (SELECT change AS x, row_number() OVER (ORDER BY u::INTEGER) - 1 AS i FROM ({_CHANGE}) WHERE change IS NOT NULL), t AS (SELECT sum(x) AS s, count(*) AS n FROM c),
    a AS (SELECT (1::BIGINT << a.i) + (1::BIGINT << b.i) + (1::BIGINT << c.i) + (1::BIGINT << d.i) + (1::BIGINT << e.i) AS m, a.x + b.x + c.x + d.x + e.x AS a
      FROM c a JOIN c b ON a.i < b.i JOIN c ON b.i < c.i JOIN c d ON c.i < d.i JOIN c e ON d.i < e.i)
    SELECT m AS subset, round(a / 5 - (s - a) / (n - 5), 6) AS did FROM a, t""")
def did_randomisation(s, d):
    c = cut_lineage(_nation_changes(s, d).filter("change is not null"))
    units = sorted((r["u"] for r in c.select("u").collect()), key=int)  # the nations
    return series.randomisation(c, "u", windows.subsets(s, units, 5)).select("subset", F.round("did", 6).alias("did"))


@q("placebo_dates", f"""
    WITH x AS (SELECT c_nationkey, date_trunc('month', o_orderdate) AS m, sum(o_totalprice) AS v FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey IS NOT NULL GROUP BY 1, 2),
    p AS (SELECT unnest(generate_series(TIMESTAMP '1997-01-01', TIMESTAMP '1999-01-01', INTERVAL 6 MONTH)) AS e),
    c AS (SELECT e, c_nationkey, avg(v) FILTER (m >= e) - avg(v) FILTER (m < e) AS change FROM x, p GROUP BY 1, 2)
    SELECT e AS event, avg(change) FILTER (c_nationkey < 5) - avg(change) FILTER (c_nationkey >= 5) AS did FROM c GROUP BY 1""")
def placebo_dates(s, d):
    return _placebo(_nation_months(s, d))


@q("conformal_coverage")
def conformal_coverage(s, d):
    c = series.conformal_intervals(_backtest(s, d), ["g"], 0.2, 3).filter("inside is not null")
    return c.groupBy("method").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("inside").cast("double")).alias("coverage"))


@q("series_long", "SELECT day, measure, value FROM (SELECT cast(ts AS DATE) AS day, count(*)::DOUBLE AS n, sum(value) AS total FROM events GROUP BY 1) UNPIVOT (value FOR measure IN (n, total))")
def series_long(s, d):
    w = table(s, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("value").alias("total"))
    return w.unpivot(["day"], ["n", "total"], "measure", "value")
