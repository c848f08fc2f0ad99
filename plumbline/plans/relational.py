"""Queries of projections, joins, windows, sorts, samples and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from plumbline.operators import serve, windows
from plumbline.plans.registry import Registry
from plumbline.sources.tables import instant, table

q = Registry()
QUERIES, SQL = q.queries, q.sql


# projections and filters

@q("first_reason", """SELECT job_id, role, CASE WHEN title IS NULL OR trim(title) = '' THEN 'no_title' WHEN length(trim(title)) < 8 THEN 'short_title'
    WHEN reviewer_label IS NULL OR trim(reviewer_label) = '' THEN 'unreviewed' END AS reason FROM human_validation_template""")
def first_reason(s, d):
    from plumbline.functions.text import is_missing

    reason = F.when(is_missing(F.col("title")), "no_title").when(F.length(F.trim("title")) < 8, "short_title").when(is_missing(F.col("reviewer_label")), "unreviewed")
    return table(s, d, "human_validation_template").select("job_id", "role", reason.alias("reason"))


@q("range_flags", """SELECT flag, count(*) AS n FROM (SELECT unnest([CASE WHEN lo > hi THEN 'crossed' END, CASE WHEN lo = hi THEN 'point' END,
      CASE WHEN (lo IS NULL) <> (hi IS NULL) THEN 'one_sided' END, CASE WHEN coalesce(lo, hi) <= 0 THEN 'non_positive' END,
      CASE WHEN coalesce(hi, lo) > 10000000 THEN 'huge' END]) AS flag
    FROM (SELECT raw.salary_min AS lo, raw.salary_max AS hi FROM records_project_manager__scrum_master)) WHERE flag IS NOT NULL GROUP BY 1""")
def range_flags(s, d):
    lo, hi = F.col("raw.salary_min"), F.col("raw.salary_max")
    flags = F.array_compact(F.array(
        F.when(lo > hi, "crossed"), F.when(lo == hi, "point"), F.when(lo.isNull() != hi.isNull(), "one_sided"),
        F.when(F.coalesce(lo, hi) <= 0, "non_positive"), F.when(F.coalesce(hi, lo) > 10_000_000, "huge"),
    ))
    return table(s, d, "records_project_manager__scrum_master").select(F.explode(flags).alias("flag")).groupBy("flag").agg(F.count(F.lit(1)).alias("n"))


@q("window_bounds", """
    WITH t AS (SELECT collection.run_id AS run_id, try_cast(collection.collected_at AS TIMESTAMPTZ) AS c, try_cast(raw.created AS TIMESTAMPTZ) AS p FROM records_graphic_designer__visual_designer),
    b AS (SELECT min(c) AS lo, max(c) + INTERVAL 14 HOUR AS hi FROM t)
    SELECT run_id, count(*) AS n, count(*) FILTER (p > hi) AS future, count(*) FILTER (p < lo - INTERVAL 60 DAY) AS old, count(*) FILTER (p IS NULL) AS undated FROM t, b GROUP BY 1""")
def window_bounds(s, d):
    t = table(s, d, "records_graphic_designer__visual_designer").select(
        F.col("collection.run_id").alias("run_id"), instant(F.col("collection.collected_at")).alias("c"), instant(F.col("raw.created")).alias("p")
    )
    lo, hi = t.agg(F.min("c"), F.max("c")).first()  # two instants
    p = F.col("p")
    return t.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(p > F.lit(hi) + F.expr("interval 14 hours")).alias("future"),
        F.count_if(p < F.lit(lo) - F.expr("interval 60 days")).alias("old"), F.count_if(p.isNull()).alias("undated"),
    )


@q("routing_split", """SELECT route, count(*) AS n, sum(o_totalprice) AS total FROM (SELECT *, CASE WHEN o_orderstatus = 'P' THEN 'stage_a'
    WHEN o_totalprice < 1000 THEN 'stage_b' ELSE 'final' END AS route FROM orders) GROUP BY 1""")
def routing_split(s, d):
    route = F.when(F.col("o_orderstatus") == "P", "stage_a").when(F.col("o_totalprice") < 1000, "stage_b").otherwise("final")
    return table(s, d, "orders").groupBy(route.alias("route")).agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total"))


@q("midpoint_span", """SELECT raw.id AS id, (raw.salary_min + raw.salary_max) / 2 AS mid, raw.salary_max - raw.salary_min AS span, raw.salary_min <= 0 AS open_ended
    FROM records_project_manager__scrum_master WHERE raw.salary_min IS NOT NULL AND raw.salary_max IS NOT NULL""")
def midpoint_span(s, d):
    lo, hi = F.col("raw.salary_min"), F.col("raw.salary_max")
    return table(s, d, "records_project_manager__scrum_master").filter(lo.isNotNull() & hi.isNotNull()).select(
        F.col("raw.id").alias("id"), ((lo + hi) / 2).alias("mid"), (hi - lo).alias("span"), (lo <= 0).alias("open_ended")
    )


FILTERS = {"o_orderpriority": ["1-URGENT", "2-HIGH"], "o_orderstatus": [], "o_totalprice": (1000.0, 200000.0)}


@q("multi_filter", "SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND (o_totalprice IS NULL OR o_totalprice BETWEEN 1000 AND 200000)")
def multi_filter(s, d):
    return table(s, d, "orders").filter(serve.conjunction(FILTERS)).select("o_orderkey")


@q("param_filter", "SELECT count(*) AS n FROM orders WHERE o_orderpriority = '5-LOW' AND o_totalprice BETWEEN 0 AND 100000")
def param_filter(s, d):
    table(s, d, "orders").createOrReplaceTempView("pl_orders")
    return s.sql(
        "SELECT count(*) AS n FROM pl_orders WHERE (:p = 'All' OR o_orderpriority = :p) AND (:st = 'All' OR o_orderstatus = :st) AND (o_totalprice IS NULL OR o_totalprice BETWEEN :lo AND :hi)",
        args={"p": "5-LOW", "st": "All", "lo": 0.0, "hi": 100000.0},
    )


@q("facet_counts", "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_totalprice IS NULL OR o_totalprice BETWEEN 1000 AND 200000 GROUP BY 1")
def facet_counts(s, d):
    return serve.facet(table(s, d, "orders"), FILTERS, "o_orderpriority")


@q("explorer_filter", "SELECT p_partkey FROM part WHERE contains(lower(p_name || ' ' || p_brand), 'ring brand#1') AND p_retailprice BETWEEN 900 AND 1500")
def explorer_filter(s, d):
    p = table(s, d, "part").withColumn("both", F.concat_ws(" ", "p_name", "p_brand"))
    return p.filter(serve.conjunction({"both": "~Ring Brand#1", "p_retailprice": (900.0, 1500.0)})).select("p_partkey")


@q("comparable_rows", """SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' AND ((SELECT count(*) FROM orders WHERE o_orderpriority = '1-URGENT' AND abs(o_totalprice - 250000) <= 100) < 15
    OR abs(o_totalprice - 250000) <= 100)""")
def comparable_rows(s, d):
    same = table(s, d, "orders").filter("o_orderpriority = '1-URGENT'")
    return serve.comparable(same, F.abs(F.col("o_totalprice") - 250000) <= 100, 15).select("o_orderkey")


@q("top_or_other", """WITH t AS (SELECT c_nationkey FROM customer GROUP BY 1 ORDER BY count(*) DESC, cast(c_nationkey AS VARCHAR) LIMIT 5)
    SELECT coalesce(cast(t.c_nationkey AS VARCHAR), 'Other') AS bucket, count(*) AS n FROM customer c LEFT JOIN t ON c.c_nationkey = t.c_nationkey GROUP BY 1""")
def top_or_other(s, d):
    c = table(s, d, "customer").select(F.col("c_nationkey").cast("string").alias("k"))
    return serve.top_or_other(c, "k", 5, "bucket").groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


@q("literal_map", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 2 WHEN 'O' THEN 1 ELSE 0 END AS level FROM orders")
def literal_map(s, d):
    level = F.coalesce(F.create_map(F.lit("F"), F.lit(2), F.lit("O"), F.lit(1))[F.col("o_orderstatus")], F.lit(0))
    return table(s, d, "orders").select("o_orderkey", level.alias("level"))


@q("dummy_columns", "SELECT c_custkey, (c_mktsegment = 'BUILDING')::INT AS building, (c_mktsegment = 'MACHINERY')::INT AS machinery FROM customer")
def dummy_columns(s, d):
    one = lambda v: (F.col("c_mktsegment") == v).cast("int").alias(v.lower())
    return table(s, d, "customer").select("c_custkey", one("BUILDING"), one("MACHINERY"))


@q("threshold_decision", """SELECT role, CASE WHEN n >= 400 THEN 'include' WHEN n >= 200 AND capped THEN 'conditional' WHEN n >= 50 THEN 'review' ELSE 'exclude' END AS decision
    FROM (SELECT role, count(*) AS n, max(cap_per_employer_in_role) >= 5 AS capped FROM employer_cap_exclusions GROUP BY 1)""")
def threshold_decision(s, d):
    n = table(s, d, "employer_cap_exclusions").groupBy("role").agg(F.count(F.lit(1)).alias("n"), (F.max("cap_per_employer_in_role") >= 5).alias("capped"))
    decision = F.when(F.col("n") >= 400, "include").when((F.col("n") >= 200) & F.col("capped"), "conditional").when(F.col("n") >= 50, "review").otherwise("exclude")
    return n.select("role", decision.alias("decision"))


@q("quadrant", """
    WITH t AS (SELECT p_brand, count(*) AS demand, avg(p_retailprice) AS level FROM part GROUP BY 1), m AS (SELECT quantile_cont(demand, 0.5) AS dm, quantile_cont(level, 0.5) AS lm FROM t)
    SELECT p_brand, CASE WHEN demand >= dm AND level >= lm THEN 'hot' WHEN demand >= dm THEN 'opportunity' WHEN level >= lm THEN 'emerging' ELSE 'avoid' END AS quadrant FROM t, m""")
def quadrant(s, d):
    t = table(s, d, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("demand"), F.avg("p_retailprice").alias("level"))
    dm, lm = t.agg(F.percentile("demand", 0.5), F.percentile("level", 0.5)).first()  # two numbers
    big, high = F.col("demand") >= dm, F.col("level") >= lm
    return t.select("p_brand", F.when(big & high, "hot").when(big, "opportunity").when(high, "emerging").otherwise("avoid").alias("quadrant"))


@q("profile_grid", """SELECT r_name, p_brand, size FROM region, (SELECT DISTINCT p_brand FROM part) p, (VALUES (1), (5), (10)) v(size)""")
def profile_grid(s, d):
    sizes = F.explode(F.array(*[F.lit(x) for x in (1, 5, 10)]))
    brands = table(s, d, "part").select("p_brand").distinct()  # a what-if grid of dimension values
    return table(s, d, "region").select("r_name", sizes.alias("size")).join(brands, F.lit(True)).select("r_name", "p_brand", "size")


# joins

@q("checked_join", """SELECT c_custkey, c_name, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def checked_join(s, d):
    c, n, r = table(s, d, "customer"), table(s, d, "nation"), table(s, d, "region")
    return c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey")).select("c_custkey", "c_name", "n_name", "r_name")


@q("left_chain", """SELECT c_custkey, o.n AS orders, o.total FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS total FROM orders GROUP BY 1) o ON c_custkey = o_custkey""")
def left_chain(s, d):
    o = table(s, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("orders"), F.sum("o_totalprice").alias("total"))
    return table(s, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "orders", "total")


@q("anti_new_rows", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def anti_new_rows(s, d):
    return table(s, d, "customer").join(table(s, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@q("semi_members", "SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_discount > 0.09)")
def semi_members(s, d):
    return table(s, d, "part").join(table(s, d, "lineitem").filter("l_discount > 0.09"), F.col("p_partkey") == F.col("l_partkey"), "left_semi").select("p_partkey")


@q("full_counts", """SELECT coalesce(a.k, b.k) AS k, coalesce(a.n, 0) AS customers, coalesce(b.n, 0) AS suppliers FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1) a
    FULL JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1) b ON a.k = b.k""")
def full_counts(s, d):
    a = table(s, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("a"))
    b = table(s, d, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("b"))
    return a.join(b, "k", "full").select("k", F.coalesce("a", F.lit(0)).alias("customers"), F.coalesce("b", F.lit(0)).alias("suppliers"))


@q("interval_overlap", """
    WITH r AS (SELECT run_id, min(try_cast(pull_started AS TIMESTAMPTZ)) AS a, max(try_cast(pull_finished AS TIMESTAMPTZ)) AS b FROM queries GROUP BY 1),
    l AS (SELECT *, lag(b) OVER (ORDER BY a, run_id) AS before FROM r) SELECT run_id, coalesce(before > a, false) AS overlaps FROM l""")
def interval_overlap(s, d):
    r = table(s, d, "queries").groupBy("run_id").agg(F.min(instant(F.col("pull_started"))).alias("a"), F.max(instant(F.col("pull_finished"))).alias("b"))
    before = F.lag("b").over(Window.orderBy("a", "run_id"))  # a row for each run
    return r.select("run_id", F.coalesce(before > F.col("a"), F.lit(False)).alias("overlaps"))


@q("asof_join", """
    SELECT e.event_id, max(p.event_id) AS last_purchase FROM events e LEFT JOIN events p ON p.user_id = e.user_id AND p.event_type = 'purchase' AND (p.ts, p.event_id) <= (e.ts, e.event_id) GROUP BY 1""")
def asof_join(s, d):
    # one window instead of an inequality join: the last matching row up to each row
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    mark = F.last(F.when(F.col("event_type") == "purchase", F.col("event_id")), ignorenulls=True)
    return table(s, d, "events").select("event_id", mark.over(w).alias("last_purchase"))


@q("calibration_join", """
    WITH m AS (SELECT date_trunc('month', o_orderdate) AS m, o_orderpriority AS g, avg(o_totalprice) AS v FROM orders GROUP BY 1, 2),
    e AS (SELECT g, m, abs(v - lag(v) OVER (PARTITION BY g ORDER BY m)) AS err FROM m)
    SELECT f.g, cast(f.m AS TIMESTAMP) AS m, count(e.err) AS n, max(e.err) AS worst FROM e f LEFT JOIN e ON e.g = f.g AND e.m < f.m GROUP BY 1, 2""")
def calibration_join(s, d):
    m = table(s, d, "orders").groupBy(F.date_trunc("month", "o_orderdate").alias("m"), F.col("o_orderpriority").alias("g")).agg(F.avg("o_totalprice").alias("v"))
    o = Window.partitionBy("g").orderBy("m")
    e = m.withColumn("err", F.abs(F.col("v") - F.lag("v").over(o)))
    past = o.rowsBetween(Window.unboundedPreceding, -1)
    return e.select("g", "m", F.count("err").over(past).alias("n"), F.max("err").over(past).alias("worst"))


@q("run_overlap_matrix", """
    WITH r AS (SELECT DISTINCT collection.run_id AS run, collection.adzuna_id AS id FROM records_graphic_designer__visual_designer)
    SELECT a.run AS run_a, b.run AS run_b, count(*) AS shared FROM r a JOIN r b ON a.id = b.id AND a.run < b.run GROUP BY 1, 2""")
def run_overlap_matrix(s, d):
    # ids that came in one run only can't be shared: they are gone before the join
    r = table(s, d, "records_graphic_designer__visual_designer").select(F.col("collection.run_id").alias("run"), F.col("collection.adzuna_id").alias("id")).distinct()
    more = r.groupBy("id").agg(F.array_sort(F.collect_set("run")).alias("runs")).filter(F.size("runs") > 1)
    a = more.select("runs", F.posexplode("runs").alias("i", "run_a"))
    b = a.select("run_a", F.explode(F.slice("runs", F.col("i") + 2, F.size("runs"))).alias("run_b"))
    return b.groupBy("run_a", "run_b").agg(F.count(F.lit(1)).alias("shared"))


@q("carry_forward", """SELECT DISTINCT h.job_id, h.role, h.title FROM human_validation_template h JOIN employer_cap_exclusions e ON h.job_id = e.job_id AND h.role = e.role WHERE h.reviewer_label IS NOT NULL""")
def carry_forward(s, d):
    h = table(s, d, "human_validation_template").filter("reviewer_label is not null").select("job_id", "role", "title")
    return h.join(table(s, d, "employer_cap_exclusions"), ["job_id", "role"], "left_semi").distinct()


@q("keyed_lookup", """SELECT r.run_id, r.query_role, count(*) AS rows_seen, any_value(q.n) AS planned FROM (SELECT collection.run_id AS run_id, collection.query_role AS query_role FROM records_project_manager__scrum_master) r
    LEFT JOIN (SELECT run_id, query_role, count(*) AS n FROM queries GROUP BY 1, 2) q ON r.run_id = q.run_id AND r.query_role = q.query_role GROUP BY 1, 2""")
def keyed_lookup(s, d):
    r = table(s, d, "records_project_manager__scrum_master").groupBy(F.col("collection.run_id").alias("run_id"), F.col("collection.query_role").alias("query_role")).agg(F.count(F.lit(1)).alias("rows_seen"))
    n = table(s, d, "queries").groupBy("run_id", "query_role").agg(F.count(F.lit(1)).alias("planned"))
    return r.join(n, ["run_id", "query_role"], "left")


@q("aligned_series", """
    WITH a AS (SELECT cast(ts AS DATE) AS day, count(*) AS clicks FROM events WHERE event_type = 'click' GROUP BY 1), b AS (SELECT cast(ts AS DATE) AS day, count(*) AS errors FROM events WHERE event_type = 'error' GROUP BY 1)
    SELECT a.day, clicks, errors FROM a LEFT JOIN b ON a.day = b.day""")
def aligned_series(s, d):
    e = table(s, d, "events").withColumn("day", F.to_date("ts"))
    n = lambda t, c: e.filter(F.col("event_type") == t).groupBy("day").agg(F.count(F.lit(1)).alias(c))
    return n("click", "clicks").join(n("error", "errors"), "day", "left")


# windows

@q("trailing_mean", """SELECT day, event_type, n, avg(n) OVER (PARTITION BY event_type ORDER BY day ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS mean
    FROM (SELECT cast(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2)""")
def trailing_mean(s, d):
    n = table(s, d, "events").groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("mean", windows.trailing_mean(["event_type"], "day", "n", 8))


@q("lag_gaps", """SELECT o_custkey, max(gap) AS longest, min(gap) AS shortest FROM (SELECT o_custkey, datediff('day', lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), o_orderdate) AS gap FROM orders)
    WHERE gap IS NOT NULL GROUP BY 1""")
def lag_gaps(s, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    g = table(s, d, "orders").select("o_custkey", F.datediff("o_orderdate", F.lag("o_orderdate").over(w)).alias("gap")).filter("gap is not null")
    return g.groupBy("o_custkey").agg(F.max("gap").cast("long").alias("longest"), F.min("gap").cast("long").alias("shortest"))


_MONTHLY = "SELECT cast(date_trunc('month', o_orderdate) AS TIMESTAMP) AS m, o_orderpriority AS g, sum(o_totalprice) AS v FROM orders GROUP BY 1, 2"


def _monthly(s, d):
    return table(s, d, "orders").groupBy(F.date_trunc("month", "o_orderdate").alias("m"), F.col("o_orderpriority").alias("g")).agg(F.sum("o_totalprice").alias("v"))


@q("first_last_window", f"""
    WITH r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY m) AS a, row_number() OVER (PARTITION BY g ORDER BY m DESC) AS z FROM ({_MONTHLY}))
    SELECT g, quantile_cont(v, 0.5) FILTER (a <= 12) AS head, quantile_cont(v, 0.5) FILTER (z <= 12) AS tail, count(*) AS n FROM r GROUP BY 1""")
def first_last_window(s, d):
    return windows.ends(_monthly(s, d), ["g"], "m", "v", 12)


@q("best_break", f"""
    WITH x AS (SELECT g, row_number() OVER w AS k, count(*) OVER (PARTITION BY g) AS n, sum(v) OVER w AS s, sum(v * v) OVER w AS q, sum(v) OVER (PARTITION BY g) AS st, sum(v * v) OVER (PARTITION BY g) AS qt
      FROM ({_MONTHLY}) WINDOW w AS (PARTITION BY g ORDER BY m)),
    e AS (SELECT g, k, q - s * s / k + (qt - q) - (st - s) ^ 2 / (n - k) AS sse FROM x WHERE k >= 8 AND n - k >= 8)
    SELECT g, arg_min(k, sse) AS k FROM e GROUP BY 1""")
def best_break(s, d):
    return windows.best_break(_monthly(s, d), ["g"], "m", "v", 8).select("g", "k")


@q("acf_lags", f"""
    WITH c AS (SELECT g, m, v - avg(v) OVER (PARTITION BY g) AS v FROM ({_MONTHLY})), i AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY m) AS i FROM c)
    SELECT a.g, a.i - b.i AS lag, round(sum(a.v * b.v) / any_value(t.c0), 8) AS acf FROM i a JOIN i b ON a.g = b.g AND a.i - b.i BETWEEN 1 AND 6 JOIN (SELECT g, sum(v * v) AS c0 FROM c GROUP BY 1) t ON t.g = a.g GROUP BY 1, 2""")
def acf_lags(s, d):
    return windows.autocorrelation(_monthly(s, d), ["g"], "m", "v", 6).select("g", F.col("lag").cast("long").alias("lag"), F.round("acf", 8).alias("acf"))


@q("pacf_lags")
def pacf_lags(s, d):
    return windows.partial_autocorrelation(windows.autocorrelation(_monthly(s, d), ["g"], "m", "v", 6), ["g"])


@q("share_of_total", f"SELECT g, m, v / sum(v) OVER (PARTITION BY m) AS share FROM ({_MONTHLY})")
def share_of_total(s, d):
    return _monthly(s, d).select("g", "m", (F.col("v") / F.sum("v").over(Window.partitionBy("m"))).alias("share"))


@q("cumulative_curve", """SELECT o_orderpriority, o_totalprice, sum(cast(o_totalprice AS DECIMAL(18, 2))) OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC) AS run FROM orders""")
def cumulative_curve(s, d):
    o = table(s, d, "orders").select("o_orderpriority", "o_totalprice", F.col("o_totalprice").cast("decimal(18,2)").alias("v"))
    sums = o.groupBy("o_orderpriority", "o_totalprice").agg(F.sum("v").alias("v"), F.count(F.lit(1)).alias("n"))
    runs = windows.prefix_sums(sums, ["o_orderpriority"], "o_totalprice", ["v"], descending=True)
    return runs.select("o_orderpriority", "o_totalprice", F.col("run_v").alias("run"), F.explode(F.sequence(F.lit(1).cast("bigint"), "n"))).drop("col")


@q("event_index", f"""SELECT g, m, 100 * v / avg(CASE WHEN m < TIMESTAMP '1998-01-01' THEN v END) OVER (PARTITION BY g) AS idx FROM ({_MONTHLY})""")
def event_index(s, d):
    before = F.avg(F.when(F.col("m") < F.lit("1998-01-01").cast("timestamp"), F.col("v"))).over(Window.partitionBy("g"))
    return _monthly(s, d).select("g", "m", (100 * F.col("v") / before).alias("idx"))


@q("expanding_origins", f"""
    WITH i AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY m) AS i FROM ({_MONTHLY})) SELECT o.g, o.i AS origin, count(*) AS rows_before, avg(b.v) AS mean_before
    FROM i o JOIN i b ON b.g = o.g AND b.i <= o.i WHERE o.i % 6 = 0 GROUP BY 1, 2""")
def expanding_origins(s, d):
    w = Window.partitionBy("g").orderBy("m")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    i = _monthly(s, d).select("g", F.row_number().over(w).alias("origin"), F.count(F.lit(1)).over(run).alias("rows_before"), F.avg("v").over(run).alias("mean_before"))
    return i.filter("origin % 6 = 0")


@q("stratified_shuffle")
def stratified_shuffle(s, d):
    return windows.stratified_shuffle(table(s, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice"), ["o_orderpriority"], "o_orderkey", "o_totalprice", 7, "shuffled")


# sorts, samples, splits

@q("final_sort", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY CASE o_orderpriority WHEN '1-URGENT' THEN 0 ELSE 1 END, o_orderkey) AS place FROM orders")
def final_sort(s, d):
    order = F.when(F.col("o_orderpriority") == "1-URGENT", 0).otherwise(1)
    o = table(s, d, "orders").select("o_orderkey", "o_orderstatus", order.alias("first"))
    return windows.ranks(o, ["o_orderstatus"], [F.col("first"), F.col("o_orderkey")], "place").select("o_orderkey", "place")


@q("top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 12")
def top_k(s, d):
    return table(s, d, "orders").orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(12).select("o_orderkey", "o_totalprice")


@q("one_page", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 20 OFFSET 40")
def one_page(s, d):
    return serve.page(table(s, d, "customer").select("c_custkey", "c_acctbal"), [F.col("c_acctbal").desc(), F.col("c_custkey")], 2, 20)


@q("argmax_column", """SELECT l_orderkey, l_linenumber, CASE WHEN l_discount >= l_tax THEN 'discount' ELSE 'tax' END AS larger FROM lineitem""")
def argmax_column(s, d):
    v = F.array("l_discount", "l_tax")
    name = F.element_at(F.array(F.lit("discount"), F.lit("tax")), F.array_position(v, F.array_max(v)).cast("int"))
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", name.alias("larger"))


@q("hashed_sample")
def hashed_sample(s, d):
    return windows.hashed_sample(table(s, d, "orders").select("o_orderpriority", "o_orderkey"), ["o_orderpriority"], "o_orderkey", 20, 42)


@q("group_split")
def group_split(s, d):
    return windows.group_split(table(s, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey", 0.2, 42)


@q("group_folds")
def group_folds(s, d):
    return windows.group_folds(table(s, d, "orders"), "o_custkey", 5)


@q("stratified_folds")
def stratified_folds(s, d):
    return windows.stratified_folds(table(s, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", "o_orderkey", 5, 42)


@q("bootstrap_means")
def bootstrap_means(s, d):
    return windows.bootstrap_means(table(s, d, "orders"), "o_custkey", "o_totalprice", 50, 42)


@q("subset_enumeration", """SELECT m AS subset, n_name AS name FROM (SELECT unnest(range(4096)) AS m) JOIN (SELECT n_name, row_number() OVER (ORDER BY n_nationkey) - 1 AS i FROM nation ORDER BY n_nationkey LIMIT 12) n
    ON (m >> i) & 1 = 1 WHERE bit_count(m) = 5""")
def subset_enumeration(s, d):
    names = [r[0] for r in table(s, d, "nation").orderBy("n_nationkey").limit(12).select("n_name").collect()]  # twelve names
    return windows.subsets(s, names, 5)


@q("quantile_picks", """SELECT o_orderpriority, o_orderkey, pos FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey) AS r, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders) t
    JOIN (VALUES (0.2), (0.4), (0.6), (0.8)) v(pos) ON r = floor(pos * (n - 1)) + 1""")
def quantile_picks(s, d):
    o = table(s, d, "orders").select("o_orderpriority", "o_orderkey", "o_totalprice")
    r = windows.ranks(o, ["o_orderpriority"], [F.col("o_totalprice"), F.col("o_orderkey")], "r")
    x = r.withColumn("pos", F.explode(F.array(*[F.lit(p) for p in (0.2, 0.4, 0.6, 0.8)])))
    return x.filter(F.col("r") == F.floor(F.col("pos") * (F.col("all_r") - 1)) + 1).select("o_orderpriority", "o_orderkey", F.col("pos").cast("double").alias("pos"))


@q("top_series", f"SELECT g, m, v FROM ({_MONTHLY}) WHERE g IN (SELECT g FROM ({_MONTHLY}) GROUP BY 1 ORDER BY avg(v) DESC, g LIMIT 2)")
def top_series(s, d):
    m = _monthly(s, d)
    top = m.groupBy("g").agg(F.avg("v").alias("a")).orderBy(F.col("a").desc(), "g").limit(2)
    return m.join(top, "g", "left_semi").select("g", "m", "v")


@q("both_tails", """(SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 8) UNION (SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal, c_custkey LIMIT 8)""")
def both_tails(s, d):
    return serve.both_tails(table(s, d, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", "c_custkey", 8)


# set operations

@q("union_sources", """SELECT collection.adzuna_id AS id, 'a' AS source FROM records_project_manager__scrum_master UNION ALL SELECT collection.adzuna_id, 'b' FROM records_graphic_designer__visual_designer""")
def union_sources(s, d):
    one = lambda t, n: table(s, d, t).select(F.col("collection.adzuna_id").alias("id"), F.lit(n).alias("source"))
    return one("records_project_manager__scrum_master", "a").unionByName(one("records_graphic_designer__visual_designer", "b"))


@q("id_set_union", """SELECT collection.adzuna_id AS id FROM records_project_manager__scrum_master UNION SELECT job_id FROM employer_cap_exclusions""")
def id_set_union(s, d):
    a = table(s, d, "records_project_manager__scrum_master").select(F.col("collection.adzuna_id").alias("id"))
    return a.union(table(s, d, "employer_cap_exclusions").select("job_id")).distinct()


@q("id_intersection", """SELECT collection.adzuna_id AS id FROM records_project_manager__scrum_master INTERSECT SELECT job_id FROM employer_cap_exclusions""")
def id_intersection(s, d):
    a = table(s, d, "records_project_manager__scrum_master").select(F.col("collection.adzuna_id").alias("id"))
    return a.intersect(table(s, d, "employer_cap_exclusions").select("job_id"))


@q("id_difference", """SELECT job_id AS id FROM employer_cap_exclusions EXCEPT SELECT collection.adzuna_id FROM records_project_manager__scrum_master""")
def id_difference(s, d):
    a = table(s, d, "records_project_manager__scrum_master").select(F.col("collection.adzuna_id").alias("id"))
    return table(s, d, "employer_cap_exclusions").select(F.col("job_id").alias("id")).subtract(a)


@q("array_set_merge", """SELECT o_custkey, array_to_string(list_sort(list_distinct(list(o_orderpriority))), ',') AS seen FROM orders GROUP BY 1""")
def array_set_merge(s, d):
    return table(s, d, "orders").groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_set("o_orderpriority")), ",").alias("seen"))


@q("content_hash")
def content_hash(s, d):
    """Equal for equal content, whatever the order: two builds are compared by it."""
    o = table(s, d, "orders")
    return o.agg(F.count(F.lit(1)).alias("n"), F.expr(f"bit_xor(xxhash64({', '.join(o.columns)}))").alias("hash"))
