"""Queries of the aggregation family (grouping, quantiles, associations, metrics)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.operators import stats
from plumbline.plans.registry import Registry
from plumbline.sources.tables import table

q = Registry()
QUERIES, SQL = q.queries, q.sql


def _orders(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "orders")


@q("value_counts", "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1")
def value_counts(s, d):
    return _orders(s, d).groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@q("explode_counts", """SELECT w AS word, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part) GROUP BY 1""")
def explode_counts(s, d):
    return table(s, d, "part").select(F.explode(F.split("p_name", " ")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


@q("stage_funnel", """
    SELECT role, rows_in, with_employer, dated, ids, kept FROM (
      SELECT role, count(*) AS rows_in, count(*) FILTER (employer IS NOT NULL AND trim(employer) <> '') AS with_employer,
        count(*) FILTER (created IS NOT NULL AND trim(created) <> '') AS dated, count(DISTINCT job_id) AS ids
      FROM employer_cap_exclusions GROUP BY role)
    JOIN (SELECT role, count(*) FILTER (r <= cap_per_employer_in_role) AS kept FROM (
      SELECT *, row_number() OVER (PARTITION BY role, employer ORDER BY job_id) AS r FROM employer_cap_exclusions) GROUP BY role) USING (role)""")
def stage_funnel(s, d):
    e = table(s, d, "employer_cap_exclusions")
    a = e.groupBy("role").agg(
        F.count(F.lit(1)).alias("rows_in"), F.count_if(F.trim("employer") != "").alias("with_employer"),
        F.count_if(F.trim("created") != "").alias("dated"), F.countDistinct("job_id").alias("ids"),
    )
    r = F.row_number().over(Window.partitionBy("role", "employer").orderBy("job_id"))
    b = e.withColumn("r", r).groupBy("role").agg(F.count_if(F.col("r") <= F.col("cap_per_employer_in_role")).alias("kept"))
    return a.join(b, "role")


@q("concentration", """
    WITH n AS (SELECT role, employer, count(*) AS n FROM employer_cap_exclusions WHERE trim(employer) <> '' GROUP BY 1, 2),
    t AS (SELECT *, sum(n) OVER (PARTITION BY role) AS total FROM n)
    SELECT role, count(*) AS members, max(n) AS top, max(n) / max(total) AS top_share, 1 / sum((n / total) ^ 2) AS effective FROM t GROUP BY role""")
def concentration(s, d):
    return stats.concentration(table(s, d, "employer_cap_exclusions"), ["role"], "employer")


@q("lower_quantiles", """
    SELECT o_orderpriority, max(n) AS n, max(CASE WHEN i = least(n - 1, floor(0.25 * n)) THEN o_totalprice END) AS q1,
      max(CASE WHEN i = least(n - 1, floor(0.5 * n)) THEN o_totalprice END) AS q2,
      max(CASE WHEN i = least(n - 1, floor(0.75 * n)) THEN o_totalprice END) AS q3
    FROM (SELECT *, count(*) OVER (PARTITION BY o_orderpriority) AS n,
      row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) - 1 AS i FROM orders WHERE o_totalprice IS NOT NULL) GROUP BY 1""")
def lower_quantiles(s, d):
    return stats.lower_quantiles(_orders(s, d), ["o_orderpriority"], "o_totalprice", {"q1": 0.25, "q2": 0.5, "q3": 0.75})


@q("interpolated_quantiles", """SELECT o_orderstatus, quantile_cont(o_totalprice, 0.1) AS p10, quantile_cont(o_totalprice, 0.5) AS p50,
    quantile_cont(o_totalprice, 0.9) AS p90 FROM orders GROUP BY 1""")
def interpolated_quantiles(s, d):
    return stats.quantiles(_orders(s, d), ["o_orderstatus"], "o_totalprice", {"p10": 0.1, "p50": 0.5, "p90": 0.9}).drop("n")


@q("having_groups", """SELECT o_custkey, count(*) AS n, quantile_cont(o_totalprice, 0.5) AS mid, avg(o_totalprice) AS mean
    FROM orders GROUP BY 1 HAVING count(*) >= 12""")
def having_groups(s, d):
    return _orders(s, d).groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("n"), F.percentile("o_totalprice", 0.5).alias("mid"), F.avg("o_totalprice").alias("mean")
    ).filter("n >= 12")


@q("shape_and_correlation", """SELECT skewness(l_extendedprice) AS skew, corr(l_quantity, l_extendedprice) AS r FROM lineitem""")
def shape_and_correlation(s, d):
    return table(s, d, "lineitem").agg(stats.adjusted_skewness("l_extendedprice").alias("skew"), F.corr("l_quantity", "l_extendedprice").alias("r"))


@q("distinct_counts", "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY 1")
def distinct_counts(s, d):
    return table(s, d, "lineitem").groupBy("l_returnflag").agg(F.countDistinct("l_partkey").alias("parts"), F.countDistinct("l_suppkey").alias("suppliers"))


@q("grouping_blocks", """
    SELECT CASE WHEN grouping(role, cap_per_employer_in_role) = 3 THEN 'all' WHEN grouping(role) = 0 THEN 'role' ELSE 'cap' END AS level,
      role, cap_per_employer_in_role AS cap, count(*) AS n, count(employer) AS named, count(DISTINCT employer) AS employers
    FROM employer_cap_exclusions GROUP BY GROUPING SETS ((), (role), (cap_per_employer_in_role))""")
def grouping_blocks(s, d):
    table(s, d, "employer_cap_exclusions").createOrReplaceTempView("pl_exclusions")
    return s.sql("""
        SELECT CASE WHEN grouping_id(role, cap_per_employer_in_role) = 3 THEN 'all' WHEN grouping(role) = 0 THEN 'role' ELSE 'cap' END AS level,
          role, cap_per_employer_in_role AS cap, count(*) AS n, count(employer) AS named, count(DISTINCT employer) AS employers
        FROM pl_exclusions GROUP BY GROUPING SETS ((), (role), (cap_per_employer_in_role))""")


@q("rollup_levels", """
    SELECT 'customer' AS level, cast(o_custkey AS VARCHAR) AS member, count(*) AS n FROM orders GROUP BY o_custkey
    UNION ALL SELECT 'priority', o_orderpriority, count(DISTINCT o_custkey) FROM orders GROUP BY o_orderpriority
    UNION ALL SELECT 'all', NULL, count(DISTINCT o_custkey) FROM orders""")
def rollup_levels(s, d):
    o = _orders(s, d)
    a = o.groupBy(F.lit("customer").alias("level"), F.col("o_custkey").cast("string").alias("member")).agg(F.count(F.lit(1)).alias("n"))
    b = o.groupBy(F.lit("priority").alias("level"), F.col("o_orderpriority").alias("member")).agg(F.countDistinct("o_custkey").alias("n"))
    c = o.agg(F.countDistinct("o_custkey").alias("n")).select(F.lit("all").alias("level"), F.lit(None).cast("string").alias("member"), "n")
    return a.unionByName(b).unionByName(c)


@q("date_checks", """SELECT min(o_orderdate) AS first, max(o_orderdate) AS last, count(DISTINCT cast(o_orderdate AS DATE)) AS days,
    (SELECT max(n) FROM (SELECT count(*) AS n FROM orders GROUP BY cast(o_orderdate AS DATE))) AS busiest FROM orders""")
def date_checks(s, d):
    days = _orders(s, d).groupBy(F.to_date("o_orderdate").alias("day")).agg(
        F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("b"), F.count(F.lit(1)).alias("n")
    )
    return days.agg(F.min("a").alias("first"), F.max("b").alias("last"), F.count("day").alias("days"), F.max("n").alias("busiest"))


@q("crosstab_share", """SELECT o_orderpriority, o_orderstatus, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY o_orderpriority) AS share
    FROM orders GROUP BY 1, 2""")
def crosstab_share(s, d):
    n = _orders(s, d).groupBy("o_orderpriority", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("o_orderpriority")))


@q("pivot_counts", """SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o,
    count(*) FILTER (o_orderstatus = 'P') AS p FROM orders GROUP BY 1""")
def pivot_counts(s, d):
    p = _orders(s, d).groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1)))
    return p.select("o_orderpriority", *[F.coalesce(c, F.lit(0)).alias(c.lower()) for c in "FOP"])


@q("unpivot_long", """SELECT l_orderkey, l_linenumber, measure, value FROM lineitem
    UNPIVOT (value FOR measure IN (l_quantity, l_discount, l_tax))""")
def unpivot_long(s, d):
    return table(s, d, "lineitem").unpivot(["l_orderkey", "l_linenumber"], ["l_quantity", "l_discount", "l_tax"], "measure", "value")


TERMS = ["project", "portfolio", "risk logs", "training slots", "budget", "release", "paper", "interns"]
_HITS = " UNION ALL ".join(
    f"SELECT doc_id, role, '{t}' AS term FROM documents WHERE regexp_matches(lower(text), '(^|[^a-z0-9+#]){t}([^a-z0-9+#]|$)')" for t in TERMS
)


def _hits(s: SparkSession, d: str) -> DataFrame:
    from plumbline.functions.text import matched_terms

    docs = table(s, d, "documents").select("doc_id", "role", F.lower("text").alias("t"))
    return docs.select("doc_id", "role", F.explode(matched_terms(F.col("t"), TERMS)).alias("term"))


@q("term_demand", f"""SELECT term, n, 100.0 * n / (SELECT count(*) FROM documents) AS pct, row_number() OVER (ORDER BY n DESC, term) AS rank
    FROM (SELECT term, count(*) AS n FROM ({_HITS}) GROUP BY term)""")
def term_demand(s, d):
    all_docs = table(s, d, "documents").agg(F.count(F.lit(1)).alias("all"))
    n = _hits(s, d).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    return n.join(F.broadcast(all_docs)).select(  # one row
        "term", "n", (100.0 * F.col("n") / F.col("all")).alias("pct"), F.row_number().over(Window.orderBy(F.col("n").desc(), "term")).alias("rank")
    )


@q("term_share_matrix", f"""SELECT h.role, term, count(*) AS n, count(*) / any_value(r.n) AS share FROM ({_HITS}) h
    JOIN (SELECT role, count(*) AS n FROM documents GROUP BY role) r ON h.role = r.role GROUP BY h.role, term""")
def term_share_matrix(s, d):
    roles = table(s, d, "documents").groupBy("role").agg(F.count(F.lit(1)).alias("docs"))
    n = _hits(s, d).groupBy("role", "term").agg(F.count(F.lit(1)).alias("n"))
    return n.join(roles, "role").select("role", "term", "n", (F.col("n") / F.col("docs")).alias("share"))


@q("cooccurrence_lift", f"""
    WITH h AS (SELECT DISTINCT doc_id, term FROM ({_HITS})), c AS (SELECT term, count(*) AS c FROM h GROUP BY term),
    p AS (SELECT x.term AS a, y.term AS b, count(*) AS together FROM h x JOIN h y ON x.doc_id = y.doc_id AND x.term < y.term GROUP BY 1, 2)
    SELECT a, b, together, together * (SELECT count(DISTINCT doc_id) FROM h)::DOUBLE / (ca.c * cb.c) AS lift, together / (ca.c + cb.c - together) AS jaccard
    FROM p JOIN c ca ON ca.term = a JOIN c cb ON cb.term = b WHERE together >= 5""")
def cooccurrence_lift(s, d):
    return stats.cooccurrence(_hits(s, d), "doc_id", "term", 5)


@q("weighted_median", """
    WITH f AS (SELECT l_returnflag, l_quantity AS v, sum(l_extendedprice) AS w, sum(l_extendedprice ^ 2) AS w2 FROM lineitem GROUP BY 1, 2),
    r AS (SELECT *, sum(w) OVER (PARTITION BY l_returnflag ORDER BY v) AS run, sum(w) OVER (PARTITION BY l_returnflag) AS total FROM f)
    SELECT l_returnflag, min(CASE WHEN run >= total / 2 THEN v END) AS median, sum(w) ^ 2 / sum(w2) AS ess FROM r GROUP BY 1""")
def weighted_median(s, d):
    return stats.weighted_median(table(s, d, "lineitem"), ["l_returnflag"], "l_quantity", "l_extendedprice")


@q("standardised_gap", """
    WITH m AS (SELECT o_orderpriority, quantile_cont(o_totalprice, 0.5) FILTER (o_orderstatus = 'F') AS a,
      quantile_cont(o_totalprice, 0.5) FILTER (NOT o_orderstatus = 'F') AS b, count(*) FILTER (NOT o_orderstatus = 'F') AS w FROM orders GROUP BY 1)
    SELECT sum((a / b - 1) * 100 * w) / sum(w) AS gap_pct FROM m WHERE a IS NOT NULL AND b IS NOT NULL""")
def standardised_gap(s, d):
    return stats.standardised_gap(_orders(s, d).withColumn("f", F.col("o_orderstatus") == "F"), "o_orderpriority", "f", "o_totalprice")


@q("oneway_r2", """
    WITH g AS (SELECT o_orderpriority, count(*) AS n, avg(o_totalprice) AS m, var_pop(o_totalprice) AS v FROM orders GROUP BY 1),
    t AS (SELECT sum(n) AS n, count(*) AS k, sum(n * m) AS s, sum(n * m * m) AS q, sum(n * v) AS w FROM g),
    r AS (SELECT (q - s * s / n) / (q - s * s / n + w) AS r2, n, k FROM t)
    SELECT round(r2, 10) AS r2, round(1 - (1 - r2) * (n - 1) / (n - k), 10) AS adjusted FROM r""")
def oneway_r2(s, d):
    return stats.oneway_r2(_orders(s, d), "o_orderpriority", "o_totalprice").select(F.round("r2", 10).alias("r2"), F.round("adjusted", 10).alias("adjusted"))


_EDGES = [float(round(1000 * 10 ** (i / 4), 4)) for i in range(12)]


@q("log_histogram", " UNION ALL ".join(
    f"SELECT {i} AS bin, {a}::DOUBLE AS lo, {b}::DOUBLE AS hi, count(*) FILTER (o_totalprice >= {a} AND (o_totalprice < {b}"
    + (f" OR o_totalprice = {b}" if i == 10 else "") + ")) AS n FROM orders" for i, (a, b) in enumerate(zip(_EDGES, _EDGES[1:]))))
def log_histogram(s, d):
    return stats.histogram(_orders(s, d), "o_totalprice", _EDGES)


@q("band_edges", """SELECT CASE WHEN l_quantity > 0 AND l_quantity <= 10 THEN 0 WHEN l_quantity > 10 AND l_quantity <= 25 THEN 1
      WHEN l_quantity > 25 AND l_quantity <= 50 THEN 2 END AS right_closed,
    CASE WHEN l_quantity >= 0 AND l_quantity < 10 THEN 0 WHEN l_quantity >= 10 AND l_quantity < 25 THEN 1
      WHEN l_quantity >= 25 AND l_quantity < 50 THEN 2 END AS left_closed, count(*) AS n FROM lineitem GROUP BY 1, 2""")
def band_edges(s, d):
    c, e = F.col("l_quantity"), [0, 10, 25, 50]
    return table(s, d, "lineitem").groupBy(stats.bands(c, e, True).alias("right_closed"), stats.bands(c, e, False).alias("left_closed")).agg(F.count(F.lit(1)).alias("n"))


@q("quantile_bands", """WITH e AS (SELECT quantile_cont(o_totalprice, [0.25, 0.5, 0.75]) AS q FROM orders)
    SELECT CASE WHEN o_totalprice <= q[1] THEN 0 WHEN o_totalprice <= q[2] THEN 1 WHEN o_totalprice <= q[3] THEN 2 ELSE 3 END AS band, count(*) AS n
    FROM orders, e GROUP BY 1""")
def quantile_bands(s, d):
    o = _orders(s, d)
    q3 = stats.quantiles(o, [], "o_totalprice", {"a": 0.25, "b": 0.5, "c": 0.75}).select("a", "b", "c").first()  # three numbers
    v = F.col("o_totalprice")
    return o.groupBy(F.when(v <= q3[0], 0).when(v <= q3[1], 1).when(v <= q3[2], 2).otherwise(3).alias("band")).agg(F.count(F.lit(1)).alias("n"))


@q("quantile_label", """WITH e AS (SELECT quantile_cont(o_totalprice, 0.75) AS q FROM orders)
    SELECT o_orderpriority, count(*) FILTER (o_totalprice >= q) AS high FROM orders, e GROUP BY 1""")
def quantile_label(s, d):
    o = _orders(s, d)
    cut = stats.quantiles(o, [], "o_totalprice", {"a": 0.75}).first()["a"]  # one number
    return o.groupBy("o_orderpriority").agg(F.count_if(F.col("o_totalprice") >= cut).alias("high"))


@q("frequency_tiers", """
    WITH n AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, o_custkey) AS r, count(*) OVER () AS m FROM n)
    SELECT o_custkey, n, CASE WHEN r <= floor(0.01 * m) THEN 0 WHEN r <= floor(0.05 * m) THEN 1 ELSE 2 END AS tier FROM r""")
def frequency_tiers(s, d):
    return stats.frequency_tiers(_orders(s, d), "o_custkey")


@q("percentile_rank", """SELECT o_orderkey, (SELECT count(*) FROM orders i WHERE i.o_orderpriority = o.o_orderpriority AND i.o_totalprice <= o.o_totalprice)
    / count(*) OVER (PARTITION BY o_orderpriority) AS rank FROM orders o""")
def percentile_rank(s, d):
    return stats.percentile_rank(_orders(s, d), ["o_orderpriority"], "o_totalprice", "rank").select("o_orderkey", "rank")


@q("error_metrics", """
    WITH b AS (SELECT l_returnflag, quantile_cont(l_extendedprice, 0.5) AS p FROM lineitem GROUP BY 1),
    e AS (SELECT l_extendedprice AS y, p FROM lineitem JOIN b USING (l_returnflag))
    SELECT avg(abs(y - p)) AS mae, quantile_cont(abs(y - p), 0.5) AS median_ae, sqrt(avg((ln(y) - ln(p)) ^ 2)) AS rmse_log,
      avg(CASE WHEN abs(y - p) <= 0.3 * y THEN 1.0 ELSE 0.0 END) AS within_30 FROM e""")
def error_metrics(s, d):
    t = table(s, d, "lineitem").select("l_returnflag", F.col("l_extendedprice").alias("y"))
    e = t.join(t.groupBy("l_returnflag").agg(F.percentile("y", 0.5).alias("p")), "l_returnflag")
    err = F.abs(F.col("y") - F.col("p"))
    return e.agg(
        F.avg(err).alias("mae"), F.percentile(err, 0.5).alias("median_ae"), F.sqrt(F.avg(F.pow(F.log("y") - F.log("p"), 2))).alias("rmse_log"),
        F.avg((err <= 0.3 * F.col("y")).cast("double")).alias("within_30"),
    )


_GUESS = """SELECT label AS truth, CASE WHEN embedding[1] > 0.05 THEN 0 WHEN embedding[2] > 0.05 THEN 1 ELSE 2 END AS guess, embedding[1]::DOUBLE AS score FROM embeddings"""


def _guesses(s: SparkSession, d: str) -> DataFrame:
    e = F.col("embedding")
    return table(s, d, "embeddings").select(
        F.col("label").alias("truth"), F.when(e[0] > F.lit(0.05).cast("double"), 0).when(e[1] > F.lit(0.05).cast("double"), 1).otherwise(2).alias("guess"), e[0].cast("double").alias("score")
    )


@q("confusion_matrix", f"SELECT truth, guess, count(*) AS n FROM ({_GUESS}) GROUP BY 1, 2")
def confusion_matrix(s, d):
    return stats.confusion(_guesses(s, d), "truth", "guess")


@q("class_scores", f"""
    WITH g AS ({_GUESS}), t AS (SELECT truth AS label, count(*) AS support, count(*) FILTER (truth = guess) AS hit FROM g GROUP BY 1),
    s AS (SELECT guess AS label, count(*) AS said FROM g GROUP BY 1),
    j AS (SELECT coalesce(t.label, s.label) AS label, coalesce(hit, 0) AS hit, coalesce(said, 0) AS said, coalesce(support, 0) AS support FROM t FULL JOIN s ON t.label = s.label),
    p AS (SELECT *, CASE WHEN said = 0 THEN 0 ELSE hit / said END AS p, CASE WHEN support = 0 THEN 0 ELSE hit / support END AS r FROM j)
    SELECT label, p AS precision, r AS recall, CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END AS f1, support FROM p""")
def class_scores(s, d):
    return stats.class_scores(stats.confusion(_guesses(s, d), "truth", "guess"))


@q("rank_auc", f"""
    WITH g AS (SELECT (truth = 1)::INT AS y, score FROM ({_GUESS})),
    r AS (SELECT y, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS r FROM g)
    SELECT (sum(r * y) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))) AS auc FROM r""")
def rank_auc(s, d):
    return stats.rank_auc(_guesses(s, d).withColumn("y", F.col("truth") == 1), "y", "score")


@q("average_precision", f"""
    WITH g AS (SELECT score, sum((truth = 1)::INT) AS p, count(*) AS n FROM ({_GUESS}) GROUP BY score),
    r AS (SELECT p, sum(p) OVER (ORDER BY score DESC) AS tp, sum(n) OVER (ORDER BY score DESC) AS said, sum(p) OVER () AS total FROM g)
    SELECT sum(p / total * tp / said) AS ap FROM r""")
def average_precision(s, d):
    return stats.average_precision(_guesses(s, d).withColumn("y", F.col("truth") == 1), "y", "score")


@q("member_rates", """
    WITH f AS (SELECT o_custkey, count(*) AS n, avg((o_orderstatus = 'F')::INT) AS rate FROM orders GROUP BY 1 HAVING count(*) >= 5)
    SELECT count(*) AS members, avg((rate = 0)::INT) AS never, avg((rate > 0.5)::INT) AS heavy FROM f""")
def member_rates(s, d):
    f = _orders(s, d).groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("o_orderstatus") == "F").cast("int")).alias("rate")).filter("n >= 5")
    return f.agg(F.count(F.lit(1)).alias("members"), F.avg((F.col("rate") == 0).cast("int")).alias("never"), F.avg((F.col("rate") > 0.5).cast("int")).alias("heavy"))


@q("wilson_interval", """
    WITH n AS (SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS k, count(*) AS n FROM orders GROUP BY 1), p AS (SELECT *, k / n AS p FROM n)
    SELECT o_orderpriority, k, n, (p + 3.8416 / (2 * n) - 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n) AS lo,
      (p + 3.8416 / (2 * n) + 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n) AS hi FROM p""")
def wilson_interval(s, d):
    n = _orders(s, d).groupBy("o_orderpriority").agg(F.count_if(F.col("o_orderstatus") == "F").alias("k"), F.count(F.lit(1)).alias("n"))
    lo, hi = stats.wilson(F.col("k"), F.col("n"))
    return n.select("o_orderpriority", "k", "n", lo.alias("lo"), hi.alias("hi"))


@q("bh_select", """
    WITH p AS (SELECT s_suppkey, (s_suppkey * 37 % 1000) / 1000.0 * ((s_suppkey % 10) / 10.0) + 0.0001 AS p FROM supplier),
    r AS (SELECT *, row_number() OVER (ORDER BY p) AS r, count(*) OVER () AS m FROM p), c AS (SELECT max(p) AS cut FROM r WHERE p <= 0.1 * r / m)
    SELECT s_suppkey, coalesce(p <= cut, false) AS selected FROM p, c""")
def bh_select(s, d):
    k = F.col("s_suppkey")
    p = table(s, d, "supplier").select("s_suppkey", ((k * 37 % 1000) / 1000.0 * ((k % 10) / 10.0) + 0.0001).alias("p"))
    return stats.benjamini_hochberg(p, "p", 0.1).select("s_suppkey", "selected")


@q("mutual_information", f"""
    WITH j AS (SELECT truth, guess, count(*) AS n FROM ({_GUESS}) GROUP BY 1, 2),
    m AS (SELECT n, sum(n) OVER (PARTITION BY truth) AS a, sum(n) OVER (PARTITION BY guess) AS b, sum(n) OVER () AS t FROM j),
    e AS (SELECT sum(n / t * ln(n * t / (a * b))) AS mi, -sum(n / t * ln(a / t)) AS ha, -sum(n / t * ln(b / t)) AS hb FROM m)
    SELECT 2 * mi / (ha + hb) AS nmi FROM e""")
def mutual_information(s, d):
    return stats.normalised_mutual_information(_guesses(s, d), "truth", "guess")


@q("spearman", """
    WITH r AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2 AS a,
      rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2 AS b FROM lineitem) SELECT corr(a, b) AS rho FROM r""")
def spearman(s, d):
    t = table(s, d, "lineitem").select("l_quantity", "l_extendedprice")
    r = stats.average_rank(stats.average_rank(t, [], "l_quantity", "a"), [], "l_extendedprice", "b")
    return r.agg(F.corr("a", "b").alias("rho"))


@q("weekly_counts", """SELECT cast(date_trunc('week', ts) + INTERVAL 6 DAY AS DATE) AS week_ending, count(*) AS n FROM events GROUP BY 1""")
def weekly_counts(s, d):
    return table(s, d, "events").groupBy(F.date_add(F.to_date(F.date_trunc("week", "ts")), 6).alias("week_ending")).agg(F.count(F.lit(1)).alias("n"))


@q("class_by_cue", """SELECT CASE WHEN p_name LIKE '%ring%' THEN 'ring' WHEN p_name LIKE '%widget%' THEN 'widget' ELSE 'other' END AS cue,
    count(*) AS n, avg(p_retailprice) AS mean FROM part GROUP BY 1""")
def class_by_cue(s, d):
    cue = F.when(F.col("p_name").contains("ring"), "ring").when(F.col("p_name").contains("widget"), "widget").otherwise("other")
    return table(s, d, "part").groupBy(cue.alias("cue")).agg(F.count(F.lit(1)).alias("n"), F.avg("p_retailprice").alias("mean"))


@q("topk_per_group", """SELECT o_orderpriority, o_orderkey, o_totalprice, r FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS r
    FROM orders) WHERE r <= 10""")
def topk_per_group(s, d):
    r = F.row_number().over(Window.partitionBy("o_orderpriority").orderBy(F.col("o_totalprice").desc(), "o_orderkey"))
    return _orders(s, d).withColumn("r", r).filter("r <= 10").select("o_orderpriority", "o_orderkey", "o_totalprice", "r")


@q("agreement", """SELECT sum((t AND x)::INT) / greatest(sum(t::INT), 1) AS recall, sum((t AND x)::INT) / greatest(sum(x::INT), 1) AS precision FROM
    (SELECT o_orderpriority = '1-URGENT' AS t, o_totalprice > 200000 AS x FROM orders)""")
def agreement(s, d):
    t, x = F.col("o_orderpriority") == "1-URGENT", F.col("o_totalprice") > 200000
    one = lambda c: F.sum(c.cast("int"))
    return _orders(s, d).agg((one(t & x) / F.greatest(one(t), F.lit(1))).alias("recall"), (one(t & x) / F.greatest(one(x), F.lit(1))).alias("precision"))


@q("terms_per_document", f"""
    WITH n AS (SELECT d.doc_id, d.role, count(h.term) AS n FROM documents d LEFT JOIN ({_HITS}) h ON d.doc_id = h.doc_id GROUP BY 1, 2)
    SELECT role, avg(n) AS mean, avg((n = 0)::INT) AS none, avg((n >= 3)::INT) AS three FROM n GROUP BY role""")
def terms_per_document(s, d):
    from plumbline.functions.text import matched_terms

    n = table(s, d, "documents").select("role", F.coalesce(F.size(matched_terms(F.lower("text"), TERMS)), F.lit(0)).alias("n"))
    return n.groupBy("role").agg(F.avg("n").alias("mean"), F.avg((F.col("n") == 0).cast("int")).alias("none"), F.avg((F.col("n") >= 3).cast("int")).alias("three"))


@q("rate_and_means", """SELECT o_orderpriority, avg((o_orderstatus = 'F')::INT) AS rate, avg(o_totalprice) FILTER (o_orderstatus = 'F') AS mean_f,
    avg(o_totalprice) FILTER (o_orderstatus <> 'F') AS mean_other FROM orders GROUP BY 1""")
def rate_and_means(s, d):
    f = F.col("o_orderstatus") == "F"
    return _orders(s, d).groupBy("o_orderpriority").agg(F.avg(f.cast("int")).alias("rate"), F.avg(F.when(f, F.col("o_totalprice"))).alias("mean_f"), F.avg(F.when(~f, F.col("o_totalprice"))).alias("mean_other"))


@q("label_counts_with_rest", """SELECT count(*) FILTER (reviewer_label = 'correct') AS exact, count(*) FILTER (lower(reviewer_label) LIKE '%correct%') AS holding,
    count(*) - count(*) FILTER (lower(reviewer_label) LIKE '%correct%') AS rest FROM human_validation_template""")
def label_counts_with_rest(s, d):
    label = F.col("reviewer_label")
    holds = F.count_if(F.lower(label).contains("correct"))
    return table(s, d, "human_validation_template").agg(F.count_if(label == "correct").alias("exact"), holds.alias("holding"), (F.count(F.lit(1)) - holds).alias("rest"))


@q("facet_bands", """
    WITH b(band) AS (VALUES (0), (1), (2), (3)), o AS (SELECT CASE WHEN o_totalprice < 50000 THEN 0 WHEN o_totalprice < 150000 THEN 1 WHEN o_totalprice < 300000 THEN 2 ELSE 3 END AS band
      FROM orders WHERE o_orderstatus = 'P') SELECT b.band, count(o.band) AS n FROM b LEFT JOIN o ON b.band = o.band GROUP BY 1""")
def facet_bands(s, d):
    v = F.col("o_totalprice")
    n = _orders(s, d).filter("o_orderstatus = 'P'").groupBy(F.when(v < 50000, 0).when(v < 150000, 1).when(v < 300000, 2).otherwise(3).alias("band")).agg(F.count(F.lit(1)).alias("n"))
    return s.range(4).select(F.col("id").cast("int").alias("band")).join(n, "band", "left").select("band", F.coalesce("n", F.lit(0)).alias("n"))


@q("geometric_mean", "SELECT o_orderpriority, exp(avg(ln(o_totalprice))) AS gmean FROM orders WHERE o_totalprice > 0 GROUP BY 1")
def geometric_mean(s, d):
    return _orders(s, d).filter("o_totalprice > 0").groupBy("o_orderpriority").agg(F.exp(F.avg(F.log("o_totalprice"))).alias("gmean"))


@q("prevalence_difference", f"""
    WITH h AS (SELECT DISTINCT h.doc_id, term, d.source = 'postings' AS g FROM ({_HITS}) h JOIN documents d ON d.doc_id = h.doc_id WHERE d.source IS NOT NULL),
    n AS (SELECT source = 'postings' AS g, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY 1)
    SELECT term, count(*) FILTER (g) / (SELECT n FROM n WHERE g) AS a, count(*) FILTER (NOT g) / (SELECT n FROM n WHERE NOT g) AS b FROM h GROUP BY term""")
def prevalence_difference(s, d):
    docs = table(s, d, "documents").filter("source is not null").select("doc_id", (F.col("source") == "postings").alias("g"))
    n = docs.agg(F.count_if("g").alias("na"), F.count_if(~F.col("g")).alias("nb"))
    h = _hits(s, d).select("doc_id", "term").distinct().join(docs, "doc_id").groupBy("term").agg(F.count_if("g").alias("x"), F.count_if(~F.col("g")).alias("y"))
    return h.join(F.broadcast(n)).select("term", (F.col("x") / F.col("na")).alias("a"), (F.col("y") / F.col("nb")).alias("b"))  # one row


@q("missing_profile", " UNION ALL ".join(
    f"SELECT '{c}' AS column, count(*) FILTER ({c} IS NULL OR trim({c}) = '') AS missing, count(*) FILTER ({c} IS NULL OR trim({c}) = '') / count(*) AS share FROM human_validation_template"
    for c in ("role", "job_id", "title", "reviewer_label", "reviewer_notes", "reviewer_name", "review_date")))
def missing_profile(s, d):
    return stats.missing_profile(table(s, d, "human_validation_template"))


@q("distinctive_terms", """
    WITH w AS (SELECT p_partkey AS doc, p_type AS g, unnest(string_split(p_name, ' ')) AS t FROM part), tf AS (SELECT doc, g, t, count(*) AS tf FROM w GROUP BY 1, 2, 3),
    df AS (SELECT t, count(*) AS df FROM tf GROUP BY 1), n AS (SELECT count(DISTINCT doc) AS n FROM tf),
    x AS (SELECT doc, g, t, (1 + ln(tf)) * (ln((1 + n) / (1 + df)) + 1) AS x FROM tf JOIN df USING (t), n),
    u AS (SELECT doc, g, t, x / sqrt(sum(x * x) OVER (PARTITION BY doc)) AS w FROM x),
    c AS (SELECT t, sum(w) / (SELECT n FROM n) AS m FROM u GROUP BY 1), k AS (SELECT p_type AS g, count(*) AS k FROM part GROUP BY 1)
    SELECT u.g, u.t, round(sum(w) / any_value(k.k) - any_value(c.m), 9) AS above FROM u JOIN c ON c.t = u.t JOIN k ON k.g = u.g GROUP BY 1, 2""")
def distinctive_terms(s, d):
    p = table(s, d, "part")
    tok = p.select(F.col("p_partkey").alias("doc"), F.explode(F.split("p_name", " ")).alias("t"))
    u = stats.tf_idf(tok, "doc", "t").join(p.select(F.col("p_partkey").alias("doc"), F.col("p_type").alias("g")), "doc")
    n = p.count()  # one number
    corpus = u.groupBy("t").agg((F.sum("w") / n).alias("m"))
    sizes = p.groupBy(F.col("p_type").alias("g")).agg(F.count(F.lit(1)).alias("k"))
    by = u.groupBy("g", "t").agg(F.sum("w").alias("w")).join(sizes, "g").join(corpus, "t")
    return by.select("g", "t", F.round(F.col("w") / F.col("k") - F.col("m"), 9).alias("above"))


@q("log_odds_terms", """
    WITH w AS (SELECT p_type AS g, unnest(string_split(p_name, ' ')) AS t FROM part), c AS (SELECT g, t, count(*)::DOUBLE AS y FROM w GROUP BY 1, 2),
    x AS (SELECT *, sum(y) OVER (PARTITION BY t) AS yt, sum(y) OVER (PARTITION BY g) AS yg, sum(y) OVER () AS n FROM c), a AS (SELECT *, 100 * yt / n AS a FROM x)
    SELECT g, t, (ln((y + a) / (yg + 100 - y - a)) - ln((yt - y + a) / (n - yg + 100 - (yt - y) - a))) / sqrt(1 / (y + a) + 1 / (yt - y + a)) AS z FROM a""")
def log_odds_terms(s, d):
    c = table(s, d, "part").select(F.col("p_type").alias("g"), F.explode(F.split("p_name", " ")).alias("t")).withColumn("n", F.lit(1))
    return stats.log_odds(c, "g", "t", "n", 100.0)
