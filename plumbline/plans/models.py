"""Queries of features, models, inference, sources and streams."""

from __future__ import annotations

from pyspark.ml import regression as R
from pyspark.sql import Window
from pyspark.sql import functions as F

from plumbline.operators import inference, learn, stats, windows
from plumbline.plans.registry import Registry
from plumbline.session import cut_lineage, new_folder
from plumbline.sources import readers
from plumbline.sources.tables import table
from plumbline.streaming import events

q = Registry()
QUERIES, SQL = q.queries, q.sql


def _priced(s, d):
    o = table(s, d, "orders").join(table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    x = o.select("o_orderkey", "o_custkey", F.col("o_orderpriority").alias("priority"), "c_mktsegment", "n_name", "c_acctbal", F.year("o_orderdate").alias("year"), F.log("o_totalprice").alias("label"))
    return windows.group_split(x, "o_custkey", 0.2, 7).withColumn("fold", F.pmod(F.xxhash64("o_custkey"), F.lit(3)).cast("int"))


def _linear():
    from pyspark.ml import Pipeline

    return Pipeline(stages=[learn.preprocessor(["c_acctbal", "year"], ["priority", "c_mktsegment"]), R.LinearRegression(regParam=0.01, maxIter=20)])


def _forest():
    from pyspark.ml import Pipeline

    return Pipeline(stages=[learn.preprocessor(["c_acctbal", "year"], ["priority"]), R.RandomForestRegressor(numTrees=8, maxDepth=5, seed=7)])


@q("tf_idf_weights", """
    WITH w AS (SELECT p_partkey AS doc, unnest(string_split(p_name, ' ')) AS t FROM part), tf AS (SELECT doc, t, count(*) AS tf FROM w GROUP BY 1, 2), df AS (SELECT t, count(*) AS df FROM tf GROUP BY 1),
    x AS (SELECT doc, t, (1 + ln(tf)) * (ln((1 + (SELECT count(DISTINCT doc) FROM tf)) / (1 + df)) + 1) AS x FROM tf JOIN df USING (t)) SELECT doc, t, x / sqrt(sum(x * x) OVER (PARTITION BY doc)) AS w FROM x""")
def tf_idf_weights(s, d):
    tok = table(s, d, "part").select(F.col("p_partkey").alias("doc"), F.explode(F.split("p_name", " ")).alias("t"))
    return stats.tf_idf(tok, "doc", "t")


@q("top_tags", "SELECT w AS tag, count(*) AS n FROM (SELECT DISTINCT p_partkey, unnest(string_split(p_name, ' ')) AS w FROM part) GROUP BY 1 HAVING count(*) >= 20 ORDER BY n DESC, tag LIMIT 10")
def top_tags(s, d):
    return learn.top_tags(table(s, d, "part").select(F.split("p_name", " ").alias("tags")), "tags", 20, 10)


@q("word_counts", f"""
    WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z][a-z0-9]*(?:[./][a-z0-9]+)*')) AS w FROM documents), n AS (SELECT doc_id, w FROM w WHERE length(w) >= 2 AND w NOT IN ({", ".join(f"'{x}'" for x in learn.STOP)}))
    SELECT d.doc_id, count(w)::INTEGER AS words, count(DISTINCT w)::INTEGER AS distinct_words FROM documents d LEFT JOIN n USING (doc_id) WHERE text IS NOT NULL GROUP BY 1""")
def word_counts(s, d):
    docs = table(s, d, "documents").filter("text is not null").select("doc_id", F.lower("text").alias("text"))
    from pyspark.ml.functions import vector_to_array

    c = learn.counts("text", "v", min_df=1, max_df=1e18, size=1 << 18).fit(docs).transform(docs).select("doc_id", vector_to_array("v").alias("a"))
    return c.select("doc_id", F.aggregate("a", F.lit(0.0), lambda p, x: p + x).cast("int").alias("words"), F.size(F.filter("a", lambda x: x > 0)).alias("distinct_words"))


@q("bigram_counts", f"""
    WITH w AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[a-z][a-z0-9]*(?:[./][a-z0-9]+)*'), lambda x: length(x) >= 2 AND x NOT IN ({", ".join(f"'{x}'" for x in learn.STOP)})) AS w FROM documents WHERE text IS NOT NULL),
    g AS (SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS gram FROM w) SELECT gram, count(*) AS n FROM g GROUP BY 1 HAVING count(DISTINCT doc_id) >= 20""")
def bigram_counts(s, d):
    docs = table(s, d, "documents").filter("text is not null").select("doc_id", F.lower("text").alias("text"))
    return learn.ngram_totals(docs, "doc_id", "text", "gram", min_df=20)


@q("truncated_svd")
def truncated_svd(s, d):
    e = table(s, d, "embeddings")
    return learn.truncated_svd(e, "embedding", 64, 5, "projected")[0].select("vec_id", F.transform("projected", lambda x: F.round(x, 6)).alias("projected"))


@q("lda_topics")
def lda_topics(s, d):
    docs = table(s, d, "documents").filter("text is not null").select("doc_id", F.lower("text").alias("text"))
    m = learn.counts("text", "v").fit(docs)
    words = F.array(*[F.lit(w) for w in m.stages[-1].vocabulary])
    t = learn.topics(m.transform(docs), "v", 4, rounds=5).describeTopics(8)
    return t.select("topic", F.transform("termIndices", lambda i: F.get(words, i)).alias("terms"), "termWeights")


def _topic_vectors(s, d):
    docs = table(s, d, "documents").filter("text is not null").select("doc_id", "source", F.lower("text").alias("text"))
    v = learn.counts("text", "v", max_df=0.4).fit(docs).transform(docs).select("doc_id", F.coalesce("source", F.lit("")).alias("source"), "v")
    return windows.group_split(cut_lineage(v), "doc_id", 0.15, 3)


@q("topic_choice")
def topic_choice(s, d):
    """Held-out perplexity of several numbers of topics."""
    v = _topic_vectors(s, d)
    return learn.topic_choice(v.filter("not held_out"), v.filter("held_out"), "v", [3, 6, 9], rounds=5)[0]


@q("topic_shares")
def topic_shares(s, d):
    """Dominant topics and mean shares by source, with the number of topics of the lowest held-out perplexity."""
    v = _topic_vectors(s, d)
    scores, models = learn.topic_choice(v.filter("not held_out"), v.filter("held_out"), "v", [3, 6], rounds=5)
    best = scores.orderBy("perplexity", "k").first()["k"]  # one row
    return learn.topic_shares(models[best], v, "v", "source")


@q("nmf_factors")
def nmf_factors(s, d):
    tok = table(s, d, "part").select(F.col("p_partkey").cast("int").alias("doc"), F.explode(F.split("p_name", " ")).alias("t"))
    ids = windows.ranks(tok.select("t").distinct(), [], [F.col("t")], "term").select("t", F.col("term").cast("int").alias("term"))
    tok = tok.join(ids, "t")
    f = learn.nmf(tok.groupBy("doc", "term").agg(F.count(F.lit(1)).cast("float").alias("w")), "doc", "term", "w", 3).itemFactors
    return f.join(ids, F.col("id") == F.col("term")).select("t", "features")


@q("unit_clusters")
def unit_clusters(s, d):
    return learn.unit_clusters(table(s, d, "embeddings"), "embedding", 10).groupBy("label", "cluster").agg(F.count(F.lit(1)).alias("n"))


@q("term_communities")
def term_communities(s, d):
    from plumbline.plans.aggregates import _hits

    edges = stats.cooccurrence(_hits(s, d), "doc_id", "term", 5).select("a", "b", F.log1p("lift").alias("w"))
    parts = learn.communities(edges, "a", "b", "w")
    return s.createDataFrame(sorted(parts.items()), "term string, community int")


@q("term_layout")
def term_layout(s, d):
    """Where the terms of the co-occurrence graph are drawn."""
    from plumbline.plans.aggregates import _hits

    edges = stats.cooccurrence(_hits(s, d), "doc_id", "term", 5).select("a", "b", F.log1p("lift").alias("w"))
    return learn.spring_layout(edges, "a", "b", "w")


@q("centroid_similarity", """
    WITH e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), c AS (SELECT label, i, avg(x) AS c FROM e GROUP BY 1, 2), n AS (SELECT label, sqrt(sum(c * c)) AS n FROM c GROUP BY 1)
    SELECT e.vec_id, sum(e.x * c.c) / any_value(n.n) / sqrt(sum(e.x * e.x)) AS sim FROM e JOIN c ON c.label = e.label AND c.i = e.i JOIN n ON n.label = e.label GROUP BY 1""")
def centroid_similarity(s, d):
    e = table(s, d, "embeddings").withColumn("v", F.transform("embedding", lambda x: x.cast("double")))
    return e.join(learn.centroids(e, "label", "v"), "label").select("vec_id", learn.cosine("v", "centroid").alias("sim"))


@q("nearest_neighbours", """
    SELECT q, ident, sim FROM (SELECT a.vec_id AS q, b.vec_id AS ident, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS sim,
      row_number() OVER (PARTITION BY a.vec_id ORDER BY list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) DESC, b.vec_id) AS r FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0) WHERE r <= 5""")
def nearest_neighbours(s, d):
    e = table(s, d, "embeddings")
    queries = e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("v"))
    return learn.nearest_neighbours(e, "vec_id", "embedding", "label", 5, queries).select("q", "ident", F.round("sim", 9).alias("sim"))


@q("cv_regression")
def cv_regression(s, d):
    p = learn.out_of_fold(_priced(s, d), "fold", 3, _linear, ["o_orderkey", "label"])
    return learn.regression_scores(p, "label", ["fold"])


@q("lasso_regression")
def lasso_regression(s, d):
    from pyspark.ml import Pipeline

    make = lambda: Pipeline(stages=[learn.preprocessor(["c_acctbal", "year"], ["priority", "c_mktsegment"]), R.LinearRegression(regParam=0.001, elasticNetParam=1.0, maxIter=30)])
    return learn.regression_scores(learn.out_of_fold(_priced(s, d), "fold", 3, make, ["o_orderkey", "label"]), "label", ["fold"])


@q("random_search")
def random_search(s, d):
    x = cut_lineage(_priced(s, d))
    x = learn.preprocessor(["c_acctbal", "year"], ["priority"]).fit(x).transform(x).select("fold", "label", "features")
    space = {"regParam": [0.0, 0.001, 0.01, 0.1, 1.0], "elasticNetParam": [0.0, 0.5, 1.0]}
    return learn.random_search(x, "fold", 3, "label", space, 6, lambda **p: R.LinearRegression(maxIter=10, **p))


@q("conformal_quantiles")
def conformal_quantiles(s, d):
    """Quantile predictions with conformal ends on held-out customers: coverage, error and width."""
    x = windows.group_split(_priced(s, d), "o_custkey", 0.25, 8, "calibrate")
    part = lambda held, cal: x.filter((F.col("held_out") == held) & (F.col("calibrate") == cal)).select("c_acctbal", F.col("year").cast("double").alias("year"), "label")
    p = learn.conformal_quantiles(part(False, False), part(False, True), part(True, True).union(part(True, False)), ["c_acctbal", "year"], "label", 0.2)
    return p.agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("label").between(F.col("lo"), F.col("hi")).cast("double")).alias("coverage"),
        F.avg(F.abs(F.exp("mid") - F.exp("label"))).alias("mae"), F.percentile(F.exp(F.col("hi") - F.col("lo")), 0.5).alias("width_ratio"),
    )


@q("linear_attributions")
def linear_attributions(s, d):
    """The Shapley values of a linear model, averaged by size over held-out rows."""
    x = cut_lineage(_priced(s, d))
    v = cut_lineage(learn.preprocessor(["c_acctbal", "year"], ["priority"]).fit(x).transform(x).select("o_orderkey", "label", "held_out", "features"))
    m = R.LinearRegression(regParam=0.01, maxIter=20).fit(v.filter("not held_out"))
    a = learn.linear_attributions(m, v.filter("held_out"), "features", "o_orderkey", v.filter("not held_out"))
    return a.groupBy("feature").agg(F.avg(F.abs("phi")).alias("mean_size"))


@q("forest_importance")
def forest_importance(s, d):
    m = _forest().fit(_priced(s, d))
    rows = [(i, float(x)) for i, x in enumerate(m.stages[-1].featureImportances.toArray())]
    return s.createDataFrame(rows, "feature int, importance double")


@q("gbt_regression")
def gbt_regression(s, d):
    x = learn.preprocessor(["c_acctbal", "year"], ["priority"]).fit(_priced(s, d)).transform(_priced(s, d))
    m = R.GBTRegressor(maxIter=5, maxDepth=3, seed=7).fit(x.filter(~F.col("held_out")))
    return learn.regression_scores(m.transform(x.filter("held_out")), "label")


@q("stacking")
def stacking(s, d):
    return learn.regression_scores(learn.stacked(_priced(s, d), "fold", 3, {"linear": _linear, "forest": _forest}, "o_orderkey", "label"), "label")


@q("group_baseline", """
    WITH f(f) AS (VALUES (0), (1), (2)), x AS (SELECT o_orderkey, o_orderkey % 3 AS fold, o_orderpriority AS g, o_totalprice AS v FROM orders),
    m AS (SELECT f, g, quantile_cont(v, 0.5) AS m FROM x, f WHERE fold <> f GROUP BY 1, 2) SELECT o_orderkey, fold::INTEGER AS fold, m AS prediction FROM x JOIN m ON m.f = x.fold AND m.g = x.g""")
def group_baseline(s, d):
    x = table(s, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 3).cast("int").alias("fold"), F.col("o_orderpriority").alias("g"), F.col("o_totalprice").alias("v"))
    return learn.group_baseline(x, "fold", "g", "v", ["o_orderkey"])


@q("quantile_regression")
def quantile_regression(s, d):
    x = _priced(s, d)
    p = learn.quantile_regression(x.filter(~F.col("held_out")), x.filter("held_out").select("c_acctbal", "year", "label"), ["c_acctbal", "year"], "label", {"lo": 0.1, "mid": 0.5, "hi": 0.9})
    return p.agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("label").between(F.col("lo"), F.col("hi")).cast("double")).alias("coverage"))


@q("conformal_band", """
    WITH m AS (SELECT o_orderpriority AS g, quantile_cont(o_totalprice, 0.5) AS m FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1), r AS (SELECT g, abs(o_totalprice - m) AS e FROM orders JOIN m ON g = o_orderpriority WHERE o_orderkey % 2 = 1),
    i AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY e) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM r) SELECT g, n, e AS q80 FROM i WHERE i = ceil(0.8 * (n - 1) - 1e-9)""")
def conformal_band(s, d):
    o = table(s, d, "orders").withColumnRenamed("o_orderpriority", "g")
    m = o.filter("o_orderkey % 2 = 0").groupBy("g").agg(F.percentile("o_totalprice", 0.5).alias("m"))
    r = o.filter("o_orderkey % 2 = 1").join(m, "g").select("g", F.abs(F.col("o_totalprice") - F.col("m")).alias("e"))
    return stats.higher_quantile(r, ["g"], "e", 0.8, "q80")


@q("conditional_coverage", """WITH b AS (SELECT quantile_cont(o_totalprice, [0.1, 0.9]) AS q FROM orders) SELECT o_orderpriority, avg((o_totalprice BETWEEN q[1] AND q[2])::INT) AS coverage FROM orders, b GROUP BY 1""")
def conditional_coverage(s, d):
    o = table(s, d, "orders")
    lo, hi = stats.quantiles(o, [], "o_totalprice", {"lo": 0.1, "hi": 0.9}).select("lo", "hi").first()  # two numbers
    return o.groupBy("o_orderpriority").agg(F.avg(F.col("o_totalprice").between(lo, hi).cast("int")).alias("coverage"))


@q("median_baseline", "SELECT o_orderstatus, quantile_cont(o_totalprice, 0.5) AS mid, mode(o_orderpriority ORDER BY o_orderpriority) IS NOT NULL AS has_mode FROM orders GROUP BY 1")
def median_baseline(s, d):
    return table(s, d, "orders").groupBy("o_orderstatus").agg(F.percentile("o_totalprice", 0.5).alias("mid"), F.mode("o_orderpriority").isNotNull().alias("has_mode"))


@q("text_classifiers")
def text_classifiers(s, d):
    docs = table(s, d, "documents").filter("text is not null and source is not null").select("doc_id", F.lower("text").alias("text"), "source")
    from pyspark.ml.feature import StringIndexer

    x = learn.hashed_tfidf("text", "features").fit(docs).transform(docs)
    x = StringIndexer(inputCol="source", outputCol="label", stringOrderType="alphabetAsc").fit(x).transform(x).withColumn("test", F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0)
    out = None
    x = cut_lineage(x)
    for name in ("complement_nb", "logistic", "linear_svm", "forest"):
        p = learn.text_learners("label", "features")[name]().fit(x.filter(~F.col("test"))).transform(x.filter("test"))
        sc = stats.class_scores(stats.confusion(p, "label", "prediction")).agg(F.avg("f1").alias("macro_f1"), F.sum("support").alias("n")).withColumn("model", F.lit(name))
        out = sc if out is None else out.unionByName(sc)
    return out


@q("threshold_choice", """
    WITH g AS (SELECT o_totalprice AS t, count(*) FILTER (o_orderstatus = 'F') AS p, count(*) AS n FROM orders GROUP BY 1), r AS (SELECT t, 2 * sum(p) OVER w / (sum(n) OVER w + sum(p) OVER ()) AS f1 FROM g WINDOW w AS (ORDER BY t DESC))
    SELECT t AS threshold, f1 FROM r ORDER BY f1 DESC, t DESC LIMIT 1""")
def threshold_choice(s, d):
    return learn.best_threshold(table(s, d, "orders").withColumn("y", F.col("o_orderstatus") == "F"), "y", "o_totalprice")


WEIGHTS = [("small", 1.5, 0.8), ("red", 1.2, -0.6), ("ring", 1.1, 0.4), ("widget", 1.3, -0.2), ("large", 1.4, 0.1)]
_W = ", ".join(f"('{t}', {i}, {c})" for t, i, c in WEIGHTS)


@q("linear_scores", f"""
    WITH w(t, idf, coef) AS (VALUES {_W}), tok AS (SELECT p_partkey AS doc, unnest(string_split(p_name, ' ')) AS t FROM part), x AS (SELECT doc, coef, (1 + ln(count(*))) * idf::DOUBLE AS x FROM tok JOIN w USING (t) GROUP BY doc, t, coef, idf),
    z AS (SELECT doc, sum(x * coef) / sqrt(sum(x * x)) - 0.1 AS score FROM x GROUP BY 1) SELECT doc, round(score, 9) + 0 AS score, round(1 / (1 + exp(-score)), 9) AS probability FROM z""")
def linear_scores(s, d):
    tok = table(s, d, "part").select(F.col("p_partkey").alias("doc"), F.explode(F.split("p_name", " ")).alias("t"))
    z = learn.linear_scores(tok, "doc", "t", s.createDataFrame(WEIGHTS, "t string, idf double, coef double"), -0.1)
    return z.select("doc", (F.round("score", 9) + 0).alias("score"), F.round("probability", 9).alias("probability"))


@q("score_parts")
def score_parts(s, d):
    tok = table(s, d, "part").select(F.col("p_partkey").alias("doc"), F.explode(F.split("p_name", " ")).alias("t"))
    return learn.contributions(tok, "doc", "t", s.createDataFrame(WEIGHTS, "t string, idf double, coef double"), 2)


@q("profile_scores", """SELECT o_orderkey, 10 + 0.5 * e + 0.02 * e * e + CASE o_orderpriority WHEN '1-URGENT' THEN 0.3 WHEN '2-HIGH' THEN 0.2 ELSE 0 END AS estimate FROM (SELECT *, year(o_orderdate) - 1994 AS e FROM orders)""")
def profile_scores(s, d):
    e = F.year("o_orderdate") - 1994
    bump = F.coalesce(F.create_map(F.lit("1-URGENT"), F.lit(0.3), F.lit("2-HIGH"), F.lit(0.2))[F.col("o_orderpriority")], F.lit(0.0))
    return table(s, d, "orders").select("o_orderkey", (10 + 0.5 * e + 0.02 * e * e + bump).alias("estimate"))


SWITCH = {"A": {"small": 1.0, "ring": 0.5}, "B": {"red": 0.9, "widget": 0.7, "ring": 0.2}, "C": {"large": 1.1, "red": 0.1}}


@q("recourse_steps")
def recourse_steps(s, d):
    p = table(s, d, "part").select("p_partkey", F.split("p_name", " ").alias("have"), F.lit("A").alias("from"), F.lit("B").alias("to"))
    return learn.recourse(p, "p_partkey", "have", "from", "to", SWITCH, {"A": 0.1, "B": 0.0, "C": -0.1})


#: What may be added on the way to a label, and the plain order to compare with.
MAY_ADD, PLAIN = {"B": ["red", "widget"], "A": ["small", "ring"], "C": ["large"]}, {("A", "B"): ["ring", "widget", "red"]}


@q("recourse_summary")
def recourse_summary(s, d):
    """Greedy and plain orders, with and without a limit to what a label asks for."""
    p = table(s, d, "part").select("p_partkey", F.split("p_name", " ").alias("have"), F.lit("A").alias("from"), F.lit("B").alias("to"))
    bias, out = {"A": 0.1, "B": 0.0, "C": -0.1}, None
    for name, how in {"greedy": {}, "feasible": {"feasible": MAY_ADD}, "plain": {"feasible": MAY_ADD, "order": PLAIN}}.items():
        r = learn.recourse_summary(learn.recourse(p, "p_partkey", "have", "from", "to", SWITCH, bias, **how), "p_partkey").withColumn("way", F.lit(name))
        out = r if out is None else out.union(r)
    return out


@q("recourse_curve")
def recourse_curve(s, d):
    """The mean probability of the target after each added term; rows that got there keep their last."""
    r = recourse_steps(s, d)
    last = r.groupBy("p_partkey").agg(F.max("step").alias("last"), F.max_by("probability", "step").alias("end"))
    x = r.join(last, "p_partkey").select("p_partkey", "last", "end", "step", "probability")
    kept = last.select("p_partkey", F.explode(F.filter(F.sequence(F.lit(0), F.lit(10)), lambda i: i > F.col("last"))).alias("step"), F.col("end").alias("probability"))
    return x.select("step", "probability").union(kept.select("step", "probability")).groupBy("step").agg(F.avg("probability").alias("probability"), F.count(F.lit(1)).alias("n"))


@q("typical_terms", """SELECT g, t, n FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY n DESC, t) AS r FROM (SELECT p_type AS g, w AS t, count(*) AS n FROM (SELECT p_type, unnest(string_split(p_name, ' ')) AS w FROM part) GROUP BY 1, 2)) WHERE r <= 3""")
def typical_terms(s, d):
    n = table(s, d, "part").select(F.col("p_type").alias("g"), F.explode(F.split("p_name", " ")).alias("t")).groupBy("g", "t").agg(F.count(F.lit(1)).alias("n"))
    r = F.row_number().over(Window.partitionBy("g").orderBy(F.col("n").desc(), "t"))
    return n.withColumn("r", r).filter("r <= 3").select("g", "t", "n")


@q("plan_coverage", """SELECT p_type, sum((w IN ('small', 'red', 'ring'))::INT) / count(*) AS covered FROM (SELECT p_type, unnest(string_split(p_name, ' ')) AS w FROM part) GROUP BY 1""")
def plan_coverage(s, d):
    w = table(s, d, "part").select("p_type", F.explode(F.split("p_name", " ")).alias("w"))
    return w.groupBy("p_type").agg((F.sum(F.col("w").isin("small", "red", "ring").cast("int")) / F.count(F.lit(1))).alias("covered"))


@q("offer_check", """WITH b AS (SELECT o_orderpriority AS g, quantile_cont(o_totalprice, [0.25, 0.75]) AS q FROM orders GROUP BY 1)
    SELECT o_orderkey, CASE WHEN o_totalprice < q[1] THEN 'below' WHEN o_totalprice > q[2] THEN 'above' ELSE 'inside' END AS verdict FROM orders JOIN b ON g = o_orderpriority""")
def offer_check(s, d):
    o = table(s, d, "orders")
    b = stats.quantiles(o, ["o_orderpriority"], "o_totalprice", {"lo": 0.25, "hi": 0.75})
    v = F.col("o_totalprice")
    return o.join(b, "o_orderpriority").select("o_orderkey", F.when(v < F.col("lo"), "below").when(v > F.col("hi"), "above").otherwise("inside").alias("verdict"))


@q("permutation_importance")
def permutation_importance(s, d):
    x = cut_lineage(_priced(s, d))
    return learn.permutation_importance(_linear().fit(x), x.filter("held_out").drop("held_out"), ["priority", "year"], "o_orderkey", "label")


@q("grid_search")
def grid_search(s, d):
    x = cut_lineage(_priced(s, d))
    x = cut_lineage(learn.preprocessor(["c_acctbal", "year"], ["priority"]).fit(x).transform(x).select("fold", "label", "features"))
    out = None
    for reg in (0.0, 0.1, 1.0):
        p = learn.out_of_fold(x, "fold", 3, lambda r=reg: R.LinearRegression(regParam=r, maxIter=10), ["label"])
        sc = learn.regression_scores(p, "label").withColumn("reg", F.lit(reg))
        out = sc if out is None else out.unionByName(sc)
    return out


# inference

@q("simple_ols", "SELECT regr_slope(ln(o_totalprice), year(o_orderdate)) AS beta FROM orders")
def simple_ols(s, d):
    x = table(s, d, "orders").select("o_custkey", F.year("o_orderdate").alias("year"), F.log("o_totalprice").alias("y"))
    fit = inference.clustered_ols(x, "o_custkey", ["year"], "y").set_index("term")
    return s.createDataFrame([(float(fit.loc["year", "beta"]),)], "beta double")


@q("clustered_premiums")
def clustered_premiums(s, d):
    x = _priced(s, d).withColumns({"urgent": (F.col("priority") == "1-URGENT").cast("int"), "low": (F.col("priority") == "5-LOW").cast("int")})
    p = inference.premiums(x, "o_custkey", ["urgent", "low"], ["year", "c_acctbal"], "label")
    return stats.benjamini_hochberg(p, "p", 0.1)


@q("ridge_intervals")
def ridge_intervals(s, d):
    return s.createDataFrame(inference.ridge_bootstrap(_priced(s, d), "o_custkey", ["year", "c_acctbal"], "label", 1.0, 40))


@q("double_ml_effect")
def double_ml_effect(s, d):
    x = _priced(s, d).withColumn("urgent", (F.col("priority") == "1-URGENT").cast("double"))
    v = learn.preprocessor(["c_acctbal", "year"], ["c_mktsegment"]).fit(x).transform(x).select("features", "fold", "urgent", F.col("label").alias("y"), "o_orderkey")
    return inference.double_ml(v, "o_orderkey", "fold", 3, "urgent", "y", lambda: R.LinearRegression(regParam=0.01, maxIter=10))


@q("inverse_weighting", """WITH p AS (SELECT o_orderpriority AS g, avg((o_orderstatus = 'F')::INT) AS p FROM orders GROUP BY 1)
    SELECT sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice / greatest(0.05, least(1, p)) END) / sum(CASE WHEN o_orderstatus = 'F' THEN 1 / greatest(0.05, least(1, p)) END) AS mean FROM orders JOIN p ON g = o_orderpriority""")
def inverse_weighting(s, d):
    o = table(s, d, "orders").withColumn("seen", F.col("o_orderstatus") == "F")
    p = o.groupBy("o_orderpriority").agg(F.avg(F.col("seen").cast("int")).alias("p"))
    w = inference.inverse_weights(o.join(p, "o_orderpriority"), "p", "seen")
    return w.agg((F.sum(F.col("weight") * F.col("o_totalprice")) / F.sum("weight")).alias("mean"))


@q("review_precision", """
    WITH n AS (SELECT role, count(*) AS n, count(*) FILTER (lower(trim(reviewer_label)) = 'correct') AS k FROM human_validation_template WHERE trim(reviewer_label) <> '' GROUP BY 1)
    SELECT role, n, k / n AS strict FROM n""")
def review_precision(s, d):
    return inference.precision_summary(table(s, d, "human_validation_template"), ["role"], "reviewer_label", 0.5).select("role", "n", "strict")


# sources, sinks, streams

@q("json_round_trip", """SELECT collection.adzuna_id AS job_id, collection.run_id AS run_id, nullif(trim(raw.title), '') AS title, raw.salary_min AS value_lo FROM records_graphic_designer__visual_designer""")
def json_round_trip(s, d):
    """Envelopes written as JSON lines and read again with the explicit schema."""
    path = new_folder(s, "jsonl")
    table(s, d, "records_graphic_designer__visual_designer").write.json(path)
    good, _ = readers.envelopes(s, path, "*.json")
    return readers.flat(good).select("job_id", "run_id", "title", "value_lo")


@q("latest_run", "SELECT collection.adzuna_id AS id FROM records_graphic_designer__visual_designer WHERE collection.run_id = (SELECT max(collection.run_id) FROM records_graphic_designer__visual_designer)")
def latest_run(s, d):
    r = table(s, d, "records_graphic_designer__visual_designer").select(F.col("collection.adzuna_id").alias("id"), F.col("collection.run_id").alias("run"))
    return readers.latest(r, "run").select("id")


@q("schema_union", "SELECT o_orderkey AS id, o_totalprice AS price, NULL::VARCHAR AS name FROM orders UNION ALL SELECT p_partkey, NULL, p_name FROM part")
def schema_union(s, d):
    return readers.union_all([
        table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price")), table(s, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    ])


@q("systematic_sample")
def systematic_sample(s, d):
    return readers.systematic_sample(table(s, d, "orders").select("o_orderkey"), "o_orderkey", 20, 5)


@q("disclosure_probe", """SELECT collection.source AS source, count(*) AS n, count(raw.salary_min) / count(*) AS rate FROM records_project_manager__scrum_master GROUP BY 1""")
def disclosure_probe(s, d):
    r = table(s, d, "records_project_manager__scrum_master")
    return r.groupBy(F.col("collection.source").alias("source")).agg(F.count(F.lit(1)).alias("n"), F.try_divide(F.count("raw.salary_min"), F.count(F.lit(1))).alias("rate"))


@q("stream_weekly_counts", "SELECT cast(date_trunc('week', ts) AS TIMESTAMP) AS week_start, count(*) AS n FROM events GROUP BY 1")
def stream_weekly_counts(s, d):
    """The weekly counts as a stream over the file, drained once."""
    src = new_folder(s, "stream")
    e = table(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    e.write.parquet(src)
    w = events.weekly_counts(events.file_stream(s, src, e.schema, files=100), "ts")
    return events.drain_complete(w, new_folder(s, "out"), new_folder(s, "ck"))


@q("stream_first_by_id", "SELECT DISTINCT user_id, event_type FROM events")
def stream_first_by_id(s, d):
    src = new_folder(s, "stream")
    e = table(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    e.write.parquet(src)
    one = events.first_by_id(events.file_stream(s, src, e.schema, files=100), ["user_id", "event_type"], "ts", "40 days")
    return events.drain(one, new_folder(s, "out"), new_folder(s, "ck")).select("user_id", "event_type")
