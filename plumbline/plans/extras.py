"""Queries of validation, callables, saved models, ablations and stability checks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml import regression as R
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.operators import inference, learn, quality, stats, windows
from plumbline.plans.models import _linear, _priced
from plumbline.plans.registry import Registry
from plumbline.session import cut_lineage, new_folder
from plumbline.sources import readers
from plumbline.sources.tables import table

q = Registry()
QUERIES, SQL = q.queries, q.sql


@q("validated_join", "SELECT c_custkey, n, c_mktsegment FROM customer JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def validated_join(s, d):
    n = table(s, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    return quality.one_to_one(table(s, d, "customer").select("c_custkey", "c_mktsegment"), n, "c_custkey", "inner").select("c_custkey", "n", "c_mktsegment")


@q("cue_classes", """
    WITH c AS (SELECT CASE WHEN contains(lower(raw.title), 'senior') OR contains(lower(raw.title), 'lead') THEN 'senior' WHEN contains(lower(raw.title), 'junior') THEN 'junior' ELSE 'other' END AS class, raw.title AS text
      FROM records_graphic_designer__visual_designer WHERE raw.title IS NOT NULL), n AS (SELECT class, text, count(*) AS n FROM c GROUP BY 1, 2)
    SELECT class, text, n FROM (SELECT *, row_number() OVER (PARTITION BY class ORDER BY n DESC, text) AS r FROM n) WHERE r <= 20""")
def cue_classes(s, d):
    return quality.cue_classes(table(s, d, "records_graphic_designer__visual_designer").select("raw.title"), "title", {"senior": ["senior", "lead"], "junior": ["junior"]}, 20)


@q("projected_yield", "SELECT run_id, query, CASE WHEN capped_by_max_records THEN round_even(raw_records * (api_count / raw_records), 0) END AS projected FROM queries WHERE raw_records > 0")
def projected_yield(s, d):
    p = quality.projected_yield(F.col("raw_records"), F.col("raw_records"), F.col("api_count"), F.col("capped_by_max_records"))
    return table(s, d, "queries").filter("raw_records > 0").select("run_id", "query", p.alias("projected"))


@q("nested_subsample")
def nested_subsample(s, d):
    return quality.subsample(table(s, d, "orders").select("o_orderkey"), "o_orderkey", 0.1, 3)


@q("registry_table", """SELECT * FROM (VALUES ('o_orderkey', 'bigint', 'SOURCE', 'order id'), ('o_totalprice', 'double', 'SOURCE', 'amount'), ('band', 'int', 'DERIVED', 'amount band')) v("column", "type", origin, description)""")
def registry_table(s, d):
    o = table(s, d, "orders").select("o_orderkey", "o_totalprice", (F.col("o_totalprice") / 100000).cast("int").alias("band"))
    about = {"o_orderkey": ("SOURCE", "order id"), "o_totalprice": ("SOURCE", "amount"), "band": ("DERIVED", "amount band")}
    path = new_folder(s, "registry")
    readers.write_table(quality.with_registry(o, about), path)
    return quality.registry_table(s.read.parquet(path))


@q("final_counts", "SELECT role, count(*) AS n, count(DISTINCT employer) AS employers, count(*) FILTER (employer IS NULL) AS unnamed FROM employer_cap_exclusions GROUP BY 1")
def final_counts(s, d):
    return table(s, d, "employer_cap_exclusions").groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("employer").alias("employers"), F.count_if(F.col("employer").isNull()).alias("unnamed"))


@q("unmatched_pool")
def unmatched_pool(s, d):
    from plumbline.functions import rules, text

    t = table(s, d, "records_project_manager__scrum_master").select("raw.title").distinct()
    free = rules.classify(t, "title", rules.TITLE_RULES).filter("status = 'unmatched'").groupBy("normalized").agg(F.min("title").alias("title"))
    return windows.hashed_sample(free.withColumn("all", F.lit(1)), ["all"], "normalized", 50, 11).select("normalized", "title")


# callables

@q("scalar_callable", "SELECT p_partkey, length(p_name)::BIGINT AS n, len(string_split(p_name, ' '))::BIGINT AS words FROM part")
def scalar_callable(s, d):
    """A row callable that gives several columns, as a vectorised struct."""

    @F.pandas_udf(T.StructType([T.StructField("n", T.LongType()), T.StructField("words", T.LongType())]))
    def shape(name: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"n": name.str.len(), "words": name.str.split(" ").str.len()})

    return table(s, d, "part").select("p_partkey", shape("p_name").alias("x")).select("p_partkey", "x.n", "x.words")


@q("group_callable", "SELECT p_brand, max(p_retailprice) - min(p_retailprice) AS span FROM part GROUP BY 1")
def group_callable(s, d):
    """A group callable as a grouped vectorised aggregate."""

    @F.pandas_udf(T.DoubleType())
    def span(v: pd.Series) -> float:
        return float(v.max() - v.min())

    return table(s, d, "part").groupBy("p_brand").agg(span("p_retailprice").alias("span"))


@q("table_callable", "SELECT l_linenumber, h::INTEGER AS step, l_quantity + h AS value FROM (SELECT l_linenumber, l_quantity, unnest(range(0, 3)) AS h FROM lineitem)")
def table_callable(s, d):
    """One row to many: a table function, here by an array of steps that stays in the JVM."""
    x = table(s, d, "lineitem").select("l_linenumber", "l_quantity", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("step"))
    return x.select("l_linenumber", "step", (F.col("l_quantity") + F.col("step")).alias("value"))


@q("python_table_function", "SELECT o_orderpriority, w::VARCHAR AS word FROM (SELECT DISTINCT o_orderpriority, unnest(string_split(o_orderpriority, '-')) AS w FROM orders)")
def python_table_function(s, d):
    @F.udtf(returnType="word string")
    class Words:
        def eval(self, text: str) -> Iterator[tuple]:
            for w in text.split("-"):
                yield (w,)

    s.udtf.register("pl_words", Words)
    table(s, d, "orders").select("o_orderpriority").distinct().createOrReplaceTempView("pl_priorities")
    return s.sql("SELECT o_orderpriority, word FROM pl_priorities, LATERAL pl_words(o_orderpriority)")


# models

@q("saved_model")
def saved_model(s, d):
    """A fitted pipeline saved, loaded and applied."""
    x = _priced(s, d)
    path = new_folder(s, "model")
    _linear().fit(x.filter(~F.col("held_out"))).write().save(path)
    return learn.regression_scores(PipelineModel.load(path).transform(x.filter("held_out")), "label")


@q("saved_bands")
def saved_bands(s, d):
    """Bands of the outcome scored by saved classifiers: without and with the order's priority."""
    from pyspark.ml import classification as C
    from pyspark.ml.functions import vector_to_array

    x = cut_lineage(_priced(s, d))
    cuts = stats.quantiles(x, [], "label", {"a": 1 / 3, "b": 2 / 3}).select("a", "b").first()  # two numbers
    x = x.withColumn("band", (F.col("label") > cuts["a"]).cast("int") + (F.col("label") > cuts["b"]).cast("int"))
    out = None
    for name, cats in {"plain": ["c_mktsegment"], "priority": ["c_mktsegment", "priority"]}.items():
        path = new_folder(s, "bands")
        Pipeline(stages=[learn.preprocessor(["c_acctbal", "year"], cats), C.LogisticRegression(labelCol="band", maxIter=15)]).fit(x.filter("not held_out")).write().save(path)
        p = PipelineModel.load(path).transform(x.filter("held_out"))
        p = p.select(F.lit(name).alias("model"), "o_orderkey", "band", F.col("prediction").cast("int").alias("guess"), vector_to_array("probability").alias("p"))
        out = p if out is None else out.union(p)
    return out


@q("curve_lookup")
def curve_lookup(s, d):
    """Each order with the what-if curve's value at its year, read from the finished grid."""
    grid = cut_lineage(what_if_grid(s, d)).select("year", F.col("prediction").alias("usual"))
    o = table(s, d, "orders").select("o_orderkey", F.year("o_orderdate").alias("year"), F.log("o_totalprice").alias("label"))
    return o.join(grid, "year", "left").select("o_orderkey", "year", "usual", (F.col("label") - F.col("usual")).alias("above"))


@q("what_if_grid")
def what_if_grid(s, d):
    """A model over a grid of one input, other inputs at their typical values."""
    x = _priced(s, d)
    mid = x.agg(F.percentile("c_acctbal", 0.5).alias("c_acctbal"), F.mode("priority").alias("priority"), F.mode("c_mktsegment").alias("c_mktsegment"))  # one row
    grid = mid.withColumn("year", F.explode(F.sequence(F.lit(1995), F.lit(2001))))
    p = _linear().fit(x).transform(grid)
    lo, hi = F.col("prediction") - 0.5, F.col("prediction") + 0.5
    return p.select("year", F.least(lo, "prediction").alias("lo"), "prediction", F.greatest(hi, "prediction").alias("hi"))


@q("ablation")
def ablation(s, d):
    """Cross-validated error without one input at a time."""
    x, out = _priced(s, d), None
    inputs = {"all": (["c_acctbal", "year"], ["priority"]), "no_year": (["c_acctbal"], ["priority"]), "no_priority": (["c_acctbal", "year"], [])}
    for name, (num, cat) in inputs.items():
        p = learn.out_of_fold(x, "fold", 3, lambda n=num, c=cat: Pipeline(stages=[learn.preprocessor(n, c), R.LinearRegression(regParam=0.01, maxIter=10)]), ["label"])
        r = learn.regression_scores(p, "label").withColumn("inputs", F.lit(name))
        out = r if out is None else out.unionByName(r)
    return out


@q("class_weights", "SELECT o_orderstatus, count(*) AS n, (SELECT count(*) FROM orders) / ((SELECT count(DISTINCT o_orderstatus) FROM orders) * count(*)) AS weight FROM orders GROUP BY 1")
def class_weights(s, d):
    w = learn.class_weights(table(s, d, "orders"), "o_orderstatus")
    return w.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.max("weight").alias("weight"))


@q("text_index")
def text_index(s, d):
    """Seniority as the description tells it: a ridge over hashed tf-idf, out of fold by employer, against the title's own words."""
    r = table(s, d, "records_graphic_designer__visual_designer").select(F.lower("raw.title").alias("title"), F.lower("raw.description").alias("text"), F.coalesce("raw.company.display_name", F.lit("")).alias("employer"))
    level = F.when(F.col("title").rlike(r"\b(senior|sr|lead|head|principal)\b"), 2.0).when(F.col("title").rlike(r"\b(junior|jr|intern|trainee|assistant)\b"), 0.0).otherwise(1.0)
    docs = r.filter("title is not null and text is not null").withColumn("label", level)
    x = learn.hashed_tfidf("text", "features").fit(docs).transform(docs).select("features", "label", F.pmod(F.xxhash64("employer"), F.lit(3)).cast("int").alias("fold"))
    p = learn.out_of_fold(x, "fold", 3, lambda: R.LinearRegression(regParam=1.0, elasticNetParam=0.0, maxIter=10), ["label"])
    return p.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.avg("prediction").alias("index"))


# stability of an association

@q("placebo_premium")
def placebo_premium(s, d):
    """The association of a flag with the outcome, and the same with the flag shuffled within strata."""
    x = _priced(s, d).withColumn("urgent", (F.col("priority") == "1-URGENT").cast("int")).select("o_orderkey", "o_custkey", "year", "c_acctbal", "label", "urgent")
    mixed = windows.stratified_shuffle(x, ["year"], "o_orderkey", "urgent", 5, "placebo")
    return inference.premiums(mixed, "o_custkey", ["urgent", "placebo"], ["year", "c_acctbal"], "label")


@q("control_ladder")
def control_ladder(s, d):
    """The association under ever more controls."""
    x, out = _priced(s, d).withColumn("urgent", (F.col("priority") == "1-URGENT").cast("int")), None
    for n, controls in enumerate(([], ["year"], ["year", "c_acctbal"])):
        p = inference.premiums(x, "o_custkey", ["urgent"], controls, "label").withColumn("controls", F.lit(n))
        out = p if out is None else out.unionByName(p)
    return out


@q("holdout_replication")
def holdout_replication(s, d):
    """Signs of associations in two halves of the clusters."""
    x = _priced(s, d).withColumn("urgent", (F.col("priority") == "1-URGENT").cast("int"))
    a = inference.premiums(x.filter("fold = 0"), "o_custkey", ["urgent"], ["year"], "label").select("term", F.col("premium").alias("a"))
    b = inference.premiums(x.filter("fold <> 0"), "o_custkey", ["urgent"], ["year"], "label").select("term", F.col("premium").alias("b"))
    return a.join(b, "term").select("term", "a", "b", (F.signum("a") == F.signum("b")).alias("same_sign"))


@q("term_quadrants", """
    WITH w AS (SELECT unnest(string_split(p_name, ' ')) AS t, p_retailprice AS v FROM part), n AS (SELECT t, count(*) AS n, avg(v) AS level FROM w GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, t) AS rank FROM n)
    SELECT t, rank, CASE WHEN rank <= (SELECT quantile_cont(rank, 0.5) FROM r) THEN CASE WHEN level >= 950 THEN 'invest' ELSE 'opportunity' END ELSE CASE WHEN level >= 950 THEN 'hype' ELSE 'avoid' END END AS quadrant FROM r""")
def term_quadrants(s, d):
    w = table(s, d, "part").select(F.explode(F.split("p_name", " ")).alias("t"), F.col("p_retailprice").alias("v"))
    n = w.groupBy("t").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("level"))
    r = n.withColumn("rank", F.row_number().over(Window.orderBy(F.col("n").desc(), "t")))  # a vocabulary
    mid = r.agg(F.percentile("rank", 0.5)).first()[0]  # one number
    high = F.col("level") >= 950
    near = F.when(high, "invest").otherwise("opportunity")
    far = F.when(high, "hype").otherwise("avoid")
    return r.select("t", "rank", F.when(F.col("rank") <= mid, near).otherwise(far).alias("quadrant"))


@q("explorer_kpis", "SELECT count(*) AS n, quantile_cont(o_totalprice, 0.5) AS mid, avg((o_totalprice > 200000)::INT) AS high, count(DISTINCT o_custkey) AS members FROM orders WHERE o_orderpriority = '1-URGENT'")
def explorer_kpis(s, d):
    o = table(s, d, "orders").filter("o_orderpriority = '1-URGENT'")
    return o.agg(F.count(F.lit(1)).alias("n"), F.percentile("o_totalprice", 0.5).alias("mid"), F.avg((F.col("o_totalprice") > 200000).cast("int")).alias("high"), F.countDistinct("o_custkey").alias("members"))


@q("weighted_overall", "SELECT sum(n * m) / sum(n) AS overall FROM (SELECT o_orderpriority, count(*) AS n, quantile_cont(o_totalprice, 0.5) AS m FROM orders GROUP BY 1)")
def weighted_overall(s, d):
    g = table(s, d, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.percentile("o_totalprice", 0.5).alias("m"))
    return g.agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("overall"))


@q("sign_agreement", "SELECT avg((sign(l_discount - 0.05) = sign(l_tax - 0.04))::INT) AS agree FROM lineitem")
def sign_agreement(s, d):
    c = F.col
    return table(s, d, "lineitem").agg(F.avg((F.signum(c("l_discount") - 0.05) == F.signum(c("l_tax") - 0.04)).cast("int")).alias("agree"))


@q("macro_f1")
def macro_f1(s, d):
    from plumbline.plans.aggregates import _guesses

    return stats.class_scores(stats.confusion(_guesses(s, d), "truth", "guess")).agg(F.avg("f1").alias("macro_f1"))
