"""Operators against literal fixtures and brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import rules, text
from plumbline.operators import dedup, inference, learn, series, serve, stats, windows
from plumbline.session import new_folder
from plumbline.sources import readers


def test_title_rules(spark):
    titles = {
        "Senior Data Analyst - SQL, BI Reporting": ("Data Analyst", "mapped"),
        "Financial Reporting Analyst": (None, "excluded"),
        "WordPress Developer": (None, "unmatched"),
        "Senior Data Engineer [T500-29640]": ("Data Engineer", "mapped"),
        "Data Analyst / Business Analyst": (None, "ambiguous"),
        "Software Engineer in Test": (None, "excluded"),
        "Quality Engineer - Software Automation": (None, "excluded"),
        "Information Security Engineer": ("Information Security Engineer", "mapped"),
        "Security Engineer II": ("Security Engineer", "mapped"),
        "FP&A Analyst": ("Financial Analyst", "mapped"),
        "UI/UX Designer": ("UX Designer", "mapped"),
        "": (None, "unmatched"),
    }
    df = spark.createDataFrame([(t,) for t in titles] + [(None,)], "title string")
    got = {r["title"]: (r["label"], r["status"]) for r in rules.classify(df, "title", rules.TITLE_RULES).collect()}
    assert got == {**titles, None: (None, "unmatched")}


def test_rule_override():
    r = rules.override(rules.TITLE_RULES, {"Scrum Master": {"enabled": False}}, [rules.Rule("X", ("x",))])
    assert {x.label for x in r} >= {"X"} and "Scrum Master" not in {x.label for x in r}


POSTS = [
    (1, "1", "Data Analyst", "A", "2026-09-01", "aaaa"), (2, "1", "Data Analyst", "A", "2026-09-01", "aaaa"), (3, "2", "Data  Analyst!", "A ", "2026-09-02", "AAAA"),
    (4, "3", "Data Analyst", "B", "2026-09-03", "bbbb"), (5, "4", "Data Analyst", "C", "2026-09-04", "cccc"), (6, "5", "Data Analyst", "D", "2026-09-05", "dddd"),
    (7, "6", "Data Analyst II", "X", "2026-09-06", "e1"), (8, "7", "Data Analyst III", "X", "2026-09-07", "e2"), (9, "8", "Data Analyst IV", "", "2026-09-08", "f1"),
]


def posts(spark):
    return spark.createDataFrame(POSTS, "ord int, id string, title string, employer string, created string, description string")


def test_first_seen_then_cap(spark):
    p = posts(spark).withColumn("t", text.norm_text(F.col("title"))).withColumn("e", text.norm_text(F.col("employer"))).withColumn("d", text.norm_text(F.col("description")))
    seen = dedup.first_seen(p, "id", ["t", "e", "d"], [F.col("ord")])
    assert [(r["ord"], r["reason"], r["kept_id"]) for r in seen.filter("reason is not null").orderBy("ord").collect()] == [(2, "id", "1"), (3, "near", "1")]
    left = seen.filter("reason is null").withColumn("g", F.lit("g"))
    capped = dedup.cap_flag(left, "g", "e", 0.25, [F.col("created").desc(), dedup.numeric_id("id")])
    assert [r["id"] for r in capped.filter(~F.col("within_cap")).collect()] == ["6"]


def test_two_step_near_dedup_and_collisions(spark):
    k = dedup.near_keys(posts(spark).filter("ord <> 2"), "title", "employer", "description")
    kept = dedup.near_dedup(k, [F.col("created").desc(), dedup.numeric_id("id")])
    assert {r["id"]: r["group_size"] for r in kept.collect()} == {"2": 2, "3": 1, "4": 1, "5": 1, "6": 1, "7": 1, "8": 1}
    long = spark.createDataFrame([(1, "T", "E", "x" * 200 + "a"), (2, "T", "E", "x" * 200 + "b"), (3, "T", None, "x")], "id int, t string, e string, d string")
    c = dedup.collisions(dedup.near_keys(long, "t", "e", "d")).collect()
    assert [(r["texts"], r["rows"]) for r in c] == [(2, 2)]


def test_lower_quantile_takes_the_third_of_four(spark):
    df = spark.createDataFrame([("a", float(v)) for v in (1, 2, 3, 4)], "g string, v double")
    assert stats.lower_quantiles(df, ["g"], "v", {"mid": 0.5}).first()["mid"] == 3.0


def test_skewness_is_adjusted(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (9.0,)], "v double")
    assert math.isclose(df.agg(stats.adjusted_skewness("v")).first()[0], 1.63, abs_tol=0.01)


def test_profiles_and_empty_tables(spark):
    df = spark.createDataFrame([(None, [], " "), ("x", ["a"], "y")], "a string, b array<string>, c string")
    assert {r["column"]: r["missing"] for r in stats.missing_profile(df).collect()} == {"a": 1, "b": 1, "c": 1}
    none = df.filter("false")
    assert stats.missing_profile(none).filter("share <> 0").count() == 0
    assert stats.concentration(none, ["a"], "c").count() == 0


def test_group_folds_split_no_group(spark):
    df = spark.range(1000).withColumn("g", F.when(F.col("id") < 400, 0).otherwise(F.col("id") % 50))
    f = windows.group_folds(df, "g", 4)
    assert f.count() == f.select("g").distinct().count() and f.select("fold").distinct().count() == 4
    assert windows.group_folds(df.filter("false"), "g", 3).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_fold_plans_are_as_even_as_placing_one_by_one(seed):
    rng = np.random.default_rng(seed)
    sizes = {int(n): int(c) for n, c in zip(rng.integers(1, 200, 12), rng.integers(1, 60, 12))}
    load, one = [0] * 4, [0] * 4
    for n, c in sorted(sizes.items(), reverse=True):
        for _ in range(c):
            one[one.index(min(one))] += n
    plan = windows.fold_plan(list(sizes.items()), 4)
    for n, c in sizes.items():
        steps = sorted((start, folds) for size, start, folds in plan if size == n)
        for r in range(c):
            start, folds = [x for x in steps if x[0] <= r][-1]
            load[folds[(r - start) % len(folds)]] += n
    assert sum(load) == sum(one) and sorted(load) == sorted(one)


def test_shuffle_keeps_strata(spark):
    df = spark.createDataFrame([(i, i % 3, float(i)) for i in range(30)] + [(99, None, 1.0)], "id int, s int, v double")
    out = windows.stratified_shuffle(df, ["s"], "id", "v", 1, "w").collect()
    for s in (0, 1, 2, None):
        assert sorted(r["v"] for r in out if r["s"] == s) == sorted(r["w"] for r in out if r["s"] == s)


def test_partial_autocorrelation_of_an_autoregression(spark):
    rng, v = np.random.default_rng(1), [0.0]
    for _ in range(800):
        v.append(0.7 * v[-1] + rng.normal())
    df = spark.createDataFrame([("a", i, float(x)) for i, x in enumerate(v)], "g string, t int, v double")
    p = {r["lag"]: r["pacf"] for r in windows.partial_autocorrelation(windows.autocorrelation(df, ["g"], "t", "v", 4), ["g"]).collect()}
    assert abs(p[1] - 0.7) < 0.08 and all(abs(p[k]) < 0.12 for k in (2, 3, 4))


def test_series(spark):
    df = spark.createDataFrame([("up", i, float(i + (i % 3))) for i in range(48)] + [("flat", i, 5.0 + (i % 2)) for i in range(48)], "g string, t int, v double")
    assert {r["g"]: r["class"] for r in series.trend_class(df, ["g"], "t", "v", 12).collect()} == {"up": "rising", "flat": "stable"}
    mk = {r["g"]: r for r in series.mann_kendall(df, ["g"], "t", "v").collect()}
    assert mk["up"]["confirmed"] and not mk["flat"]["confirmed"]
    bt = series.backtest(df, ["g"], "t", "v", 30, 3, 6, 12)
    naive = bt.filter("method = 'naive' and g = 'up'").first()
    assert naive["forecast"] == 29 + 29 % 3
    its = series.interrupted(spark.createDataFrame([("a", i, 1.0 + (10.0 if i >= 20 else 0.0)) for i in range(40)], "g string, t int, v double"), ["g"], "t", "v", 20).first()
    assert abs(its["level"] - 10) < 0.5


def test_student_and_normal_tails():
    assert math.isclose(inference.student_p(2.0, 10), 0.07338803, rel_tol=1e-5)
    assert math.isclose(inference.student_p(5.0, 30), 2.3296682e-05, rel_tol=1e-4)
    assert math.isclose(series.normal_sf(1.96), 0.0249979, rel_tol=1e-4)


def test_clustered_ols_finds_the_slope(spark):
    rng = np.random.default_rng(2)
    x, c = rng.normal(size=400), rng.integers(0, 40, 400)
    y = 3 * x + rng.normal(size=400) * 0.1
    df = spark.createDataFrame([(int(a), float(b), float(d)) for a, b, d in zip(c, x, y)], "c int, x double, y double")
    fit = inference.clustered_ols(df, "c", ["x"], "y").set_index("term")
    assert abs(fit.loc["x", "beta"] - 3) < 0.05 and fit.loc["x", "p"] < 1e-6
    boot = inference.ridge_bootstrap(df, "c", ["x"], "y", 0.0, 30).set_index("term")
    assert boot.loc["x", "lo"] < 3 < boot.loc["x", "hi"]


def test_quantile_boosting_orders_and_covers():
    rng = np.random.default_rng(3)
    x = rng.uniform(0, 1, (2000, 1))
    y = x[:, 0] * 4 + rng.normal(size=2000)
    lo, hi = (learn.quantile_predict(learn.boosted_quantile(x, y, q), x) for q in (0.1, 0.9))
    assert 0.72 < ((y >= lo) & (y <= hi)).mean() < 0.88


def test_recourse_reaches_the_target(spark):
    w = {"A": {"a": 1.0}, "B": {"b": 0.6, "c": 0.9}}
    df = spark.createDataFrame([(1, ["a"], "A", "B"), (2, None, "A", "B"), (3, ["b", "c"], "A", "Z")], "id int, h array<string>, f string, t string")
    got = [(r["id"], r["step"], r["added"]) for r in learn.recourse(df, "id", "h", "f", "t", w, {"A": 0.0, "B": 0.0}).orderBy("id", "step").collect()]
    assert got == [(1, 0, None), (1, 1, "c"), (1, 2, "b"), (2, 0, None), (2, 1, "c")]


def test_communities(spark):
    e = [("a", "b", 1.0), ("b", "c", 1.0), ("a", "c", 1.0), ("x", "y", 1.0), ("y", "z", 1.0), ("x", "z", 1.0), ("c", "x", 0.1)]
    p = learn.communities(spark.createDataFrame(e, "a string, b string, w double"), "a", "b", "w")
    assert p["a"] == p["b"] == p["c"] != p["x"] == p["y"] == p["z"]


def test_facets(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", None), ("b", 9.0)], "k string, v double")
    assert df.filter(serve.conjunction({"k": [], "v": (0.0, 2.0)})).count() == 2
    assert {r["k"]: r["n"] for r in serve.facet(df, {"k": ["a"], "v": (0.0, 2.0)}, "k").collect()} == {"a": 1, "b": 1}


def test_envelope_reader_keeps_bad_lines(spark, tmp_path):
    (tmp_path / "records_x.jsonl").write_text('{"collection": {"adzuna_id": "1"}, "raw": {"title": " ", "company": "odd"}}\nnot json\n\n{"raw": {"title": "T"}}\n')
    good, bad = readers.envelopes(spark, str(tmp_path))
    assert bad.select("line").collect()[-1]["line"] == "not json"
    assert [r["title"] for r in readers.flat(good).filter("title is not null").collect()] == ["T"]


def test_weekly_series_and_sorted_csv(spark, tmp_path):
    (tmp_path / "s.csv").write_text("date,SQL,Go,isPartial\n2026-01-04,50,1,False\nbad,1,1,False\n2026-01-11,60,x,False\n2026-01-18,9,9,True\n")
    w = readers.weekly_series(spark, str(tmp_path / "s.csv"))
    assert w.count() == 4 and w.filter("value is null").count() == 1
    readers.write_sorted_csv(w, str(tmp_path / "out"), [F.col("date"), F.col("name")])
    assert spark.read.option("header", "true").csv(str(tmp_path / "out")).count() == 4


def test_replay_source_pages_and_caps(spark, tmp_path):
    (tmp_path / "q.jsonl").write_text("\n".join(f'{{"id": {i}}}' for i in range(7)))
    spark.dataSource.register(readers.ReplaySource)
    got = spark.read.format("replay").option("path", str(tmp_path)).option("page_size", "2").option("max_records", "5").load()
    assert sorted((r["page"], r["position"]) for r in got.collect()) == [(1, 1), (1, 2), (2, 1), (2, 2), (3, 1)]


def test_retry_delays():
    waits, answers = [], iter([(429, None, None), (500, None, 7), (200, "ok", None)])
    r = readers.Retry(waits.append)
    assert r.call(lambda: next(answers)) == "ok" and waits == [1.0, 7]
    assert readers.Retry(waits.append).call(lambda: (401, None, None)) is None
    four = readers.Retry(waits.append)
    assert four.call(lambda: (500, None, None)) is None and len(four.log) == 4


def test_retry_of_timeouts_and_bad_bodies():
    import json

    waits, answers = [], iter([TimeoutError("url: /x?app_id=ID999&app_key=SECRET1&a=1"), (200, "no json", None), (429, None, 9), (200, '{"ok": 1}', None)])

    def request():
        a = next(answers)
        if isinstance(a, Exception):
            raise a
        return a

    r = readers.Retry(waits.append, most=6)
    assert r.call(request, json.loads) == {"ok": 1} and waits == [1.0, 2.0, 9]
    assert (r.failures, r.retries, r.log[-1]["outcome"]) == (3, 3, "recovered")
    assert "SECRET1" not in str(r.log) and "ID999" not in str(r.log) and "a=1" in str(r.log)
    out = readers.Retry(waits.append)
    assert out.call(lambda: (503, None, None)) is None and out.stop_reason == "retries_exhausted"
    no = readers.Retry(waits.append)
    assert no.call(lambda: (401, None, None)) is None and no.stop_reason == "non_retryable_http_401" and len(no.log) == 1


def test_faults_of_json_arrays_are_named(spark, tmp_path):
    for name, body in {"a_x_2026-01-02.json": '[{"id": "1"}, 5, "x", {"id": "2"}]', "b_y_2026-01-02.json": "[{", "c.json": '{"id": 1}', "d.json": "[]"}.items():
        (tmp_path / name).write_text(body)
    got = {(r["file"], r["line"], r["reason"]) for r in readers.json_array_faults(spark, str(tmp_path)).collect()}
    assert got == {("a_x_2026-01-02.json", 1, "record is not an object"), ("a_x_2026-01-02.json", 2, "record is not an object"), ("b_y_2026-01-02.json", None, "unreadable file"), ("c.json", None, "no array")}


def test_rules_come_from_a_json_file(spark, tmp_path):
    import json

    from plumbline.functions import rules

    roles = [
        {"role": "Baker", "match": [r"\bbaker\b", r"\bbread maker\b"], "exclude": [r"\bassistant\b"]}, {"role": "Cook", "match": [r"\bcook\b"], "overlap_group": "k"},
        {"role": "Head Cook", "match": [r"\bhead cook\b"], "overlap_group": "k", "priority": 2}, {"role": "Off", "match": ["x"], "enabled": False},
    ]
    (tmp_path / "roles.json").write_text(json.dumps({"roles": roles}))
    got = rules.load(spark, str(tmp_path / "roles.json"))
    assert [r.label for r in got] == ["Baker", "Cook", "Head Cook"]
    want = {"Night Baker": ("Baker", "mapped", "canonical"), "Bread maker": ("Baker", "mapped", "synonym"), "Assistant baker": (None, "excluded", None), "Head cook": ("Head Cook", "mapped", "canonical"), "Baker & cook": (None, "ambiguous", None), "x": (None, "unmatched", None)}
    out = rules.classify(spark.createDataFrame([(t,) for t in want], "t string"), "t", got)
    assert {r["t"]: (r["label"], r["status"], r["tier"]) for r in out.collect()} == want
    for bad in ({"role": "A"}, {"role": "A", "match": ["("]}):
        with pytest.raises(ValueError):
            rules.from_config({"roles": [bad]})


def test_conformal_quantiles_cover(spark):
    rng = np.random.default_rng(3)
    x = rng.uniform(0, 1, 3000)
    y = 2 * x + rng.normal(0, 0.1 + x)
    rows = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))], "id int, x double, y double")
    part = lambda i: rows.filter(F.col("id") % 3 == i)
    out = learn.conformal_quantiles(part(0), part(1), part(2), ["x"], "y", 0.2)
    assert out.columns == ["id", "x", "y", "lo", "mid", "hi"]
    got = out.toPandas()
    assert len(got) == 1000 and abs(((got.y >= got.lo) & (got.y <= got.hi)).mean() - 0.8) < 0.05
    assert (got.hi - got.lo)[got.x > 0.8].mean() > (got.hi - got.lo)[got.x < 0.2].mean()


def test_recourse_keeps_to_what_is_feasible(spark):
    w = {"A": {"a": 1.0}, "B": {"b": 3.0, "c": 1.5, "e": 0.2}}
    df = spark.createDataFrame([(1, ["a"], "A", "B"), (2, None, "A", "X")], "id int, h array<string>, f string, t string")
    steps = lambda **k: [(r["added"], r["reached"]) for r in learn.recourse(df, "id", "h", "f", "t", w, {"A": 0.0, "B": 0.0}, **k).orderBy("step").collect()]
    assert steps() == [(None, False), ("b", True)]
    assert steps(feasible={"B": ["c", "e"]}) == [(None, False), ("c", True)]
    assert steps(feasible={"B": ["c", "e"]}, order={("A", "B"): ["b", "e", "c"]}) == [(None, False), ("e", False), ("c", True)]
    assert steps(feasible={"B": ["e"]}) == [(None, False), ("e", False)]
    r = learn.recourse_summary(learn.recourse(df, "id", "h", "f", "t", w, {"A": 0.0, "B": 0.0}), "id").first()
    assert (r["n"], r["flip_5"], r["median_added"]) == (1, 1.0, 1.0)


def test_stl_finds_the_parts_of_a_series(spark):
    t = np.arange(120)
    season, trend = 10 * np.sin(2 * np.pi * t / 12), 0.5 * t
    v = season + trend
    v[50] += 200
    df = spark.createDataFrame([("a", int(i), float(x)) for i, x in zip(t, v)] + [("b", 0, 1.0)], "g string, t int, v double")
    p = series.stl(df, ["g"], "t", "v", 12).orderBy("t").toPandas()
    assert len(p) == 120 and abs(p.rest.iloc[50] - 200) < 10
    keep = np.delete(np.arange(120), 50)
    assert np.abs(p.seasonal.to_numpy() - season)[keep].max() < 1.5 and np.abs(p.trend.to_numpy() - trend)[keep].max() < 2
    assert np.allclose(p.trend + p.seasonal + p.rest, p.v)


def test_premiums_equal_one_regression_for_each_flag(spark):
    from plumbline.operators import inference

    rng = np.random.default_rng(4)
    rows = [(int(rng.integers(40)), int(rng.integers(2)), int(rng.integers(3) == 0), float(rng.normal()), float(rng.normal())) for _ in range(600)]
    df = spark.createDataFrame([(*r, 0.3 * r[1] + 0.1 * r[3] + r[4]) for r in rows], "c int, f int, g int, x double, e double, y double")
    got = {r["term"]: r for r in inference.premiums(df, "c", ["f", "g"], ["x"], "y").collect()}
    for f in "fg":
        one = inference.clustered_ols(df, "c", [f, "x"], "y").set_index("term").loc[f]
        assert math.isclose(got[f]["premium"], math.exp(one["beta"]) - 1, rel_tol=1e-8) and math.isclose(got[f]["se"], one["se"], rel_tol=1e-8) and math.isclose(got[f]["p"], one["p"], rel_tol=1e-6)


def test_topics_and_attributions(spark):
    from pyspark.ml.linalg import Vectors
    from pyspark.ml.regression import LinearRegression

    rng = np.random.default_rng(5)
    rows = [(i, Vectors.dense([float(a), float(b)]), float(2.0 * a - b)) for i, (a, b) in enumerate(rng.normal(size=(200, 2)))]
    df = spark.createDataFrame(rows, ["id", "v", "label"])
    m = LinearRegression(featuresCol="v").fit(df)
    total = learn.linear_attributions(m, df, "v", "id", df).groupBy("id").agg(F.sum("phi").alias("s"))
    j = m.transform(df).join(total, "id").crossJoin(m.transform(df).agg(F.avg("prediction").alias("m")))
    assert j.filter("abs(prediction - m - s) > 1e-8").count() == 0
    docs = spark.createDataFrame([(i, "a" if i % 2 else "b", Vectors.dense([float(rng.poisson(9 if (i % 2) == (k < 4) else 0.1)) for k in range(8)])) for i in range(80)], ["id", "g", "v"])
    scores, models = learn.topic_choice(docs.filter("id < 60"), docs.filter("id >= 60"), "v", [2, 5])
    p = {r["k"]: r["perplexity"] for r in scores.collect()}
    assert p[2] < p[5]
    top = {(r["g"], r["topic"]): r["dominant"] for r in learn.topic_shares(models[2], docs, "v", "g").collect()}
    assert {max((0, 1), key=lambda t: top[g, t]) for g in "ab"} == {0, 1}


def test_literals_and_pools(spark):
    c = spark.createDataFrame([("{'a': [1, 2], 'b': None, 'c': True, 'd': 'None, True'}",), ("{'a': [], 'b': 'x', 'c': False, 'd': \"it's\"}",), ("no",), (None,)], "t string")
    got = [tuple(r[0]) if r[0] else None for r in c.select(text.python_literal(F.col("t"), "a array<int>, b string, c boolean, d string")).collect()]
    assert got[:2] == [([1, 2], None, True, "None, True"), ([], "x", False, "it's")] and got[2] in (None, (None,) * 4) and got[3] is None


def test_digest_ignores_order(spark):
    a = spark.range(100).withColumn("x", F.col("id") * 2)
    assert readers.content_digest(a) == readers.content_digest(a.orderBy(F.col("id").desc()).repartition(3))
    assert readers.content_digest(a) != readers.content_digest(a.filter("id <> 5"))


def test_systematic_sample_is_even(spark):
    got = [r["id"] for r in readers.systematic_sample(spark.range(1000), "id", 10, 3).orderBy("id").collect()]
    assert got == [b + i for b in range(0, 1000, 100) for i in range(3)]


def test_text_functions(spark):
    df = spark.createDataFrame([("Café  & Co — node.js", "app_id=abc&x=1"), (None, None), ("", "")], "t string, u string")
    r = df.select(text.norm_title(F.col("t")), text.norm_text(F.col("t")), text.redact(F.col("u")), text.norm_description(F.col("t"))).collect()
    assert r[0][0] == "cafe co node js" and r[0][1] == "caf co node js" and r[0][2] == "app_id=***&x=1" and r[1][1] == ""
    low = F.lower("t")
    c = spark.createDataFrame([("uses c++ and c#",), ("scala c",)], "t string")
    assert [x[0] for x in c.select(text.has_word(low, "c++")).collect()] == [True, False]
    assert [x[0] for x in c.select(text.has_word(low, "c")).collect()] == [False, True]


def test_stream_state_keeps_running_quantiles(spark):
    from plumbline.streaming import events

    path = new_folder(spark, "state")
    spark.createDataFrame([("a", float(i)) for i in range(10)], "k string, v double").write.parquet(path)
    s = events.running_quantile(events.file_stream(spark, path, "k string, v double", files=100), "k", "v", 0.5)
    got = events.drain_complete(s, new_folder(spark, "o"), new_folder(spark, "c"), "update").collect()
    assert [(r["key"], r["n"], r["quantile"]) for r in got] == [("a", 10, 5.0)]


@pytest.mark.parametrize("n", [0, 1])
def test_rates_of_tiny_tables(spark, n):
    df = spark.createDataFrame([("a", True, 1.0)][:n], "g string, y boolean, s double")
    assert stats.rank_auc(df, "y", "s").count() == 1
    assert stats.weighted_median(df, ["g"], "s", "s").count() == n


def test_discovery_arrays_and_logs(spark, tmp_path):
    (tmp_path / "run1").mkdir()
    (tmp_path / "run1" / "posts_data_analyst_2026-01-05.json").write_text('[{"id": "1", "title": "A"}, {"id": "2", "company": {"display_name": "X"}}]')
    d = readers.discover(spark, str(tmp_path), "*.json").collect()
    assert [(r["name"], r["run_dir"]) for r in d] == [("posts_data_analyst_2026-01-05.json", "run1")]
    a = readers.json_arrays(spark, str(tmp_path / "run1"))
    assert sorted((r["id"], r["file_query"], str(r["file_date"])) for r in a.collect()) == [("1", "data_analyst", "2026-01-05"), ("2", "data_analyst", "2026-01-05")]
    log = spark.createDataFrame([("posts_data_analyst_2026-01-05.json", "ok")], "records_file string, status string")
    assert {r["log_status"] for r in readers.with_query_log(a, log).collect()} == {"ok"}
    before = sorted(map(str, readers.file_digests(spark, str(tmp_path)).collect()))
    assert before == sorted(map(str, readers.file_digests(spark, str(tmp_path)).collect()))


def test_typed_extract_and_query_plan(spark, tmp_path):
    (tmp_path / "t.csv").write_text("id,created_date,v\n1,2026-01-02,1.5\n2,bad,NaN\n")
    t = readers.typed_extract(spark, str(tmp_path / "t.csv"), str(tmp_path / "out"))
    assert dict(t.dtypes)["created_date"] == "date" and t.filter("v is null and created_date is null").count() == 1
    plans = spark.createDataFrame([("r", ["in", "gb"], [("a", None), ("b", 9)], 5)], "role string, countries array<string>, variants array<struct<query:string,max_records:int>>, max_records int")
    assert sorted(tuple(r) for r in readers.expand_queries(plans).collect()) == [("r", "gb", "a", 5), ("r", "gb", "b", 9), ("r", "in", "a", 5), ("r", "in", "b", 9)]


def test_one_to_one_refuses_repeated_keys(spark):
    from plumbline.operators import quality

    a = spark.createDataFrame([(1, "x"), (1, "y")], "k int, v string")
    b = spark.createDataFrame([(1, 2.0)], "k int, w double")
    with pytest.raises(Exception, match="repeated"):
        quality.one_to_one(a, b, "k").collect()
    assert quality.one_to_one(b, a.limit(1), "k").count() == 1


def test_prefix_sums_and_quantiles_of_a_hot_group(spark):
    rng = np.random.default_rng(4)
    rows = [("hot" if i % 4 else f"g{i % 7}", float(v)) for i, v in enumerate(rng.integers(0, 60, 900))]
    df = spark.createDataFrame(rows + [(None, 1.0), ("n", None)], "g string, v double")
    for r in stats.quantiles(df, ["g"], "v", {"a": 0.1, "m": 0.5, "z": 0.97}).collect():
        own = [v for g, v in [*rows, (None, 1.0)] if g == r["g"]]
        assert np.allclose([r["a"], r["m"], r["z"]], np.quantile(own, [0.1, 0.5, 0.97])) and r["n"] == len(own)
    ranked = stats.average_rank(df, [], "v", "r").collect()
    assert len(ranked) == 902 and next(r for r in ranked if r["v"] is None)["r"] is None


def test_neighbours_in_several_blocks_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(300, 6))
    df = spark.createDataFrame([(i, [float(x) for x in r], i % 3) for i, r in enumerate(v)], "id int, v array<double>, y int")
    queries = df.filter("id % 5 = 0").select(F.col("id").alias("q"), "v")
    got = learn.nearest_neighbours(df, "id", "v", "y", 4, queries, block=1)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = {(q, int(i)) for q in range(0, 300, 5) for i in np.argsort(-(u @ u[q]), kind="stable")[:4]}
    assert {(r["q"], r["ident"]) for r in got.collect()} == want
    assert learn.nearest_neighbours(df, "id", "v", "y", 4, queries.filter("false")).count() == 0


def test_open_entities_are_decoded_like_all_others(spark, tmp_path):
    import html
    import re

    from plumbline.plans import texts

    said = ["Design &amp; print", "ends in &", "ends in &am", "ends in &amp", "ends in &lt", "ends in &copy", "a&nbsp", "&#38", "", None, "see https://x.example/a?b=1&amp", "R&D &notit"]
    df = spark.createDataFrame([((f"run{i % 2}",), (t,)) for i, t in enumerate(said)], "collection struct<run_id: string>, raw struct<description: string>")
    df.write.parquet(f"{tmp_path}/records_graphic_designer__visual_designer.parquet")
    want = {}
    for i, t in enumerate(said):
        if t is not None:
            n, chars = want.get(f"run{i % 2}", (0, 0))
            want[f"run{i % 2}"] = (n + 1, chars + len(re.sub(r"https?://\S+", " ", html.unescape(t))))
    assert {r["run_id"]: (r["n"], r["chars"]) for r in texts.decode_entities(spark, str(tmp_path)).collect()} == want


def test_runs_are_never_overwritten(spark, tmp_path):
    run = readers.Run(spark, str(tmp_path), "run1")
    run.append(1, ['{"collection": {"adzuna_id": "1"}, "raw": {"id": "1"}}', ""])
    run.append(2, ['{"collection": {"adzuna_id": "2"}, "raw": {"id": "2"}}'])
    with pytest.raises(Exception):
        run.append(2, ["x"])
    with pytest.raises(FileExistsError):
        readers.Run(spark, str(tmp_path), "run1")
    good, bad = readers.envelopes(spark, str(tmp_path))
    assert sorted(r["collection"]["adzuna_id"] for r in good.collect()) == ["1", "2"] and bad.count() == 0


def test_pages_limits_and_batches(spark, tmp_path):
    now, slept = [0.0], []

    def sleep(x):
        slept.append(x)
        now[0] += x

    limit = readers.RateLimiter(2.6, lambda: now[0], sleep)
    limit.wait()
    now[0] += 1
    limit.wait()
    now[0] += 5
    limit.wait()
    assert slept == [1.6]
    assert readers.anchor_batches(list("abcdefa"), "c") == [["c", "a", "b", "d", "e"], ["c", "f"]] and readers.anchor_batches([], "z") == [["z"]]
    assert readers.relabel(spark.range(1).toDF("/m/1"), {"/m/1": "Excel"}).columns == ["Excel"]
    path = str(tmp_path / "page.html")
    readers.write_page(path, "<script>{{data}}</script>", {"grid": {"a": [1, 2]}, "note": "</script>"}, "grid", 2)
    assert open(path).read() == '<script>{"grid": {"a": [1, 2]}, "note": "<\\/script>"}</script>'
    with pytest.raises(ValueError):
        readers.write_page(path, "", {"grid": {"a": [1]}}, "grid", 2)


def test_future_rows_are_left_out(spark):
    from plumbline.streaming import events

    df = spark.sql("SELECT timestamp'2026-01-02 00:00:00' AS ts, timestamp'2026-01-01 10:00:00' AS clock, 1 AS id UNION ALL SELECT timestamp'2026-01-02 00:00:01', timestamp'2026-01-01 10:00:00', 2 UNION ALL SELECT null, timestamp'2026-01-01 10:00:00', 3")
    assert [r["id"] for r in events.without_future(df, "ts", "clock").collect()] == [1]


def test_layout_draws_linked_names_together(spark):
    edges = spark.createDataFrame([(a, b, 1.0) for g in ("abcd", "wxyz") for i, a in enumerate(g) for b in g[i + 1 :]] + [("d", "w", 0.01)], "a string, b string, w double")
    at = {r["name"]: np.array([r["x"], r["y"]]) for r in learn.spring_layout(edges, "a", "b", "w").collect()}
    near = np.mean([np.linalg.norm(at[a] - at[b]) for g in ("abcd", "wxyz") for i, a in enumerate(g) for b in g[i + 1 :]])
    far = np.mean([np.linalg.norm(at[a] - at[b]) for a in "abc" for b in "xyz"])
    assert far > 1.5 * near
    assert learn.spring_layout(edges.filter("false"), "a", "b", "w").count() == 0


def test_forecasts_find_the_parameters_of_simulated_series():
    rng = np.random.default_rng(6)
    e, d = rng.normal(size=1501), [0.0]
    for i in range(1, 1501):
        d.append(0.6 * d[-1] + e[i] + 0.3 * e[i - 1])
    phi, theta, _ = series.arma(np.array(d))
    assert abs(phi - 0.6) < 0.08 and abs(theta - 0.3) < 0.08
    t = np.arange(72)
    v = 50 + 0.5 * t + 8 * np.sin(2 * np.pi * t / 12)
    got = series._holt_winters(v[:60], 12, 12)
    assert np.abs(got - v[60:]).max() < 2.5
    level = np.cumsum(rng.normal(size=300)) + 100
    assert abs(series._ses(level) - level[-1]) < 1.5
    flat = 100 + rng.normal(size=300)
    assert abs(series._ses(flat) - 100) < 0.5
    assert np.allclose(series.minimise(lambda x: (x[0] - 1) ** 2 + 3 * (x[1] + 2) ** 2, (0, 0)), [1, -2], atol=1e-4)


def test_phrases_meet_the_texts_that_hold_them(spark):
    import random

    rng = random.Random(13)
    word = lambda n: "".join(rng.choice("ab ") for _ in range(rng.randrange(n)))
    texts, phrases = [word(14) for _ in range(80)] + [None, ""], [word(8) for _ in range(40)] + [None, ""]
    got = rules.contained(spark.createDataFrame(enumerate(texts), "i int, t string"), "t", spark.createDataFrame(enumerate(phrases), "j int, p string"), "p")
    assert sorted((r["i"], r["j"]) for r in got.collect()) == sorted((i, j) for i, t in enumerate(texts) for j, p in enumerate(phrases) if t and p and p in t)
