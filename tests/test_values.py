"""Values of the queries that SQL can't express, against brute force over the smallest tables."""

import hashlib
import html
import math
import re
import unicodedata

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.functions import rules
from plumbline.operators import quality, series
from plumbline.plans import extras, models, relational, texts, timeseries

DATA = "/root/testdata/sf0.001"
ALL = {n: f for m in (extras, models, relational, texts, timeseries) for n, f in m.QUERIES.items()}


@pytest.fixture(scope="module")
def out(spark):
    known: dict[str, pd.DataFrame] = {}

    def get(name):
        if name not in known:
            known[name] = ALL[name](spark, DATA).toPandas()
        return known[name]

    return get


@pytest.fixture(scope="module")
def load(spark):
    return lambda name: pd.read_parquet(f"{DATA}/{name}.parquet")


@pytest.fixture(scope="module")
def priced(spark):
    return models._priced(spark, DATA).toPandas()


@pytest.fixture(scope="module")
def orders(load):
    return load("orders")


# samples, splits, ranks

def test_samples_and_splits(out, orders, spark):
    h = out("hashed_sample")
    assert set(h.o_orderkey) <= set(orders.o_orderkey) and (h.groupby("o_orderpriority").size() == orders.groupby("o_orderpriority").size().clip(upper=20)).all()
    g = out("group_split")
    assert len(g) == len(orders) and (g.groupby("o_custkey").held_out.nunique() == 1).all() and 0.05 < g.held_out.mean() < 0.4
    f = out("group_folds").merge(orders, on="o_custkey")
    assert len(f) == len(orders) and (f.groupby("o_custkey").fold.nunique() == 1).all()
    load = f.groupby("fold").size()
    assert len(load) == 5 and load.max() - load.min() <= orders.groupby("o_custkey").size().max()
    s = out("stratified_folds")
    n = s.groupby(["o_orderpriority", "fold"]).size().unstack()
    assert len(s) == len(orders) and n.shape[1] == 5 and ((n.max(axis=1) - n.min(axis=1)) <= 1).all()
    o = spark.read.parquet(f"{DATA}/orders.parquet").select("o_orderkey")
    small = {r[0] for r in quality.subsample(o, "o_orderkey", 0.05, 3).collect()}
    nested = set(out("nested_subsample").o_orderkey)
    assert small <= nested <= set(orders.o_orderkey) and 0.03 * len(orders) < len(nested) < 0.2 * len(orders)
    sample = sorted(out("systematic_sample").o_orderkey)
    place = {k: i for i, k in enumerate(sorted(orders.o_orderkey))}
    step = len(orders) // 20
    assert [place[k] for k in sample] == [w * step + i for w in range(20) for i in range(5)]


def test_shuffle_and_bootstrap(out, orders):
    s = out("stratified_shuffle")
    assert len(s) == len(orders) and (s.o_totalprice != s.shuffled).mean() > 0.9
    for _, g in s.groupby("o_orderpriority"):
        assert sorted(g.o_totalprice) == sorted(g.shuffled)
    b = out("bootstrap_means")
    assert sorted(b.replicate) == list(range(50)) and abs(b["mean"].mean() / orders.o_totalprice.mean() - 1) < 0.05 and b["mean"].std() > 0


def test_digest_and_partial_autocorrelation(out, orders, spark):
    assert len(out("content_hash")) >= 1
    acf = relational.QUERIES["acf_lags"](spark, DATA).toPandas()
    keys = [c for c in acf.columns if c not in ("lag", "acf")]
    got = out("pacf_lags")
    for key, g in acf.groupby(keys):
        r = np.concatenate([[1.0], g.sort_values("lag").acf.to_numpy()])
        p = got[(got[keys] == pd.Series(key if isinstance(key, tuple) else (key,), index=keys)).all(axis=1)].sort_values("lag").pacf.to_numpy()
        for k in range(1, min(len(p), 6) + 1):
            system = np.array([[r[abs(i - j)] for j in range(k)] for i in range(k)])
            assert math.isclose(np.linalg.solve(system, r[1 : k + 1])[-1], p[k - 1], abs_tol=1e-5)


# texts

def norm_description(t):
    t = unicodedata.normalize("NFKC", t or "")
    t = re.sub("[​‌‍⁠﻿]", "", t)
    t = "".join(" " if unicodedata.category(c) == "Cc" else c for c in t)
    t = re.sub(r"\s+", " ", t).strip(" ")
    return re.sub(r"(\.\.\.|…)\s*$", "", t).strip(" ").lower()


def norm_title(t):
    t = unicodedata.normalize("NFKD", t or "").encode("ascii", "ignore").decode().lower()
    return re.sub(r"[^a-z0-9]+", " ", t).strip()


def test_normal_descriptions(out, load):
    docs = load("documents").set_index("doc_id").text
    got = out("norm_description").set_index("doc_id").digest
    assert len(got) == len(docs)
    for i, t in docs.items():
        assert got[i] == hashlib.md5(norm_description(t if isinstance(t, str) else None).encode()).hexdigest(), repr(t)


def records(load, name):
    r = load(name)
    return pd.concat([pd.json_normalize(r.collection), pd.json_normalize(r.raw)], axis=1)


def test_decoded_entities(out, load):
    r = records(load, "records_graphic_designer__visual_designer").dropna(subset=["description"])
    want = r.groupby("run_id").description.agg(lambda d: sum(len(re.sub(r"https?://\S+", " ", html.unescape(t))) for t in d))
    got = out("decode_entities").set_index("run_id")
    assert got.chars.to_dict() == want.to_dict() and got.n.to_dict() == r.groupby("run_id").size().to_dict()


def test_near_duplicates(out, load):
    r = records(load, "records_graphic_designer__visual_designer")
    got = out("near_dedup")
    assert got.group_size.sum() == r.adzuna_id.nunique() and got.id.is_unique
    whole = {}
    for i, title, employer, text in r[["adzuna_id", "title", "company.display_name", "description"]].itertuples(index=False):
        t, d = norm_title(title if isinstance(title, str) else ""), norm_description(text if isinstance(text, str) else "")
        e = re.sub(r"[^a-z0-9]+", " ", (employer if isinstance(employer, str) else "").lower()).strip()
        key = hashlib.sha1(f"{t}|{e}|{d[:150]}".encode()).hexdigest()[:16] if t and e and d else None
        whole.setdefault(i, set()).add((key, d))
    keyed = got.dropna(subset=["near_key"])
    assert all(any(k == key for k, _ in whole[i]) for i, key in keyed[["id", "near_key"]].itertuples(index=False))
    want: dict = {}
    for role, employer, text in load("documents")[["role", "employer", "text"]].itertuples(index=False):
        t, d = norm_title(role if isinstance(role, str) else ""), norm_description(text if isinstance(text, str) else "")
        e = re.sub(r"[^a-z0-9]+", " ", (employer if isinstance(employer, str) else "").lower()).strip()
        if t and e and d:
            want.setdefault(hashlib.sha1(f"{t}|{e}|{d[:40]}".encode()).hexdigest()[:16], []).append(d)
    got = out("template_collisions").set_index("near_key")
    assert {k: (r.texts, r.rows) for k, r in got.iterrows()} == {k: (len(set(v)), len(v)) for k, v in want.items() if len(set(v)) > 1}


def test_title_rules_and_the_unmatched_pool(out, load):
    def label(t):
        n = norm_title(t)
        hit = [r for r in rules.TITLE_RULES if any(re.search(p, n) for p in r.match)]
        fired = [r for r in hit if not any(re.search(p, n) for p in r.exclude)]
        wins = [r for r in fired if not any(o.overlap and o.overlap == r.overlap and o.priority > r.priority for o in fired)]
        return ("mapped", wins[0].label) if len(wins) == 1 else ("ambiguous", None) if wins else ("excluded", None) if hit else ("unmatched", None)

    got = out("title_rules")
    title = next(c for c in got.columns if "title" in c)
    for row in got.itertuples(index=False):
        t = getattr(row, title)
        assert (row.status, row.label if isinstance(row.label, str) else None) == label(t if isinstance(t, str) else ""), t
    pool = out("unmatched_pool")
    assert 0 < len(pool) <= 50 and all(label(t)[0] == "unmatched" for t in pool.title if isinstance(t, str))


# decompositions and topics

def test_svd_equals_numpy(out, load):
    e = load("embeddings").sort_values("vec_id")
    m = np.stack(e.embedding).astype(float)
    _, _, vt = np.linalg.svd(m, full_matrices=False)
    got = np.stack(out("truncated_svd").sort_values("vec_id").projected)
    assert np.allclose(np.abs(got), np.abs(m @ vt[:5].T), atol=1e-4)


def test_topics_clusters_and_communities(out, load):
    docs = load("documents").dropna(subset=["text"])
    t = out("lda_topics")
    assert len(t) == 4 and all(len(x) == 8 and all(re.fullmatch(r"[a-z][a-z0-9./]*", w) for w in x) for x in t.terms)
    assert all(list(w) == sorted(w, reverse=True) for w in t.termWeights)
    c = out("topic_choice")
    assert sorted(c.k) == [3, 6, 9] and (c.perplexity > 1).all()
    s = out("topic_shares")
    assert np.allclose(s.groupby("source").mean_share.sum(), 1) and 0.9 * len(docs) <= s.dominant.sum() <= len(docs)
    assert out("unit_clusters").n.sum() == len(load("embeddings"))
    part = load("part")
    words = {w for n in part.p_name for w in n.split(" ")}
    f = out("nmf_factors")
    assert set(f.t) == words and all(min(x) >= 0 for x in f.features)
    k = out("term_communities")
    assert k.term.is_unique and set(k.community) == set(range(k.community.max() + 1))


# models: compared with a constant guess and with closed forms

def constant_mae(p):
    return np.abs(p.label - p.label.mean()).mean()


@pytest.mark.parametrize("name", ["cv_regression", "lasso_regression"])
def test_fold_scores(out, priced, name):
    got = out(name).set_index("fold")
    assert got.n.to_dict() == priced.groupby("fold").size().to_dict()
    assert (got.mae < 1.1 * constant_mae(priced)).all() and (got.r2 > -0.1).all() and (got.rmse >= got.mae).all()


@pytest.mark.parametrize("name", ["saved_model", "gbt_regression"])
def test_held_out_scores(out, priced, name):
    got = out(name).iloc[0]
    held = priced[priced.held_out]
    assert got.n == len(held) and got.mae < 1.15 * constant_mae(held) and got.r2 > -0.25


def test_model_studies(out, priced):
    assert out("stacking").iloc[0].n == len(priced) and out("stacking").iloc[0].r2 > -0.1
    a = out("ablation").set_index("inputs")
    assert set(a.index) == {"all", "no_year", "no_priority"} and (a.n == len(priced)).all()
    g = out("grid_search").set_index("reg")
    assert set(g.index) == {0.0, 0.1, 1.0} and (g.n == len(priced)).all()
    r = out("random_search")
    assert len(r) == 6 and r.params.is_unique and (r.mae < 1.1 * constant_mae(priced)).all()
    f = out("forest_importance")
    assert math.isclose(f.importance.sum(), 1, abs_tol=1e-9) and (f.importance >= 0).all()
    p = out("permutation_importance").set_index("column")
    assert set(p.index) == {"priority", "year"} and (p.spread >= 0).all() and (p.gain > -0.05).all()
    q = out("quantile_regression").iloc[0]
    assert q.n == priced.held_out.sum() and 0.6 < q.coverage < 0.95
    c = out("conformal_quantiles").iloc[0]
    assert c.n == priced.held_out.sum() and 0.65 < c.coverage < 0.95 and c.width_ratio > 1 and c.mae > 0
    assert (out("linear_attributions").mean_size >= 0).all()
    w = out("what_if_grid").sort_values("year")
    assert list(w.year) == list(range(1995, 2002)) and (w.lo <= w.prediction).all() and (w.prediction <= w.hi).all()
    assert np.allclose(np.diff(w.prediction, 2), 0, atol=1e-8)
    t = out("text_classifiers").set_index("model")
    assert set(t.index) == {"complement_nb", "logistic", "linear_svm", "forest"} and t.n.nunique() == 1 and t.macro_f1.between(0, 1).all()
    x = out("text_index")
    assert x["index"].between(-0.5, 2.5).all() and x.n.sum() > 0


def test_bands_curves_and_layout(out, priced, orders):
    b = out("saved_bands")
    held = priced[priced.held_out]
    assert (b.groupby("model").size() == len(held)).all() and np.allclose([sum(p) for p in b.p], 1)
    assert all(g == int(np.argmax(p)) for g, p in zip(b.guess, b.p))
    c = out("curve_lookup").merge(out("what_if_grid"), on="year", how="left")
    assert len(c) == len(orders) and np.allclose(c.usual.dropna(), c.prediction.dropna())
    r = out("recourse_curve").sort_values("step")
    steps = out("recourse_steps")
    assert list(r.step) == list(range(11)) and (r.n == steps.p_partkey.nunique()).all() and (r.probability.diff().dropna() > -1e-12).all()
    assert math.isclose(r.probability.iloc[0], steps[steps.step == 0].probability.mean(), rel_tol=1e-9)
    t = out("term_layout")
    assert t.name.is_unique and t.x.between(0, 1).all() and t.y.between(0, 1).all() and set(t.name) == set(out("term_communities").term)


def test_macro_f1(out, spark):
    from plumbline.plans import aggregates

    g = aggregates._guesses(spark, DATA).toPandas()
    scores = []
    for k in set(g.truth) | set(g.guess):
        hit, said, own = ((g.truth == k) & (g.guess == k)).sum(), (g.guess == k).sum(), (g.truth == k).sum()
        p, r = hit / said if said else 0, hit / own if own else 0
        scores.append(2 * p * r / (p + r) if p + r else 0)
    assert math.isclose(out("macro_f1").iloc[0, 0], np.mean(scores), rel_tol=1e-9)


def ols(x, y, cluster):
    x = np.column_stack([np.ones(len(y)), *x])
    inv = np.linalg.inv(x.T @ x)
    beta = inv @ x.T @ y
    u = pd.DataFrame(x * (y - x @ beta)[:, None]).groupby(np.asarray(cluster)).sum().to_numpy()
    g, (n, k) = len(u), x.shape
    var = inv @ u.T @ u @ inv * g / (g - 1) * (n - 1) / (n - k)
    return beta, np.sqrt(np.diag(var))


def test_premiums_equal_least_squares(out, priced):
    urgent, y = (priced.priority == "1-URGENT").astype(float), priced.label.to_numpy()
    year, bal = priced.year.to_numpy(float), priced.c_acctbal.to_numpy(float)
    got = out("clustered_premiums").set_index("term")
    for term, flag in {"urgent": urgent, "low": (priced.priority == "5-LOW").astype(float)}.items():
        beta, se = ols([flag, year - year.mean(), bal - bal.mean()], y, priced.o_custkey)
        assert math.isclose(got.premium[term], math.exp(beta[1]) - 1, rel_tol=1e-6) and math.isclose(got.se[term], se[1], rel_tol=1e-6)
    ladder = out("control_ladder").set_index("controls")
    for n, c in enumerate(([], [year - year.mean()], [year - year.mean(), bal - bal.mean()])):
        assert math.isclose(ladder.premium[n], math.exp(ols([urgent, *c], y, priced.o_custkey)[0][1]) - 1, rel_tol=1e-6)
    p = out("placebo_premium").set_index("term")
    assert set(p.index) == {"urgent", "placebo"} and p.n.nunique() == 1
    h = out("holdout_replication").iloc[0]
    for side, part in (("a", priced.fold == 0), ("b", priced.fold != 0)):
        beta, _ = ols([urgent[part], year[part] - year[part].mean()], y[part], priced.o_custkey[part])
        assert math.isclose(h[side], math.exp(beta[1]) - 1, rel_tol=1e-6)
    assert h.same_sign == (np.sign(h.a) == np.sign(h.b))


def test_ridge_and_double_ml(out, priced):
    r = out("ridge_intervals").set_index("term")
    x = np.column_stack([np.ones(len(priced)), priced.year, priced.c_acctbal]).astype(float)
    beta = np.linalg.solve(x.T @ x + np.diag([0, 1.0, 1.0]), x.T @ priced.label.to_numpy())
    assert np.allclose(r.beta.to_numpy(), beta, rtol=1e-3, atol=1e-4) and (r.lo <= r.hi).all()
    d = out("double_ml_effect").iloc[0]
    assert d.n == len(priced) and d.se > 0 and abs(d.beta) < 10 * d.se


def test_recourse_and_parts_of_scores(out, load):
    part = load("part")
    s = out("recourse_steps").sort_values(["p_partkey", "step"])
    assert set(s.p_partkey) == set(part.p_partkey) and (s[s.step == 0].added.isna()).all()
    assert (s.groupby("p_partkey").reached.sum() <= 1).all()
    rise = s.groupby("p_partkey").probability.diff().dropna()
    assert (rise > -1e-12).all()
    r = out("recourse_summary").set_index("way")
    assert set(r.index) == {"greedy", "feasible", "plain"} and (r.n == len(part)).all() and r.flip_5["greedy"] >= r.flip_5["feasible"] >= r.flip_5["plain"] - 1e-12
    w = {t: (i, c) for t, i, c in models.WEIGHTS}
    want = {}
    for key, name in part[["p_partkey", "p_name"]].itertuples(index=False):
        tf = pd.Series(name.split(" ")).value_counts()
        x = {t: (1 + math.log(n)) * w[t][0] for t, n in tf.items() if t in w}
        norm = math.sqrt(sum(v * v for v in x.values()))
        best = sorted(((-abs(v / norm * w[t][1]), t) for t, v in x.items()))[:2]
        want |= {(key, t): x[t] / norm * w[t][1] for _, t in best}
    got = {(k, t): v for k, t, v in out("score_parts").itertuples(index=False)}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-9) for k in want)


# series

def test_backtests_agree_with_each_other(out, spark):
    a = out("backtest_all")
    naive = timeseries.QUERIES["naive_backtest"](spark, DATA).toPandas().set_index("g")
    assert set(a.method) == set(series.METHODS)
    for g, mape in a[a.method == "naive"][["g", "mape"]].itertuples(index=False):
        assert math.isclose(naive.mape[g], mape, rel_tol=1e-9)
    wide = a.pivot(index="g", columns="method", values="mape")
    b = out("beats_naive").set_index("method")
    for m in b.index:
        assert math.isclose(b.share[m], (wide[m] < wide.naive).mean()) and math.isclose(b.mean_gain[m], (wide.naive - wide[m]).mean(), rel_tol=1e-9)
    best = out("best_method").set_index("g")
    assert all(math.isclose(best.mape[g], wide.loc[g].min()) and wide.loc[g, best.method[g]] == wide.loc[g].min() for g in best.index)


def test_interruption_equals_least_squares(out, spark):
    m = timeseries._monthly(spark, DATA).toPandas()
    got = out("interrupted_series").set_index("g")
    for g, p in m.groupby("g"):
        p = p.sort_values("m")
        after = (p.m >= pd.Timestamp("1998-07-01")).to_numpy(float)
        n = len(p)
        x = np.column_stack([np.ones(n), np.arange(n), after, after * (np.arange(n) - (n - after.sum()))])
        beta, *_ = np.linalg.lstsq(x, p.v.to_numpy(float), rcond=None)
        assert math.isclose(got.level[g], beta[2], rel_tol=1e-6) and math.isclose(got.slope[g], beta[3], rel_tol=1e-6) and got.level_se[g] > 0


def test_strengths_and_conformal_coverage(out, spark):
    for name in ("seasonal_strength", "stl_strength"):
        assert out(name).trend_strength.between(0, 1).all() and out(name).seasonal_strength.between(0, 1).all() and len(out(name)) > 0
    bt = timeseries._backtest(spark, DATA).toPandas()
    bt["e"] = (bt.actual - bt.forecast).abs()
    hits: dict = {}
    for r in bt.itertuples(index=False):
        past = sorted(bt[(bt.g == r.g) & (bt.method == r.method) & (bt.h == r.h) & (bt.target < r.origin)].e)
        if len(past) >= 3:
            q = past[min(len(past), math.ceil((len(past) + 1) * 0.8 - 1e-9)) - 1]
            hits.setdefault(r.method, []).append(abs(r.actual - r.forecast) <= q + 1e-12)
    got = out("conformal_coverage").set_index("method")
    assert {m: (got.n[m], round(got.coverage[m], 9)) for m in got.index} == {m: (len(v), round(np.mean(v), 9)) for m, v in hits.items()}


def test_every_query_without_sql_is_looked_at():
    import pathlib

    text = pathlib.Path(__file__).read_text()
    without = [n for m in (extras, models, relational, texts, timeseries) for n in m.QUERIES if n not in m.SQL]
    assert [n for n in without if f'"{n}"' not in text] == []
