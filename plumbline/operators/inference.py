"""Regression-adjusted associations from additive sums: the data is aggregated once, small systems are solved on the driver."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.session import cut_lineage


def student_p(t: float, df: float) -> float:
    """The two-sided p-value of a t statistic, by the incomplete beta function's continued fraction."""
    if not math.isfinite(t) or df <= 0:
        return float("nan")
    x = df / (df + t * t)
    a, b = df / 2, 0.5
    flip = x > (a + 1) / (a + b + 2)
    if flip:
        a, b, x = b, a, 1 - x
    if x <= 0:
        return 1.0 if flip else 0.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d, f = 1.0, 0.0, 1.0
    for i in range(300):
        m = i // 2
        if i == 0:
            n = 1.0
        elif i % 2 == 0:
            n = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            n = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / max(1 + n * d, 1e-300) if 1 + n * d > 0 else 1 / (1 + n * d)
        c = 1 + n / c
        f *= c * d
        if abs(1 - c * d) < 1e-12:
            break
    value = front * (f - 1)
    return 1 - value if flip else value


def cluster_sums(df: DataFrame, cluster: str, inputs: Sequence[str], truth: str) -> DataFrame:
    """``cluster, xx, xy, n``: each cluster's cross products with an intercept first, flattened; rows with a null are left out."""
    cols = [F.lit(1.0), *[F.col(c).cast("double") for c in inputs], F.col(truth).cast("double")]
    width = len(inputs) + 1
    ok = df.select(cluster, F.array(*cols).alias("v")).filter("not exists(v, x -> x is null or isnan(x))")
    v = F.col("v")
    sums = [F.sum(v[i] * v[j]).alias(f"m{i}_{j}") for i in range(width + 1) for j in range(i, width + 1)]
    g = ok.groupBy(cluster).agg(F.count(F.lit(1)).alias("n"), *sums)
    xx = F.array(*[F.col(f"m{min(i, j)}_{max(i, j)}") for i in range(width) for j in range(width)])
    return g.select(cluster, xx.alias("xx"), F.array(*[F.col(f"m{i}_{width}") for i in range(width)]).alias("xy"), F.col(f"m{width}_{width}").alias("yy"), "n")


def _total(sums: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray, int, int]:
    r = sums.agg(
        F.array(*[F.sum(F.col("xx")[i]) for i in range(width * width)]), F.array(*[F.sum(F.col("xy")[i]) for i in range(width)]), F.sum("n"), F.count(F.lit(1))
    ).first()  # one row
    return np.array(r[0], float).reshape(width, width), np.array(r[1], float), int(r[2]), int(r[3])


def clustered_ols(df: DataFrame, cluster: str, inputs: Sequence[str], truth: str) -> pd.DataFrame:
    """``term, beta, se, t, p``: least squares with cluster-robust errors; the intercept is the fit at the inputs' means.

    Three aggregates: the means, by which inputs are centred, the sums, and the
    clusters' scores at the solution; nothing but ``width x width`` matrices reaches
    the driver.
    """
    width = len(inputs) + 1
    means = df.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in inputs]).first()  # one row
    df = df.select(cluster, truth, *[(F.col(c).cast("double") - F.lit(means[c] or 0.0)).alias(c) for c in inputs])
    sums = cluster_sums(df, cluster, inputs, truth)
    xx, xy, n, g = _total(sums, width)
    inv = np.linalg.pinv(xx)
    beta = inv @ xy

    def meat(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((width, width))
        for b in batches:
            for row_xx, row_xy in zip(b["xx"], b["xy"]):
                s = np.asarray(row_xy) - np.asarray(row_xx).reshape(width, width) @ beta
                total += np.outer(s, s)
        yield pd.DataFrame({"m": [total.ravel()]})

    parts = sums.select("xx", "xy").mapInPandas(meat, "m array<double>")
    r = parts.agg(F.array(*[F.sum(F.col("m")[i]) for i in range(width * width)])).first()  # one row
    middle = np.array(r[0], float).reshape(width, width)
    scale = g / (g - 1) * (n - 1) / (n - width) if g > 1 and n > width else 1.0
    se = np.sqrt(np.maximum(np.diag(inv @ middle @ inv) * scale, 0))
    t = np.divide(beta, se, out=np.full(width, np.nan), where=se > 0)
    return pd.DataFrame({"term": ["intercept", *inputs], "beta": beta, "se": se, "t": t, "p": [student_p(x, g - 1) for x in t]})


def premiums(df: DataFrame, cluster: str, flags: Sequence[str], controls: Sequence[str], truth: str, least: int = 25) -> DataFrame:
    """``term, premium, se, p, n``: ``exp(beta) - 1`` of each flag on its own beside the controls, with at least ``least`` rows on both sides.

    All flags come from one aggregation to clusters: the controls' cross products and,
    for each flag, its products with itself, the controls and the outcome. A second
    aggregate over the clusters gives every flag's clustered variance. Rows with a null
    control or outcome are left out; a null flag counts as not set.
    """
    num = lambda c: F.col(c).cast("double")
    whole = df.filter(" and ".join(f"`{c}` is not null and not isnan(cast(`{c}` as double))" for c in [*controls, truth]))
    head = whole.agg(
        F.count(F.lit(1)).alias("_n"), *[F.sum(F.coalesce(num(f), F.lit(0.0))).alias(f"_f{i}") for i, f in enumerate(flags)],
        *[F.avg(num(c)).alias(f"_c{i}") for i, c in enumerate(controls)],
    ).first()  # one row
    n, k = head["_n"], len(controls)
    tested = [f for i, f in enumerate(flags) if least <= (head[f"_f{i}"] or 0) <= n - least]
    if not tested:
        return df.sparkSession.createDataFrame([], "term string, premium double, se double, p double, n int")
    # the intercept and the centred controls, then the outcome; a flag's products with all of these and with itself
    base = [F.lit(1.0), *[num(c) - F.lit(head[f"_c{i}"]) for i, c in enumerate(controls)]]
    x = whole.select(cluster, *[c.alias(f"x{i}") for i, c in enumerate(base)], num(truth).alias("y"), *[F.coalesce(num(f), F.lit(0.0)).alias(f"d{i}") for i, f in enumerate(tested)])
    names = [f"x{i}" for i in range(k + 1)] + ["y"]
    sums = {f"{a}_{b}": F.col(a) * F.col(b) for i, a in enumerate(names[:-1]) for b in names[i:]}
    for i in range(len(tested)):
        sums |= {f"d{i}_{b}": F.col(f"d{i}") * F.col(b) for b in [*names, f"d{i}"]}
    g = cut_lineage(x.groupBy(cluster).agg(*[F.sum(v).alias(c) for c, v in sums.items()]))
    total = g.agg(*[F.sum(c).alias(c) for c in sums], F.count(F.lit(1)).alias("_g")).first()  # one row
    cell = lambda a, b: f"{a}_{b}" if f"{a}_{b}" in sums else f"{b}_{a}"
    fits, spread = [], []
    for i in range(len(tested)):
        cols = [f"d{i}", *names[:-1]]
        xx = np.array([[total[cell(a, b)] for b in cols] for a in cols], float)
        inv = np.linalg.pinv(xx)
        beta = inv @ np.array([total[cell(a, "y")] for a in cols], float)
        # a cluster's share of the flag's coefficient: its scores weighted by the flag's row of the inverse
        part = F.lit(0.0)
        for w, a in zip(inv[0], cols):
            score = F.col(cell(a, "y"))
            for b, v in zip(cols, beta):
                score = score - F.col(cell(a, b)) * F.lit(float(v))
            part = part + score * F.lit(float(w))
        fits.append(float(beta[0]))
        spread.append(F.sum(part * part).alias(f"v{i}"))
    var, clusters, width = g.agg(*spread).first(), total["_g"], k + 2  # one row
    scale = clusters / (clusters - 1) * (n - 1) / (n - width) if clusters > 1 and n > width else 1.0
    rows = []
    for i, f in enumerate(tested):
        se = math.sqrt(max(var[f"v{i}"] * scale, 0.0))
        p = student_p(fits[i] / se, clusters - 1) if se > 0 else float("nan")
        rows.append((f, math.exp(fits[i]) - 1, se, p, int(head[f"_f{list(flags).index(f)}"])))
    return df.sparkSession.createDataFrame(rows, "term string, premium double, se double, p double, n int")


def ridge_bootstrap(df: DataFrame, cluster: str, inputs: Sequence[str], truth: str, l2: float, replicates: int, seed: int = 7) -> pd.DataFrame:
    """``term, beta, lo, hi``: a joint ridge and its 95 % range over clusters drawn with replacement.

    The clusters' sums are additive, so a replicate is a weighted sum of them; the
    weights are Poisson(1) from a hash of replicate and cluster.
    """
    width = len(inputs) + 1
    sums = cluster_sums(df, cluster, inputs, truth).withColumn("c", F.xxhash64(F.lit(seed), cluster))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        xx, xy = np.zeros((replicates + 1, width * width)), np.zeros((replicates + 1, width))
        for b in batches:
            for c, a, v in zip(b["c"], b["xx"], b["xy"]):
                w = np.concatenate([[1], np.random.default_rng(int(c) & (2**63 - 1)).poisson(1, replicates)])
                xx += w[:, None] * np.asarray(a)
                xy += w[:, None] * np.asarray(v)
        yield pd.DataFrame({"r": np.arange(replicates + 1), "xx": list(xx), "xy": list(xy)})

    parts = sums.select("c", "xx", "xy").mapInPandas(work, "r int, xx array<double>, xy array<double>")
    tot = parts.groupBy("r").agg(F.array(*[F.sum(F.col("xx")[i]) for i in range(width * width)]).alias("xx"), F.array(*[F.sum(F.col("xy")[i]) for i in range(width)]).alias("xy"))
    penalty = l2 * np.eye(width)
    penalty[0, 0] = 0
    betas = {r["r"]: np.linalg.pinv(np.array(r["xx"]).reshape(width, width) + penalty) @ np.array(r["xy"]) for r in tot.collect()}  # a small matrix per replicate
    rest = np.array([betas[i] for i in range(1, replicates + 1)])
    lo, hi = np.quantile(rest, [0.025, 0.975], axis=0)
    return pd.DataFrame({"term": ["intercept", *inputs], "beta": betas[0], "lo": lo, "hi": hi})


def double_ml(df: DataFrame, ident: str, fold: str, k: int, treatment: str, truth: str, make) -> DataFrame:
    """``beta, se, n``: the effect of ``treatment`` after predicting it and the outcome from ``features``, each out of fold; ``ident`` is unique."""
    from plumbline.operators.learn import out_of_fold

    x = df
    y = out_of_fold(x.withColumn("label", F.col(truth).cast("double")), fold, k, make, [ident, "label"])
    d = out_of_fold(x.withColumn("label", F.col(treatment).cast("double")), fold, k, make, [ident, "label"])
    r = y.select(ident, (F.col("label") - F.col("prediction")).alias("ry")).join(d.select(ident, (F.col("label") - F.col("prediction")).alias("rd")), ident)
    s = r.agg(F.sum(F.col("ry") * F.col("rd")).alias("a"), F.sum(F.col("rd") * F.col("rd")).alias("b"), F.count(F.lit(1)).alias("n")).first()
    beta = s["a"] / s["b"] if s["b"] else float("nan")
    u = F.pow(F.col("rd") * (F.col("ry") - F.lit(beta) * F.col("rd")), 2)
    m = r.agg(F.sum(u)).first()[0]
    return df.sparkSession.createDataFrame([(beta, math.sqrt(m) / s["b"] if s["b"] else float("nan"), s["n"])], "beta double, se double, n bigint")


def inverse_weights(df: DataFrame, probability: str, observed: str, floor: float = 0.05) -> DataFrame:
    """``df`` with ``weight``: one over the clipped probability of being observed, 0 where not observed."""
    p = F.greatest(F.lit(floor), F.least(F.lit(1.0), F.col(probability)))
    return df.withColumn("weight", F.when(F.col(observed), 1 / p).otherwise(0.0))


def precision_summary(df: DataFrame, by: Sequence[str], label: str, gate: float) -> DataFrame:
    """``by.., n, strict, lenient, lo, hi, passes``: shares of ``correct``, and with ``acceptable``, a Wilson range and a gate on its lower end."""
    from plumbline.operators.stats import wilson

    low = F.lower(F.trim(label))
    n = df.filter(low != "").groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(low == "correct").alias("k"), F.count_if(low.isin("correct", "acceptable")).alias("l"))
    lo, hi = wilson(F.col("k"), F.col("n"))
    return n.select(*by, "n", (F.col("k") / F.col("n")).alias("strict"), (F.col("l") / F.col("n")).alias("lenient"), lo.alias("lo"), hi.alias("hi"), (lo >= gate).alias("passes"))
