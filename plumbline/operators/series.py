"""Time series in long form ``(by.., t, v)``: rescaling, trends, tests, forecasts, backtests, causal comparisons.

``t`` may be any orderable column; each series is one group. Aggregates and windows
do what they can; what has a recursion runs per series in ``applyInPandas``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.windows import ends, prefix_sums


def rescale(df: DataFrame, batch: str, t: str, name: str, value: str, anchor: str) -> DataFrame:
    """``t, name, value`` with every batch scaled to the first by the means of their common ``anchor``; of a series in several batches the first wins."""
    means = df.filter(F.col(name) == anchor).groupBy(batch).agg(F.avg(value).alias("m"))
    ref = means.agg(F.min_by("m", batch).alias("ref"))
    factor = means.join(F.broadcast(ref)).select(batch, F.try_divide("ref", "m").alias("f"))  # one row
    first = Window.partitionBy(name)
    x = df.join(factor, batch).withColumn("_b", F.min(batch).over(first)).filter(F.col(batch) == F.col("_b"))
    return x.select(t, name, (F.col(value) * F.col("f")).alias(value))


def trend_class(df: DataFrame, by: Sequence[str], t: str, value: str, size: int, pct: float = 10.0, robust: bool = True, low: float | None = None) -> DataFrame:
    """``by.., slope, pct_change, class, low_volume``: the change from the first to the last ``size`` rows, by medians or means.

    A series that starts at 0 has no change. ``low_volume``: its level is under ``low``.
    """
    w = Window.partitionBy(*by)
    i = df.withColumn("_i", F.row_number().over(w.orderBy(t)) - 1)
    slope = i.groupBy(*by).agg(F.regr_slope(F.col(value), F.col("_i").cast("double")).alias("slope"), F.percentile(value, 0.5).alias("_m"))
    if robust:
        e = ends(df, by, t, value, size)
    else:
        z = i.withColumn("_z", F.row_number().over(w.orderBy(F.col(t).desc())))
        e = z.groupBy(*by).agg(
            F.avg(F.when(F.col("_i") < size, F.col(value))).alias("head"), F.avg(F.when(F.col("_z") <= size, F.col(value))).alias("tail"), F.count(F.lit(1)).alias("n")
        )
    change = F.when(F.col("head") == 0, 0.0).otherwise((F.col("tail") / F.col("head") - 1) * 100)
    label = F.when(F.col("pct_change") >= pct, "rising").when(F.col("pct_change") <= -pct, "declining").otherwise("stable")
    return e.withColumn("pct_change", change).join(slope, list(by)).select(
        *by, "slope", "pct_change", label.alias("class"), (F.col("_m") < F.lit(low if low is not None else -1e300)).alias("low_volume")
    )


def sensitivity(trends: DataFrame, by: Sequence[str], pcts: Sequence[float]) -> DataFrame:
    """``by.., classes, stable``: how many classes a series gets under several thresholds."""
    p = F.explode(F.array(*[F.lit(float(x)) for x in pcts]))
    x = trends.select(*by, "pct_change", p.alias("p"))
    c = F.when(F.col("pct_change") >= F.col("p"), "rising").when(F.col("pct_change") <= -F.col("p"), "declining").otherwise("stable")
    return x.groupBy(*by).agg(F.countDistinct(c).alias("classes")).withColumn("stable", F.col("classes") == 1)


def pairwise_agreement(df: DataFrame, series: str, t: str, value: str) -> DataFrame:
    """``a, b, r, ratio``: correlation and ratio of means of each pair of series over their common times."""
    x, y = df.alias("x"), df.alias("y")
    j = x.join(y, (F.col(f"x.{t}") == F.col(f"y.{t}")) & (F.col(f"x.{series}") < F.col(f"y.{series}")))
    return j.groupBy(F.col(f"x.{series}").alias("a"), F.col(f"y.{series}").alias("b")).agg(
        F.corr(f"x.{value}", f"y.{value}").alias("r"), F.try_divide(F.avg(f"x.{value}"), F.avg(f"y.{value}")).alias("ratio")
    )


def normal_sf(z: float) -> float:
    """The upper tail of the standard normal distribution."""
    return 0.5 * math.erfc(z / math.sqrt(2))


def mann_kendall(df: DataFrame, by: Sequence[str], t: str, value: str, alpha: float = 0.05) -> DataFrame:
    """``by.., s, sen_slope, z, p, confirmed``: the trend test with the variance corrected for autocorrelated ranks, and the median of pairwise slopes."""

    def test(pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf.sort_values(t)[value].to_numpy(float)
        n = len(v)
        if n < 4:
            return pd.DataFrame()
        s, slopes = 0, []
        for i in range(n - 1):  # a row of the pair matrix at a time
            d = v[i + 1 :] - v[i]
            s += int(np.sign(d).sum())
            slopes.append(d / np.arange(1, n - i))
        sen = float(np.median(np.concatenate(slopes)))
        _, ties = np.unique(v, return_counts=True)
        var = (n * (n - 1) * (2 * n + 5) - (ties * (ties - 1) * (2 * ties + 5)).sum()) / 18
        flat = v - sen * np.arange(1, n + 1)
        r = pd.Series(flat).rank().to_numpy()
        r = r - r.mean()
        acf = np.array([(r[k:] * r[: n - k]).sum() / (r * r).sum() if (r * r).sum() else 0.0 for k in range(1, n)])
        keep = np.abs(acf) > 1.96 / math.sqrt(n)
        k = np.arange(1, n)
        corr = 1 + 2 / (n * (n - 1) * (n - 2)) * ((n - k) * (n - k - 1) * (n - k - 2) * acf * keep).sum()
        var *= max(corr, 1e-9)
        z = (s - np.sign(s)) / math.sqrt(var) if var > 0 else 0.0
        p = 2 * normal_sf(abs(z))
        row = {c: pdf[c].iloc[0] for c in by} | {"s": s, "sen_slope": sen, "z": float(z), "p": p, "confirmed": p < alpha}
        return pd.DataFrame([row])

    kinds = dict(df.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in by) + ", s bigint, sen_slope double, z double, p double, confirmed boolean"
    return df.groupBy(*by).applyInPandas(test, schema)


def minimise(f, start: Sequence[float], step: float = 0.2, rounds: int = 120) -> np.ndarray:
    """Where ``f`` is smallest near ``start``, by a simplex that reflects, stretches and shrinks."""
    points = [np.array(start, float)] + [np.array(start, float) + step * e for e in np.eye(len(start))]
    worth = [f(p) for p in points]
    for _ in range(rounds):
        by = np.argsort(worth)
        points, worth = [points[i] for i in by], [worth[i] for i in by]
        if worth[-1] - worth[0] <= 1e-10 * (abs(worth[0]) + 1e-10) and np.ptp(points, axis=0).max() < 1e-6:
            break
        mid = np.mean(points[:-1], axis=0)
        tries = {r: mid + r * (mid - points[-1]) for r in (1.0, 2.0, -0.5)}
        far = f(tries[1.0])
        if far < worth[0] and (farther := f(tries[2.0])) < far:
            points[-1], worth[-1] = tries[2.0], farther
        elif far < worth[-2]:
            points[-1], worth[-1] = tries[1.0], far
        elif (near := f(tries[-0.5])) < worth[-1]:
            points[-1], worth[-1] = tries[-0.5], near
        else:
            points = [points[0]] + [(p + points[0]) / 2 for p in points[1:]]
            worth = [worth[0]] + [f(p) for p in points[1:]]
    return points[int(np.argmin(worth))]


def _within(x: float, low: float = 1e-4, high: float = 1 - 1e-4) -> float:
    return min(high, max(low, x))


def _ses(v: np.ndarray) -> float:
    """The last level of simple exponential smoothing; its weight has the least squared one-step error."""

    def run(a: float) -> tuple[float, float]:
        x, err = v[0], 0.0
        for y in v[1:]:
            err += (y - x) ** 2
            x += a * (y - x)
        return err, x

    low, high, ratio = 1e-4, 1 - 1e-4, (math.sqrt(5) - 1) / 2
    a, b = high - ratio * (high - low), low + ratio * (high - low)
    fa, fb = run(a)[0], run(b)[0]
    while high - low > 1e-5:  # golden section
        if fa <= fb:
            high, b, fb = b, a, fa
            a = high - ratio * (high - low)
            fa = run(a)[0]
        else:
            low, a, fa = a, b, fb
            b = low + ratio * (high - low)
            fb = run(b)[0]
    return float(run((low + high) / 2)[1])


def _holt_winters(v: np.ndarray, h: int, season: int) -> np.ndarray:
    """Additive trend and season; the three weights have the least squared one-step error."""
    if len(v) < 2 * season:
        return np.full(h, v[-1])
    base = v[: 2 * season].reshape(2, season)
    start = base[0].mean(), (base[1].mean() - base[0].mean()) / season, list(base.mean(axis=0) - base.mean(axis=1).mean())

    def run(w) -> tuple[float, np.ndarray]:
        a, b, g = (_within(x) for x in w)
        (level, slope, s), err = (start[0], start[1], list(start[2])), 0.0
        for i, y in enumerate(v.tolist()):
            k = i % season
            err += (y - level - slope - s[k]) ** 2
            old = level
            level = a * (y - s[k]) + (1 - a) * (level + slope)
            slope = b * (level - old) + (1 - b) * slope
            s[k] = g * (y - level) + (1 - g) * s[k]
        return err, np.array([level + (k + 1) * slope + s[(len(v) + k) % season] for k in range(h)])

    return run(minimise(lambda w: run(w)[0], (0.3, 0.05, 0.1), rounds=60))[1]


def arma(d: np.ndarray) -> tuple[float, float, float]:
    """``phi, theta`` of an ARMA(1,1) by conditional least squares, and the last shock."""
    d = [float(x) for x in d]

    def run(w) -> tuple[float, float]:
        phi, theta = (_within(x, -0.99, 0.99) for x in w)
        e = err = 0.0
        for i in range(1, len(d)):
            e = d[i] - phi * d[i - 1] - theta * e
            err += e * e
        return err, e

    first = min(((p, t) for p in (-0.5, 0.0, 0.5) for t in (-0.5, 0.0, 0.5)), key=lambda w: run(w)[0])
    best = minimise(lambda w: run(w)[0], first, rounds=80)
    return _within(best[0], -0.99, 0.99), _within(best[1], -0.99, 0.99), run(best)[1]


def _arima111(v: np.ndarray, h: int) -> np.ndarray:
    """ARIMA(1,1,1)."""
    d = np.diff(v)
    if len(d) < 4:
        return np.full(h, v[-1])
    phi, theta, e = arma(d)
    step, level, out = phi * d[-1] + theta * e, v[-1], []
    for _ in range(h):
        level += step
        out.append(level)
        step *= phi
    return np.array(out)


METHODS = ("naive", "ses", "arima", "holt_winters")


def forecasts(v: np.ndarray, h: int, season: int) -> dict[str, np.ndarray]:
    """The next ``h`` values by each method."""
    return {"naive": np.full(h, v[-1]), "ses": np.full(h, _ses(v)), "arima": _arima111(v, h), "holt_winters": _holt_winters(v, h, season)}


def backtest(df: DataFrame, by: Sequence[str], t: str, value: str, first: int, horizon: int, every: int, season: int) -> DataFrame:
    """``by.., origin, target, method, h, forecast, actual, scale``: forecasts from expanding windows.

    An origin is the number of rows before it; ``target`` the row it forecasts; ``scale``
    the mean absolute step before the origin, for scaled errors.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf.sort_values(t)[value].to_numpy(float)
        rows = []
        for o in range(first, len(v) - horizon + 1, every):
            scale = float(np.abs(np.diff(v[:o])).mean())
            for m, f in forecasts(v[:o], horizon, season).items():
                rows += [(o, o + k, m, k + 1, float(f[k]), float(v[o + k]), scale) for k in range(horizon)]
        out = pd.DataFrame(rows, columns=["origin", "target", "method", "h", "forecast", "actual", "scale"])
        for c in reversed(by):
            out.insert(0, c, pdf[c].iloc[0])
        return out

    kinds = dict(df.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in by) + ", origin int, target int, method string, h int, forecast double, actual double, scale double"
    return df.groupBy(*by).applyInPandas(run, schema)


def forecast_errors(bt: DataFrame, by: Sequence[str]) -> DataFrame:
    """``by.., method, mape, smape, mase`` of a :func:`backtest`."""
    e, f, a = F.abs(F.col("actual") - F.col("forecast")), F.col("forecast"), F.col("actual")
    return bt.groupBy(*by, "method").agg(
        (F.avg(F.try_divide(e, F.abs(a))) * 100).alias("mape"), (F.avg(F.try_divide(2 * e, F.abs(a) + F.abs(f))) * 100).alias("smape"),
        F.avg(F.try_divide(e, F.col("scale"))).alias("mase"),
    )


def beats(errors: DataFrame, by: Sequence[str], metric: str, base: str = "naive") -> DataFrame:
    """``method, share, mean_gain``: in how many groups a method's error is under the base's."""
    b = errors.filter(F.col("method") == base).select(*by, F.col(metric).alias("b"))
    j = errors.filter(F.col("method") != base).join(b, list(by))
    return j.groupBy("method").agg(F.avg((F.col(metric) < F.col("b")).cast("double")).alias("share"), F.avg(F.col("b") - F.col(metric)).alias("mean_gain"))


def signed_rank(df: DataFrame, a: str, b: str) -> DataFrame:
    """``n, w, z, p``: the signed-rank test of two columns, zero differences left out, normal approximation.

    Ranks are found over the distinct absolute differences.
    """
    d = df.select((F.col(a) - F.col(b)).alias("d")).filter("d <> 0")
    g = d.groupBy(F.abs("d").alias("x")).agg(F.count(F.lit(1)).alias("c"), F.count_if(F.col("d") > 0).alias("up"))
    r = prefix_sums(g, [], "x", ["c"]).withColumn("rank", F.col("run_c") - (F.col("c") - 1) / 2)
    s = r.agg(F.sum("c").alias("n"), F.sum(F.col("rank") * F.col("up")).alias("w"), F.sum(F.pow("c", F.lit(3)) - F.col("c")).alias("ties"))
    n = F.col("n").cast("double")
    var = n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48
    z = s.withColumn("z", F.try_divide(F.col("w") - n * (n + 1) / 4, F.sqrt(var)))
    tail = F.udf(lambda x: None if x is None else 2 * normal_sf(abs(x)), "double")  # one row
    return z.select("n", "w", "z", tail("z").alias("p"))


def decompose(df: DataFrame, by: Sequence[str], t: str, value: str, season: int) -> DataFrame:
    """``by.., t, trend, seasonal, rest``: centred moving average, then the mean of each phase."""
    w = Window.partitionBy(*by).orderBy(t)
    half = season // 2
    x = df.withColumn("_i", F.row_number().over(w) - 1)
    wide, n = w.rowsBetween(-half, half), F.count(F.lit(1)).over(w.rowsBetween(-half, half))
    if season % 2:
        trend = F.sum(value).over(wide) / season
    else:
        trend = (F.sum(value).over(w.rowsBetween(-half, half - 1)) + F.sum(value).over(w.rowsBetween(1 - half, half))) / (2 * season)
    x = x.withColumn("trend", F.when(n == 2 * half + 1, trend)).withColumn("_p", F.col("_i") % season)
    phase = F.avg(F.col(value) - F.col("trend")).over(Window.partitionBy(*by, "_p"))
    x = x.withColumn("_s", phase)
    x = x.withColumn("seasonal", F.col("_s") - F.avg("_s").over(Window.partitionBy(*by)))
    return x.select(*by, t, value, "trend", "seasonal", (F.col(value) - F.col("trend") - F.col("seasonal")).alias("rest"))


def loess(x: np.ndarray, y: np.ndarray, at: np.ndarray, window: int, weights: np.ndarray) -> np.ndarray:
    """Locally weighted straight lines through the ``window`` nearest points, tricube weights times ``weights``."""
    d = np.abs(at[:, None] - x[None, :])
    q = min(window, len(x))
    reach = np.sort(d, axis=1)[:, q - 1] * max(1.0, window / len(x))
    w = np.clip(1 - (d / np.maximum(reach, 1e-12)[:, None]) ** 3, 0, None) ** 3 * weights[None, :]
    total = np.maximum(w.sum(1), 1e-12)
    mx, my = (w * x).sum(1) / total, (w * y).sum(1) / total
    dx = x[None, :] - mx[:, None]
    var = (w * dx * dx).sum(1)
    slope = np.where(var > 1e-12, (w * dx * (y[None, :] - my[:, None])).sum(1) / np.maximum(var, 1e-12), 0.0)
    return my + slope * (at - mx)


def _stl(v: np.ndarray, season: int, seasonal: int, robust: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, t = len(v), np.arange(len(v), dtype=float)
    wide = int(np.ceil(1.5 * season / (1 - 1.5 / seasonal))) | 1
    low = season + 1 if season % 2 == 0 else season
    trend, cycle, rho = np.zeros(n), np.zeros(n), np.ones(n)
    mean = lambda a, k: np.convolve(a, np.ones(k) / k, "valid")
    for _ in range(15 if robust else 1):
        for _ in range(2 if robust else 5):
            flat, long = v - trend, np.zeros(n + 2 * season)
            for phase in range(season):
                own = np.arange(phase, n, season)
                k = np.arange(len(own), dtype=float)
                long[phase::season][: len(own) + 2] = loess(k, flat[own], np.arange(-1, len(own) + 1, dtype=float), seasonal, rho[own])
            smooth = mean(mean(mean(long, season), season), 3)
            cycle = long[season : season + n] - loess(t, smooth, t, low, np.ones(n))
            trend = loess(t, v - cycle, t, wide, rho)
        rest = np.abs(v - trend - cycle)
        bound = 6 * np.median(rest)
        if not robust or bound <= 0:
            break
        rho = np.clip(1 - (rest / bound) ** 2, 0, None) ** 2
    return trend, cycle, v - trend - cycle


def stl(df: DataFrame, by: Sequence[str], t: str, value: str, season: int, seasonal: int = 7, robust: bool = True) -> DataFrame:
    """``by.., t, trend, seasonal, rest``: seasonal and trend decomposition by LOESS, robust against outliers.

    Series of fewer than two seasons, or with a gap in their values, give no rows. A
    series is one group; series are short, and their number scales.
    """
    kinds = dict(df.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(t)
        v = pdf[value].to_numpy(float)
        out = pdf[[*by, t, value]].assign(trend=np.nan, seasonal=np.nan, rest=np.nan)
        if len(v) < 2 * season or np.isnan(v).any():
            return out.iloc[:0]
        out["trend"], out["seasonal"], out["rest"] = _stl(v, season, seasonal, robust)
        return out

    names = [*by, t, value]
    return df.select(*names).groupBy(*by).applyInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in names) + ", trend double, seasonal double, rest double")


def strengths(parts: DataFrame, by: Sequence[str]) -> DataFrame:
    """``by.., trend_strength, seasonal_strength`` of a :func:`decompose`."""
    ok = parts.filter("rest is not null")
    s = lambda c: F.greatest(F.lit(0.0), 1 - F.try_divide(F.var_pop("rest"), F.var_pop(F.col(c) + F.col("rest"))))
    return ok.groupBy(*by).agg(s("trend").alias("trend_strength"), s("seasonal").alias("seasonal_strength"))


def interrupted(df: DataFrame, by: Sequence[str], t: str, value: str, event: object, lags: int = 8) -> DataFrame:
    """``by.., level, slope, level_se, slope_se``: change of level and slope at ``event``, with errors that allow for autocorrelation."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(t)
        y = pdf[value].to_numpy(float)
        n = len(y)
        i, after = np.arange(n, dtype=float), (pdf[t] >= event).to_numpy(float)
        if n < 6 or not 0 < after.sum() < n:
            return pd.DataFrame()
        x = np.column_stack([np.ones(n), i, after, after * (i - (n - after.sum()))])
        inv = np.linalg.pinv(x.T @ x)
        beta = inv @ x.T @ y
        u = (y - x @ beta)[:, None] * x
        meat = u.T @ u
        for k in range(1, min(lags, n - 1) + 1):
            c = u[k:].T @ u[:-k]
            meat += (1 - k / (lags + 1)) * (c + c.T)
        se = np.sqrt(np.maximum(np.diag(inv @ meat @ inv), 0))
        row = {c: pdf[c].iloc[0] for c in by} | {"level": beta[2], "slope": beta[3], "level_se": se[2], "slope_se": se[3]}
        return pd.DataFrame([row])

    kinds = dict(df.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in by) + ", level double, slope double, level_se double, slope_se double"
    return df.groupBy(*by).applyInPandas(fit, schema)


def changes(df: DataFrame, unit: str, t: str, value: str, event: Column) -> DataFrame:
    """``unit, change``: the mean after ``event`` minus the mean before."""
    return df.groupBy(unit).agg((F.avg(F.when(F.col(t) >= event, F.col(value))) - F.avg(F.when(F.col(t) < event, F.col(value)))).alias("change"))


def difference_in_differences(change: DataFrame, unit: str, treated: Sequence[object]) -> DataFrame:
    """``did``: the treated units' mean change minus the others'."""
    inside = F.col(unit).isin(list(treated))
    return change.agg((F.avg(F.when(inside, F.col("change"))) - F.avg(F.when(~inside, F.col("change")))).alias("did"))


def randomisation(change: DataFrame, unit: str, assignments: DataFrame) -> DataFrame:
    """``subset, did`` for every assignment ``(subset, name)`` of treated units."""
    every = Window.partitionBy(F.lit(0))  # the units are few
    c = change.select(F.col(unit), "change", F.sum("change").over(every).alias("s"), F.count("change").over(every).alias("n"))
    t = assignments.join(c, F.col("name") == F.col(unit)).groupBy("subset").agg(
        F.sum("change").alias("a"), F.count("change").alias("k"), F.max("s").alias("s"), F.max("n").alias("n")
    )
    return t.select("subset", (F.col("a") / F.col("k") - (F.col("s") - F.col("a")) / (F.col("n") - F.col("k"))).alias("did"))


def conformal_intervals(bt: DataFrame, by: Sequence[str], alpha: float, least: int) -> DataFrame:
    """``bt`` with ``lo, hi, inside``: the band of past absolute errors of the same method and horizon, known by each origin.

    An error is known once its target lies before the origin. The quantile is the
    ``ceil((n + 1)(1 - alpha))``-th smallest; fewer than ``least`` errors give no band.
    """
    e = bt.select(*[F.col(c).alias(f"e_{c}") for c in by], F.col("method").alias("e_m"), F.col("h").alias("e_h"), F.col("target").alias("e_t"), F.abs(F.col("actual") - F.col("forecast")).alias("e"))
    on = (F.col("method") == F.col("e_m")) & (F.col("h") == F.col("e_h")) & (F.col("e_t") < F.col("origin"))
    for c in by:
        on = on & (F.col(c) == F.col(f"e_{c}"))
    keys = [*by, "method", "h", "origin"]
    known = bt.select(*keys).distinct().join(e, on).groupBy(*keys).agg(F.array_sort(F.collect_list("e")).alias("es"))
    n = F.size("es")
    rank = F.least(n, F.ceil((n + 1) * F.lit(1 - alpha) - 1e-9).cast("int"))
    q = known.filter(n >= least).select(*keys, F.element_at("es", rank).alias("q"))
    out = bt.join(q, keys, "left").withColumn("lo", F.col("forecast") - F.col("q")).withColumn("hi", F.col("forecast") + F.col("q"))
    return out.withColumn("inside", (F.col("actual") >= F.col("lo")) & (F.col("actual") <= F.col("hi"))).drop("q")
