"""Aggregate statistics as compositions of built-in aggregates and windows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.windows import prefix_sums, ranks
from plumbline.session import cut_lineage


def concentration(df: DataFrame, by: Sequence[str], member: str) -> DataFrame:
    """``by.., members, top, top_share, effective``: how a group spreads over its members; null and blank members don't count."""
    n = df.filter(F.trim(member) != "").groupBy(*by, member).agg(F.count(F.lit(1)).alias("n"))
    total = n.withColumn("total", F.sum("n").over(Window.partitionBy(*by)))
    return total.groupBy(*by).agg(
        F.count(F.lit(1)).alias("members"), F.max("n").alias("top"), (F.max("n") / F.max("total")).alias("top_share"),
        (1 / F.sum(F.pow(F.col("n") / F.col("total"), 2))).alias("effective"),
    )


def _counted(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """``by.., value, n, run_n, all_n``: the distinct values of each group with cumulative counts."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    return prefix_sums(counts, by, value, ["n"])


def lower_quantiles(df: DataFrame, by: Sequence[str], value: str, targets: Mapping[str, float]) -> DataFrame:
    """The value at index ``min(n - 1, int(q n))`` of each group's sorted values, from cumulative counts."""
    c = _counted(df, by, value)
    at = lambda q: F.least(F.col("all_n") - 1, F.floor(F.lit(q) * F.col("all_n")))
    return c.groupBy(*by).agg(
        F.max("all_n").alias("n"), *[F.min(F.when(F.col("run_n") > at(q), F.col(value))).alias(k) for k, q in targets.items()]
    )


def quantiles(df: DataFrame, by: Sequence[str], value: str, targets: Mapping[str, float]) -> DataFrame:
    """``by.., n`` and the interpolated quantiles, exact.

    ``percentile`` keeps all distinct values of a group in one task's memory; this
    reads them off cumulative counts, for groups of any size.
    """
    c = _counted(df, by, value)
    picks = []
    for k, q in targets.items():
        h = F.lit(q) * (F.col("all_n") - 1)
        for end, i in (("lo", F.floor(h)), ("hi", F.ceil(h))):
            picks.append(F.min(F.when(F.col("run_n") > i, F.col(value))).alias(f"_{end}_{k}"))
    g = c.groupBy(*by).agg(F.max("all_n").alias("n"), *picks)
    part = lambda q: F.lit(q) * (F.col("n") - 1) - F.floor(F.lit(q) * (F.col("n") - 1))
    return g.select(*by, "n", *[(F.col(f"_lo_{k}") + (F.col(f"_hi_{k}") - F.col(f"_lo_{k}")) * part(q)).alias(k) for k, q in targets.items()])


def higher_quantile(df: DataFrame, by: Sequence[str], value: str, q: float, out: str) -> DataFrame:
    """The value at index ``ceil(q (n - 1))``: the conformal choice."""
    c = _counted(df, by, value)
    at = F.ceil(F.lit(q) * (F.col("all_n") - 1) - 1e-9)
    return c.groupBy(*by).agg(F.max("all_n").alias("n"), F.min(F.when(F.col("run_n") > at, F.col(value))).alias(out))


def adjusted_skewness(c: str) -> Column:
    """Skewness with the bias correction of small samples."""
    n = F.count(c)
    return F.skewness(c) * F.sqrt(n * (n - 1)) / (n - 2)


def weighted_median(df: DataFrame, by: Sequence[str], value: str, weight: str) -> DataFrame:
    """``by.., median, ess``: the smallest value whose cumulative weight reaches half, and the effective sample size."""
    flat = df.groupBy(*by, value).agg(F.sum(weight).alias("w"), F.sum(F.pow(F.col(weight), 2)).alias("w2"))
    return prefix_sums(flat, by, value, ["w"]).groupBy(*by).agg(
        F.min(F.when(F.col("run_w") >= F.col("all_w") / 2, F.col(value))).alias("median"),
        (F.pow(F.sum("w"), 2) / F.sum("w2")).alias("ess"),
    )


def standardised_gap(df: DataFrame, stratum: str, flag: str, value: str) -> DataFrame:
    """``gap_pct``: the strata's gaps of medians between flagged and other rows, weighted by the other rows' mix."""
    rows = df.select(stratum, F.expr(flag).cast("boolean").alias("_f"), value).filter("_f is not null")
    mid = quantiles(rows, [stratum, "_f"], value, {"m": 0.5})
    n = rows.groupBy(stratum).agg(F.count_if(~F.col("_f")).alias("w"))
    m = mid.groupBy(stratum).agg(F.max(F.when(F.col("_f"), F.col("m"))).alias("a"), F.max(F.when(~F.col("_f"), F.col("m"))).alias("b"))
    m = m.join(n, stratum).filter("a is not null and b is not null and b <> 0")
    return m.agg((F.sum((F.col("a") / F.col("b") - 1) * 100 * F.col("w")) / F.sum("w")).alias("gap_pct"))


def oneway_r2(df: DataFrame, level: str, value: str) -> DataFrame:
    """``r2, adjusted``: the share of variance between the levels."""
    g = df.filter(F.col(value).isNotNull()).groupBy(level).agg(
        F.count(value).alias("n"), F.avg(value).alias("m"), F.var_pop(value).alias("v")
    )
    t = g.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"), F.sum(F.col("n") * F.col("m")).alias("s"),
              F.sum(F.col("n") * F.col("m") * F.col("m")).alias("q"), F.sum(F.col("n") * F.col("v")).alias("within"))
    between = F.col("q") - F.col("s") * F.col("s") / F.col("n")
    r2 = between / (between + F.col("within"))
    return t.select(r2.alias("r2"), (1 - (1 - r2) * (F.col("n") - 1) / (F.col("n") - F.col("k"))).alias("adjusted"))


def histogram(df: DataFrame, value: str, edges: Sequence[float]) -> DataFrame:
    """``bin, lo, hi, n``: right-open bins, the last one closed; values outside are ignored, empty bins stay."""
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(edges, edges[1:]))]
    bins = df.sparkSession.createDataFrame(rows, "bin int, lo double, hi double")
    at = F.when(F.col(value) == edges[-1], len(edges) - 2)
    for i, a, b in rows:
        at = at.when((F.col(value) >= a) & (F.col(value) < b), i)
    n = df.select(at.alias("bin")).filter("bin is not null").groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    return bins.join(n, "bin", "left").select("bin", "lo", "hi", F.coalesce("n", F.lit(0)).alias("n"))


def bands(c: Column, edges: Sequence[float], right_closed: bool) -> Column:
    """The band's index: ``(a, b]`` or ``[a, b)``; null outside."""
    out = None
    for i, (a, b) in enumerate(zip(edges, edges[1:])):
        inside = (c > a) & (c <= b) if right_closed else (c >= a) & (c < b)
        out = F.when(inside, i) if out is None else out.when(inside, i)
    return out


def frequency_tiers(df: DataFrame, member: str, shares: Sequence[float] = (0.01, 0.05)) -> DataFrame:
    """``member, n, tier``: 0 for the most frequent ``int(share members)`` and so on; ties by name."""
    n = df.filter(F.col(member).isNotNull()).groupBy(member).agg(F.count(F.lit(1)).alias("n"))
    r = ranks(n, [], [-F.col("n"), F.col(member)], "r")
    tier = F.lit(len(shares))
    for i, s in reversed(list(enumerate(shares))):
        tier = F.when(F.col("r") <= F.floor(F.lit(s) * F.col("all_r")), i).otherwise(tier)
    return r.select(member, "n", tier.alias("tier"))


def confusion(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """``truth, guess, n``."""
    return df.groupBy(F.col(truth).alias("truth"), F.col(guess).alias("guess")).agg(F.count(F.lit(1)).alias("n"))


def class_scores(cells: DataFrame) -> DataFrame:
    """``label, precision, recall, f1, support`` from a confusion table; undefined ratios are 0."""
    t = cells.groupBy(F.col("truth").alias("label")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("truth") == F.col("guess"), F.col("n")).otherwise(0)).alias("hit"))
    g = cells.groupBy(F.col("guess").alias("label")).agg(F.sum("n").alias("said"))
    j = t.join(g, "label", "full")
    hit, said, sup = (F.coalesce(c, F.lit(0)) for c in ("hit", "said", "support"))
    zero = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    p, r = zero(hit, said), zero(hit, sup)
    return j.select("label", p.alias("precision"), r.alias("recall"), zero(2 * p * r, p + r).alias("f1"), sup.alias("support"))


def _scored(df: DataFrame, positive: str, score: str) -> DataFrame:
    """``score, p, n``: positives and rows at each distinct score."""
    return df.groupBy(F.col(score).alias("score")).agg(F.sum(F.col(positive).cast("double")).alias("p"), F.count(F.lit(1)).cast("double").alias("n"))


def rank_auc(df: DataFrame, positive: str, score: str) -> DataFrame:
    """``auc`` from average ranks, over the distinct scores; null where one class is missing."""
    r = prefix_sums(_scored(df, positive, score), [], "score", ["n"]).withColumn("rank", F.col("run_n") - (F.col("n") - 1) / 2)
    t = r.agg(F.sum(F.col("rank") * F.col("p")).alias("u"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    return t.select(F.try_divide(F.col("u") - F.col("p") * (F.col("p") + 1) / 2, F.col("p") * (F.col("n") - F.col("p"))).alias("auc"))


def average_precision(df: DataFrame, positive: str, score: str) -> DataFrame:
    """``ap``: precision at each distinct score, weighted by the recall it adds."""
    r = prefix_sums(_scored(df, positive, score), [], "score", ["p", "n"], descending=True)
    return r.agg(F.sum(F.try_divide("p", "all_p") * F.col("run_p") / F.col("run_n")).alias("ap"))


def wilson(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """The Wilson interval of a proportion."""
    p = hits / n
    mid, half = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return (mid - half) / (1 + z * z / n), (mid + half) / (1 + z * z / n)


def benjamini_hochberg(df: DataFrame, p: str, q: float) -> DataFrame:
    """``df`` with ``selected``: the step-up choice at level ``q``; null p-values are never selected and don't count."""
    tested = df.filter(F.col(p).isNotNull())
    run = prefix_sums(tested.groupBy(p).agg(F.count(F.lit(1)).alias("c")), [], p, ["c"])
    cut = run.filter(F.col(p) <= F.lit(q) * F.col("run_c") / F.col("all_c")).agg(F.max(p).alias("cut")).first()[0]  # one number
    return df.withColumn("selected", F.coalesce(F.col(p) <= F.lit(cut), F.lit(False)) if cut is not None else F.lit(False))


def normalised_mutual_information(df: DataFrame, a: str, b: str) -> DataFrame:
    """``nmi`` with the arithmetic mean of the entropies; 1 where both labelings are constant."""
    joint = df.groupBy(a, b).agg(F.count(F.lit(1)).cast("double").alias("n"))
    j = joint.select("n", F.sum("n").over(Window.partitionBy(a)).alias("na"), F.sum("n").over(Window.partitionBy(b)).alias("nb"), F.sum("n").over(Window.partitionBy()).alias("t"))
    h = lambda m: -F.sum(F.col("n") / F.col("t") * F.log(F.col(m) / F.col("t")))
    e = j.agg(F.sum(F.col("n") / F.col("t") * F.log(F.col("n") * F.col("t") / (F.col("na") * F.col("nb")))).alias("mi"), h("na").alias("ha"), h("nb").alias("hb"))
    return e.select(F.when(F.col("ha") + F.col("hb") == 0, 1.0).otherwise(2 * F.col("mi") / (F.col("ha") + F.col("hb"))).alias("nmi"))


def percentile_rank(df: DataFrame, by: Sequence[str], value: str, out: str) -> DataFrame:
    """``df`` with the share of its group's values that are at most the row's; null values have none."""
    c = _counted(df, by, value)
    shares = c.select(*[F.col(b).alias(f"_b{i}") for i, b in enumerate(by)], F.col(value).alias("_v"), (F.col("run_n") / F.col("all_n")).alias(out))
    on = F.col(value) == F.col("_v")
    for i, b in enumerate(by):
        on = on & F.col(b).eqNullSafe(F.col(f"_b{i}"))
    return df.join(shares, on, "left").drop("_v", *[f"_b{i}" for i in range(len(by))])


def average_rank(df: DataFrame, by: Sequence[str], value: str, out: str) -> DataFrame:
    """``df`` with the average rank of ``value`` in its group; null values have none."""
    c = _counted(df, by, value)
    ranks = c.select(*[F.col(b).alias(f"_b{i}") for i, b in enumerate(by)], F.col(value).alias("_v"), (F.col("run_n") - (F.col("n") - 1) / 2).alias(out))
    on = F.col(value) == F.col("_v")
    for i, b in enumerate(by):
        on = on & F.col(b).eqNullSafe(F.col(f"_b{i}"))
    return df.join(ranks, on, "left").drop("_v", *[f"_b{i}" for i in range(len(by))])


def cooccurrence(pairs: DataFrame, doc: str, term: str, least: int) -> DataFrame:
    """``a, b, together, lift, jaccard`` for terms that share at least ``least`` documents, ``a < b``."""
    edge = cut_lineage(pairs.select(F.col(doc).alias("d"), F.col(term).alias("t")).distinct())  # matched once, read four times
    n = edge.select("d").distinct().count()  # one number
    single = edge.groupBy("t").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") >= least)
    kept = edge.join(single, "t", "left_semi")
    both = kept.alias("x").join(kept.alias("y"), F.expr("x.d = y.d and x.t < y.t")).groupBy(
        F.col("x.t").alias("a"), F.col("y.t").alias("b")
    ).agg(F.count(F.lit(1)).alias("together")).filter(F.col("together") >= least)
    ca, cb = single.select(F.col("t").alias("a"), F.col("c").alias("ca")), single.select(F.col("t").alias("b"), F.col("c").alias("cb"))
    return both.join(ca, "a").join(cb, "b").select(
        "a", "b", "together", (F.col("together") * F.lit(float(n)) / (F.col("ca") * F.col("cb"))).alias("lift"),
        (F.col("together") / (F.col("ca") + F.col("cb") - F.col("together"))).alias("jaccard"),
    )


def log_odds(counts: DataFrame, group: str, term: str, n: str, prior: float) -> DataFrame:
    """``group, term, z``: weighted log-odds of a term in a group against the others, with a Dirichlet prior of total ``prior``."""
    c = counts.groupBy(F.col(group).alias("g"), F.col(term).alias("t")).agg(F.sum(n).cast("double").alias("y"))
    total = c.agg(F.sum("y")).first()[0] or 0.0  # one number
    term_n = c.groupBy("t").agg(F.sum("y").alias("yt"))
    group_n = c.groupBy("g").agg(F.sum("y").alias("yg"))
    a = F.lit(prior) * F.col("yt") / F.lit(total)
    x = c.join(term_n, "t").join(group_n, "g")
    rest = F.col("yt") - F.col("y")
    odds = lambda y, m: F.log((y + a) / (m + F.lit(prior) - y - a))
    d = odds(F.col("y"), F.col("yg")) - odds(rest, F.lit(total) - F.col("yg"))
    return x.select(F.col("g").alias(group), F.col("t").alias(term), (d / F.sqrt(1 / (F.col("y") + a) + 1 / (rest + a))).alias("z"))


def tf_idf(tokens: DataFrame, doc: str, term: str) -> DataFrame:
    """``doc, term, w``: sublinear term frequency, smooth inverse document frequency, unit length."""
    tf = tokens.groupBy(doc, term).agg(F.count(F.lit(1)).alias("tf"))
    n = tf.select(doc).distinct().count()  # one number
    df = tf.groupBy(term).agg(F.count(F.lit(1)).alias("df"))
    raw = tf.join(df, term).withColumn("x", (1 + F.log("tf")) * (F.log((1 + F.lit(n)) / (1 + F.col("df"))) + 1))
    return raw.select(doc, term, (F.col("x") / F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy(doc)))).alias("w"))


def missing_profile(df: DataFrame) -> DataFrame:
    """``column, missing, share``: null, blank and empty-list values of each column, in one pass."""
    kinds = dict(df.dtypes)

    def gone(c: str) -> Column:
        test = F.col(f"`{c}`").isNull()
        if kinds[c] == "string":
            test = test | (F.trim(f"`{c}`") == "")
        elif kinds[c].startswith("array"):
            test = test | (F.size(f"`{c}`") == 0)
        return F.count_if(test).alias(c)

    one = df.agg(F.count(F.lit(1)).alias("_n"), *[gone(c) for c in df.columns])
    parts = ", ".join(f"'{c}', `{c}`" for c in df.columns)
    return one.selectExpr("_n", f"stack({len(df.columns)}, {parts}) as (column, missing)").select(
        "column", "missing", F.coalesce(F.try_divide("missing", "_n"), F.lit(0.0)).alias("share")
    )
