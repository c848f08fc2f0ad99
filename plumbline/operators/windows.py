"""Ordered rows: moving windows, breaks, autocorrelation, samples, splits, folds."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.session import cut_lineage, shuffle_width


def prefix_sums(df: DataFrame, by: Sequence[str], order: str, columns: Sequence[str], descending: bool = False) -> DataFrame:
    """``df`` with ``run_<c>``, the sum of ``c`` over the group's rows up to this one, and ``all_<c>``, over all its rows.

    Rows are range-partitioned by group and ``order``; each partition's running sums get
    the totals of the group's earlier partitions. No group, however large, meets one
    task. Values of ``order`` are distinct within a group: aggregate before.
    """
    key = F.col(order).desc() if descending else F.col(order)
    parts = cut_lineage(
        df.repartitionByRange(shuffle_width(df.sparkSession), *by, key).withColumn("_ps_part", F.spark_partition_id())
    )
    chunk = Window.partitionBy(*by, "_ps_part").orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    sums = parts.groupBy(*by, "_ps_part").agg(*[F.sum(c).alias(f"_ps_s_{c}") for c in columns])
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))  # a row for each partition
    before = group.orderBy("_ps_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        *[F.col(c).alias(f"_ps_k_{c}") for c in by], F.col("_ps_part").alias("_ps_q"),
        *[F.coalesce(F.sum(f"_ps_s_{c}").over(before), F.lit(0)).alias(f"_ps_o_{c}") for c in columns],
        *[F.sum(f"_ps_s_{c}").over(group).alias(f"all_{c}") for c in columns],
    )
    on = F.col("_ps_part") == F.col("_ps_q")
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"_ps_k_{c}"))
    runs = parts.select("*", *[F.sum(c).over(chunk).alias(f"_ps_r_{c}") for c in columns]).join(offsets, on)
    return runs.select(*df.columns, *[(F.col(f"_ps_r_{c}") + F.col(f"_ps_o_{c}")).alias(f"run_{c}") for c in columns], *[f"all_{c}" for c in columns])


def trailing_mean(by: Sequence[str], order: str, value: str, size: int) -> Column:
    """The mean of the last ``size`` rows, fewer at the start."""
    return F.avg(value).over(Window.partitionBy(*by).orderBy(order).rowsBetween(1 - size, 0))


def ends(df: DataFrame, by: Sequence[str], order: str, value: str, size: int) -> DataFrame:
    """``by.., head, tail, n``: medians of the first and last ``size`` rows."""
    w = Window.partitionBy(*by)
    x = df.withColumn("_a", F.row_number().over(w.orderBy(order))).withColumn("_z", F.row_number().over(w.orderBy(F.col(order).desc())))
    med = lambda c: F.expr(f"percentile({value}, 0.5) filter (where {c} <= {size})")
    return x.groupBy(*by).agg(med("_a").alias("head"), med("_z").alias("tail"), F.count(F.lit(1)).alias("n"))


def best_break(df: DataFrame, by: Sequence[str], order: str, value: str, margin: int) -> DataFrame:
    """``by.., k, sse``: the split into two levels with the least squared error, at least ``margin`` rows on each side."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    a = Window.partitionBy(*by)
    x = df.select(
        *by, F.row_number().over(Window.partitionBy(*by).orderBy(order)).alias("k"), F.count(F.lit(1)).over(a).alias("n"),
        F.sum(value).over(w).alias("s"), F.sum(F.col(value) * F.col(value)).over(w).alias("q"),
        F.sum(value).over(a).alias("st"), F.sum(F.col(value) * F.col(value)).over(a).alias("qt"),
    ).filter((F.col("k") >= margin) & (F.col("n") - F.col("k") >= margin))
    sse = F.col("q") - F.col("s") * F.col("s") / F.col("k") + (F.col("qt") - F.col("q")) - F.pow(F.col("st") - F.col("s"), 2) / (F.col("n") - F.col("k"))
    x = x.withColumn("sse", F.round(sse, 4))
    return x.groupBy(*by).agg(F.min(F.struct("sse", "k")).alias("m")).select(*by, "m.k", "m.sse")


def autocorrelation(df: DataFrame, by: Sequence[str], order: str, value: str, lags: int) -> DataFrame:
    """``by.., lag, acf`` for lags 1 to ``lags``."""
    w = Window.partitionBy(*by)
    x = df.select(*by, order, (F.col(value) - F.avg(value).over(w)).alias("v"), F.count(F.lit(1)).over(w).alias("n"))
    o = Window.partitionBy(*by).orderBy(order)
    sums = [F.sum(F.col("v") * F.col(f"v{k}")).alias(f"c{k}") for k in range(1, lags + 1)]
    shifted = x.select(*by, "v", *[F.lag("v", k).over(o).alias(f"v{k}") for k in range(1, lags + 1)])
    g = shifted.groupBy(*by).agg(F.sum(F.col("v") * F.col("v")).alias("c0"), *sums)
    rows = F.array(*[F.struct(F.lit(k).alias("lag"), F.try_divide(f"c{k}", "c0").alias("acf")) for k in range(1, lags + 1)])
    return g.select(*by, F.inline(rows)).filter("acf is not null")


def partial_autocorrelation(acf: DataFrame, by: Sequence[str]) -> DataFrame:
    """``by.., lag, pacf`` from :func:`autocorrelation`, by Durbin and Levinson."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("lag")
        r = np.concatenate([[1.0], pdf["acf"].to_numpy()])
        phi, out = np.zeros(0), []
        for k in range(1, len(r)):
            below = 1 - phi @ r[1:k]
            a = (r[k] - phi @ r[k - 1 : 0 : -1]) / below if below else 0.0
            phi = np.concatenate([phi - a * phi[::-1], [a]])
            out.append(a)
        return pdf.drop(columns="acf").assign(pacf=out)

    schema = ", ".join(f"{c} {t}" for c, t in acf.dtypes if c != "acf") + ", pacf double"
    return acf.groupBy(*by).applyInPandas(solve, schema) if by else acf.groupBy().applyInPandas(solve, schema)


def ranks(df: DataFrame, by: Sequence[str], order: Sequence[Column], out: str) -> DataFrame:
    """``df`` with ``out``, each row's place in its group from 1 on, and ``all_<out>``, the group's rows.

    By prefix sums over range partitions: a group of any size is ranked by many tasks.
    ``order`` must tell the rows of a group apart.
    """
    ordered = df.withColumns({out: F.lit(1).cast("bigint"), f"_by_{out}": F.struct(*order)})
    r = prefix_sums(ordered, by, f"_by_{out}", [out])
    return r.select(*df.columns, F.col(f"run_{out}").alias(out), f"all_{out}")


def stratified_shuffle(df: DataFrame, stratum: Sequence[str], ident: str, value: str, seed: int, out: str) -> DataFrame:
    """``df`` with ``value`` permuted within each stratum, by a seeded hash of the id."""
    a = ranks(df, stratum, [F.col(ident)], "_p").drop("all__p")
    keys = df.select(*[F.col(s).alias(f"_{s}") for s in stratum], F.col(ident).alias("_id"), F.col(value).alias(out))
    b = ranks(keys, [f"_{s}" for s in stratum], [F.xxhash64(F.lit(seed), F.col("_id")), F.col("_id")], "_q").drop("all__q", "_id")
    on = F.col("_p") == F.col("_q")
    for s in stratum:
        on = on & F.col(s).eqNullSafe(F.col(f"_{s}"))
    return a.join(b, on).drop("_p", "_q", *[f"_{s}" for s in stratum])


def hashed_sample(df: DataFrame, stratum: Sequence[str], ident: str, n: int, seed: int) -> DataFrame:
    """``n`` rows of each stratum, the same ones at every run: a sampling operator. Each task keeps its ``n`` best before the shuffle."""
    w = Window.partitionBy(*stratum).orderBy(F.xxhash64(F.lit(seed), *stratum, F.col(ident)), ident)
    return df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")


def group_split(df: DataFrame, group: str, share: float, seed: int, out: str = "held_out") -> DataFrame:
    """``df`` with whether its group is held out: about ``share`` of the groups, never a part of one. A null group is a group."""
    return df.withColumn(out, F.pmod(F.xxhash64(F.lit(seed), F.col(group)), F.lit(10_000)) < int(share * 10_000))


def fold_plan(sizes: Sequence[tuple[int, int]], k: int) -> list[tuple[int, int, list[int]]]:
    """``(size, start, folds)``: groups of ``size`` from rank ``start`` on go to ``folds`` in turn.

    ``sizes`` has each size of group with its number of groups. The largest groups come
    first and always go to the emptiest folds; groups of one size are dealt out at once,
    so the work follows the number of different sizes.
    """
    load, plan = [0] * k, []
    for size, left in sorted(sizes, reverse=True):
        start = 0
        while left:
            order = sorted(range(k), key=lambda j: (load[j], j))
            low = [j for j in order if load[j] < load[order[0]] + size]
            above = [load[j] for j in order if j not in low]
            rounds = max(1, (min(above) - load[low[-1]]) // size) if above else left
            rounds = min(rounds, left // len(low))
            if not rounds:
                low, rounds = low[:left], 1
            plan.append((size, start, low))
            for j in low:
                load[j] += rounds * size
            start += rounds * len(low)
            left -= rounds * len(low)
    return plan


def group_folds(df: DataFrame, group: str, k: int) -> DataFrame:
    """``group, fold``: folds of nearly equal size that split no group, the largest groups placed first.

    What reaches the driver is the number of groups of each size: a table of ``n`` rows
    has fewer than ``sqrt(2 n)`` different sizes.
    """
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    plan = fold_plan([(r["n"], r["c"]) for r in sizes.groupBy("n").agg(F.count(F.lit(1)).alias("c")).collect()], k)
    steps = df.sparkSession.createDataFrame(plan, "n bigint, start bigint, folds array<int>")
    steps = steps.groupBy("n").agg(F.array_sort(F.collect_list(F.struct("start", "folds"))).alias("steps"))  # a few for each size
    placed = ranks(sizes, ["n"], [F.col(group)], "r").join(steps, "n")
    mine = F.element_at(F.filter("steps", lambda x: x["start"] < F.col("r")), -1)
    placed = placed.withColumn("m", mine)
    return placed.select(group, F.expr("m.folds[cast((r - 1 - m.start) % size(m.folds) as int)]").alias("fold"))


def stratified_folds(df: DataFrame, stratum: str, ident: str, k: int, seed: int) -> DataFrame:
    """``df`` with ``fold``: each stratum spread evenly."""
    r = ranks(df, [stratum], [F.xxhash64(F.lit(seed), F.col(ident)), F.col(ident)], "_n")
    return r.select(*df.columns, F.pmod("_n", F.lit(k)).cast("int").alias("fold"))


def bootstrap_means(df: DataFrame, cluster: str, value: str, replicates: int, seed: int) -> DataFrame:
    """``replicate, mean``: whole clusters drawn with replacement, as Poisson(1) weights from a hash of replicate and cluster."""
    sums = df.groupBy(cluster).agg(F.sum(value).alias("s"), F.count(value).alias("n"))
    reps = sums.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    u = (F.pmod(F.xxhash64(F.lit(seed), "replicate", cluster), F.lit(1 << 40)) + 0.5) / F.lit(float(1 << 40))
    weight, cumulative, term = F.lit(0), 0.0, float(np.exp(-1))
    for i in range(1, 9):
        cumulative += term
        weight = weight + (u > cumulative).cast("int")
        term /= i
    return reps.withColumn("w", weight).groupBy("replicate").agg(
        (F.sum(F.col("w") * F.col("s")) / F.sum(F.col("w") * F.col("n"))).alias("mean")
    )


def subsets(spark, names: Sequence[str], size: int) -> DataFrame:
    """``subset, name``: all subsets of ``size`` of at most 62 names, numbered by their bits.

    Built member by member, so that only the subsets themselves are made.
    """
    if len(names) > 62:
        raise ValueError("at most 62 names")
    if not 0 < size <= len(names):
        return spark.createDataFrame([], "subset bigint, name string")
    x = spark.range(1).select(F.array().cast("array<int>").alias("at"), F.lit(-1).alias("last"))
    for i in range(size):
        x = x.select("at", F.explode(F.sequence(F.col("last") + 1, F.lit(len(names) - size + i))).alias("last")).select(F.array_append("at", F.col("last")).alias("at"), "last")
    bits = F.aggregate("at", F.lit(0).cast("bigint"), lambda a, i: a + F.call_function("shiftleft", F.lit(1).cast("bigint"), i))
    at = F.explode("at").alias("i")
    return x.select(bits.alias("subset"), at).select("subset", F.element_at(F.array(*map(F.lit, names)), F.col("i") + 1).alias("name"))
