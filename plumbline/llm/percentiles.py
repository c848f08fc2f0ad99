"""Percentiles of large numeric columns from cumulative frequencies.

The input is reduced to ``(group, value, n)`` counts, which add up over
partitions, runs and days. The counts are range-sorted, so that a group holding
most of the values lies over many partitions; each partition's running sums get
the total of the group's earlier partitions added, and the first value whose sum
reaches a target rank is the percentile. The rank error is 0. Where the distinct
values themselves are too many, ``relative_error`` puts values on a logarithmic
grid first: the result is then within that share of the exact value.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.session import cut_lineage, shuffle_width
from plumbline.sources.tables import table

QUARTS = {"p10": 0.10, "p25": 0.25, "p50": 0.50, "p75": 0.75, "p90": 0.90}


def grid_step(relative_error: float) -> float:
    """The distance of grid points in logarithms: half of it, upwards, is the whole error; a 10^-9 of it is left to rounding."""
    if not relative_error > 0:
        raise ValueError("the error is positive")
    return 2 * math.log1p(relative_error) * (1 - 1e-9)


def on_grid(value: Column, relative_error: float) -> Column:
    """``value`` moved to a grid point at most ``relative_error`` of it away; 0 stays 0."""
    step = grid_step(relative_error)
    return F.when(value == 0, F.lit(0.0)).otherwise(
        F.signum(value) * F.exp(F.round(F.log(F.abs(value)) / F.lit(step)) * F.lit(step))
    )


def value_counts(df: DataFrame, group: Column, value: Column, relative_error: float = 0.0) -> DataFrame:
    """``g, v, n``. Null and NaN values don't count; a null group is a group of its own."""
    v = value.cast("double")
    v = on_grid(v, relative_error) if relative_error else v + F.lit(0.0)
    return df.select(group.alias("g"), v.alias("v")).filter("v is not null and not isnan(v)").groupBy("g", "v").agg(
        F.count(F.lit(1)).alias("n")
    )


def combine(*counts: DataFrame) -> DataFrame:
    """The counts of several partitions, runs or days as one."""
    whole = counts[0]
    for c in counts[1:]:
        whole = whole.unionByName(c)
    return whole.groupBy("g", "v").agg(F.sum("n").alias("n"))


def percentiles(counts: DataFrame, targets: Mapping[str, float] = QUARTS, partitions: int | None = None) -> DataFrame:
    """``g, n`` and a column for each target ``q``: the smallest value that ``ceil(q n)`` of the group's values (1 at least) don't exceed.

    Groups without values have no row.
    """
    spark = counts.sparkSession
    width = partitions or shuffle_width(spark)
    ordered = cut_lineage(
        counts.repartitionByRange(width, "g", "v").withColumn("part", F.spark_partition_id())
    )
    chunk = Window.partitionBy("g", "part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    sums = ordered.groupBy("g", "part").agg(F.sum("n").alias("s"))
    parts = Window.partitionBy("g").orderBy("part")
    offsets = sums.select(
        F.col("g").alias("og"), F.col("part").alias("opart"),
        (F.sum("s").over(parts.rowsBetween(Window.unboundedPreceding, 0)) - F.col("s")).alias("before"),
        F.sum("s").over(Window.partitionBy("g")).alias("total"),
    )
    running = ordered.withColumn("run", F.sum("n").over(chunk)).join(
        offsets, F.col("g").eqNullSafe(F.col("og")) & (F.col("part") == F.col("opart"))
    ).withColumn("reach", F.col("run") + F.col("before"))
    rank = lambda q: F.greatest(F.lit(1), F.ceil(F.lit(q) * F.col("total") - F.lit(1e-9)))
    return running.groupBy("g").agg(
        F.max("total").alias("n"), *[F.min(F.when(F.col("reach") >= rank(q), F.col("v"))).alias(k) for k, q in targets.items()]
    )


#: The relative error of ``p3_bounded``.
BOUND = 0.01
RECORDS = "records_project_manager__scrum_master"


def _rows(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, RECORDS).select("raw.title", "raw.salary_min", "collection.run_id")


def p3_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    """Pay percentiles of each title."""
    return percentiles(value_counts(_rows(spark, folder), F.col("title"), F.col("salary_min"))).withColumnRenamed("g", "title")


def p3_combined(spark: SparkSession, folder: str) -> DataFrame:
    """The same from the counts of single runs, combined."""
    by_run = _rows(spark, folder).groupBy("run_id", F.col("title").alias("g"), (F.col("salary_min") + 0.0).alias("v")).agg(
        F.count(F.lit(1)).alias("n")
    ).filter("v is not null and not isnan(v)")
    return percentiles(combine(by_run.drop("run_id"))).withColumnRenamed("g", "title")


def p3_bounded(spark: SparkSession, folder: str) -> DataFrame:
    """Percentiles of all titles together with values on a grid of 1 % relative error."""
    counts = value_counts(_rows(spark, folder), F.lit("all"), F.col("salary_min"), BOUND)
    return percentiles(counts).drop("g").select("n", *[F.round(k, 4).alias(k) for k in QUARTS])


QUERIES = {"p3_percentiles": p3_percentiles, "p3_combined": p3_combined, "p3_bounded": p3_bounded}

_PICK = ", ".join(
    f"min(CASE WHEN r >= greatest(1, ceil({q} * n - 1e-9)) THEN v END) AS {k}" for k, q in QUARTS.items()
)
_SQL = f"""
    SELECT title, max(n) AS n, {_PICK} FROM (
      SELECT title, v, count(*) OVER (PARTITION BY title) AS n,
             row_number() OVER (PARTITION BY title ORDER BY v) AS r
      FROM (SELECT raw.title AS title, raw.salary_min AS v FROM {RECORDS}) WHERE v IS NOT NULL) GROUP BY title"""

_STEP = repr(grid_step(BOUND))
_GRID = f"""
    SELECT max(n) AS n, {", ".join(f"round(min(CASE WHEN r >= greatest(1, ceil({q} * n - 1e-9)) THEN v END), 4) AS {k}" for k, q in QUARTS.items())} FROM (
      SELECT v, count(*) OVER () AS n, row_number() OVER (ORDER BY v) AS r FROM (
        SELECT CASE WHEN v = 0 THEN 0.0 ELSE sign(v) * exp(round(ln(abs(v)) / {_STEP}) * {_STEP}) END AS v
        FROM (SELECT raw.salary_min AS v FROM {RECORDS}) WHERE v IS NOT NULL AND NOT isnan(v)))"""

SQL = {"p3_percentiles": _SQL, "p3_combined": _SQL, "p3_bounded": _GRID}
