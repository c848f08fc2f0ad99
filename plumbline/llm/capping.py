"""Capping records per dominant contributor with mergeable bounded heaps.

``collect_top_k`` is Spark's own bounded priority queue as an aggregate: each task
keeps, for a contributor, only the cap's best (score, identifier) pairs before
anything is shuffled, and merging two heaps gives a heap again. Heaps are merged
in two levels, first by contributor and a salt, then by contributor, so that a
contributor that fills a third of the table is merged by many tasks. The kept
identifiers then select the full records by a semi-join; where several copies of one
row lie on the cap's edge, so many of them stay as have a place left.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.session import scratch_name
from plumbline.sources.tables import instant, table

try:
    from pyspark.sql.internal import InternalFunction
except ImportError:  # Spark's own, not promised to stay: sorted runs do without it
    InternalFunction = None

#: Heaps up to this size stay in memory; larger caps merge sorted runs, which spill.
HEAP_LIMIT = 20_000
#: Tasks that merge one contributor's heaps on the first level.
SALTS = 16


def _row_hash(df: DataFrame) -> Column:
    """A hash of the whole row, equal for equal rows in any run of a task."""
    return F.xxhash64(F.lit(0), *[F.to_json(F.struct(F.col(f"`{c}`"))) if "map<" in t else F.col(f"`{c}`") for c, t in df.dtypes])


def kept_ids(
    df: DataFrame, keys: Sequence[Column], score: Sequence[Column], ident: Column, cap: Column,
    heap_limit: int = HEAP_LIMIT, salts: int = SALTS,
) -> DataFrame:
    """``k0.., id, tie, places, edge``: the pairs that stay, at most ``cap`` rows of each combination of ``keys``.

    The largest ``score`` (then the larger ``ident``, then the larger hash of the row)
    stay; nulls in a score count as smallest. ``cap`` is constant within a contributor;
    null or negative means none stay. Copies of a row each take a place: ``places``
    says how many of them stay, ``edge`` whether the contributor's last place is
    among them. Empty input gives no rows.
    """
    names = [f"k{i}" for i in range(len(keys))]
    pair = F.struct(*[c.alias(f"s{i}") for i, c in enumerate(score)], ident.alias("id"), _row_hash(df).alias("tie"))
    pairs = df.select(*[k.alias(n) for k, n in zip(keys, names)], cap.cast("long").alias("cap"), pair.alias("pair")).filter("cap > 0")
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("pair"), F.lit(salts)))
    largest = pairs.agg(F.max("cap")).first()[0]  # one number: the size that heaps may need
    if InternalFunction and (largest is None or largest <= heap_limit):
        size = int(largest or 1)
        heap = lambda c: InternalFunction.collect_top_k(c, size, False)
        trim = lambda d: d.select(*names, "cap", F.explode(F.slice("heap", F.lit(1), F.col("cap").cast("int"))).alias("pair"))
        part = trim(salted.groupBy(*names, "cap", "salt").agg(heap("pair").alias("heap")))
        best = part.groupBy(*names, "cap").agg(heap("pair").alias("heap"))
        best = best.select(*names, "cap", F.posexplode(F.slice("heap", F.lit(1), F.col("cap").cast("int"))).alias("r", "pair"))
        best = best.withColumn("r", F.col("r") + 1)
    else:
        first = Window.partitionBy(*names, "salt").orderBy(F.col("pair").desc())
        second = Window.partitionBy(*names).orderBy(F.col("pair").desc())
        part = salted.withColumn("r", F.row_number().over(first)).filter("r <= cap")
        best = part.withColumn("r", F.row_number().over(second)).filter("r <= cap")
    return best.groupBy(*names, "pair.id", "pair.tie").agg(
        F.count(F.lit(1)).alias("places"), (F.max("r") == F.max("cap")).alias("edge")
    )


def cap_contributors(
    df: DataFrame, keys: Sequence[Column], score: Sequence[Column], ident: Column, cap: Column, dropped: bool = False, **how,
) -> DataFrame:
    """The full records that stay under the cap, or with ``dropped`` those that go.

    Never more than ``cap`` rows of a contributor stay, copies of a row counted one by
    one. Rows with a null key have no contributor and are never capped. All columns
    come through unchanged.
    """
    known = F.lit(True)
    for k in keys:
        known = known & k.isNotNull()
    own = scratch_name()  # no clash with the table's own columns
    n, columns = len(keys), [F.col(f"`{c}`") for c in df.columns]
    kept = kept_ids(df.filter(known), keys, score, ident, cap, **how).toDF(
        *[f"{own}_{i}" for i in range(n + 2)], f"{own}_places", f"{own}_edge"
    )
    tied = df.filter(known).withColumn(f"{own}_tie", _row_hash(df))
    match = ident.eqNullSafe(F.col(f"{own}_{n}")) & (F.col(f"{own}_tie") == F.col(f"{own}_{n + 1}"))
    for i, k in enumerate(keys):
        match = match & (k == F.col(f"{own}_{i}"))
    # at most one pair of a contributor lies on the edge; its copies are equal, so they are counted, not listed
    edge = tied.join(kept.filter(F.col(f"{own}_edge")), match).groupBy(*[f"{own}_{i}" for i in range(n + 2)], f"{own}_places").agg(
        F.any_value(F.struct(*columns)).alias(f"{own}_row"), F.count(F.lit(1)).alias(f"{own}_copies")
    )
    places, copies = F.col(f"{own}_places"), F.col(f"{own}_copies")
    times = copies - places if dropped else F.least(places, copies)
    edge = edge.filter(times > 0).select(F.explode(F.sequence(F.lit(1), times)), f"{own}_row").select(f"{own}_row.*")
    if dropped:
        return tied.join(kept, match, "left_anti").select(*columns).unionByName(edge)
    whole = tied.join(kept.filter(~F.col(f"{own}_edge")), match, "left_semi").select(*columns)
    return whole.unionByName(edge).unionByName(df.filter(~known))


EXCLUSIONS = "employer_cap_exclusions"


def _audit(spark: SparkSession, folder: str, dropped: bool) -> DataFrame:
    rows = table(spark, folder, EXCLUSIONS).select("role", "job_id", "employer", "created", "cap_per_employer_in_role")
    employer = F.when(F.col("employer").rlike(r"(?U)\S"), F.col("employer"))
    score = [instant(F.col("created")), -F.expr("try_cast(job_id as decimal(38,0))")]
    return cap_contributors(rows, [F.col("role"), employer], score, F.col("job_id"), F.col("cap_per_employer_in_role"), dropped)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """The rows that go."""
    return _audit(spark, folder, True).select("role", "job_id")


def p2_kept(spark: SparkSession, folder: str) -> DataFrame:
    """What the cap leaves, counted by role."""
    return _audit(spark, folder, False).groupBy("role").agg(
        F.count(F.lit(1)).alias("kept"), F.countDistinct("employer").alias("employers")
    )


QUERIES = {"p2_found": p2_found, "p2_kept": p2_kept}

_RANKED = f"""
    SELECT *, row_number() OVER (PARTITION BY role, employer ORDER BY
        try_cast(nullif(trim(created), '') AS TIMESTAMPTZ) DESC NULLS LAST,
        try_cast(job_id AS HUGEINT) NULLS LAST, job_id DESC) AS r,
        coalesce(regexp_matches(employer, '[^\\s\\p{{Z}}]'), false) AS named FROM {EXCLUSIONS}"""

SQL = {
    "p2_found": f"SELECT role, job_id FROM ({_RANKED}) WHERE named AND r > cap_per_employer_in_role",
    "p2_kept": f"""SELECT role, count(*) AS kept, count(DISTINCT employer) AS employers
        FROM ({_RANKED}) WHERE NOT (named AND r > cap_per_employer_in_role) GROUP BY role""",
}
