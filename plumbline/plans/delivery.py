"""Queries of the delivery store over the raw posting envelopes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.keyed_store import KeyedStore
from plumbline.session import new_folder
from plumbline.sources.tables import instant, table

RECORDS = "records_project_manager__scrum_master"
#: Deliveries are upserted in so many batches; a run belongs to one of them.
BATCHES = 3


def _filled(spark: SparkSession, folder: str) -> KeyedStore:
    """A store of the whole envelopes."""
    rows = table(spark, folder, RECORDS)
    at = F.col("collection")
    batch = F.pmod(F.coalesce(F.xxhash64(at["run_id"]), F.lit(0)), F.lit(BATCHES))
    store = KeyedStore(spark, new_folder(spark, "deliveries"))
    for i in range(BATCHES):
        store.upsert(rows.filter(batch == i), at["adzuna_id"], f"batch{i}", [instant(at["collected_at"]), at["run_id"], at["collected_at"]])
    store.compact()
    return store


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Each identifier that was delivered in more than one row."""
    return _filled(spark, folder).deliveries().filter("n > 1").select(F.col("k").alias("adzuna_id"))


def p1_kept(spark: SparkSession, folder: str) -> DataFrame:
    """The one copy that stays of each identifier: the latest collected, then the largest run."""
    c = F.col("collection")
    return _filled(spark, folder).read("deliveries").select(c["adzuna_id"].alias("adzuna_id"), c["run_id"].alias("run_id"), c["collected_at"].alias("collected_at"), "deliveries")


def p1_envelopes(spark: SparkSession, folder: str) -> DataFrame:
    """The whole envelopes that stay: one of each identifier, and every one without an identifier."""
    store = _filled(spark, folder)
    return store.read("deliveries").unionByName(store.unkeyed().withColumn("deliveries", F.lit(1).cast("bigint")))


QUERIES = {"p1_found": p1_found, "p1_kept": p1_kept, "p1_envelopes": p1_envelopes}

SQL = {
    "p1_found": f"""
        SELECT collection.adzuna_id AS adzuna_id FROM {RECORDS}
        WHERE collection.adzuna_id IS NOT NULL GROUP BY 1 HAVING count(*) > 1""",
    "p1_kept": f"""
        SELECT adzuna_id, run_id, collected_at, deliveries FROM (
          SELECT collection.adzuna_id AS adzuna_id, collection.run_id AS run_id,
                 collection.collected_at AS collected_at,
                 count(*) OVER (PARTITION BY collection.adzuna_id) AS deliveries,
                 row_number() OVER (PARTITION BY collection.adzuna_id ORDER BY
                   try_cast(collection.collected_at AS TIMESTAMPTZ) DESC NULLS LAST,
                   collection.adzuna_id DESC NULLS LAST, collection.run_id DESC NULLS LAST,
                   collection.collected_at DESC NULLS LAST) AS r
          FROM {RECORDS} WHERE collection.adzuna_id IS NOT NULL) WHERE r = 1""",
}
