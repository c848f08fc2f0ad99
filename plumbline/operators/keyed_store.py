"""Messages delivered more than once: an idempotent upsert store.

Rows live in *sorted runs*: each batch becomes one run, hash-bucketed and sorted
by the identifier. Upserting a batch id that the store already holds changes
nothing. Two runs of one level are merged to a run of the next with a sort-merge join
over the bucketed files; as both sides are bucketed and sorted alike, it neither
shuffles nor sorts its input, and equal identifiers collapse to one row. A row is
rewritten once a level, so a store of many batches is not rewritten for a new one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.session import read_json, register_bucketed, remove, shuffle_width, write_json

ORDERED_SCAN = "spark.sql.legacy.bucketedTableScan.outputOrdering"


class KeyedStore:
    """One row for each identifier, whatever was delivered how often.

    Of several copies the one with the largest ``(prefer..., all columns)`` stays,
    nulls counting as smallest, so the result depends on neither order nor
    batching. Rows without an identifier cannot be recognised again: they are kept
    aside one by one and come back from :meth:`unkeyed`.

    ``n_buckets`` is fixed when the store is created and recorded in its manifest;
    choose it so that one bucket of the whole history fits a task's disk (at
    100 TB some ten thousand). The manifest is replaced by a rename, after the
    run's files are complete.
    """

    def __init__(self, spark: SparkSession, path: str, n_buckets: int | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        self._tag = "pl_" + hashlib.md5(self.path.encode()).hexdigest()[:12]
        self._state = read_json(spark, f"{self.path}/manifest.json") or {
            "n_buckets": n_buckets or shuffle_width(spark),
            "schema": None,
            "levels": [],
            "batches": [],
            "unkeyed": [],
            "next": 0,
        }
        for run in self.runs:
            self._register(run)

    @property
    def runs(self) -> list[str]:
        """The runs from the oldest level to the newest."""
        return [r for level in reversed(self._state["levels"]) for r in level]

    # writing

    def upsert(self, rows: DataFrame, key: Column, batch_id: str, prefer: Sequence[Column] = ()) -> bool:
        """Add a batch as one sorted run; False where the store already holds ``batch_id``."""
        if batch_id in self._state["batches"]:
            return False
        shaped = rows.select(
            key.cast("string").alias("k"),
            F.struct(
                F.struct(*([c.alias(f"p{i}") for i, c in enumerate(prefer)] or [F.lit(0).alias("p0")])).alias("rank"),
                F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"),
            ).alias("v"),
        )
        # max and count combine map-side, so a hot identifier leaves each task as one row
        one = shaped.filter("k is not null").groupBy("k").agg(F.max("v").alias("v"), F.count(F.lit(1)).alias("n"))
        run = self._write(one)
        loose = f"{self.path}/unkeyed/{run}"
        shaped.filter("k is null").select("v.row.*").write.mode("overwrite").parquet(loose)
        self._state["levels"] = self._state["levels"] or [[]]
        self._state["levels"][0].append(run)
        self._state["batches"].append(batch_id)
        self._state["unkeyed"].append(run)
        self._save()
        at = 0
        while at < len(self._state["levels"]):
            level = self._state["levels"][at]
            if len(level) > 1:
                if at + 1 == len(self._state["levels"]):
                    self._state["levels"].append([])
                self._replace(level[:2], self._write(self._merge(*level[:2]), ordered=True), at + 1)
            at += 1
        return True

    def compact(self, to: int = 1) -> None:
        """Merge the newest runs until ``to`` are left."""
        while len(runs := self.runs) > to:
            level = next(i for i, level in enumerate(self._state["levels"]) if runs[-2] in level)
            self._replace(runs[-2:], self._write(self._merge(*runs[-2:]), ordered=True), level)

    def _replace(self, old: Sequence[str], new: str, level: int) -> None:
        self._state["levels"] = [[r for r in runs if r not in old] for runs in self._state["levels"]]
        self._state["levels"][level].append(new)
        self._save()
        for run in old:
            self.spark.sql(f"DROP TABLE IF EXISTS {self._name(run)}")
            remove(self.spark, f"{self.path}/runs/{run}")

    # reading

    def _view(self) -> DataFrame:
        """``k, v, n`` over all runs: the newer ones are merged until two are left, and these in the reader's plan.

        The oldest run, which holds most rows, is not rewritten. Runs are never brought
        together by a union: over bucketed scans Spark 4.1 takes its rows for grouped
        by bucket where they are not.
        """
        self.compact(to=2)
        if not self.runs:
            raise ValueError("the store is empty")
        return self._merge(*self.runs) if len(self.runs) == 2 else self.spark.table(self._name(self.runs[0]))

    def read(self, counts: str | None = None) -> DataFrame:
        """The surviving rows; ``counts`` names a column for the number of deliveries."""
        extra = [F.col("n").alias(counts)] if counts else []
        return self._view().select("v.row.*", *extra)

    def deliveries(self) -> DataFrame:
        """``k, n``: each identifier and how often it was delivered, without touching the rows."""
        return self._view().select("k", "n")

    def unkeyed(self) -> DataFrame:
        """The rows without an identifier, all of them."""
        return self.spark.read.parquet(*[f"{self.path}/unkeyed/{r}" for r in self._state["unkeyed"]])

    def merge_plan(self) -> DataFrame:
        """The merge of the first two runs, for ``explain``."""
        return self._merge(*self.runs[:2])

    # inside

    def _merge(self, a: str, b: str) -> DataFrame:
        x, y = (self.spark.table(self._name(r)).alias(s) for r, s in ((a, "a"), (b, "b")))
        return x.hint("merge").join(y, F.expr("a.k = b.k"), "full").select(
            F.coalesce("a.k", "b.k").alias("k"),
            F.greatest("a.v", "b.v").alias("v"),
            (F.coalesce("a.n", F.lit(0)) + F.coalesce("b.n", F.lit(0))).cast("bigint").alias("n"),
        )

    def _write(self, df: DataFrame, ordered: bool = False) -> str:
        n, run = self._state["n_buckets"], f"run{self._state['next']:06d}"
        self._state["next"] += 1
        self._state["schema"] = df.schema.jsonValue()
        # as many shuffle partitions as buckets: the aggregate's own shuffle is then the bucketing
        conf = {"spark.sql.shuffle.partitions": str(n), ORDERED_SCAN: str(ordered).lower()}
        before = {k: self.spark.conf.get(k) for k in conf}
        for k, v in conf.items():
            self.spark.conf.set(k, v)
        try:
            (
                df.write.format("parquet").mode("overwrite").bucketBy(n, "k").sortBy("k")
                .option("path", f"{self.path}/runs/{run}").saveAsTable(self._name(run))
            )
        finally:
            for k, v in before.items():
                self.spark.conf.set(k, v)
        return run

    def _name(self, run: str) -> str:
        return f"{self._tag}_{run}"

    def _register(self, run: str) -> None:
        register_bucketed(self.spark, self._name(run), self._state["schema"], ["k"], self._state["n_buckets"], f"{self.path}/runs/{run}")

    def _save(self) -> None:
        write_json(self.spark, f"{self.path}/manifest.json", self._state)

    def drop(self) -> None:
        """Remove the store and its tables."""
        for run in self.runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {self._name(run)}")
        remove(self.spark, self.path)
