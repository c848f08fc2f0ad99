"""Structured Streaming readings of the batch operators."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def file_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet", files: int = 1) -> DataFrame:
    """New files of a folder, ``files`` per trigger."""
    return spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", str(files)).load(path)


def weekly_counts(stream: DataFrame, ts: str, late: str = "14 hours") -> DataFrame:
    """``week_start, n`` by event time, weeks from Monday; rows later than ``late`` are left out."""
    w = F.window(ts, "7 days", "7 days", "4 days")  # the epoch is a Thursday
    return stream.withWatermark(ts, late).groupBy(w).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("week_start"), "n")


def without_future(stream: DataFrame, ts: str, clock: str, tolerance: str = "14 hours") -> DataFrame:
    """Rows dated at most ``tolerance`` after their collection clock."""
    return stream.filter(F.col(ts) <= F.col(clock) + F.expr(f"interval {tolerance}"))


def first_by_id(stream: DataFrame, key: Sequence[str], ts: str, late: str = "14 hours") -> DataFrame:
    """One row per key within the watermark."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(list(key))


def running_quantile(stream: DataFrame, key: str, value: str, q: float, digits: int | None = None) -> DataFrame:
    """``key, n, quantile``: after each batch the ``q`` quantile of all of a key's values so far, the pool that calibration draws on.

    The state is the pool's distinct values with their counts, in order, so every value
    counts; ``digits`` rounds values first where the distinct ones would be too many.
    """

    def step(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        values, counts = state.get if state.exists else ([], [])
        pool = dict(zip(values, counts))
        for b in batches:
            v = b[value].dropna()
            v = v if digits is None else v.round(digits)
            for x, c in v.value_counts().items():
                pool[float(x)] = pool.get(float(x), 0) + int(c)
        ordered = sorted(pool)
        state.update((ordered, [pool[x] for x in ordered]))
        n, below, quantile = sum(pool.values()), 0, None
        for x in ordered:
            below += pool[x]
            if below > min(n - 1, int(q * n)):
                quantile = x
                break
        yield pd.DataFrame({"key": [k[0]], "n": [n], "quantile": [quantile]})

    kind = stream.schema[key].dataType.simpleString()
    return stream.groupBy(key).applyInPandasWithState(
        step, f"key {kind}, n bigint, quantile double", "values array<double>, counts array<bigint>", "update", "NoTimeout"
    )


def drain(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there into Parquet and returns the result as a table."""
    query = stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.parquet(path)


def drain_complete(stream: DataFrame, path: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """The same for results that change: the last batch's rows, written once per batch."""

    def put(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    query = stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    done = stream.sparkSession.read.parquet(path)
    last = done.agg(F.max("batch")).first()[0]  # one number
    return done.filter(F.col("batch") == last).drop("batch")
