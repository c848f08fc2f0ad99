"""Validation, registries and pipelines' bookkeeping."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def one_to_one(left: DataFrame, right: DataFrame, key: str, how: str = "left") -> DataFrame:
    """The join of two frames whose keys are unique on both sides; a repeated key raises when the plan runs.

    The check rides on the join's own partitioning by key, so it costs no further pass.
    """
    from pyspark.sql import Window

    w = Window.partitionBy(key)

    def sure(df: DataFrame, side: str) -> DataFrame:
        n = df.withColumn("_n", F.count(F.lit(1)).over(w))
        guard = F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit(f"{side}: {key} repeated: "), F.col(key).cast("string")))).otherwise(F.col(key))
        return n.withColumn(key, guard.cast(dict(df.dtypes)[key])).drop("_n")

    return sure(left, "left").join(sure(right, "right"), key, how)


def registry(schema: T.StructType, about: Mapping[str, tuple[str, str]]) -> T.StructType:
    """``schema`` with each field's origin and description in its metadata."""
    out = []
    for f in schema.fields:
        origin, text = about.get(f.name, ("unknown", ""))
        out.append(T.StructField(f.name, f.dataType, f.nullable, {**f.metadata, "origin": origin, "description": text}))
    return T.StructType(out)


def with_registry(df: DataFrame, about: Mapping[str, tuple[str, str]]) -> DataFrame:
    """``df`` with the registry in its schema; it is kept in Parquet."""
    meta = {f.name: f.metadata for f in registry(df.schema, about).fields}
    return df.select(*[F.col(f"`{c}`").alias(c, metadata=meta[c]) for c in df.columns])


def registry_table(df: DataFrame) -> DataFrame:
    """``column, type, origin, description`` from a schema."""
    rows = [(f.name, f.dataType.simpleString(), f.metadata.get("origin"), f.metadata.get("description")) for f in df.schema.fields]
    return df.sparkSession.createDataFrame(rows, "column string, type string, origin string, description string")


def cue_classes(df: DataFrame, text: str, classes: Mapping[str, Sequence[str]], k: int) -> DataFrame:
    """``class, text, n``: texts by the first class whose terms they hold, the ``k`` most frequent texts of each class."""
    from pyspark.sql import Window

    cls = None
    for name, terms in classes.items():
        hit = F.lit(False)
        for t in terms:
            hit = hit | F.contains(F.lower(text), F.lit(t))
        cls = F.when(hit, name) if cls is None else cls.when(hit, name)
    n = df.filter(F.col(text).isNotNull()).groupBy(cls.otherwise("other").alias("class"), F.col(text).alias("text")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("class").orderBy(F.col("n").desc(), "text")
    return n.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k).drop("_r")


def projected_yield(clean: Column, seen: Column, available: Column, capped: Column) -> Column:
    """What a capped pull would have given in full, half to even; null for a pull that saw everything."""
    return F.when(capped, F.bround(clean * F.try_divide(available, seen), 0))


def subsample(df: DataFrame, ident: str, share: float, seed: int) -> DataFrame:
    """About ``share`` of the rows, nested: a larger share holds every smaller one. A sampling operator."""
    return df.filter(F.pmod(F.xxhash64(F.lit(seed), F.col(ident)), F.lit(1_000_000)) < int(share * 1_000_000))
