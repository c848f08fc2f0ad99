"""Filters, facets and benchmark lookups for interactive use."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def conjunction(filters: Mapping[str, object], skip: str | None = None) -> Column:
    """All filters but ``skip``. A list or set: one of them, empty for no filter. A pair ``(lo, hi)``: between, null values stay. A string ``~text``: holds the text, case aside."""
    out = F.lit(True)
    for c, f in filters.items():
        if c == skip or f is None or (isinstance(f, (list, set)) and not f):
            continue
        if isinstance(f, (list, set)):
            out = out & F.col(c).isin(list(f))
        elif isinstance(f, tuple):
            out = out & (F.col(c).isNull() | F.col(c).between(*f))
        elif isinstance(f, str) and f.startswith("~"):
            out = out & F.contains(F.lower(c), F.lit(f[1:].lower()))
        else:
            out = out & (F.col(c) == f)
    return out


def facet(df: DataFrame, filters: Mapping[str, object], by: str) -> DataFrame:
    """``by, n`` under all filters except the facet's own."""
    return df.filter(conjunction(filters, skip=by)).groupBy(by).agg(F.count(F.lit(1)).alias("n"))


def comparable(df: DataFrame, near: Column, least: int) -> DataFrame:
    """The rows where ``near`` holds, or all of them where fewer than ``least`` do."""
    enough = df.agg(F.count_if(near)).first()[0] >= least  # one number
    return df.filter(near) if enough else df


def page(df: DataFrame, order: Sequence[Column], number: int, size: int) -> DataFrame:
    """One page of the sorted rows, from 0: a limit is the feature."""
    return df.orderBy(*order).offset(number * size).limit(size)


def both_tails(df: DataFrame, value: str, ident: str, k: int) -> DataFrame:
    """The ``k`` highest and ``k`` lowest rows without repeats."""
    high = df.orderBy(F.col(value).desc(), ident).limit(k)
    low = df.orderBy(value, ident).limit(k)
    return high.union(low).distinct()


def top_or_other(df: DataFrame, c: str, k: int, out: str) -> DataFrame:
    """``df`` with ``c`` where it is among the ``k`` most frequent values (ties by name), else ``Other``."""
    top = df.filter(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("_n")).orderBy(F.col("_n").desc(), c).limit(k)
    top = top.select(F.col(c).alias("_c"), F.col(c).alias(out))
    return df.join(F.broadcast(top), F.col(c) == F.col("_c"), "left").drop("_c").fillna("Other", [out])  # k rows
