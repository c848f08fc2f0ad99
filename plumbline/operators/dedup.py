"""Deduplication with a stated representative, conflict reports, first-seen variants, incremental merges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.text import norm_description, norm_text, norm_title


def numeric_id(name: str) -> Column:
    """A numeric id as a number, anything else as 10^18: ids order by it."""
    return F.coalesce(F.col(name).try_cast("bigint"), F.lit(10**18))


def by_id(df: DataFrame, key: str, order: Sequence[Column], source: str, seen: Sequence[str] = ()) -> DataFrame:
    """One row for each ``key``: the first under ``order``, with ``dup_count``, the other sources in ``also_seen_in`` and the sorted sets of ``seen``.

    Rows with a null or blank key are left out; give ``order`` a last column that is unique.
    """
    keyed = df.filter(F.trim(key) != "")
    w = Window.partitionBy(key).orderBy(*order)
    first = keyed.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")
    sets = keyed.groupBy(F.col(key).alias("_k")).agg(
        F.count(F.lit(1)).alias("dup_count"), F.collect_set(source).alias("_src"),
        *[F.array_sort(F.collect_set(c)).alias(f"{c}_seen") for c in seen],
    )
    joined = first.join(sets, F.col(key) == F.col("_k")).drop("_k")
    return joined.withColumn("also_seen_in", F.array_sort(F.array_except("_src", F.array(F.col(source))))).drop("_src")


def id_conflicts(df: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """``field, ids``: how many ids come with more than one value of each field, null being a value."""
    g = df.filter(F.trim(key) != "").groupBy(key).agg(
        *[(F.countDistinct(F.struct(f)) > 1).cast("int").alias(f) for f in fields]
    ).agg(*[F.coalesce(F.sum(f), F.lit(0)).alias(f) for f in fields])
    return g.unpivot([], list(fields), "field", "ids")


def multiplicity(df: DataFrame, key: str, top: int = 10) -> DataFrame:
    """``times, ids``: how many ids came how often, the last row for ``top`` and more."""
    n = df.filter(F.trim(key) != "").groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(F.least("n", F.lit(top)).cast("int").alias("times")).agg(F.count(F.lit(1)).alias("ids"))


def near_keys(df: DataFrame, title: str, group: str, text: str, prefix: int = 150) -> DataFrame:
    """``df`` with ``near_key`` (null where a part is empty) and ``near_text``, a digest of the whole normal text."""
    t, g, d = norm_title(F.col(title)), norm_text(F.col(group)), norm_description(F.col(text))
    x = df.withColumns({"_t": t, "_g": g, "_d": d})
    key = F.substring(F.sha1(F.concat_ws("|", "_t", "_g", F.substring("_d", 1, prefix))), 1, 16)
    return x.withColumn("near_key", F.when((F.col("_t") != "") & (F.col("_g") != "") & (F.col("_d") != ""), key)).withColumn(
        "near_text", F.sha2("_d", 256)
    ).drop("_t", "_g", "_d")


def near_dedup(keyed: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Survivors of :func:`near_keys`: of equal key and equal whole text the first under ``order``; ``group_size`` says how many it stands for.

    Rows without a key all survive, as groups of one.
    """
    full, loose = keyed.filter("near_key is not null"), keyed.filter("near_key is null")
    same = Window.partitionBy("near_key", "near_text")
    kept = full.withColumn("group_size", F.count(F.lit(1)).over(same)).withColumn("_r", F.row_number().over(same.orderBy(*order)))
    return kept.filter("_r = 1").drop("_r").unionByName(loose.withColumn("group_size", F.lit(1).cast("long")))


def collisions(keyed: DataFrame) -> DataFrame:
    """``near_key, texts, rows`` of candidate groups that hold more than one whole text."""
    return keyed.filter("near_key is not null").groupBy("near_key").agg(
        F.countDistinct("near_text").alias("texts"), F.count(F.lit(1)).alias("rows")
    ).filter("texts > 1")


def first_seen(df: DataFrame, ident: str, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """``df`` with ``reason`` (``id``, ``near`` or null) and ``kept_id``: the streaming variant, the first id and then the first key wins."""
    by_ident = F.row_number().over(Window.partitionBy(ident).orderBy(*order))
    x = df.withColumn("_i", by_ident)
    live = F.col("_i") == 1
    w = Window.partitionBy(live, *key).orderBy(*order)
    x = x.withColumn("_live", live).withColumn("_k", F.row_number().over(w)).withColumn("_f", F.first(ident).over(w))
    reason = F.when(~F.col("_live"), "id").when(F.col("_k") > 1, "near")
    kept = F.when(~F.col("_live"), F.col(ident)).when(F.col("_k") > 1, F.col("_f"))
    return x.withColumn("reason", reason).withColumn("kept_id", kept).drop("_i", "_live", "_k", "_f")


def cap_flag(df: DataFrame, group: str, member: str, share: float, order: Sequence[Column]) -> DataFrame:
    """``df`` with ``cap``, ``member_rank`` and ``within_cap``: at most ``max(1, floor(share * rows of the group))`` rows of a member; null and blank members are never capped."""
    size = df.groupBy(F.col(group).alias("_g")).agg(F.count(F.lit(1)).alias("_n"))
    x = df.join(size, F.col(group).eqNullSafe(F.col("_g")))
    rank = F.row_number().over(Window.partitionBy(group, member).orderBy(*order))
    x = x.withColumn("cap", F.greatest(F.lit(1), F.floor(F.lit(share) * F.col("_n"))).cast("int")).withColumn("member_rank", rank)
    return x.withColumn("within_cap", F.coalesce(F.trim(member) == "", F.lit(True)) | (F.col("member_rank") <= F.col("cap"))).drop("_g", "_n")


def duplicated(df: DataFrame, keys: Sequence[Sequence[str]], order: Sequence[Column], out: str = "duplicate") -> DataFrame:
    """``df`` with whether any of ``keys`` was seen before under ``order``; nulls are equal to each other."""
    flag = F.lit(False)
    kinds = dict(df.dtypes)
    for k in keys:
        # long texts are shuffled and compared as digests
        by = [F.sha2(c, 256) if kinds.get(c) == "string" else F.col(c) for c in k]
        flag = flag | (F.row_number().over(Window.partitionBy(*by).orderBy(*order)) > 1)
    return df.withColumn(out, flag)


def merge_new(existing: DataFrame, batch: DataFrame, key: str, order: Sequence[Column], required: Sequence[tuple[str, Column]] = ()) -> DataFrame:
    """The batch with ``skip``: ``no_id``, ``in_existing``, ``in_batch``, the name of the first unmet requirement, or null for rows to append."""
    known = existing.select(F.col(key).alias("_e")).distinct().withColumn("_known", F.lit(True))
    x = batch.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).join(known, F.col(key) == F.col("_e"), "left")
    skip = F.when(F.col(key).isNull() | (F.trim(key) == ""), "no_id").when(F.col("_known"), "in_existing").when(F.col("_r") > 1, "in_batch")
    for name, test in required:
        skip = skip.when(~F.coalesce(test, F.lit(False)), name)
    return x.withColumn("skip", skip).drop("_r", "_e", "_known")
