"""Pigeonhole segment join: pairs of strings within a small edit distance, without comparing all.

A string is cut into ``k + 1`` segments. Whoever lies within ``k`` edits of it holds
at least one of them unchanged, moved by at most ``k`` places. The segments form an
inverted index; the other side looks up its substrings of the right length at the
places such a move allows, and a banded edit distance verifies what meets.

A string of ``k`` letters or fewer has an empty segment. It meets those of up to
``2 k`` letters with which it has a letter in common, which is what ``k`` edits leave.
A segment that many strings share is split: its index entries are dealt out over
salts, and its lookups go to each of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.session import cut_lineage, shuffle_width


def _segments(k: int) -> str:
    """SQL: an array of ``(i, len, seg)`` of column ``s``, cut into ``k + 1`` nearly equal segments."""
    cut = f"cast(floor(i * length(s) / {k + 1}) as int)"
    nxt = f"cast(floor((i + 1) * length(s) / {k + 1}) as int)"
    return f"transform(sequence(0, {k}), i -> named_struct('i', i, 'len', length(s), 'seg', substring(s, {cut} + 1, {nxt} - {cut})))"


def _lookups(k: int) -> str:
    """SQL: the substrings of column ``s`` that may equal segment ``i`` of a string of length ``len``."""
    start = f"cast(floor(i * len / {k + 1}) as int)"
    size = f"(cast(floor((i + 1) * len / {k + 1}) as int) - {start})"
    return (
        f"flatten(flatten(transform(sequence(greatest(1, length(s) - {k}), length(s) + {k}), len -> "
        f"transform(sequence(0, {k}), i -> transform("
        f"filter(sequence({start} - {k}, {start} + {k}), p -> p >= 0 and p + {size} <= length(s) and {size} > 0), "
        f"p -> named_struct('i', i, 'len', len, 'seg', substring(s, p + 1, {size})))))))"
    )


#: Index entries of one segment that a task takes at most about; a segment with more is dealt out over several.
HOT = 1_000


def segment_join(probe: DataFrame, index: DataFrame, k: int, hot: int = HOT) -> DataFrame:
    """``probe.*, t, distance``: each row of ``probe`` (a column ``s``) with each string of ``index`` (a column ``t``) within ``k`` edits.

    Edits are insertions, deletions and substitutions. Strings that have no letter in
    common are no pair, however short: replacing every letter is no typo. Null and
    empty strings match nothing. Distinct strings only are compared.
    """
    width = shuffle_width(probe.sparkSession)
    given = cut_lineage(index.select("t").filter("t <> ''").distinct())
    asked = probe.select("s").filter("s <> ''").distinct()
    right = given.filter(F.length("t") > k).select(F.col("t").alias("s")).select(F.col("s").alias("t"), F.expr(f"inline({_segments(k)})"))
    # few strings make many substrings: they are spread before they are cut up
    left = asked.filter(F.length("s") > k).repartition(width, F.xxhash64("s"))
    left = left.select("s", F.explode(F.array_distinct(F.expr(_lookups(k)))).alias("x")).select("s", "x.*")
    crowded = cut_lineage(right.groupBy("i", "len", "seg").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > hot))
    salts = F.coalesce(F.ceil(F.col("n") / hot), F.lit(1)).cast("int")
    keys = ["i", "len", "seg"]
    # substrings outgrow what the planner sees of the strings: the join itself is never a broadcast
    if crowded.head(1):
        right = right.join(crowded, keys, "left").withColumn("salt", F.pmod(F.xxhash64("t"), salts)).drop("n")
        left = left.join(crowded, keys, "left").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), (salts - 1).cast("bigint")))).drop("n")
        keys = [*keys, "salt"]
    met = left.join(right.hint("merge"), keys).select("s", "t").distinct()
    # short strings, by the letters they have
    letters = lambda d, c: d.select(c, F.explode(F.array_distinct(F.split(c, ""))).alias("x"))
    small = lambda c: F.length(c) <= k
    tiny, brief = letters(given.filter(small("t")), "t"), letters(given.filter(~small("t") & (F.length("t") <= 2 * k)), "t")
    short = letters(asked.filter(F.length("s") <= 2 * k), "s").join(tiny, "x").select("s", "t")
    short = short.union(letters(asked.filter(small("s")), "s").join(brief, "x").select("s", "t")).distinct()
    near = met.union(short).withColumn("distance", F.levenshtein("s", "t", k)).filter("distance >= 0 and distance < greatest(length(s), length(t))")
    return probe.join(near, "s")
