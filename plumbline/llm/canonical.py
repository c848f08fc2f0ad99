"""Mapping freely typed values to a reference list by token-level repair and soft TF-IDF.

Every distinct token of the values is joined to the words of the reference list: by
a pigeonhole segment join within a few edits, and by the ways words are abbreviated.
The corrected tokens then cover reference entries; an entry counts where all its
words are covered by different tokens, and the entry with the largest soft TF-IDF
weight wins. A value that covers no entry comes out with id 0.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm.segmentjoin import segment_join
from plumbline.session import cut_lineage
from plumbline.sources.tables import table

EDITS = 2
#: Words of so many letters may hold two edits that aren't one swap.
LONG = 9
#: A word of so many letters may have two more at its end ("programme").
STEM = 6
#: Similarity of an abbreviation, of one that drops the word's last letter, and of a fixed spelling.
ABBREVIATED, CLIPPED, FIXED = 0.8, 0.7, 0.98

# Spellings that no rule finds; others may be given.
SPELLINGS = {"biz": ["business"], "sw": ["software"], "finance": ["financial"], "engg": ["engineer", "engineering"]}
_BRACKETS = re.compile(r"\[[^\]]*\]|\([^)]*\)")
_WORD = re.compile(r"[^\W_]+")
_CAMEL = re.compile(r"(?<=[^\W\d_A-Z])(?=[A-Z][a-z])")


def tokens_of(value: str) -> list[str]:
    """The words of a value in one spelling, without what stands in brackets; all of it where nothing else is there."""
    text = unicodedata.normalize("NFKD", _CAMEL.sub(" ", value))
    text = "".join(c for c in text if not unicodedata.combining(c)).casefold()
    text = re.sub(r"\b([a-z])/([a-z])\b", r"\1\2", text)
    return _WORD.findall(_BRACKETS.sub(" ", text)) or _WORD.findall(text)


def abbreviates(short: str, word: str) -> bool:
    """``short`` is the beginning of ``word`` and then some of its consonants in order, at least three letters or the first and last."""
    if not 2 <= len(short) < len(word) or short[0] != word[0]:
        return False
    if len(short) == 2:
        return short[1] == word[-1] and len(word) <= 4
    for i in range(len(short), 0, -1):
        rest = short[i:]
        if word.startswith(short[:i]) and not re.search("[aeiou]", rest):
            at = iter(word[i:])
            return all(c in at for c in rest)
    return False


def abbreviation_keys(word: str) -> set[str]:
    """How abbreviations of ``word`` may begin: their first three letters, or both of two."""
    if len(word) < 3:
        return set()
    keys = {word[0] + word[-1]} if len(word) <= 4 else set()
    firm = [i for i in range(1, len(word)) if word[i] not in "aeiou"]
    keys |= {word[0] + word[i] + word[j] for i in firm for j in firm if i < j}
    return keys | {word[:3]} | {word[:2] + word[j] for j in firm if j > 1}


def _tokens(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        values = batch.column(0)
        yield pa.RecordBatch.from_arrays([values, pa.array([tokens_of(v) for v in values.to_pylist()], pa.list_(pa.string()))], ["value", "toks"])


def _keys(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        rows = [(k, t) for t in batch.column(0).to_pylist() for k in sorted(abbreviation_keys(t))]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in (0, 1)], ["k", "t"])


def _abbreviated(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        pairs = [(s, t) for s, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if abbreviates(s, t)]
        rows = [(s, t, ABBREVIATED if t.startswith(s) or s[-1] == t[-1] else CLIPPED) for s, t in pairs]
        columns = list(zip(*rows)) or [(), (), ()]
        kinds = [pa.string(), pa.string(), pa.float64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["s", "t", "sim"])


def map_values(values: DataFrame, reference: DataFrame) -> DataFrame:
    """``value, ref_id, score`` for each distinct non-blank string of column ``value``, exactly as written.

    ``reference`` has ``ref_id`` and ``ref``; null and blank entries are left out, and
    an empty list maps everything to 0. Ties go to the entry whose tokens stand closer
    together, then to the smaller id. ``score`` is the covered share of the entry's
    weight, 0 without an entry; of equal shares the heavier entry wins.
    """
    given = values.select("value").filter(r"value is not null and value rlike '(?U)\\S'").distinct()
    titled = cut_lineage(given.mapInArrow(_tokens, "value string, toks array<string>"))
    titled = titled.withColumn("sig", F.concat_ws(" ", F.expr("filter(toks, x -> not x rlike '^[0-9]+$')")))
    sigs = titled.filter("sig <> ''").select("sig").distinct().withColumn("w", F.split("sig", " "))
    # single tokens, and two neighbours as one ("co-ordinator")
    placed = sigs.select("sig", F.explode(F.expr(
        "concat(transform(w, (x, i) -> named_struct('p', i, 's', x)),"
        " transform(slice(w, 1, greatest(size(w) - 1, 0)), (x, i) -> named_struct('p', i, 's', concat(x, w[i + 1]))))"
    )).alias("x")).select("sig", "x.*")

    refs = reference.select("ref_id", "ref").filter(r"ref is not null and ref rlike '(?U)\\S'")
    entries = cut_lineage(refs.select("ref_id", F.col("ref").alias("value")).join(
        refs.select(F.col("ref").alias("value")).distinct().mapInArrow(_tokens, "value string, toks array<string>"), "value"
    ).select("ref_id", F.array_distinct("toks").alias("toks")))
    total = entries.count()  # one number
    words = entries.select("ref_id", F.size("toks").alias("need"), F.explode("toks").alias("t"))
    weight = words.groupBy("t").agg(F.log(1 + F.lit(total) / F.count(F.lit(1))).alias("idf"))
    words = words.join(weight, "t")
    whole = entries.filter("size(toks) > 1").select("ref_id", F.concat_ws("", "toks").alias("t"))
    vocabulary = words.select("t").union(whole.select("t")).distinct()

    distinct = cut_lineage(placed.select("s").distinct())
    same = distinct.join(vocabulary.withColumn("s", F.col("t")), "s").select("s", "t", F.lit(1.0).alias("sim"))
    near = segment_join(distinct, vocabulary, EDITS)
    swap = (F.length("s") == F.length("t")) & (F.array_sort(F.split("s", "")) == F.array_sort(F.split("t", "")))
    edits = F.when((F.col("distance") == 2) & swap, F.lit(1)).otherwise(F.col("distance"))
    near = near.withColumn("edits", edits).filter(
        f"distance > 0 and (edits <= 1 or length(t) >= {LONG} or length(t) >= {STEM} and startswith(s, t)) and length(s) >= 3 and length(t) >= 3"
    ).select("s", "t", (1 - F.col("edits") / F.length("t")).alias("sim"))
    starts = words.select("t").distinct().mapInArrow(_keys, "k string, t string")
    short = distinct.filter("length(s) >= 2").withColumn("k", F.substring("s", 1, 3)).join(starts, "k").filter(
        "length(s) < length(t)"
    ).select("s", "t").mapInArrow(_abbreviated, "s string, t string, sim double")
    fixed = values.sparkSession.createDataFrame([(s, t) for s, ts in SPELLINGS.items() for t in ts], "s string, t string")
    fixed = fixed.join(vocabulary, "t", "left_semi").withColumn("sim", F.lit(FIXED)).select("s", "t", "sim")
    repaired = same.union(near).union(short).union(fixed).groupBy("s", "t").agg(F.max("sim").alias("sim"))
    # a token means the words it is most like: "mgr" is a manager, no migration
    most = F.max("sim").over(Window.partitionBy("s"))
    repaired = cut_lineage(repaired.withColumn("most", most).filter("sim = most").drop("most"))

    hits = placed.join(repaired, "s")
    # all words of an entry are needed, so its rarest one leads to it
    rarest = words.groupBy("ref_id").agg(F.max_by("t", F.struct("idf", "t")).alias("t"))
    likely = hits.join(rarest, "t").select("sig", "ref_id").distinct().join(words, "ref_id")
    by_word = hits.join(likely, ["sig", "t"]).groupBy("sig", "ref_id", "need", "t", "idf").agg(F.max(F.struct("sim", -F.col("p"))).alias("m"))
    covered = by_word.groupBy("sig", "ref_id", "need").agg(
        F.count(F.lit(1)).alias("n"), (F.sum(F.col("m.sim") * F.col("idf")) / F.sum("idf")).alias("score"), F.sum("idf").alias("weight"),
        F.collect_set(F.col("m.col2")).alias("at"),
    ).filter("n = need and size(at) = need").select("sig", "ref_id", "score", "weight", (F.array_max("at") - F.array_min("at")).alias("span"))
    full = words.groupBy("ref_id").agg(F.sum("idf").alias("idf"))
    joined = hits.join(whole, "t").join(full, "ref_id").select(
        "sig", "ref_id", F.col("sim").alias("score"), F.col("idf").alias("weight"), F.lit(0).alias("span")
    )
    rank = Window.partitionBy("sig").orderBy(F.round("score", 6).desc(), F.round("weight", 6).desc(), "span", "ref_id")
    best = covered.union(joined).withColumn("r", F.row_number().over(rank)).filter("r = 1").select("sig", "ref_id", "score")
    return titled.join(best, "sig", "left").select(
        "value", F.coalesce("ref_id", F.lit(0)).cast("int").alias("ref_id"), F.coalesce("score", F.lit(0.0)).alias("score")
    )


RECORDS = "records_project_manager__scrum_master"


def _mapped(spark: SparkSession, folder: str) -> DataFrame:
    a = table(spark, folder, RECORDS).select(F.col("raw.title").alias("value"))
    b = table(spark, folder, "human_validation_template").select(F.col("title").alias("value"))
    return map_values(a.union(b), table(spark, folder, "title_reference").select("ref_id", F.col("ref_title").alias("ref")))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Each distinct title with the entry it means, 0 for none."""
    return _mapped(spark, folder).select(F.col("value").alias("title"), "ref_id")


def p6_unmatched(spark: SparkSession, folder: str) -> DataFrame:
    """The titles without an entry."""
    return _mapped(spark, folder).filter("ref_id = 0").select(F.col("value").alias("title"))


QUERIES = {"p6_found": p6_found, "p6_unmatched": p6_unmatched}
SQL: dict[str, str] = {}
