"""Text cut off by field limits: a structural completeness check against each source's own habits.

A stack automaton walks the brackets, quotes, elements, entities and escapes of a text
and says what is still open at its end; further marks are a broken multibyte
sequence, a continuation mark, and a missing terminator. What these mean depends on
the source, so three baselines are counted over all records, in the same pass over
the texts:

* lengths, in characters and in bytes, at which a source's texts pile up;
* endings with an ellipsis that are a house phrase, not a cut;
* openings of sentences that a source ends without a terminator anyway.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.session import cut_lineage
from plumbline.sources.tables import table

#: A length is a limit where this many times more texts end than at the lengths before it, and so many at least.
PILE, PILE_LEAST, BEFORE = 6.0, 4, 10
#: Share of an ellipsis' uses above which its last words are a house phrase, if several sources
#: have it or its texts differ in length by more than cut ones would.
HOUSE, SPREAD = 0.04, 0.15
#: Share of terminated sentences below which an opening needs no terminator; weight of all sources against one, and of all openings against one.
LOOSE, PRIOR = 0.5, 5.0
#: Share of an opening's endings below which an ending is not one of its usual ones.
USUAL = 0.12

#: A text that holds more than white space of any kind.
BLANKLESS = r"(?U)\S"

# Marks that say the text goes on elsewhere.
CONTINUED = re.compile(r"(?:\((?:cont\.?|continued|more)\)|\[(?:more|cont\.?|\.\.\.|…)\]|(?:…|\.\.\.)?\s*(?:read|see|show) more)$", re.I)
ELLIPSIS = re.compile(r"(?:…|\.\.\.)$")
ENDS, CLOSERS = ".!?。！？।؟", "\"'”’»)]"
_BREAK = re.compile(r"(?<=[.!?。！？।])[\"'”’»)\]]*\s+|[\r\n]+|\s+[•—]\s+|\s{2,}")
_STRUCTURE = re.compile(r"[()\[\]{}“”«»\"]|</?[A-Za-z][^\s<>/]*|<!--|-->|/>|>")
# an entity's name, unless it is one or two capitals: "R&D"
_OPEN_ENTITY = re.compile(r"&(?:#\w{0,6}|[a-z][A-Za-z]{0,6}|[A-Z][a-z]{2,6})?$")
_OPEN_ESCAPE = re.compile(r"(?<!\\)(?:\\\\)*\\(?:u[0-9A-Fa-f]{0,3}|U[0-9A-Fa-f]{0,7}|x[0-9A-Fa-f]?)?$")
_CLOSES = {")": "(", "]": "[", "}": "{", "”": "“", "»": "«"}
# Elements that have no end tag, and those whose end tag may be left out.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
OPTIONAL = frozenset("p li dt dd option tr td th thead tbody tfoot colgroup html head body".split())
_WHOLE_BYTES = re.compile("[\u00c2-\u00df][\u0080-\u00bf]|[\u00e0-\u00ef][\u0080-\u00bf]{2}|\u00e2\u20ac.")
_LEAD = re.compile("(?:[\u00c2-\u00f4]|[\u00e0-\u00f4][\u0080-\u00bf]|[\u00f0-\u00f4][\u0080-\u00bf]{2}|\u00e2\u20ac)$")


def broken_end(text: str) -> bool:
    """Whether a text ends within a multibyte character: as a replacement sign, or as the first bytes of one read as Latin-1.

    A single accented letter at the end is such a byte as well; it counts only where
    the text shows other bytes read so, or as a capital within a small word.
    """
    if text.endswith("\ufffd"):
        return True
    m = _LEAD.search(text)
    if not m:
        return False
    if len(m[0]) > 1 or m[0] in "\u00c2\u00c3" and text[m.start() - 1 : m.start()].islower():
        return True
    return bool(_WHOLE_BYTES.search(text, 0, m.start()))


def still_open(text: str) -> str:
    """What is open at the end of ``text``: the automaton's stack, where ``<`` is an unfinished tag, then ``E`` for open elements, ``&`` for an unfinished entity, ``\\`` for an unfinished escape, ``?`` for a broken character."""
    stack: list[str] = []
    for m in _STRUCTURE.finditer(text):
        mark = m[0]
        top = stack[-1] if stack else ""
        if top == "<!--":
            if mark == "-->":
                stack.pop()
        elif top[:1] == "<" and top[1:2] != ">":
            # within a tag only its end counts
            if mark == ">":
                stack.pop()
                name = top.lstrip("</").casefold()
                if top[1] != "/":
                    if name not in VOID and name not in OPTIONAL:
                        stack.append("<>" + name)
                elif "<>" + name in stack:
                    # an end tag closes what was left open within its element
                    del stack[len(stack) - 1 - stack[::-1].index("<>" + name) :]
            elif mark == "/>":
                stack.pop()
        elif mark[0] == "<":
            stack.append(mark)
        elif mark == '"':
            # a straight quote closes one that is open, an inch sign after a digit is none
            if top == '"':
                stack.pop()
            elif not text[: m.start()][-1:].isdigit():
                stack.append('"')
        elif mark in _CLOSES:
            if top == _CLOSES[mark]:
                stack.pop()
        elif mark in "([{“«":
            stack.append(mark)
    end = text.rstrip()
    tail = "E" if any(x[:2] == "<>" for x in stack) else ""
    if _OPEN_ENTITY.search(end, max(0, len(end) - 9)):
        tail += "&"
    if "\\" in end[-9:] and _OPEN_ESCAPE.search(end):
        tail += "\\"
    if broken_end(end):
        tail += "?"
    return "".join(x[0] for x in stack if x[:2] != "<>") + tail


def terminated(segment: str) -> bool:
    """Whether a sentence has its terminator, before closing quotes and brackets."""
    return segment.rstrip(CLOSERS)[-1:] in ENDS and segment.rstrip(CLOSERS) != ""


def _short(text: str) -> str:
    """``text``, or a hash of it where it is long; different texts stay different."""
    return text if len(text) <= 40 else hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=16).hexdigest()


def _shape(segment: str) -> str:
    """A hash of a whole sentence with its numbers and capitalised words blanked, but for the first."""
    head, _, rest = segment.partition(" ")
    rest = re.sub(r"\b[^\W\d_a-z]\w*", "W", re.sub(r"\d+", "9", rest))
    return hashlib.blake2b(f"{_head(head)} {rest}".strip().encode("utf-8", "replace"), digest_size=8).hexdigest()


def _head(word: str) -> str:
    """The opening of a sentence: its first word, or ``#`` for a tag."""
    return "#" if word.startswith("#") else _short(word.casefold())


def segments(text: str) -> list[str]:
    """The sentences and lines of a text."""
    return [s for s in (p.strip().lstrip("•—- \t\xa0") for p in _BREAK.split(text)) if s]


NAMES = ("row", "source", "chars", "bytes", "open", "mark", "phrase", "ended", "head", "shape", "n")


def _features(batches: Iterator) -> Iterator:
    """A row for each text, and one without ``chars`` for each source, opening and whether it was terminated, with its number ``n`` in the batch."""
    import pyarrow as pa

    for batch in batches:
        rows: list = []
        seen: Counter = Counter()
        out = []
        for at, (source, text) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
            end = text.rstrip()
            last = ""
            for last in segments(text):
                seen[source, last.split(" ", 1)[0], terminated(last)] += 1
            mark = "continued" if CONTINUED.search(end) else "ellipsis" if ELLIPSIS.search(end) else None
            phrase = _short(" ".join(end.casefold().rsplit(None, 3)[-3:])) if mark == "ellipsis" else None
            rows.append(at)
            out.append((
                source, len(text), len(text.encode("utf-8", "surrogatepass")), still_open(text), mark, phrase,
                terminated(end), _head(last.split(" ", 1)[0]), _shape(last), 1,
            ))
        heads: Counter = Counter()
        for (source, word, ended), n in seen.items():
            heads[source, _head(word), ended] += n
        out += [(source, None, None, None, None, None, ended, head, None, n) for (source, head, ended), n in heads.items()]
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.string(), pa.string(), pa.int64()]
        columns = list(zip(*out)) or [()] * len(kinds)
        keys = batch.column(0).take(pa.array([*rows, *[None] * len(heads)], pa.int64()))
        yield pa.RecordBatch.from_arrays([keys, *(pa.array(c, k) for c, k in zip(columns, kinds))], list(NAMES))


def _limits(feats: DataFrame, unit: str) -> DataFrame:
    """``source, <unit>, all_cut``: lengths where a source's unmarked texts pile up; ``all_cut`` where terminated ones do too."""
    hist = feats.filter("mark is null").groupBy("source", unit).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("ended").cast("int")).alias("t")
    )
    near = Window.partitionBy("source").orderBy(unit).rangeBetween(-BEFORE, -1)
    mean = lambda c: F.coalesce(F.sum(c).over(near), F.lit(0)) / F.lit(float(BEFORE))
    return hist.withColumn("usual", mean("n")).withColumn("usual_t", mean("t")).filter(
        (F.col("n") >= PILE_LEAST) & (F.col("n") >= F.lit(PILE) * (F.col("usual") + 0.4))
    ).filter("n - t >= 0.5 * n").select("source", unit, (F.col("t") > 3 * F.col("usual_t") + 1).alias("all_cut"))


def cut_texts(df: DataFrame, row: Column, source: Column, text: Column) -> DataFrame:
    """``row, source, cut``: whether each text is only the beginning of what was written.

    Null, empty and blank texts are not cut, and a short text is not cut for being
    short. A null source is a source of its own. Rows with equal ``row`` come out as
    often as they come in. Empty input gives no rows.
    """
    src = df.select(row.alias("row"), F.coalesce(source, F.lit("")).alias("source"), text.alias("t"))
    filled = src.filter(F.coalesce(F.col("t").rlike(BLANKLESS), F.lit(False)))
    kind = src.schema["row"].dataType.simpleString()
    parsed = cut_lineage(filled.mapInArrow(
        _features,
        f"row {kind}, source string, chars int, bytes int, open string, mark string, phrase string, ended boolean, head string, shape string, n bigint",
    ))
    feats = parsed.filter("chars is not null").drop("n")
    heads = cut_lineage(parsed.filter("chars is null").groupBy("source", "head").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("ended"), F.col("n")).otherwise(0)).alias("t")
    ))
    # an opening that is hardly known counts as one of all openings, not as one that is never terminated
    share = heads.agg(F.sum("t") / F.sum("n")).first()[0] or 0.0  # one number
    everywhere = heads.groupBy("head").agg(((F.sum("t") + PRIOR * F.lit(share)) / (F.sum("n") + PRIOR)).alias("rate"))
    loose = heads.join(everywhere, "head").select(
        "source", "head", ((F.col("t") + PRIOR * F.col("rate")) / (F.col("n") + PRIOR) < LOOSE).alias("loose")
    )
    phrases = feats.filter("phrase is not null").groupBy("phrase").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("source").alias("sources"), (F.stddev_pop("chars") / F.avg("chars")).alias("spread")
    )
    phrases = cut_lineage(phrases)
    total = phrases.agg(F.sum("n")).first()[0] or 0  # one number
    house = phrases.filter(
        (F.col("n") >= F.lit(HOUSE * total)) & (F.col("n") >= 3)
        & ((F.col("sources") >= 2) | (F.col("n") >= 5) & (F.col("spread") > SPREAD))
    ).select("phrase", F.lit(True).alias("house"))
    plain = cut_lineage(feats.filter("mark is null and not ended").groupBy("head", "shape").agg(F.count(F.lit(1)).alias("n")))
    usual = plain.join(plain.groupBy("head").agg(F.sum("n").alias("all")), "head").filter(
        F.col("n") >= F.lit(USUAL) * F.col("all")
    ).select("head", "shape", F.lit(True).alias("usual"))

    judged = (
        feats.join(house, "phrase", "left")
        .join(_limits(feats, "chars").withColumnRenamed("all_cut", "c_all"), ["source", "chars"], "left")
        .join(_limits(feats, "bytes").withColumnRenamed("all_cut", "b_all"), ["source", "bytes"], "left")
        .join(loose, ["source", "head"], "left")
        .join(usual, ["head", "shape"], "left")
    )
    at_limit = (F.col("c_all").isNotNull() | F.col("b_all").isNotNull())
    all_cut = F.coalesce("c_all", F.lit(False)) | F.coalesce("b_all", F.lit(False))
    unended = ~F.col("ended")
    natural = F.coalesce("loose", F.lit(False)) & F.coalesce("usual", F.lit(False))
    verdict = (
        (F.col("mark") == "continued")
        | ((F.col("mark") == "ellipsis") & F.col("house").isNull())
        | F.col("open").rlike(r"[E&\\?<]$")
        | F.col("mark").isNull() & (
            at_limit & (unended | all_cut) | unended & (~natural | (F.col("open") != ""))
        )
    )
    judged = judged.select("row", "source", F.coalesce(verdict, F.lit(False)).alias("cut"))
    return judged.unionByName(
        src.filter(~F.coalesce(F.col("t").rlike(BLANKLESS), F.lit(False))).select("row", "source", F.lit(False).alias("cut"))
    )


RECORDS = "records_graphic_designer__visual_designer"


def _judged(spark: SparkSession, folder: str) -> DataFrame:
    c = "collection"
    key = F.struct(F.col(f"{c}.run_id").alias("run_id"), F.col(f"{c}.adzuna_id").alias("adzuna_id"))
    return cut_texts(table(spark, folder, RECORDS), key, F.col(f"{c}.source"), F.col("raw.description"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Each record whose description is cut."""
    return _judged(spark, folder).filter("cut").select("row.run_id", "row.adzuna_id").distinct()


def p7_share(spark: SparkSession, folder: str) -> DataFrame:
    """For each source the share of its records that are cut."""
    return _judged(spark, folder).groupBy("source").agg(
        F.count(F.lit(1)).alias("records"), F.sum(F.col("cut").cast("long")).alias("cut"),
        F.avg(F.col("cut").cast("double")).alias("share"),
    )


QUERIES = {"p7_found": p7_found, "p7_share": p7_share}
SQL: dict[str, str] = {}
