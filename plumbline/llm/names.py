"""Variant spellings of organisation names, linked by a pigeonhole segment join.

A name is taken apart into its *core* (the proper words), the words for its field,
its legal form, a place and an alias in brackets. Names with equal cores up to the
order of words are one *spelling class*. Each class then looks for the class it is a
variant of: within ``EDITS`` edits of the core (segment join, banded distance), or by
what people shorten to: consonants, an initial, one of the words, the initials of all.
A class links to one better-attested class only, so two organisations never grow
together through a chain of typos.
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
#: A word of so many letters is taken for two that were typed without a space.
JOINED = 11
#: A single word of so many letters may hold two edits.
SURE = 9
#: An ambiguous short form means the candidate that is so many times better attested than the next.
LEAD = 2.0

# Words for a field of business.
FIELDS = (
    "analytics consulting consultants consultancy infotech interactive labs laboratories logistics networks services software solutions "
    "staffing studios systems technologies technology holdings industries media partners ventures enterprises"
).split()
SAME_FIELD = {"laboratories": "labs", "technology": "technologies", "consultants": "consulting", "consultancy": "consulting"}
# Legal forms and what stands for them.
LEGAL = {
    "limited": "l", "ltd": "l", "llp": "llp", "inc": "i", "incorporated": "i", "group": "g", "grp": "g", "private": "p",
    "pvt": "p", "p": "p", "llc": "llc", "corp": "c", "corporation": "c", "co": "c", "company": "c", "plc": "plc", "gmbh": "gmbh",
}
# Words that join others or say nothing.
FILLERS = {"and", "the", "of", "team", "dept", "department"}
_TOKEN = re.compile(r"[^\W_]+")
_VOWELS = re.compile(r"(?<=.)[aeiou]")


def _plain(text: str) -> str:
    text = unicodedata.normalize("NFKD", text)
    return "".join(c for c in text if not unicodedata.combining(c)).casefold()


def _subsequence(short: str, long: str) -> bool:
    at = iter(long)
    return all(c in at for c in short)


def field_of(token: str) -> str | None:
    """The field word that ``token`` is or abbreviates."""
    word = _field_of(token)
    return SAME_FIELD.get(word, word)


def _field_of(token: str) -> str | None:
    token = re.sub(r"x$", "cs", token)
    for word in FIELDS:
        if token == word or token + "s" == word or token == word + "s":
            return word
    if token == "sw":
        return "software"
    best = None
    for word in FIELDS:
        if token[:1] != word[:1] or len(token) < 3 or len(token) > len(word) + 1:
            continue
        if word.startswith(token) or token.endswith("s") and word.startswith(token[:-1]) and len(token) > 3:
            return word
        # consonants kept in order, and the last ones among them
        if len(token) >= 4 and _subsequence(token, word) and len(token) < len(word):
            best = best or word
    return best


def parse(name: str) -> dict | None:
    """The parts of a name; null and blank names have none.

    ``words``: the proper words in order; ``field``, ``legal``: letters for the
    initials; ``alias``: initials in brackets; ``kind``: ``full``, ``initials``,
    ``team`` (a word after "team") or ``one`` (one word).
    """
    if not name or not name.strip():
        return None
    text = _plain(re.sub(r"(?<=[^\W\d_A-Z])(?=[A-Z][a-z])", " ", name))
    bare = re.sub(r"[^A-Za-z.]", "", name.strip())
    letters = bare.replace(".", "")
    if re.fullmatch(r"[A-Z]{3,6}|(?:[A-Z]\.){2,6}[A-Z]?", bare) and " " not in name.strip():
        return {"words": [], "field": None, "legal": "", "alias": letters.casefold(), "kind": "initials"}
    if m := re.match(r"^(.*\S)\s+[-–—]\s+[^-–—]+$", text):  # a place at the end
        text = m[1]
    alias = None
    if m := re.search(r"\(([a-z]{3,6})\)", text):
        alias, text = m[1], text[: m.start()] + " " + text[m.end() :]
    text = re.sub(r"\bs\s*/\s*w\b", "sw", text)
    text = re.sub(r"\b((?:[a-z]\.){2,})", lambda m: m[1].replace(".", ""), text)  # l.l.p.
    initial = set(re.findall(r"(?:^|\s)([a-z])\.(?=\s)", text))
    front = None
    if m := re.match(r"^\s*([a-z]+)\.?\s*,\s*(.+)$", text):  # the field first, then the name
        if (f := field_of(m[1])) and _TOKEN.search(m[2]):
            front, text = f, m[2]
    tokens = _TOKEN.findall(text)
    team = tokens[:1] == ["team"]
    tokens = [t for i, t in enumerate(tokens) if t not in FILLERS or i == 0 and t != "team"]
    legal = []
    while len(tokens) > 1 and tokens[-1] in LEGAL and not (tokens[-1] in initial and len(tokens) == 2):
        legal.insert(0, LEGAL[tokens.pop()])
    field = front
    if not field and len(tokens) > 2:
        if len(tokens) > 3 and field_of("".join(tokens[-2:])) == "".join(tokens[-2:]):
            field = "".join(tokens[-2:])
            tokens = tokens[:-2]
        elif f := field_of(tokens[-1]):
            field, tokens = f, tokens[:-1]
    elif not field and len(tokens) == 2 and (tokens[-1] in FIELDS or len(tokens[0]) >= JOINED and field_of(tokens[-1])):
        field, tokens = field_of(tokens[-1]), tokens[:-1]
    kind = "full"
    if len(tokens) == 1 and not legal and not field and len(tokens[0]) < JOINED:
        kind = "team" if team else "one"
    return {"words": tokens, "field": field, "legal": "".join(legal), "alias": alias, "kind": kind}


def _parts(batches: Iterator) -> Iterator:
    import pyarrow as pa

    names = ["name", "n", "core", "turns", "words", "field", "initials", "alias", "kind"]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string()), pa.string(), pa.string(), pa.string(), pa.string()]
    for batch in batches:
        rows = []
        for name, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            p = parse(name)
            words = p["words"]
            turns = sorted({"".join(words[i:] + words[:i]) for i in range(len(words))}) if len(words) <= 6 else ["".join(words)]
            core = turns[0] if turns else None
            turns = sorted({*turns, "".join(sorted(words))} - {""})  # the last meets the same words in any order
            initials = "".join(w[0] for w in words) + (p["field"] or "")[:1] + p["legal"]
            rows.append((name, n, core, turns, words, p["field"], initials, p["alias"], p["kind"]))
        columns = list(zip(*rows)) or [()] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def _skeleton(word: str):
    return F.regexp_replace(word, "(?<=.)[aeiou]", "")


def link_names(names: DataFrame) -> DataFrame:
    """``name, entity`` for each distinct spelling in column ``name``; equal ``entity``, same organisation.

    Null and blank names are left out; a name is compared exactly as written, so two
    spellings that differ by a space are two. Copies count as attestation. Which class
    gives the entity its id depends on the names only, not on their order.
    """
    counted = names.select(F.col("name")).filter(r"name is not null and name rlike '(?U)\\S'").groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    parts = cut_lineage(counted.mapInArrow(
        _parts,
        "name string, n bigint, core string, turns array<string>, words array<string>, field string, initials string, alias string, kind string",
    ))
    whole = parts.filter("kind = 'full' and core <> ''")
    # a class: a core in any order of its words
    cores = cut_lineage(whole.groupBy("core").agg(
        F.sum("n").alias("n"),
        F.max_by("words", F.struct(F.size("words") == 2, "n", "name")).alias("words"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("turns")))).alias("turns"),
        F.max_by("field", F.struct(F.col("field").isNotNull(), "n", "name")).alias("field"),
        F.max(F.size("words") == 2).alias("paired"),
    ))
    better = (F.col("tn") > F.col("n")) | (F.col("tn") == F.col("n")) & (F.col("t") < F.col("core"))
    target = cores.select(F.col("core").alias("t"), F.col("n").alias("tn"), F.col("words").alias("tw"), F.col("field").alias("tf"))

    # typos: every turn of a core against the indexed cores and their turns
    turned = cores.select("core", F.explode("turns").alias("t"))
    probes = cores.select("core", "n", F.explode("turns").alias("s"))
    near = segment_join(probes, turned.select("t"), EDITS + 1).join(
        turned.select("t", F.col("core").alias("tcore")), "t"
    ).select("core", "n", F.col("tcore").alias("t"), "distance").filter("core <> t")
    near = near.groupBy("core", "n", "t").agg(F.min("distance").alias("distance"))
    near = near.join(target, "t").filter(better).join(cores.select("core", "words"), "core")
    # an edit more where each of two words has its own
    each = lambda i, j: F.levenshtein(F.col("words")[i], F.col("tw")[j], EDITS) >= 0
    spread = (F.size("words") == 2) & (F.size("tw") == 2) & (each(0, 0) & each(1, 1) | each(0, 1) & each(1, 0))
    # in a core of three letters one edit is a typo, two are another name
    tiny = F.least(F.length("core"), F.length("t")) <= EDITS + 1
    near = near.filter(F.when(tiny, (F.col("distance") <= 1) & (F.length("core") > 2) & (F.length("t") > 2)).otherwise((F.col("distance") <= EDITS) | spread))
    pick = Window.partitionBy("core").orderBy("distance", F.col("tn").desc(), "t")
    typos = near.withColumn("r", F.row_number().over(pick)).filter("r = 1").select("core", "t")

    # shortened words: the consonants or the initial of one word, the other as it is
    pairs = cores.filter(F.col("paired") & (F.size("words") == 2))
    long = target.filter((F.size("tw") == 2) & (F.length(F.col("tw")[0]) > 2) & (F.length(F.col("tw")[1]) > 2))
    keys = []
    for a, b in ((0, 1), (1, 0)):
        w, v = F.col("tw")[a], F.col("tw")[b]
        keys.append(long.select("t", "tn", "tf", w.alias("fixed"), F.explode(F.array(
            F.regexp_replace(v, "(?<=.)[aeiou]", ""), F.regexp_replace(v, "[aeiou]", ""), F.substring(v, 1, 1),
        )).alias("short")))
    keys = keys[0].union(keys[1]).distinct()
    shorts = []
    for a, b in ((0, 1), (1, 0)):
        w, v = F.col("words")[a], F.col("words")[b]
        shorts.append(pairs.select("core", "n", "field", w.alias("fixed"), v.alias("short")).filter(
            ~F.col("short").rlike("(?<=.)[aeiou]") & (F.length("fixed") > 2)
        ))
    shorts = shorts[0].union(shorts[1])
    short = shorts.join(keys, ["fixed", "short"]).filter(
        (F.col("core") != F.col("t")) & (F.col("field").isNull() | F.col("tf").isNull() | (F.col("field") == F.col("tf")))
    ).filter(better)
    shortened = _clear(short.select("core", "t", "tn"), "core")

    links = cut_lineage(typos.withColumn("way", F.lit(1)).union(shortened.withColumn("way", F.lit(0))))
    one = Window.partitionBy("core").orderBy("way", "t")
    links = links.withColumn("r", F.row_number().over(one)).filter("r = 1").select("core", "t")
    roots = _follow(cores.select("core").join(links, "core", "left").select("core", F.coalesce("t", "core").alias("root")))
    named = cut_lineage(whole.join(roots, "core").select("name", "n", "words", "initials", "alias", "root"))

    # one word, or the initials of all: they mean the best attested organisation that has them
    size = named.groupBy("root").agg(F.sum("n").alias("tn"))
    # how an organisation is written in full most often decides on which word comes first
    order = named.filter("size(words) = 2").groupBy("root").agg(F.max_by("words", F.struct("n", "name")).alias("w"))
    sized = order.join(size, "root")
    firsts = sized.select(F.col("w")[0].alias("key"), F.lit("one").alias("kind"), F.col("root").alias("t"), "tn")
    seconds = sized.select(F.col("w")[1].alias("key"), F.lit("team").alias("kind"), F.col("root").alias("t"), "tn")
    lone = parts.filter("kind in ('one', 'team')").select("name", F.col("words")[0].alias("key"), "kind")
    by_word = _clear(lone.join(firsts.union(seconds), ["key", "kind"]).select("name", "t", "tn"), "name")
    by_word = cut_lineage(by_word)
    by_typo = _mistyped(lone.join(by_word.select("name"), "name", "left_anti"), firsts.union(seconds), parts)
    by_word = by_word.union(by_typo)
    full = named.groupBy("root", "initials").agg(F.sum("n").alias("n"))
    said = named.filter("alias is not null").groupBy("root", F.col("alias").alias("initials")).agg(F.sum("n").alias("n"))
    # initials given in brackets count before initials that only fit
    known = said.withColumn("told", F.lit(1)).union(full.withColumn("told", F.lit(0))).join(size, "root")
    known = known.groupBy("initials", "root").agg(F.max("told").alias("told"), F.max("tn").alias("tn"))
    top = Window.partitionBy("initials")
    known = known.withColumn("most", F.max("told").over(top)).filter("told = most")
    acronyms = parts.filter("kind = 'initials'").select("name", F.col("alias").alias("initials"))
    by_initials = _clear(acronyms.join(known, "initials").select("name", F.col("root").alias("t"), "tn"), "name")

    loose = parts.filter("kind <> 'full' or core is null or core = ''").select("name").join(
        by_word.union(by_initials).withColumnRenamed("t", "root"), "name", "left"
    )
    # a short form of nobody is its own organisation, under its letters
    letters = F.regexp_replace(F.lower("name"), r"[^\p{L}\p{N}]", "")
    own = F.concat(F.lit("~"), F.when(letters != "", letters).otherwise(F.col("name")))
    rest = loose.select("name", F.coalesce("root", own).alias("entity"))
    return named.select("name", F.col("root").alias("entity")).union(rest)


def _mistyped(lone: DataFrame, keys: DataFrame, parts: DataFrame) -> DataFrame:
    """``name, t`` of single words that no organisation has: the one whose word lies one edit away, or two in ``SURE`` letters and more.

    A word that is itself attested as often as the one it resembles is no typo of it.
    Words that resemble each other only become one under the better attested of them.
    """
    said = parts.filter("kind in ('one', 'team')").select(F.col("words")[0].alias("key"), "kind", "n").groupBy("key", "kind").agg(F.sum("n").alias("own"))
    words = lone.select("key", "kind").distinct().join(said, ["key", "kind"])
    targets = keys.select("key", "kind", F.col("t").alias("root"), "tn").union(
        words.select("key", "kind", F.concat(F.lit("~"), "key"), F.col("own").alias("tn"))
    )
    near = segment_join(words.withColumn("s", F.col("key")), targets.select(F.col("key").alias("t")), EDITS)
    fits = (F.col("distance") == 1) & (F.length("s") >= 5) | (F.col("distance") == 2) & (F.length("s") >= SURE)
    near = near.filter("distance > 0").filter(fits).select("key", "kind", "own", F.col("t").alias("other"))
    found = near.join(targets.withColumnRenamed("key", "other"), ["other", "kind"]).filter("tn > own or tn = own and other < key")
    links = _clear(found.select(F.concat_ws("|", "kind", "key").alias("key"), F.col("root").alias("t"), "tn"), "key")
    return lone.select("name", F.concat_ws("|", "kind", "key").alias("key")).join(links, "key").select("name", "t")


def _clear(candidates: DataFrame, key: str) -> DataFrame:
    """``key, t``: the best attested candidate, where it leads clearly."""
    c = candidates.groupBy(key, "t").agg(F.max("tn").alias("tn"))
    w = Window.partitionBy(key).orderBy(F.col("tn").desc(), "t")
    c = c.withColumn("r", F.row_number().over(w)).withColumn("next", F.lead("tn").over(w))
    return c.filter((F.col("r") == 1) & (F.col("next").isNull() | (F.col("tn") >= LEAD * F.col("next")))).select(key, "t")


def _follow(links: DataFrame) -> DataFrame:
    """``core, root`` with every link followed to its end by doubling; links only lead to better attested cores.

    Each round is materialised, so the plan doesn't double with the steps, and the
    rounds end when nothing moves.
    """
    links = cut_lineage(links)
    while True:
        far = links.select(F.col("core").alias("root"), F.col("root").alias("far"))
        step = cut_lineage(links.join(far, "root").select("core", F.col("far").alias("root"), (F.col("far") != F.col("root")).alias("moved")))
        links = step.drop("moved")
        if not step.filter("moved").head(1):
            return links


RECORDS = "records_project_manager__scrum_master"
EXCLUSIONS = "employer_cap_exclusions"


def _entities(spark: SparkSession, folder: str) -> DataFrame:
    a = table(spark, folder, RECORDS).select(F.col("raw.company.display_name").alias("name"))
    b = table(spark, folder, EXCLUSIONS).select(F.col("employer").alias("name"))
    return link_names(a.union(b))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Each pair of different spellings of one organisation."""
    e = cut_lineage(_entities(spark, folder))
    a, b = e.select("entity", F.col("name").alias("name_a")), e.select("entity", F.col("name").alias("name_b"))
    return a.join(b, "entity").filter("name_a < name_b").select("name_a", "name_b")


def p4_entities(spark: SparkSession, folder: str) -> DataFrame:
    """Each spelling with its organisation."""
    return _entities(spark, folder)


QUERIES = {"p4_found": p4_found, "p4_entities": p4_entities}
SQL: dict[str, str] = {}
