"""Bringing visually identical text to one form, with DuckDB inside Arrow partitions.

Each Arrow batch is a table to an embedded DuckDB, whose SQL removes invisible
characters, composes accents, and maps wide and compatibility forms, odd spaces
and look-alike letters. Case, digits, accents, line breaks and every letter that
reads differently stay as they are.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.session import cut_lineage
from plumbline.sources.tables import table

# Letters that look like the Latin letter below them; Cyrillic, Greek, Armenian, Cherokee, phonetic.
LOOK_FROM = "АВЕЅІЈКМНОРСТУХаеорсухѕіјһԁԛԝҮӀԌԚԜѴѵӏ" "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοϲϳν" "օսհց" "ᎪᏴᏟᎠᎬᏀᎻᎫᏦᏞᎷᏢᎡᏚᎢᏙᏔᏃ" "ɑɡ"
LOOK_INTO = "ABESIJKMHOPCTYXaeopcyxsijhdqwYIGQWVvl" "ABEZHIKMNOPTYXocjv" "ouhg" "ABCDEGHJKLMPRSTVWZ" "ag"
# Spaces that show as a space, hyphens that show as a hyphen.
SPACES = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
HYPHENS = "\u2010\u2011"
# Characters without any width, as a regular expression.
INVISIBLE = r"[\x{00AD}\x{034F}\x{061C}\x{180E}\x{200B}\x{200E}\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{2066}-\x{2069}\x{FEFF}]"
# Signs after which a joiner changes what is shown.
VIRAMAS = r"\x{094D}\x{09CD}\x{0A4D}\x{0ACD}\x{0B4D}\x{0BCD}\x{0C4D}\x{0CCD}\x{0D4D}"


#: What a compatibility form is called in the Unicode data if it looks like its plain form: width, font, place in a word.
SHOWN_ALIKE = {"<wide>", "<narrow>", "<font>", "<isolated>", "<initial>", "<medial>", "<final>", "<noBreak>"}


@lru_cache(maxsize=1)
def _tables() -> tuple[dict[str, str], dict[str, str], dict[str, str]]:
    """What each character is replaced by: everyday characters, further single ones, and those that become several.

    All but the look-alike letters comes from the Unicode data: compatibility forms of
    the kinds ``SHOWN_ALIKE``, ligatures and numerals made of letters, and accented
    look-alike letters as their Latin letter with the same accents. Superscripts,
    fractions, circled and squared signs read differently and stay.
    """
    look = dict(zip(LOOK_FROM, LOOK_INTO))
    common, rare, more = look | dict.fromkeys(SPACES, " ") | dict.fromkeys(HYPHENS, "-"), {}, {}
    for code in [*range(0xA0, 0xD800), *range(0xF900, 0x20000)]:
        char = chr(code)
        kind, _, _ = unicodedata.decomposition(char).partition(" ")
        if not kind or char in common:
            continue
        plain = unicodedata.normalize("NFKC", char)
        if not kind.startswith("<"):
            parts = unicodedata.normalize("NFD", char)
            plain = unicodedata.normalize("NFC", look.get(parts[0], parts[0]) + parts[1:])
            fits = parts[0] in look
        elif kind == "<compat>":
            letters = unicodedata.category(char)[0] == "L" and len(plain) > 1 or unicodedata.category(char) == "Nl"
            fits = letters and all(unicodedata.category(c)[0] in "LM" for c in plain) and unicodedata.category(plain[0])[0] == "L"
        else:
            fits = kind in SHOWN_ALIKE
        if fits and plain != char:
            if len(plain) == 1:
                (common if 0xFF00 <= code < 0xFFF0 or not kind.startswith("<") else rare)[char] = plain
            elif kind == "<compat>" or not kind.startswith("<"):
                more[char] = plain
    common.update({"\uff9e": "\u3099", "\uff9f": "\u309a"})  # sound marks that compose with the sign before them
    return common, rare, more


def _class(chars) -> str:
    """A regular expression for any of some characters."""
    codes, spans = sorted(map(ord, chars)), []
    for c in codes:
        if spans and spans[-1][1] == c - 1:
            spans[-1][1] = c
        else:
            spans.append([c, c])
    return "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in spans) + "]"


def fold_sql(column: str) -> str:
    """The SQL expression that folds ``column``."""
    common, rare, more = _tables()
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    mapped = lambda t, m: f"translate({t}, {quote(''.join(m))}, {quote(''.join(m.values()))})"
    look = dict(zip(LOOK_FROM, LOOK_INTO))
    text = f"regexp_replace({column}, '{INVISIBLE}', '', 'g')"
    text = f"regexp_replace({text}, '(^|[^{VIRAMAS}])\\x{{200C}}+', '\\1', 'g')"
    text = f"regexp_replace({text}, '(^|[\\p{{L}}\\p{{N}}\\p{{P}}\\p{{Z}}\\s])\\x{{200D}}+', '\\1', 'g')"
    text = f"replace({text}, chr(13) || chr(10), chr(10))"
    # a look-alike letter before its accents compose, and the composed ones
    text = mapped(f"nfc_normalize({mapped(text, look)})", common)
    special = text
    for char, plain in more.items():
        special = f"replace({special}, {quote(char)}, {quote(plain)})"
    special = mapped(special, rare)
    text = f"CASE WHEN regexp_matches({column}, '{_class([*rare, *more])}') THEN {special} ELSE {text} END"
    # most texts are plain: they are left alone
    return f"CASE WHEN regexp_full_match({column}, '[\\x00-\\x0C\\x0E-\\x7F]*') THEN {column} ELSE nfc_normalize({text}) END"


@lru_cache(maxsize=1)
def _python_tables() -> tuple[dict[int, str], dict[int, str], re.Pattern, re.Pattern, re.Pattern]:
    common, rare, more = _tables()
    plain = lambda p: re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: "\\u" + m[1], p)
    return (
        {ord(a): b for a, b in zip(LOOK_FROM, LOOK_INTO)},
        {ord(a): b for a, b in (more | rare | common).items()},
        re.compile(plain(INVISIBLE)),
        re.compile(f"(^|[^{plain(VIRAMAS)}])\u200c+"),
        re.compile("(^|[\\w\\s])\u200d+"),
    )


def fold_python(text: str) -> str:
    """The same form for operators that hold a text in Python already."""
    if text.isascii():
        return text.replace("\r\n", "\n")
    look, chars, invisible, disjoiner, joiner = _python_tables()
    text = joiner.sub(r"\1", disjoiner.sub(r"\1", invisible.sub("", text))).replace("\r\n", "\n")
    return unicodedata.normalize("NFC", unicodedata.normalize("NFC", text.translate(look)).translate(chars))


def _run(batches: Iterator, query: str) -> Iterator:
    import duckdb
    import pyarrow as pa

    con = duckdb.connect(config={"threads": 1, "memory_limit": "400MB"})
    for batch in batches:
        con.register("batch", pa.Table.from_batches([batch]))
        yield from con.sql(query).to_arrow_table().to_batches()
        con.unregister("batch")


def fold_text(df: DataFrame, id_col: str, text_col: str, out: str = "folded") -> DataFrame:
    """``id_col`` and the text in its one form. Null stays null, blank texts stay blank."""
    src = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    query = f"SELECT id, {fold_sql('t')} AS f FROM batch"
    kind = src.schema["id"].dataType.simpleString()
    return src.mapInArrow(lambda it: _run(it, query), f"id {kind}, f string").select(
        F.col("id").alias(id_col), F.col("f").alias(out)
    )


def same_look(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``a, b``: the pairs of ids, ``a`` the smaller, whose texts differ and look the same.

    Null and blank texts take no part; equal texts are no pair. Only two digests of
    each text are shuffled. Pairs are first made between classes of equal texts, so
    no two copies are ever compared, and then expanded to ids.
    """
    src = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).filter("id is not null and t is not null")
    kind = src.schema["id"].dataType.simpleString()
    blank = r"[\s\p{Z}]*"
    query = (
        f"SELECT id, md5(f) AS look, md5(t) AS exact FROM (SELECT id, t, {fold_sql('t')} AS f FROM batch)"
        f" WHERE NOT regexp_full_match(f, '{blank}')"
    )
    keys = src.mapInArrow(lambda it: _run(it, query), f"id {kind}, look string, exact string")
    keys = cut_lineage(keys)
    texts = keys.groupBy("look", "exact").agg(F.count(F.lit(1)).alias("n"))
    mixed = texts.groupBy("look").agg(F.min("exact").alias("lo"), F.max("exact").alias("hi")).filter("lo <> hi").select("look")
    classes = texts.join(mixed, "look", "left_semi").select("look", "exact")
    pairs = classes.select("look", F.col("exact").alias("ea")).join(
        classes.select("look", F.col("exact").alias("eb")), "look"
    ).filter("ea < eb")
    left = keys.select("look", F.col("exact").alias("ea"), F.col("id").alias("x"))
    right = keys.select("look", F.col("exact").alias("eb"), F.col("id").alias("y"))
    return pairs.join(left, ["look", "ea"]).join(right, ["look", "eb"]).select(
        F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")
    ).filter("a <> b").distinct()


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    """Each pair of documents that look the same and aren't equal."""
    return same_look(table(spark, folder, "documents"), "doc_id", "text").select(
        F.col("a").alias("doc_id_a"), F.col("b").alias("doc_id_b")
    )


def p10_folded(spark: SparkSession, folder: str) -> DataFrame:
    """Each text in its one form."""
    return fold_text(table(spark, folder, "documents"), "doc_id", "text")


QUERIES = {"p10_found": p10_found, "p10_folded": p10_folded}

_F = fold_sql("text")
SQL = {
    "p10_found": f"""
        WITH f AS (SELECT doc_id, text, {_F} AS folded FROM documents WHERE text IS NOT NULL),
        g AS (SELECT * FROM f WHERE NOT regexp_full_match(folded, '[\\s\\p{{Z}}]*'))
        SELECT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM g a JOIN g b
        ON a.folded = b.folded AND a.doc_id < b.doc_id AND a.text <> b.text""",
    "p10_folded": f"SELECT doc_id, {_F} AS folded FROM documents",
}
