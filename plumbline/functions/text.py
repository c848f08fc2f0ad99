"""Scalar text functions, as Catalyst expressions wherever Spark has the parts."""

from __future__ import annotations

import html
import unicodedata
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def norm_text(c: Column) -> Column:
    """Lower case, runs of anything but a-z and 0-9 as one space; null as ''."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " "))


@F.pandas_udf(StringType())
def _to_ascii(s: pd.Series) -> pd.Series:
    plain = lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode()
    return s.map(plain, na_action="ignore")


@F.pandas_udf(StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: t if t.isascii() else unicodedata.normalize("NFKC", t), na_action="ignore")


@F.pandas_udf(StringType())
def _unescape(s: pd.Series) -> pd.Series:
    return s.map(html.unescape, na_action="ignore")


def norm_title(c: Column) -> Column:
    """Like :func:`norm_text`, with accented letters as their base letters first."""
    return norm_text(_to_ascii(c))


def norm_description(c: Column) -> Column:
    """Compatibility forms composed, invisible and control characters and a closing ellipsis gone, white space collapsed, lower case; null as ''."""
    t = _nfkc(F.coalesce(c, F.lit("")))
    t = F.regexp_replace(t, "[​‌‍⁠﻿]", "")
    t = F.regexp_replace(t, r"\p{Cc}", " ")
    t = F.trim(F.regexp_replace(t, r"(?U)\s+", " "))
    return F.lower(F.trim(F.regexp_replace(t, r"(\.\.\.|…)\s*$", "")))


def clean_text(c: Column) -> Column:
    """URLs and mail addresses as a space, lower case, white space collapsed; null as ''."""
    t = F.regexp_replace(F.coalesce(c, F.lit("")), r"https?://\S+|www\.\S+", " ")
    t = F.regexp_replace(t, r"[\w.+-]+@[\w-]+\.[\w.-]+", " ")
    return F.trim(F.regexp_replace(F.lower(t), r"(?U)\s+", " "))


def strip_markup(c: Column) -> Column:
    """Tags as a space, then only letters, digits, white space and ``+#./-``."""
    t = F.regexp_replace(F.coalesce(c, F.lit("")), "<[^>]*>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(t), "[^a-z0-9+#./\\s-]", " "), r"\s+", " "))


def decode_entities(c: Column) -> Column:
    """HTML entities as their characters, URLs as a space."""
    return F.regexp_replace(_unescape(c), r"https?://\S+", " ")


def has_word(c: Column, word: str) -> Column:
    """Whether ``word`` stands in lower-case text ``c`` with no letter, digit, ``+`` or ``#`` beside it."""
    safe = "".join("\\" + x if not x.isalnum() and x != " " else x for x in word.lower())
    return c.rlike(f"(?<![a-z0-9+#]){safe}(?![a-z0-9+#])")


def loose_word(c: Column, word: str) -> Column:
    """The same with letters only as neighbours, and space, underscore or hyphen between its parts."""
    return c.rlike("(?i)(?<![a-z])" + "[ _-]*".join(word.split()) + "(?![a-z])")


def matched_terms(c: Column, terms: Sequence[str]) -> Column:
    """The terms that stand in lower-case text ``c``, in their order."""
    return F.array_compact(F.array(*[F.when(has_word(c, t), F.lit(t)) for t in terms]))


def first_match(c: Column, patterns: Mapping[str, str], default: str | None = None) -> Column:
    """The label of the first pattern that matches, case aside."""
    out = None
    for label, p in patterns.items():
        out = F.when(c.rlike("(?i)" + p), label) if out is None else out.when(c.rlike("(?i)" + p), label)
    return out.otherwise(F.lit(default))


def first_number(c: Column, pattern: str) -> Column:
    """The first capture of ``pattern``, a run of up to nine digits, as an int; null without one."""
    got = F.regexp_extract(F.lower(c), pattern, 1)
    return F.when(got.rlike("^[0-9]{1,9}$"), got.cast("int"))


def mask_tokens(c: Column, drop: Column | Sequence[str]) -> Column:
    """Text without the words in ``drop``; other words stay in their order, repeats included."""
    stop = drop if isinstance(drop, Column) else F.array(*[F.lit(d) for d in drop])
    return F.array_join(F.filter(F.split(c, " "), lambda t: ~F.array_contains(stop, t)), " ")


def foreign_share(c: Column) -> Column:
    """Share of letters outside ASCII; null without letters."""
    letters = F.length(F.regexp_replace(c, r"[^\p{L}]", ""))
    plain = F.length(F.regexp_replace(c, "[^A-Za-z]", ""))
    return F.try_divide(letters - plain, letters)


def group_key(c: Column) -> Column:
    """Lower-case letters and digits only; null as ''."""
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]", "")


def slug(c: Column) -> Column:
    """Words joined by underscores."""
    return F.regexp_replace(norm_text(c), " ", "_")


def redact(c: Column, names: Sequence[str] = ("app_id", "app_key", "api_key", "token")) -> Column:
    """The values of secret parameters as ``***``."""
    return F.regexp_replace(c, "(?i)\\b(" + "|".join(names) + ")=[^&\\s]+", "$1=***")


def is_missing(c: Column) -> Column:
    """Null or blank."""
    return c.isNull() | (F.trim(c) == "")


def python_literal(c: Column, schema: str) -> Column:
    """A dict typed as a Python literal (single quotes, ``None``, ``True``, ``False``) as a struct; null where it isn't one.

    Only bare words are rewritten, those after a sign of the literal and before the next one.
    """
    bare = r"((?:^|[,:\[{(])\s*)(?:%s)(?=\s*(?:[,\]}:)]|$))"
    for word, plain in (("None", "null"), ("True", "true"), ("False", "false")):
        c = F.regexp_replace(c, bare % word, f"$1{plain}")
    return F.from_json(c, schema, {"allowSingleQuotes": "true"})
