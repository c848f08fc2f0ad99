"""A rule engine for short texts: rules become literal patterns, unrolled into one projection."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.text import norm_title


#: Letters of a phrase by which texts look it up.
KEY = 4


@dataclass(frozen=True)
class Rule:
    """A label with the patterns that call for it and those that forbid it; of rules of one ``overlap`` group the highest ``priority`` wins."""

    label: str
    match: Sequence[str]
    exclude: Sequence[str] = ()
    overlap: str | None = None
    priority: int = 0
    enabled: bool = True


def override(rules: Sequence[Rule], changes: Mapping[str, Mapping[str, object]], added: Sequence[Rule] = ()) -> list[Rule]:
    """The enabled rules with some fields replaced and some rules added."""
    out = [replace(r, **changes.get(r.label, {})) for r in rules]
    return [r for r in [*out, *added] if r.enabled]


def from_config(config: Mapping[str, object]) -> list[Rule]:
    """The enabled rules of a configuration: ``roles`` with ``role``, ``match``, ``exclude``, ``overlap_group``, ``priority``, ``enabled``.

    A pattern that doesn't compile or a role without patterns is an error that names the role.
    """
    out = []
    for r in config.get("roles", []):
        name = r["role"]
        if not r.get("match"):
            raise ValueError(f"role {name!r} has no pattern")
        for p in [*r["match"], *r.get("exclude", [])]:
            try:
                re.compile(p)
            except re.error as e:
                raise ValueError(f"role {name!r}: {p!r}: {e}") from e
        out.append(Rule(name, tuple(r["match"]), tuple(r.get("exclude", ())), r.get("overlap_group"), int(r.get("priority", 0)), bool(r.get("enabled", True))))
    return [r for r in out if r.enabled]


def load(spark: SparkSession, path: str) -> list[Rule]:
    """The rules of one JSON file, wherever Spark can read it."""
    return from_config(json.loads(spark.read.option("wholetext", "true").text(path).first()[0]))


def _any(c: Column, patterns: Sequence[str]) -> Column:
    return c.rlike("|".join(f"(?:{p})" for p in patterns)) if patterns else F.lit(False)


def classify(df: DataFrame, text: str, rules: Sequence[Rule]) -> DataFrame:
    """``df`` with ``normalized``, ``candidates``, ``label``, ``status`` and ``tier``.

    A rule fires where a pattern matches the normalised text and none forbids it. One
    label left after overlap groups: ``mapped``, and ``tier`` says whether its first
    pattern matched. More: ``ambiguous``. None, but one forbidden: ``excluded``. None at
    all: ``unmatched``. Null and blank texts are unmatched.
    """
    # the normal form is computed once: it becomes a column before the rules read it
    base = df.withColumn("normalized", norm_title(F.col(text)))
    t = F.col("normalized")
    fired = {r.label: _any(t, r.match) & ~_any(t, r.exclude) for r in rules}
    hit = {r.label: _any(t, r.match) for r in rules}
    wins = {}
    for r in rules:
        better = [o for o in rules if r.overlap and o.overlap == r.overlap and o.priority > r.priority]
        beaten = F.lit(False)
        for o in better:
            beaten = beaten | fired[o.label]
        wins[r.label] = fired[r.label] & ~beaten
    some = lambda d: F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in d.items()]))
    out = base.withColumn("candidates", some(wins)).withColumn("_hit", some(hit))
    n = F.size("candidates")
    out = out.withColumn("label", F.when(n == 1, F.col("candidates")[0])).withColumn(
        "status", F.when(n == 1, "mapped").when(n > 1, "ambiguous").when(F.size("_hit") > 0, "excluded").otherwise("unmatched")
    )
    tier = None
    for r in rules:
        step = F.when(t.rlike(r.match[0]), "canonical").otherwise("synonym")
        tier = F.when(F.col("label") == r.label, step) if tier is None else tier.when(F.col("label") == r.label, step)
    return out.withColumn("tier", tier).drop("_hit")


def contained(texts: DataFrame, text: str, phrases: DataFrame, phrase: str) -> DataFrame:
    """Each row of ``texts`` with each row of ``phrases`` whose phrase stands in its text, as an equi-join for any number of phrases.

    A phrase is looked up by its first ``KEY`` letters, a shorter one by all of it; a
    text by all its pieces of these lengths. Null and empty texts and phrases meet
    nothing. The two frames have no column in common.
    """
    size = F.least(F.lit(KEY), F.length(phrase))
    keyed = phrases.filter(F.col(phrase) != "").withColumn("_key", F.substring(F.col(phrase), F.lit(1), size))
    pieces = f"flatten(transform(sequence(1, {KEY}), k -> transform(sequence(1, greatest(length(`{text}`) - k + 1, 1)), i -> substring(`{text}`, i, k))))"
    looked = texts.filter(F.col(text) != "").withColumn("_key", F.explode(F.array_distinct(F.expr(pieces))))
    return looked.join(keyed, "_key").filter(F.contains(F.col(text), F.col(phrase))).drop("_key")


def scope(df: DataFrame, label: str, scopes: DataFrame, out: str = "scope") -> DataFrame:
    """``df`` with the scope of its label from a small table ``(label, scope)``, ``unknown`` where it has none."""
    s = scopes.select(F.col("label").alias("_l"), F.col("scope").alias(out))
    return df.join(s, F.col(label) == F.col("_l"), "left").drop("_l").fillna("unknown", [out])


#: Rules for job titles, as an example that the queries use.
TITLE_RULES = (
    Rule("Data Analyst", (r"\bdata analyst\b", r"\b(bi|reporting) analyst\b"), (r"\b(regulatory|financial) reporting\b",)),
    Rule("Business Analyst", (r"\bbusiness analyst\b",), ()),
    Rule("Data Engineer", (r"\bdata engineer\b",), ()),
    Rule("Software Engineer", (r"\bsoftware engineer\b", r"\bs w eng(g|r)?\b"), (r"\bin test\b", r"\bquality\b")),
    Rule("Security Engineer", (r"\bsecurity engineer\b",), (), "security", 0),
    Rule("Information Security Engineer", (r"\binformation security engineer\b",), (), "security", 1),
    Rule("Project Manager", (r"\bproject manager\b", r"\bprj m(n)?gr\b"), ()),
    Rule("Product Manager", (r"\bproduct manager\b",), ()),
    Rule("Scrum Master", (r"\bscrum ?master\b",), ()),
    Rule("Quality Engineer", (r"\bquality engineer\b",), (r"\b(software|test(ing)?|automation)\b",)),
    Rule("UX Designer", (r"\bui ux designer\b", r"\bux designer\b"), ()),
    Rule("Financial Analyst", (r"\bfinancial analyst\b", r"\bfp a analyst\b"), ()),
)
