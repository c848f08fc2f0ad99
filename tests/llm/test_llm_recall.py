"""Queries without SQL against what they must add up to, and recall on variants made from the test tables."""

import random
import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.llm import canonical, leakage, names, registry, truncation

DATA = "/root/testdata/sf0.001"
ALL = {n: f for m in registry.modules() for n, f in m.QUERIES.items()}


@pytest.fixture(scope="module")
def out(spark):
    known: dict[str, pd.DataFrame] = {}

    def get(name):
        if name not in known:
            known[name] = ALL[name](spark, DATA).toPandas()
        return known[name]

    return get


def records(name):
    r = pd.read_parquet(f"{DATA}/{name}.parquet")
    return pd.concat([pd.json_normalize(r.collection), pd.json_normalize(r.raw)], axis=1)


def blank(t):
    return not isinstance(t, str) or not t.strip()


def test_names_come_out_once_and_pairs_are_those_of_entities(out):
    given = {t for t in records("records_project_manager__scrum_master")["company.display_name"] if not blank(t)}
    given |= {t for t in pd.read_parquet(f"{DATA}/employer_cap_exclusions.parquet").employer if not blank(t)}
    e = out("p4_entities")
    assert set(e.name) == given and e.name.is_unique
    want = {(a, b) for _, g in e.groupby("entity") for a in g.name for b in g.name if a < b}
    assert set(out("p4_found").itertuples(index=False, name=None)) == want and len(out("p4_found")) == len(want)


def test_titles_come_out_once(out):
    given = {t for t in records("records_project_manager__scrum_master").title if not blank(t)}
    given |= {t for t in pd.read_parquet(f"{DATA}/human_validation_template.parquet").title if not blank(t)}
    f = out("p6_found")
    assert set(f.title) == given and f.title.is_unique
    assert set(f.ref_id) <= {0, *pd.read_parquet(f"{DATA}/title_reference.parquet").ref_id}
    assert set(out("p6_unmatched").title) == set(f[f.ref_id == 0].title)


def test_cut_records_and_shares_agree(out):
    r = records("records_graphic_designer__visual_designer")
    found = set(out("p7_found").itertuples(index=False, name=None))
    keys = set(r[["run_id", "adzuna_id"]].itertuples(index=False, name=None))
    assert found <= keys and not found & set(r[r.description.map(blank)][["run_id", "adzuna_id"]].itertuples(index=False, name=None)) - set(
        r[~r.description.map(blank)][["run_id", "adzuna_id"]].itertuples(index=False, name=None)
    )
    s = out("p7_share").set_index("source")
    assert s.records.to_dict() == r.groupby(r.source.fillna("")).size().to_dict()
    assert s.share.between(0, 1).all() and s.cut.sum() >= len(found)


def test_spans_hold_the_words_of_their_items(out):
    docs = pd.read_parquet(f"{DATA}/documents.parquet").set_index("doc_id").text
    items = pd.read_parquet(f"{DATA}/eval_items.parquet").set_index("item_id").text
    spans = out("p9_spans")
    assert set(spans[["doc_id", "item_id"]].itertuples(index=False, name=None)) == set(out("p9_found").itertuples(index=False, name=None))
    for d, i, first, n in spans.itertuples(index=False):
        words, item = leakage.words_of(docs[d])[first : first + n], leakage.words_of(items[i])
        assert n >= 12 and all(any(words[k : k + 12] == item[j : j + 12] for j in range(len(item))) for k in range(n - 11))


def mistyped(rng, word):
    """A swap of two letters, or a letter lost, doubled or replaced; the first one stays."""
    i = rng.randrange(1, len(word) - 1)
    kind = rng.randrange(4)
    if kind == 0 and word[i] != word[i + 1 : i + 2]:
        return word[:i] + word[i + 1 : i + 2] + word[i] + word[i + 2 :]
    return word[:i] + ("" if kind == 1 else word[i] * 2 if kind == 2 else rng.choice("aeionrst")) + word[i + 1 :]


def test_recall_of_typed_titles(spark):
    rng = random.Random(21)
    ref = pd.read_parquet(f"{DATA}/title_reference.parquet")
    truth = {}
    for i, title in ref[["ref_id", "ref_title"]].itertuples(index=False):
        for n in range(8):
            words = title.split(" ")
            if n % 2:
                at = max(range(len(words)), key=lambda k: len(words[k]))
                words[at] = mistyped(rng, words[at]) if len(words[at]) > 4 else words[at]
            text = " ".join(words[::-1] if n == 4 else words)
            text = rng.choice(["Senior ", "Sr. ", "", "Lead - "]) + text + rng.choice(["", " (Remote)", " - Pune", " [R-12]"])
            truth.setdefault(text.upper() if n == 6 else text, set()).add(i)
    truth = {t: i for t, i in truth.items() if len(i) == 1}
    got = canonical.map_values(spark.createDataFrame([(t,) for t in truth], "value string"), spark.createDataFrame(ref[["ref_id", "ref_title"]]).toDF("ref_id", "ref"))
    right = sum(r["ref_id"] in truth[r["value"]] for r in got.collect())
    assert right / len(truth) >= 0.9


def test_recall_of_typed_names(spark):
    rng = random.Random(22)
    first, second = ["Zalkote", "Mirhawi", "Pimekpo", "Burtango", "Ferlisto", "Quandero", "Wexcombe", "Haldrian"], ["Vohbehu", "Idnupon", "Kestralo", "Jumbraki", "Nortevia", "Sandalup", "Torvanek", "Gelmaris"]
    full = [f"{a} {b} {f} {k}" for a, b, f, k in zip(first, second, ["Services", "Labs", "Analytics", "Systems"] * 2, ["LLP", "Inc", "Ltd", "Group"] * 2)]
    rows, truth = [], {}
    for i, name in enumerate(full):
        a, b, field, legal = name.split(" ")
        forms = [name, name.upper(), f"{b} {a} {field} {legal}", f"{a} {b} {field}", f"{mistyped(rng, a)} {b} {field} {legal}", f"{a} {mistyped(rng, b)} {field} {legal}", f"{a} & {b} {field}", f"{a}  {b} {field}, {legal}"]
        truth |= dict.fromkeys(forms, i)
        rows += [name] * 20 + forms
    got = {r["name"]: r["entity"] for r in names.link_names(spark.createDataFrame([(r,) for r in rows], "name string")).collect()}
    pairs = [(a, b) for a in truth for b in truth if a < b]
    same = [p for p in pairs if truth[p[0]] == truth[p[1]]]
    linked = [p for p in pairs if got[p[0]] == got[p[1]]]
    both = set(same) & set(linked)
    assert len(both) / len(same) >= 0.9 and len(both) / len(linked) >= 0.98


def test_recall_of_cut_texts(spark):
    rng = random.Random(23)
    r = records("records_project_manager__scrum_master").drop_duplicates("description")
    whole = [t for t in r.description if not blank(t) and re.search(r"[.!?]$", t) and len(t) > 120]
    rows, cut = [], set()
    for i, t in enumerate(whole):
        if i % 3 == 0:
            t = t[: rng.randrange(len(t) // 2, len(t) - 10)].rstrip(".!? ")
            cut.add(i)
        rows.append((i, "abc"[i // 3 % 3], t))  # each source cuts a third of its texts
    got = truncation.cut_texts(spark.createDataFrame(rows, "id int, s string, t string"), F.col("id"), F.col("s"), F.col("t")).collect()
    found = {x["row"] for x in got if x["cut"]}
    assert len(whole) > 50 and len(found & cut) / len(cut) >= 0.9 and len(found & cut) / len(found) >= 0.85
