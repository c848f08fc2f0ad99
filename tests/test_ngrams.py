"""Totals of n-grams against plain counting."""

import re
from collections import Counter, defaultdict

import pytest

from plumbline.operators import learn

ROWS = [
    (1, "red fox red fox red"), (2, "the red fox of red"), (3, ""), (4, "fox"), (5, None), (6, "a.b/c d1 a.b/c d1 x"), (7, "fox red fox"), (None, "red fox red fox"),
]


def brute(rows, least):
    n, docs = Counter(), defaultdict(set)
    for doc, text in rows:
        w = [x for x in re.findall(r"[a-z][a-z0-9]*(?:[./][a-z0-9]+)*", text or "") if len(x) > 1 and x not in learn.STOP]
        for pair in zip(w, w[1:]):
            n[" ".join(pair)] += 1
            docs[" ".join(pair)] |= {doc} - {None}
    return {g: k for g, k in n.items() if len(docs[g]) >= least}


@pytest.mark.parametrize("rows", [ROWS, [*ROWS, (1, "red fox"), (1, "big dog"), (1, "big dog")]])
def test_totals_equal_plain_counting(spark, rows):
    df = spark.createDataFrame(rows, "doc bigint, text string")
    for least in (1, 2, 3):
        assert {r["gram"]: r["n"] for r in learn.ngram_totals(df, "doc", "text", "gram", min_df=least).collect()} == brute(rows, least)


def test_no_vocabulary_is_cut_or_made_dense(spark, tmp_path, monkeypatch):
    from plumbline.plans import models

    monkeypatch.setattr(learn, "counts", None)  # a count vector holds a place for each word of the vocabulary
    spark.createDataFrame([(i, "Red fox") for i in range(20)] + [(99, "lone wolf")], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert [tuple(r) for r in models.bigram_counts(spark, str(tmp_path)).collect()] == [("red fox", 20)]
