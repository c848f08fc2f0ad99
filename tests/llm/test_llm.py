"""The operators for training data against brute force, round trips and awkward inputs."""

import random
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import canonical, capping, encoding, history, leakage, lookalike, names, percentiles, segmentjoin, truncation
from plumbline.session import new_folder

LONG = "lorem ipsum " * 20_000


# capping

CAPS = "grp string, who string, at int, id string, cap int, k0 int"


def kept(df, **how):
    score = [F.col("at"), -F.expr("try_cast(id as decimal(38,0))")]
    return capping.cap_contributors(df, [F.col("grp"), F.col("who")], score, F.col("id"), F.col("cap"), **how)


def test_cap_equals_sorting_with_heaps_and_with_runs(spark):
    rng = random.Random(1)
    rows = [("g%d" % rng.randrange(2), rng.choice(["hot"] * 5 + ["a", "b", None]), rng.choice([None, *range(6)]), str(i), 4, 0) for i in range(300)]
    want = set()
    for key in {(r[0], r[1]) for r in rows}:
        own = [r for r in rows if (r[0], r[1]) == key]
        own.sort(key=lambda r: (r[2] is None, -(r[2] or 0), int(r[3])))
        want |= {r[3] for r in (own if key[1] is None else own[:4])}
    df = spark.createDataFrame(rows, CAPS)
    assert {r["id"] for r in kept(df).collect()} == want
    assert {r["id"] for r in kept(df, heap_limit=1).collect()} == want
    gone = {r["id"] for r in kept(df, dropped=True).collect()}
    assert gone == {r[3] for r in rows} - want


def test_cap_edges(spark):
    df = spark.createDataFrame([("g", "w", 1, "x", 1, 7), ("g", "w", 1, "x", 1, 7), ("g", "w", None, None, 1, 7), (None, "w", 1, "y", 1, 7)], CAPS)
    assert sorted(str(r["id"]) for r in kept(df).collect()) == ["x", "y"]
    assert kept(df.filter("false")).count() == 0
    assert kept(df.withColumn("cap", F.lit(None).cast("int"))).count() == 1


@pytest.mark.parametrize("how", [{}, {"heap_limit": 1}])
def test_copies_on_the_edge_never_exceed_the_cap(spark, how):
    rows = [("g", "w", 5, "a", 3, 0)] + [("g", "w", 4, "b", 3, 0)] * 3 + [("g", "w", 4, "b", 3, 1), ("g", "v", 1, "b", 3, 0), ("g", "v", 1, "b", 3, 0)]
    df = spark.createDataFrame(rows, CAPS).withColumn("m", F.create_map(F.lit("x"), F.col("at")))
    stay = sorted(tuple(r)[:6] for r in kept(df, **how).collect())
    gone = sorted(tuple(r)[:6] for r in kept(df, dropped=True, **how).collect())
    assert len([r for r in stay if r[1] == "w"]) == 3 and len([r for r in stay if r[1] == "v"]) == 2
    assert sorted(stay + gone) == sorted(rows)


# percentiles

def exact(values, q):
    v = sorted(values)
    return v[max(1, int(np.ceil(q * len(v) - 1e-9))) - 1]


def test_percentiles_equal_sorting_also_for_a_hot_group(spark):
    rng = random.Random(2)
    rows = [("hot" if i % 3 else rng.choice(["a", None]), rng.choice([None, float("nan"), *(float(rng.randrange(50)) for _ in range(4))])) for i in range(2000)]
    df = spark.createDataFrame(rows, "t string, v double")
    c = percentiles.value_counts(df, F.col("t"), F.col("v"))
    for r in percentiles.percentiles(c, partitions=7).collect():
        own = [v for t, v in rows if t == r["g"] and v is not None and v == v]
        assert r["n"] == len(own) and all(r[k] == exact(own, q) for k, q in percentiles.QUARTS.items())


def test_percentiles_combine_over_days_and_bound_their_error(spark):
    df = spark.range(5000).select(F.lit("g").alias("t"), (F.pow(F.col("id") + 1, 1.5)).alias("v"), (F.col("id") % 4).alias("day"))
    parts = [percentiles.value_counts(df.filter(F.col("day") == d), F.col("t"), F.col("v")) for d in range(4)]
    whole = percentiles.percentiles(percentiles.value_counts(df, F.col("t"), F.col("v"))).first()
    assert percentiles.percentiles(percentiles.combine(*parts)).first() == whole
    for e in (0.01, 0.2):
        near = percentiles.percentiles(percentiles.value_counts(df, F.col("t"), F.col("v"), e)).first()
        assert all(abs(near[k] / whole[k] - 1) <= e for k in percentiles.QUARTS)


@pytest.mark.parametrize("e", [0.001, 0.01, 0.2])
def test_grid_keeps_its_bound(spark, e):
    rng = random.Random(11)
    df = spark.createDataFrame([(rng.choice([-1, 1]) * 10 ** rng.uniform(-6, 9),) for _ in range(20_000)], "v double")
    far = df.filter("v <> 0").select(F.max(F.abs(percentiles.on_grid(F.col("v"), e) / F.col("v") - 1))).first()[0]
    assert 0.9 * e < far <= e


def test_percentiles_of_nothing(spark):
    df = spark.createDataFrame([("a", None)], "t string, v double")
    assert percentiles.percentiles(percentiles.value_counts(df, F.col("t"), F.col("v"))).count() == 0


# segment join

def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@pytest.mark.parametrize("k", [1, 2, 3])
def test_segment_join_misses_no_pair(spark, k):
    rng = random.Random(k)
    base = ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 12))) for _ in range(120)]
    left = spark.createDataFrame([(s,) for s in base[:60]] + [(None,), ("",)], "s string")
    right = spark.createDataFrame([(s,) for s in base[60:]] + [(None,)], "t string")
    got = {(r["s"], r["t"], r["distance"]) for r in segmentjoin.segment_join(left, right, k).collect()}
    want = {(a, b, edits(a, b)) for a in base[:60] for b in base[60:] if edits(a, b) <= k and edits(a, b) < max(len(a), len(b))}
    assert got == want
    split = segmentjoin.segment_join(left, right, k, hot=2)
    assert {(r["s"], r["t"], r["distance"]) for r in split.collect()} == want


def test_segment_join_knows_short_strings(spark):
    one = lambda c, *v: spark.createDataFrame([(x,) for x in v], f"{c} string")
    got = {(r["s"], r["t"]): r["distance"] for r in segmentjoin.segment_join(one("s", "abc", "a", "xyz"), one("t", "abd", "ab", "q", "abcdef"), 3).collect()}
    assert got == {("abc", "abd"): 1, ("abc", "ab"): 1, ("abc", "abcdef"): 3, ("a", "ab"): 1, ("a", "abd"): 2}


# names

SAME = [
    ["Zalkote Vohbehu Services LLP", "ZALKOTE VOHBEHU SERVICES L.L.P.", "Vohbehu Zalkote Services LLP", "Zalkote & Vohbehu Svcs LLP", "Zalkoet Vohbehu Services LLP", "Services, Zalkote Vohbehu",
     "Zalkote Vohbehu Services LLP - Tenurvi", "Zalkoté  Vohbehu Services", "Zalk ote Vohbehu Services LLP", "ZalkoteVohbehu Services LLP", "Zalkote V. Services", "Zalkote Vhbh Services", "Zalkote",
     "Team Vohbehu", "ZVSL", "Z.V.S.L.", "Zalkote Vohbehu Services (ZVSLLP)"],
    ["Zalkote Mirhawi Labs Inc", "Zalkote Mirhawi Laboratories Incorporated"],
    ["Pimekpo Idnupon Analytics Inc"],
]


def test_names_link_variants_and_keep_other_words_apart(spark):
    rows = [(SAME[0][0],)] * 50 + [(n,) for g in SAME for n in g] + [(None,), (" ",)]
    got = {r["name"]: r["entity"] for r in names.link_names(spark.createDataFrame(rows, "name string")).collect()}
    assert len(got) == sum(map(len, SAME))
    sets = [{got[n] for n in g} for g in SAME]
    assert [len(s - {got[n] for n in ("ZVSL", "Z.V.S.L.") if n in g}) for s, g in zip(sets, SAME)] == [1, 1, 1]
    assert len(set.union(*sets)) <= 4


def test_names_of_nothing_and_odd_names(spark):
    assert names.link_names(spark.createDataFrame([], "name string")).count() == 0
    odd = ["???", "&", LONG[:5000], "a", "Ltd", "(P) Ltd", "日本 株式会社"]
    assert names.link_names(spark.createDataFrame([(o,) for o in odd], "name string, other int".split(",")[0])).count() == len(odd)


def test_names_of_one_word_may_be_mistyped(spark):
    rows = ["Google"] * 9 + ["Gogle", "Ikea", "Ikae", "IBM", "IBN", "Zalkote Vohbehu", "Zalkote Vohbehu", "Zalkot", "Abc Ltd", "Abc Ltd", "Abd Ltd", "Xy Ltd", "Zy Ltd"]
    got = {r["name"]: r["entity"] for r in names.link_names(spark.createDataFrame([(r,) for r in rows], "name string")).collect()}
    assert got["Google"] == got["Gogle"] and got["Zalkot"] == got["Zalkote Vohbehu"] and got["Abc Ltd"] == got["Abd Ltd"]
    assert got["IBM"] != got["IBN"] and got["Ikea"] != got["Ikae"] and got["Xy Ltd"] != got["Zy Ltd"]


def test_abbreviated_fields():
    assert [names.field_of(x) for x in ("svcs", "soln", "tech", "s", "networks", "analytix", "stfg", "zalkote")] == ["services", "solutions", "technologies", None, "networks", "analytics", "staffing", None]


# history

def brute(rows):
    sets = [(r, i, set(history.shingles(t).tolist()), history.group_key(g)) for r, i, t, g in rows]
    out = set()
    for r, i, s, g in sets:
        for r2, i2, s2, g2 in sets:
            if (r2 or "") < (r or ""):
                n = len(s & s2)
                c = n / min(len(s), len(s2)) if s and s2 else 0
                if i == i2 or c >= history.SURE or c >= history.THRESHOLD and n >= history.LEAST and g == g2:
                    out.add((r or "", i))
    return out


def batch_rows():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    house = " ".join(rng.choice(words) for _ in range(15))
    rows, texts = [], []
    for n in range(120):
        kind = n % 4
        if kind and texts:
            t, g = rng.choice(texts)
            w = t.split()
            if kind == 1:
                w[rng.randrange(len(w))] = "changed"
            elif kind == 2:
                w = w[: int(len(w) * 0.6)]
            else:
                rng.shuffle(w)
            t = " ".join(w)
        else:
            t, g = house + " " + " ".join(rng.choice(words) for _ in range(rng.randrange(10, 60))), rng.choice(["A", "B", None])
            texts.append((t, g))
        rows.append((f"run{n // 12:02d}", str(rng.randrange(100)), t, g))
    return rows + [("run01", "900", None, "A"), ("run05", "901", "", "A"), ("run06", "902", "Details on request.", "A"), ("run07", "903", "Details on request.", "A"), (None, "904", LONG, None), ("run03", "905", LONG + "!", None)]


def added(spark, p, runs, path=None, **how):
    """What an index finds in ``runs``, opened again for each."""
    path, got = path or new_folder(spark, "h"), set()
    for i, run in enumerate(runs):
        index = history.HistoryIndex(spark, path, n_buckets=3, **how)
        batch = p.filter(F.col("run") == run)
        if not i:
            index.fit(batch)
        got |= {(r["run"], r["id"]) for r in index.add(batch, run).collect()}
    return got


@pytest.mark.parametrize("fan", [2, 16])
def test_history_equals_brute_force_batch_by_batch(spark, fan):
    rows = batch_rows()
    df = spark.createDataFrame(rows, "run string, id string, t string, g string")
    p = history.prepare(df, F.col("run"), F.col("id"), F.col("t"), F.col("g")).cache()
    assert added(spark, p, sorted({r[0] or "" for r in rows}), fan=fan) == brute(rows)


def test_history_unfitted_gives_the_same_and_refuses_disorder(spark):
    rows = batch_rows()[:60]
    p = history.prepare(spark.createDataFrame(rows, "run string, id string, t string, g string"), F.col("run"), F.col("id"), F.col("t"), F.col("g")).cache()
    index, runs = history.HistoryIndex(spark, new_folder(spark, "h"), n_buckets=2), sorted({r[0] for r in rows})
    for run in runs:
        index.add(p.filter(F.col("run") == run), run)
    assert {(r["run"], r["id"]) for r in index.found().collect()} == brute(rows)
    with pytest.raises(ValueError):
        index.add(p, runs[-1])


def test_history_settles_hot_groups_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(history, "LONG", 3)
    rng = random.Random(8)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for n in range(90):
        w = list(base)
        for _ in range(rng.randrange(0, 7)):
            w[rng.randrange(60)] = f"x{rng.randrange(1000)}"
        rows.append((f"run{n // 30}", str(n), " ".join(w if n % 5 else [f"y{n}_{i}" for i in range(20)] + base[:12]), rng.choice("AB")))
    p = history.prepare(spark.createDataFrame(rows, "run string, id string, t string, g string"), F.col("run"), F.col("id"), F.col("t"), F.col("g")).cache()
    assert added(spark, p, ["run0", "run1", "run2"]) == brute(rows)


def test_history_reads_for_a_batch_what_the_batch_asks_for(spark, monkeypatch):
    monkeypatch.setattr(history, "GROUP_ROWS", dict.fromkeys(history.GROUP_ROWS, 8))
    rng = random.Random(9)
    text = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(40))
    schema, reads = "run string, id string, t string, g string", []
    last = [("z", "new", text(), "A"), ("z", "0-0", None, "A")]
    for runs in (2, 8):
        index = history.HistoryIndex(spark, new_folder(spark, "h"), n_buckets=2, fan=64, measure=True)
        for run in [f"{i:02d}" for i in range(runs)] + ["z"]:
            rows = last if run == "z" else [(run, f"{run}-{i}", text(), "A") for i in range(200 // runs)]
            index.add(history.prepare(spark.createDataFrame(rows, schema), F.col("run"), F.col("id"), F.col("t"), F.col("g")), run)
        reads.append(index.rows_read)
    small = history.HistoryIndex(spark, new_folder(spark, "h"), n_buckets=2, measure=True)
    for run, n in (("0", 40), ("1", 4000)):
        small.add(history.prepare(spark.createDataFrame([(run, f"{run}-{i}", text(), "A") for i in range(n)], schema), F.col("run"), F.col("id"), F.col("t"), F.col("g")), run)
    small.add(history.prepare(spark.createDataFrame(last, schema), F.col("run"), F.col("id"), F.col("t"), F.col("g")), "z")
    tokens = 36 * 2 * 2
    assert 0 < small.rows_read <= 2 * 8 * tokens
    assert all(0 < read <= 2 * 8 * tokens * 8 for read in reads)


# canonical titles

REF = [(1, "Project Manager"), (2, "Scrum Master"), (3, "Program Manager"), (4, "Software Engineer"), (5, "Data Analyst"), (8, "Migration Lead"), (6, None), (7, " ")]
TITLES = {
    "Project Manager": 1, "Sr. Proj Mgr (3-5 Years)": 1, "Manager, Project": 1, "PROJECT MANGER - Remote": 1, "Projcet Manager": 1, "ProjectManager": 1, "projectmanager": 1, "Srcum Master [Req-12]": 2,
    "Programme Mngr": 3, "LEAD PROJECT MGR": 1, "Lead Prj Mgr": 1, "Migration Ld": 8, "S/W Engg": 4, "Data Analysts": 5, "Master Mason": 0, "Project Photographer": 0, "???": 0, "Données Analyst": 0, "Data Pro-ject Manager": 1, LONG[:2000]: 0,
}


def test_titles(spark):
    df = spark.createDataFrame([(t,) for t in TITLES] * 2 + [(None,), ("  ",)], "value string")
    ref = spark.createDataFrame(REF, "ref_id int, ref string")
    got = canonical.map_values(df, ref).collect()
    assert {r["value"]: r["ref_id"] for r in got} == TITLES and len(got) == len(TITLES)
    none = canonical.map_values(df, ref.filter("false")).collect()
    assert len(none) == len(TITLES) and {r["ref_id"] for r in none} == {0}
    assert canonical.map_values(df.filter("false"), ref).count() == 0


def test_every_abbreviation_has_its_key():
    rng = random.Random(12)
    for _ in range(3000):
        word = "".join(rng.choice("abcdeiorst") for _ in range(rng.randrange(2, 10)))
        cut = rng.randrange(1, len(word))
        short = word[:cut] + "".join(c for c in word[cut:] if c not in "aeiou" and rng.random() < 0.5)
        if canonical.abbreviates(short, word):
            assert short[:3] in canonical.abbreviation_keys(word), (short, word)


# truncation

def test_structure_left_open():
    assert truncation.still_open('he said "yes" (really)') == ""
    assert truncation.still_open("a (b [c") == "([" and truncation.still_open("x &am") == "&" and truncation.still_open("x\\") == "\\"
    assert truncation.still_open("caf�") == "?" and truncation.still_open('a 5" board') == ""


OPEN = {
    "<ul><li>one</li><li>two": "E", "<b>bold text": "E", "<b>x</b": "<E", "<p>one<p>two": "", "<ul><li>one<li>two</ul> end.": "", "a <br> b <img src='x'> c": "",
    "<b>x</b>": "", "<i>a <b>c</i>": "", "x <!-- a <b> -->": "", "x <!-- a": "<", '<a href="x': "<", '<a href="x > y': "E", "<a/> b": "", "3 < 4 and 5 > 2": "",
    "x \\u00": "\\", "x \\u00e9": "", "x \\x4": "\\", "x \\\\": "", "x \\\\\\": "\\", "cafÃ": "?", "CAFÃ": "", "donâ€": "?", "café": "", "thé": "", "crÃ¨me brÃ»lÃ©e Ã": "?", "Bogotá": "",
    "&amp": "&", "&amp;": "", "R&D": "", "x &": "&", "x &#82": "&",
}


@pytest.mark.parametrize("text", OPEN)
def test_automaton_knows_elements_escapes_and_bytes(text):
    assert truncation.still_open(text) == OPEN[text]


def test_truncation_learns_each_source(spark):
    rng = random.Random(4)
    heads = ["Files", "Grids", "Budgets", "Interns"]
    sentence = lambda: f"{rng.choice(heads)} for {rng.choice('abcdefgh') * 5} need {rng.randrange(90)} careful hours of quiet work in the studio."
    rows, want = [], set()
    for i in range(600):
        full = " ".join(sentence() for _ in range(rng.randrange(2, 7)))
        if i % 10 == 0:
            full += " Notice period: 30 days"
        if i % 12 == 1:
            full += " Good people, good coffee..."
        s = ("fixed", "dots", "free")[i % 3]
        cut = s == "fixed" and len(full) > 200 or s == "dots" and len(full) > 250
        text = full[:200] if cut and s == "fixed" else full[:250].rsplit(" ", 1)[0] + "..." if cut else full
        if s == "free" and i % 30 == 2:
            text, cut = full[: len(full) // 2].rstrip(". ")[:-3], True
        rows.append((i, s, text))
        if cut:
            want.add(i)
    rows += [(900, "fixed", None), (901, "fixed", ""), (902, "free", " \t\xa0\n"), (903, "free", "Short."), (904, None, LONG + "."), (905, "free", "Grids for x (and"), (905, "free", "Grids for x (and")]
    got = truncation.cut_texts(spark.createDataFrame(rows, "id int, s string, t string"), F.col("id"), F.col("s"), F.col("t")).collect()
    assert len(got) == len(rows)
    found = {r["row"] for r in got if r["cut"]}
    # a complete text that ends just at the limit can't be told from a cut one
    assert len(found - want - {905}) <= 2 and 905 in found
    assert len(found & want) / len(want) > 0.97
    empty = spark.createDataFrame([], "id int, s string, t string")
    assert truncation.cut_texts(empty, F.col("id"), F.col("s"), F.col("t")).count() == 0


# encoding

PATH = f"{encoding.DEFAULT_FOLDER}/byte_bpe_50k.tiktoken"
SIGNS = " \n\t\r'sStTmdrevl aZé1²٣!?…　\xa0<|endoftext|>中ने🎨‍’"


@pytest.fixture(scope="module")
def public():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(f"{encoding.DEFAULT_FOLDER}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return lambda texts: [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_encoding_equals_the_public_library(public):
    rng = random.Random(5)
    texts = ["".join(rng.choice(SIGNS) for _ in range(rng.randrange(40))) for _ in range(5000)] + ["", " ", "'s", " 's", "a's'll!'re", "\n\n x", "x \n", "<|endoftext|>", "é" * 3000, LONG]
    ids, offsets = encoding.encode_texts(texts, encoding.vocabulary(PATH))
    assert ids == public(texts)
    for t, off in zip(texts, offsets):
        assert off == sorted(set(off)) and (not t or off[0] == 0)


def test_encode_and_decode_a_table(spark):
    rows = [(1, "Hello, world's  end"), (2, ""), (3, None), (4, "日本\r\n🎨"), (4, "日本\r\n🎨")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("ids", F.lit(1))
    e = encoding.encode(df, "doc_id", "text", PATH, offsets=True)
    assert e.filter("doc_id in (2, 3) and size(ids) = 0").count() == 2
    d = encoding.decode(e, "doc_id", "ids", PATH)
    assert sorted((r["doc_id"], r["text"]) for r in d.collect()) == sorted((i, t or "") for i, t in rows)
    assert encoding.encode(df.filter("false"), "doc_id", "text", PATH).count() == 0


# leakage

ITEMS = [(1, " ".join(f"alpha{i} beta{i}" for i in range(10))), (2, "too short"), (3, None), (4, " ".join(f"alpha{i} beta{i}" for i in range(3, 12)))]


def leak_docs():
    a = ITEMS[0][1].split()
    plain = ["x y z " + " ".join(a[2:14]) + " tail", " ".join(a[2:13]), " ".join(a) + " and " + " ".join(a[:15]), "only other words " * 30, "", None]
    odd = [" ".join(a[:12]).upper().replace("A", "Α"), "　".join(a[:12]), ", ".join(w[0] + "­" + w[1:] for w in a[:12]), " ".join("".join(chr(ord(c) + 0xFEE0) for c in w) for w in a[4:17])]
    return [(i, t) for i, t in enumerate(plain + odd)] + [(2, plain[2]), (77, LONG + " ".join(a))]


def test_leaks_equal_brute_force(spark):
    want = set()
    items = {i: leakage.words_of(t) for i, t in ITEMS}
    for d, t in leak_docs():
        w = leakage.words_of(t)
        runs = {tuple(w[i : i + 12]) for i in range(len(w) - 11)}
        want |= {(d, i) for i, v in items.items() if any(tuple(v[j : j + 12]) in runs for j in range(len(v) - 11))}
    docs = spark.createDataFrame(leak_docs(), "doc_id bigint, text string")
    items_df = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    for shard, block in ((400_000, 2000), (30, 1)):
        found = leakage.leaks(docs, items_df, shard_words=shard, block_items=block)
        assert {(r[0], r[1]) for r in found.select("doc_id", "item_id").distinct().collect()} == want
        assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1, "one pass for any number of items"
    assert (0, 1) in want and (1, 1) not in want and {d for d, _ in want} >= {0, 2, 6, 7, 8, 9, 77}
    assert leakage.leaks(docs.filter("false"), items_df).count() == 0
    assert leakage.leaks(docs, items_df.filter("false")).count() == 0


def test_spans_merge_and_point_at_words(spark):
    got = leakage.leaks(spark.createDataFrame(leak_docs()[:3], "d int, t string"), spark.createDataFrame(ITEMS[:1], "i bigint, t string")).orderBy("doc_id", "first_word").collect()
    assert [(r["doc_id"], r["first_word"], r["n_words"]) for r in got] == [(0, 3, 12), (2, 0, 20), (2, 21, 15)]


def test_suffix_array_equals_sorting():
    rng = np.random.default_rng(10)
    for sigma, n in ((2, 400), (50, 500), (3, 1), (100_000, 300)):
        seq = rng.integers(1, sigma, n) if sigma > 2 else np.ones(n, np.int64)
        seq[n // 2] = seq[-1] = 0
        zeros = np.flatnonzero(seq == 0).tolist()
        key = lambda i: [(0, zeros.index(j)) if seq[j] == 0 else (1, int(seq[j])) for j in range(i, n)]
        assert leakage.suffix_array(seq).tolist() == sorted(range(n), key=key)


def test_fm_index_counts_and_locates():
    rng = np.random.default_rng(6)
    seq = rng.integers(1, 5, 3000)
    seq[299::300] = 0
    index = leakage.FMIndex(seq, 5, np.arange(0, 3000, 300))
    for n in (1, 3, 5):
        phrases = np.array([seq[i : i + n] for i in range(0, 290, 7)])
        lo, hi = index.search(phrases)
        for p, a, b in zip(phrases, lo, hi):
            want = [i for i in range(len(seq) - n + 1) if (seq[i : i + n] == p).all()]
            assert sorted(index.locate(np.arange(a, b))) == want


# look-alikes

def test_fold(spark):
    same = [
        ("Paper", "Рареr"), ("café", "café"), ("a b", "a b"), ("Ｐａｙ １２", "Pay 12"), ("profile", "proﬁle"), ("ad­min​", "admin"), ("x\r\ny", "x\ny"), ("non‑stop", "non-stop"), ("ё", "ё"), ("ｶﾞ", "ガ"),
    ]
    other = [("m2", "m²"), ("a", "A"), ("cafe", "café"), ("1", "l"), ("a  b", "a b"), ("👩‍💻", "👩💻"), ("क्‍ष", "क्ष"), ("й", "и"), ("1/2", "½"), ("1", "①"), ("s", "ſ"), ("kg", "㎏"), ("x\u2026", "x...")]
    rows = [(i, t) for i, t in enumerate(t for p in same + other for t in p)] + [(900, None), (901, ""), (902, " \n")]
    got = {r["id"]: r["folded"] for r in lookalike.fold_text(spark.createDataFrame(rows, "id int, t string"), "id", "t").collect()}
    for i, p in enumerate(same + other):
        assert (got[2 * i] == got[2 * i + 1]) == (i < len(same)), p
    assert got[900] is None and got[901] == "" and got[902] == " \n"
    for i, t in rows:
        if t is not None:
            assert lookalike.fold_python(t) == got[i], t


def test_same_look_pairs(spark):
    rows = [(1, "Pay"), (2, "Рay"), (3, "Pay"), (4, "Ｐay"), (5, "pay"), (6, " "), (7, " "), (8, None), (9, LONG), (10, LONG + "​"), (10, LONG + "​")]
    df = spark.createDataFrame(rows, "id bigint, t string").withColumn("look", F.lit(1))
    got = {(r["a"], r["b"]) for r in lookalike.same_look(df, "id", "t").collect()}
    assert got == {(1, 2), (2, 3), (1, 4), (3, 4), (2, 4), (9, 10)}
    assert lookalike.same_look(df.filter("false"), "id", "t").count() == 0
    assert unicodedata.normalize("NFC", lookalike.fold_python("Рay")) == "Pay"


def test_history_finds_repeated_phrases_under_another_employer(spark):
    long = " ".join(f"word{i}" for i in range(30))
    rows = [
        ("r1", "1", "apply " * 14, "Acme"), ("r1", "2", "join us " * 8, "Acme"), ("r1", "3", "call us now " * 6, "Acme"), ("r1", "4", "new " * 12 + long, "Acme"),
        ("r2", "11", "apply " * 20, "Bolt"), ("r2", "12", "join us " * 9, "Bolt"), ("r2", "13", "call us now " * 7, "Bolt"), ("r2", "14", "new " * 14, "Bolt"),
        ("r2", "15", "other " * 14, "Bolt"), ("r2", "16", "join them " * 8, "Bolt"),
    ]
    p = history.prepare(spark.createDataFrame(rows, "run string, id string, t string, g string"), F.col("run"), F.col("id"), F.col("t"), F.col("g"))
    assert brute(rows) == {("r2", str(i)) for i in (11, 12, 13, 14)}
    assert added(spark, p.cache(), ["r1", "r2"]) == brute(rows)


def test_history_tells_short_texts_from_stock_phrases(spark):
    rows = [("r1", "1", "Great team. Apply by mail.", "Acme"), ("r1", "2", "Details on request.", "Acme"), ("r1", "3", "Ask us. Now", "Acme")]
    rows += [("r2", i + "b", t, g) for _, i, t, g in rows]
    p = history.prepare(spark.createDataFrame(rows, "run string, id string, t string, g string"), F.col("run"), F.col("id"), F.col("t"), F.col("g"))
    assert added(spark, p.cache(), ["r1", "r2"]) == {("r2", "1b"), ("r2", "3b")} == brute(rows)


def test_names_with_the_same_words_in_any_order_are_one(spark):
    same = [["Amber Brook Castle", "Amber Castle Brook"], ["Dune Ember Falcon Garnet", "Ember Dune Garnet Falcon"], ["Harbor Indigo Juniper Kestrel Lagoon Meadow Nimbus", "Nimbus Harbor Indigo Lagoon Juniper Kestrel Meadow"]]
    df = spark.createDataFrame([(n,) for pair in same for n in pair] + [("Amber Brook Tundra",)], "name string")
    got = {r["name"]: r["entity"] for r in names.link_names(df).collect()}
    assert all(got[a] == got[b] for a, b in same)
    assert len(set(got.values())) == 4


def test_long_words_may_be_abbreviated(spark):
    ref = spark.createDataFrame([(1, "Internationalization Engineer"), (2, "Road Engineer")], "ref_id int, ref string")
    got = canonical.map_values(spark.createDataFrame([("Internationalztn Engineer",)], "value string"), ref).collect()
    assert [r["ref_id"] for r in got] == [1]


def test_shapes_of_endings_are_compared_whole():
    house = "we " + "gladly answer all questions about this place " * 3 + "at any time you like"
    assert truncation._shape(house) == truncation._shape(house)
    assert truncation._shape(house) != truncation._shape(house[:120])
    assert truncation._shape("Ask Anna about 12 posts") == truncation._shape("Ask Bert about 7 posts")
