"""Every query that has SQL gives the same rows in DuckDB, on the smallest tables."""

import datetime
import decimal
import os

import duckdb
import pytest

import __spark_entry__ as entry
from plumbline.plans import aggregates, delivery, extras, models, relational, texts, timeseries

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
MODULES = (aggregates, delivery, extras, models, relational, texts, timeseries)
PAIRS = [(n, m) for m in MODULES for n in m.QUERIES if n in m.SQL]
ROWS_ONLY = [(n, m) for m in MODULES for n in m.QUERIES if n not in m.SQL]


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return float(f"{v:.8g}")
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return tuple(plain(x) for x in v) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return c


@pytest.mark.parametrize("name,module", PAIRS, ids=[p[0] for p in PAIRS])
def test_equals_sql(spark, con, name, module):
    df = module.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=str)
    cur = con.execute(module.SQL[name])
    names = [d[0] for d in cur.description]
    want = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in cur.fetchall()), key=str)
    assert sorted(names) == cols
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert all(a == b or (isinstance(a, (int, float)) and b is not None and abs(a - b) <= 1e-6 * max(1, abs(a))) for a, b in zip(g, w)), (g, w)


@pytest.mark.parametrize("name,module", ROWS_ONLY, ids=[p[0] for p in ROWS_ONLY])
def test_runs(spark, name, module):
    assert module.QUERIES[name](spark, DATA).columns


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_did_queries_hold_every_nation(spark):
    from itertools import combinations
    from statistics import mean

    months = timeseries._nation_months(spark, DATA)
    total = spark.read.parquet(f"{DATA}/orders.parquet").agg({"o_totalprice": "sum"}).first()[0]
    assert months.agg({"v": "sum"}).first()[0] == pytest.approx(total)
    c = {int(r["u"]): r["change"] for r in timeseries._nation_changes(spark, DATA).filter("change is not null").collect()}
    assert len(c) > 12
    got = {r["subset"]: r["did"] for r in timeseries.did_randomisation(spark, DATA).collect()}
    names = sorted(c)
    want = {sum(1 << names.index(u) for u in t): mean(c[u] for u in t) - mean(c[u] for u in names if u not in t) for t in combinations(names, 5)}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(v, abs=1e-4) for k, v in want.items())


def test_every_line_and_event_is_expanded(spark):
    lines, events = (spark.read.parquet(f"{DATA}/{t}.parquet").count() for t in ("lineitem", "events"))
    assert extras.table_callable(spark, DATA).count() == 3 * lines
    assert texts.literal_dict(spark, DATA).count() == events
