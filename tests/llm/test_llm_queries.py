"""The registered queries of the operators for training data: equal to their SQL, or to brute force over the same tables."""

import pytest

from plumbline.llm import registry
from tests.test_queries import DATA, con, plain  # noqa: F401  (con is a fixture)

MODULES = registry.modules()
PAIRS = [(n, m) for m in MODULES for n in m.QUERIES if n in m.SQL]


@pytest.mark.parametrize("name,module", PAIRS, ids=[p[0] for p in PAIRS])
def test_equals_sql(spark, con, name, module):  # noqa: F811
    df = module.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=str)
    cur = con.execute(module.SQL[name])
    names = [d[0] for d in cur.description]
    want = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in cur.fetchall()), key=str)
    assert sorted(names) == cols and got == want
