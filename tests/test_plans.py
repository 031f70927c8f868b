"""Every plan with SQL equals it on the smallest tables; the subpackage llm may be missing."""

import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry

D = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
CORE = list(entry.oracle_sql())


def _norm(v):
    if v is None or v != v:
        return None
    return round(float(v), 4) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(D):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{D}/{f}'")
    return c


@pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")
@pytest.mark.parametrize("name", CORE)
def test_plan_equals_sql(spark, duck, name):
    got = entry.queries()[name](spark, D)
    want = duck.execute(entry.oracle_sql()[name])
    cols = [c[0] for c in want.description]
    assert sorted(cols) == sorted(got.columns)
    rows = lambda it: sorted((tuple(map(_norm, r)) for r in it), key=str)
    assert rows(got.select(*cols).collect()) == rows(want.fetchall())


def test_everything_imports_without_llm():
    code = "import sys; sys.modules['opinionframe.llm'] = None\ntry:\n import importlib.util as u; u.find_spec = (lambda f: lambda n, *a: None if n.startswith('opinionframe.llm') else f(n, *a))(u.find_spec)\nfinally:\n import __spark_entry__ as e; print(sorted(k for k in e.queries() if k[0] == 'p'))"
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    assert out.stdout.strip() == "['p3_found', 'p3_report', 'p5_found', 'p5_profile']", out.stderr
