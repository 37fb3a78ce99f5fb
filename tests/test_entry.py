"""The driver's contract, on the smallest tables: every query with SQL gives what DuckDB gives."""

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
DATA = Path("/root/testdata/sf0.001")


def test_contract():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and all(callable(q) for q in e.queries().values())


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_core_queries_against_sql(spark):
    sys.path.insert(0, str(ROOT / "tools"))
    import compare
    import duckdb

    from cuemill.plans import registry

    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    queries, sql = registry.core()
    wrong = []
    for name, text in sql.items():
        df = queries[name](spark, str(DATA))
        cols = sorted(df.columns)
        mine = sorted(repr(tuple(compare.norm(r[c]) for c in cols)) for r in df.collect())
        got = con.execute(text)
        at = [d[0] for d in got.description]
        theirs = sorted(repr(tuple(compare.norm(r[at.index(c)]) for c in cols)) for r in got.fetchall()) if sorted(at) == cols else None
        if mine != theirs:
            wrong.append(name)
    assert not wrong


def test_core_imports_without_llm():
    code = "import sys; sys.modules['cuemill.llm'] = None; import __spark_entry__ as e; assert e.queries() and not any(k.startswith('p2') for k in e.queries())"
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT).returncode == 0
