import duckdb
import pytest

from shelfspark import registry

SF = "/root/testdata/sf0.001"
TABLES = "events documents embeddings pages labels clients".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def normal(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(round(r[i], 5) if isinstance(r[i], float) else r[i] for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_against_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    got = normal([tuple(r) for r in df.collect()], df.columns)
    if name in registry.ORACLES:
        found = duck.execute(registry.ORACLES[name])
        cols = [c[0] for c in found.description]
        assert sorted(cols) == sorted(df.columns) and normal(found.fetchall(), cols) == got


def test_entry_imports_without_the_subpackage():
    import subprocess
    import sys
    from pathlib import Path

    code = "import sys; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert not any(k.startswith('op') for k in e.queries()); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).resolve().parent.parent, timeout=120)
