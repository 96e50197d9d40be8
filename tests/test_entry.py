import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from voxelframe import catalog

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings".split()


def same(v):
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_matches_sql(spark, name):
    df = catalog.QUERIES[name](spark, D)
    rows = sorted((tuple(same(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=str)
    if name not in catalog.ORACLE:
        assert rows
        return
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{D}/{t}.parquet'")
    r = con.sql(catalog.ORACLE[name])
    at = [r.columns.index(c) for c in sorted(r.columns)]
    assert sorted(r.columns) == sorted(df.columns)
    assert rows == sorted((tuple(same(x[i]) for i in at) for x in r.fetchall()), key=str)


def test_entry(spark):
    assert entry.entry(spark).columns == ["x", "y", "z"] and set(catalog.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("missing", ["sentencepiece", "zstandard", "voxelframe.llm"])
def test_entry_without_optional_modules(missing):
    """Without a module that only the optional operators need, the other queries are still there."""
    code = f"""
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name == {missing!r}:
            raise ModuleNotFoundError(f"No module named {{name}}", name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
names = e.queries()
assert "window_sphere" in names and "op1_pii" not in names and "pipeline" not in names and set(e.oracle_sql()) <= set(names)
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(entry.__file__).parent)
