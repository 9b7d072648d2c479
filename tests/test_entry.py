import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from marlspike.plans import catalog

ROOT = Path(__file__).parent.parent
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def value(v):
    if isinstance(v, (list, tuple)):
        return tuple(map(value, v))
    return None if v is None else repr(v) if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def db(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def same(spark, db, sf, run, sql):
    df = run(spark, sf)
    names = sorted(df.columns)
    got = [tuple(value(r[n]) for n in names) for r in df.collect()]
    cursor = db.execute(sql)
    have = [x[0] for x in cursor.description]
    assert sorted(have) == names
    want = [tuple(value(r[have.index(n)]) for n in names) for r in cursor.fetchall()]
    assert sorted(got, key=str) == sorted(want, key=str)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, db, sf, name):
    same(spark, db, sf, catalog.QUERIES[name], catalog.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_runs(spark, sf, name):
    assert catalog.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 10
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_stands_without_the_training_data_package(tmp_path):
    code = "import sys\nclass No:\n def find_spec(self, n, p=None, t=None):\n  if n == 'corpus_pipeline' or n.startswith('marlspike.llm'): raise ModuleNotFoundError(n, name=n)\nsys.meta_path.insert(0, No())\nimport __spark_entry__ as e\nassert e.llm is None and len(e.queries()) > 40 and not any(n.startswith('op') for n in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)
