"""Every registered query has a name, runs, and its oracle is one of the registered ones."""

import os

import __spark_entry__ as entry
import pytest
from metrelle.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(registry.QUERIES) >= 60


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
@pytest.mark.parametrize("name", ["sample_excluded", "number_text", "segments", "crash_failures", "cer_micro_by_group"])
def test_queries_match_their_oracle(spark, name):
    duckdb = pytest.importorskip("duckdb")
    got = registry.QUERIES[name](spark, SF).toPandas()
    db = duckdb.connect()
    for file in os.listdir(SF):
        db.execute(f"CREATE VIEW {file[:-8]} AS SELECT * FROM '{SF}/{file}'")
    want = db.execute(registry.ORACLES[name]).fetchdf()
    order = sorted(got.columns)
    key = lambda f: sorted(map(str, (tuple(None if x != x else x for x in r) for r in f[order].itertuples(index=False))))
    assert order == sorted(want.columns) and key(got.astype(object)) == key(want.astype(object))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
def test_every_query_is_built(spark):
    for name, made in registry.QUERIES.items():
        assert made(spark, SF).columns, name
