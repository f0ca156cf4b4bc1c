"""Every registered query without the training-data operators runs on the smallest tables, and equals its oracle there."""

import os

import duckdb
import pytest

from proseline import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def rows(df):
    return sorted(map(repr, df[sorted(df.columns)].itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_equals_its_oracle(spark, name):
    found = catalog.QUERIES[name](spark, SF).toPandas()
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    assert rows(found) == rows(db.execute(catalog.ORACLE_SQL[name]).df())


def test_stream_equals_batch(spark):
    batch = {(r.seq, r.reason) for r in catalog.QUERIES["rate_limit"](spark, SF).collect()}
    assert batch == {(r.seq, r.reason) for r in catalog.QUERIES["stream_rate_limit"](spark, SF).collect()}


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL) ))
def test_queries_without_oracle_run(spark, name):
    """Their operators are compared with plain Python in the other tests."""
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_tables_of_texts_set_small_arrow_batches(spark):
    from proseline.plans import views

    spark.conf.unset(views.BATCH)
    views.table(spark, SF, "documents")
    assert spark.conf.get(views.BATCH) == str(views.BATCH_ROWS)


def test_reports_measure_texts_once(spark):
    plan = lambda name: catalog.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    found = plan("sensitivity_trials")
    assert "n_chars" not in found and "InMemoryRelation" not in found
    # bands look at the lengths of people's texts; all else is there already
    assert plan("synthesis").count("n_chars") == 1
