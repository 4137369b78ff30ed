"""Every query with SQL gives the rows of its SQL; the others run."""

import duckdb
import pytest

from pairsmith import queries as Q
from pairsmith.plans import pipeline
from pairsmith.sources import pairs as S


@pytest.fixture(scope="module")
def database(sf):
    c = duckdb.connect()
    for t in ("customer", "part", "orders", "lineitem"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query(spark, sf, database, name):
    df = Q.QUERIES[name](spark, sf)
    rows = df.collect()
    if name in Q.ORACLE_SQL:
        found = database.sql(Q.ORACLE_SQL[name])
        columns = sorted(found.columns)
        assert sorted(df.columns) == columns
        at = [found.columns.index(c) for c in columns]
        assert sorted((tuple(r[c] for c in columns) for r in rows), key=repr) == sorted((tuple(r[i] for i in at) for r in found.fetchall()), key=repr)
    else:
        assert df.columns


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == len(Q.RULES)


def test_filters_reach_the_scan(spark, tmp_path):
    spark.range(100).selectExpr("id AS a", "id % 7 AS b", "id AS c").write.parquet(str(tmp_path / "x"))
    plan = S.read_pairs(spark, str(tmp_path / "x"), condition="a > 90", columns=["b"])._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(a,90)" in plan and "ReadSchema: struct<a:bigint,b:bigint>" in plan
    with pytest.raises(ValueError):
        S.read_pairs(spark, str(tmp_path / "x"), columns=["nope"])


def test_full_run_and_sinks(spark, sf, tmp_path):
    from pairsmith import fixtures as X

    config = X.Config(predicates=X.PREDICATES, filters=X.CONFIG.filters, learning=X.Learning(1, 50, 0.3, 5), positive_rate=None)
    mined, evaluated = pipeline.run(X.pairs(spark, sf), None, config)
    assert mined.composition.recall[-1] >= 0.3
    assert evaluated.metrics.first().window_total_pairs > 0
    S.write_results({"metrics": evaluated.metrics, **evaluated.reports}, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out/metrics")).count() == 1


def test_no_rules(spark, sf):
    from pairsmith import fixtures as X

    result = pipeline.evaluate(X.pairs(spark, sf), None, [], X.CONFIG)
    assert result.optimum_step is None and result.metrics.first().optimum_step == 0
