"""Every registered query against its SQL in DuckDB on the given tables."""

import os

import duckdb
import pytest

from quillmark import plans

from .conftest import DATA

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        path = f"{DATA}/sf0.001/{name}.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def cell(value):
    if value is None or value != value:
        return "null"
    return repr(round(float(value), 6)) if type(value).__name__ in ("float", "float64", "Decimal") else str(value)


def rows(frame):
    names = sorted(frame.columns)
    return names, sorted(tuple(map(cell, r)) for r in frame[names].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_query_equals_its_sql(spark, sf, duck, name):
    got, want = rows(plans.QUERIES[name](spark, sf).toPandas()), rows(duck.sql(plans.ORACLES[name]).df())
    assert got[0] == want[0]
    assert got[1] == want[1]
    assert got[1], "nothing to compare"


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLES)))
def test_queries_without_sql_run(spark, sf, name):
    assert plans.QUERIES[name](spark, sf).count() > 0


def test_plans_have_no_products_and_stay_on_the_jvm(spark, sf):
    scored = {"top_candidates", "word_review", "extended_review", "page_scores", "page_texts", "run_texts", "overlay_labels", "top_display", "reranked_words", "prediction_report", "confusions", "most_misclassified", "missing_confusions", "log_loss", "isolated_failures"}
    for name, query in plans.QUERIES.items():
        plan = query(spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name
        if name not in scored and not name.startswith("accuracy"):
            assert "Python" not in plan and "Pandas" not in plan, name
