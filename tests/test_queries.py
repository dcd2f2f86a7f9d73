"""Every named query against its SQL equivalent, over the whole tables of the smallest data set."""

import decimal
import math
import os

import pytest

from assayline.plans import all_queries, all_sql

duckdb = pytest.importorskip("duckdb")
FOLDER = os.environ.get("ASSAYLINE_TEST_DATA", "/root/testdata/sf0.001")
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations").split()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not present")


@pytest.fixture(scope="module")
def other():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    yield connection
    connection.close()


def plain(value):
    if value is None:
        return ""
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 9) + 0.0)
    return repr(float(value)) if isinstance(value, decimal.Decimal) else str(value)


def test_every_query_has_an_equivalent():
    assert set(all_sql()) == set(all_queries()) and len(all_queries()) > 80


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query_equals_sql(spark, other, name):
    frame = all_queries()[name](spark, FOLDER)
    names = sorted(frame.columns)
    got = sorted(tuple(map(plain, row)) for row in frame.select(*[f"`{n}`" for n in names]).collect())
    result = other.execute(all_sql()[name])
    found = [d[0] for d in result.description]
    assert sorted(found) == names
    places = [found.index(n) for n in names]
    assert got == sorted(tuple(plain(row[i]) for i in places) for row in result.fetchall())


LOOKUPS = (
    "chk_unique", "chk_unique_composite", "xref_exists", "xref_two_pairs", "run_suite", "kpi_trend", "description_asof_version",
    "run_failures", "latest_failures", "runs_scope", "reconcile_runs_after_delete", "run_bundle_audit", "tickets_apply",
)


@pytest.mark.usefixtures("no_broadcast")
@pytest.mark.parametrize("name", LOOKUPS)
def test_query_equals_sql_on_the_shuffled_route(spark, other, name):
    test_query_equals_sql(spark, other, name)
