"""Every registered query of the library against its SQL, and those without SQL for sense."""

import pytest

from athenor.plans.registry import ORACLES, QUERIES, load
from tests.oracle import both

load()
FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    left, right = both(spark, FOLDER, QUERIES[name], ORACLES[name])
    assert left == right


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_entry_runs(spark):
    import __spark_entry__

    assert set(__spark_entry__.entry(spark).columns) == {"author_id", "year_from", "year_to", "drift", "is_jump"}


def test_same_result_under_any_number_of_partitions(spark):
    rows = []
    for n in ("1", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        rows.append(sorted(map(tuple, QUERIES["bridge_papers"](spark, FOLDER).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert rows[0] == rows[1]
