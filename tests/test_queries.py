import pytest

from flowspark.queries import ORACLE, QUERIES

from .compare import as_rows, sql_rows

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_gives_the_rows_of_its_sql(spark, name):
    found, wanted = QUERIES[name](spark, FOLDER).toPandas(), sql_rows(ORACLE[name], FOLDER)
    assert sorted(found.columns) == sorted(wanted.columns)
    assert as_rows(found) == as_rows(wanted)
