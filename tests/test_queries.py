import duckdb
import pytest

from tests.compare import connect, same
from waymark.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_query_equals_sql(spark, sf_dir, name):
    same(catalogue.QUERIES[name](spark, sf_dir), connect(sf_dir).execute(catalogue.ORACLE[name]).df())


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE)))
def test_query_without_sql_has_rows(spark, sf_dir, name):
    assert catalogue.QUERIES[name](spark, sf_dir).count() > 0


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 15
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_faults_of_a_table_put_in_the_place_of_another(spark, sf_dir, tmp_path):
    found = []
    for shift in (0, 1000, 0):  # written anew each time, in the same session
        duckdb.execute(f"copy (select * replace (event_id + {shift} as event_id, user_id + {shift} as user_id) from '{sf_dir}/events.parquet' where event_id >= {shift // 2}) to '{tmp_path}/events.parquet' (format parquet)")
        con = duckdb.connect()
        con.execute(f"create view events as select * from '{tmp_path}/events.parquet'")
        for folder in (tmp_path, f"{tmp_path}/"):
            mine = catalogue.QUERIES["flt_all"](spark, str(folder))
            same(mine, con.execute(catalogue.ORACLE["flt_all"]).df())
        found.append(mine.count())
    assert found[0] == found[2] > found[1] > 0
