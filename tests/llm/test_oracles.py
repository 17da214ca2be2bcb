"""Every query of the operators has its SQL or a brute-force test; SQL is run on a larger data set here."""

import pytest

from tests.compare import connect, same
from waymark.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_sql_at_the_next_size(spark, name):
    sf_dir = "/root/testdata/sf0.01"
    same(queries.QUERIES[name](spark, sf_dir), connect(sf_dir).execute(queries.ORACLE[name]).df())
