import pytest
from compare import difference

from tidewatch.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_its_sql(spark, name):
    assert difference(queries.QUERIES[name](spark, SF), queries.ORACLE[name], SF) == ""
