"""Every registered query with SQL agrees with it on the smallest tables."""

import pytest
from compare import difference

from tidewatch import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query_equals_its_sql(spark, name):
    assert difference(registry.QUERIES[name](spark, SF), registry.ORACLE[name], SF) == ""
