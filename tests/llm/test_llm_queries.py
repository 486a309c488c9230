import pytest
from oracle import DATA, same

from loomline.llm import queries


@pytest.mark.skipif(not DATA.exists(), reason="no test tables here")
@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, name):
    """Queries with SQL are compared; the others give rows."""
    if name in queries.ORACLE:
        same(spark, name, queries.QUERIES[name], queries.ORACLE[name])
    else:
        assert queries.QUERIES[name](spark, str(DATA)).count() > 0
