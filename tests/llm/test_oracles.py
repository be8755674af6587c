import pytest
from compare import differences, duck

from tidewell.llm.queries import ORACLES, queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    assert differences(queries()[name](spark, SF), ORACLES[name], duck(SF)) == []
