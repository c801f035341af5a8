"""Every registered query that SQL can express against its oracle."""

import pytest
from oracle import difference

from precolens.llm.oracles import ORACLES
from precolens.llm.queries import QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(name, spark, folder, duck):
    assert difference(QUERIES[name](spark, folder), duck, ORACLES[name]) is None
