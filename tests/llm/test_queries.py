import pytest

import __spark_entry__ as entry
from checks.compare import compare, duck
from skyledger.llm import oracle, queries
from tests.conftest import SF_DIR


def test_all_operators_and_the_pipeline_are_registered():
    names = [name for name in entry.queries() if name.startswith("op") or name == "pipeline"]
    assert sorted({int(name[2:].split("_")[0]) for name in names if name != "pipeline"}) == list(range(1, 14)) and "pipeline" in names
    assert set(oracle.oracle_sql()) <= set(queries.registered()) and set(oracle.oracle_sql()) <= set(entry.oracle_sql())


@pytest.fixture(scope="module")
def con():
    yield (connection := duck(SF_DIR))
    connection.close()


@pytest.mark.parametrize("name", oracle.oracle_sql())
def test_query_equals_sql(llm, con, name):
    assert compare(queries.registered()[name](llm, SF_DIR), con, oracle.oracle_sql()[name]) == []
