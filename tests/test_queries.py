import pytest

from gridloom import plans
from tests.compare import same


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(name, spark, sf_dir, duck):
    df = plans.QUERIES[name](spark, sf_dir)
    if name in plans.ORACLE_SQL:
        same(df, duck, plans.ORACLE_SQL[name])
    else:
        df.collect()


def test_entry_imports():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
