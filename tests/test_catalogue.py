"""Every query against its SQL on DuckDB."""

import pytest

from weavegrid.plans import catalogue

SQL = catalogue.oracle_sql()


def rows_of(table, columns):
    return sorted(map(repr, zip(*[table.column(c).to_pylist() for c in columns])))


@pytest.mark.parametrize("name", list(catalogue.queries()))
def test_query(name, spark, sf, duck):
    found = catalogue.queries()[name](spark, sf).toArrow()
    if name not in SQL:
        assert found.num_rows
        return
    wanted = duck.sql(SQL[name]).to_arrow_table()
    columns = sorted(found.column_names)
    assert columns == sorted(wanted.column_names)
    assert rows_of(found, columns) == rows_of(wanted, columns)


def test_entry():
    import __spark_entry__

    assert set(catalogue.queries()) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
