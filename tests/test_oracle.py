"""Every registered query against its SQL, on the whole tables of the smallest folder."""

import math

import pytest

from cohortine.plans.catalogue import ORACLE, QUERIES


def tidy(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}") + 0.0
    return value


def rows_of(names, rows, order):
    at = [names.index(c) for c in order]
    out = [tuple(tidy(r[i]) for i in at) for r in rows]
    return sorted(out, key=lambda r: tuple((v is None, str(v)) for v in r))


def test_every_sql_has_its_query():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows(name, spark, duck, folder):
    df = QUERIES[name](spark, folder)
    cur = duck.execute(ORACLE[name])
    theirs = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(theirs)
    order = sorted(theirs)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()], order) == rows_of(theirs, cur.fetchall(), order)


def test_file_inventory_lists_every_table(spark, folder):
    names = {r.file_name for r in QUERIES["file_inventory"](spark, folder).collect()}
    assert "lineitem.parquet" in names and len(names) == 14
