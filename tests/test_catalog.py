"""Queries against their DuckDB twins on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from tessella.plans import catalog

SF = Path("/root/testdata/sf0.001")
BOOKS = ("tessella.plans.budgets", "tessella.plans.coverage", "tessella.plans.reports", "tessella.plans.rules", "tessella.plans.stores", "tessella.plans.views")
NAMES = ["select_prototypicality_given", "select_random", "patch_histogram", "tail_scores", "prototype_mass", "class_iou", "rare_classes", "inertia_drop", "boundary_f"]
NAMES += [name for name, query in catalog.queries().items() if query.__module__ in BOOKS and name in catalog.oracle_sql()]


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.6g}"
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return str(value)


@pytest.mark.skipif(not SF.exists(), reason="no test tables here")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_oracle(spark, name):
    found = catalog.queries()[name](spark, str(SF))
    db = duckdb.connect()
    for file in SF.glob("*.parquet"):
        db.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    wanted = db.execute(catalog.oracle_sql()[name])
    columns = [c[0] for c in wanted.description]
    assert sorted(found.columns) == sorted(columns)
    rows = [tuple(plain(r[c]) for c in sorted(columns)) for r in found.collect()]
    expected = [tuple(plain(r[columns.index(c)]) for c in sorted(columns)) for r in wanted.fetchall()]
    assert rows and sorted(rows) == sorted(expected)


def test_every_oracle_has_a_query():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())
