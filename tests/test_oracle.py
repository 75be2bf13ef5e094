"""Every registered query against its SQL counterpart at the smallest scale."""

import math

import pytest

import __spark_entry__ as entry
from tools.compare import connect, text

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def _close(a: str, b: str) -> bool:
    if a == b:
        return True
    try:  # a mean that falls on a rounding boundary may differ in its last digit
        return math.isclose(float(a), float(b), rel_tol=2e-4)
    except ValueError:
        return False


def _rows(pdf):
    cols = sorted(pdf.columns)
    rows = [tuple(text(v) for v in r) for r in zip(*[pdf[c] for c in cols])]
    # keys first, so that measures differing in the last digit do not reorder rows
    return sorted(rows, key=lambda r: ([v for v in r if not _number(v)], [v for v in r if _number(v)]))


def _number(v: str) -> bool:
    try:
        float(v)
        return "." in v
    except ValueError:
        return False


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_matches_sql(spark, con, name):
    got, want = entry.queries()[name](spark, SF).toPandas(), con.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want)
    for a, b in zip(_rows(got), _rows(want)):
        assert all(_close(x, y) for x, y in zip(a, b)), (a, b)


def test_entry(spark):
    assert entry.entry(spark).count() == 5
