from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from orrery.session import local_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = local_session("4", 4, "4g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def rows_of(df):
    """All rows as sorted tuples, in the order of column names."""
    cols = sorted(df.columns)
    return in_order(tuple(r[c] for c in cols) for r in df.select(*cols).collect())


def in_order(rows):
    """Sorted, nulls last."""
    return sorted(rows, key=lambda t: tuple((v is None, 0 if v is None else v) for v in t))
