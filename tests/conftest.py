import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF001 = "/root/testdata/sf0.01"
SF0001 = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    import tempfile

    from quarry.session import build_session

    warehouse = tempfile.mkdtemp(prefix="quarry-warehouse-")
    s = build_session("local[4]", 4, app="quarry-tests", extra={"spark.sql.warehouse.dir": warehouse})
    yield s
    s.stop()


def rows(df, *cols):
    """Result rows as sorted tuples of the named (or all) columns, Python values."""
    cols = cols or tuple(df.columns)
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=_none_last)


def _none_last(row):
    return tuple((v is None, v if v is not None else 0) for v in row)
