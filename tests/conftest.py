from __future__ import annotations

import datetime as dt
import os
import sys
from decimal import Decimal

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
for p in (ROOT, os.path.join(ROOT, "tests")):
    if p not in sys.path:
        sys.path.insert(0, p)

from ledgerscope.config import ensure_checkpoint_dir, local_session  # noqa: E402
from ledgerscope.schemas import TABLE_NAMES, TABLE_SCHEMAS  # noqa: E402
from ledgerscope.sources.tables import Tables  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    session = local_session(cores=8, shuffle_partitions=8, app="ledgerscope-tests")
    ensure_checkpoint_dir(session)
    yield session


def D(x) -> Decimal | None:
    return None if x is None else Decimal(str(x))


def ts(s: str) -> dt.datetime:
    return dt.datetime.fromisoformat(s)


@pytest.fixture
def make_tables(spark):
    """Build ``Tables`` from plain tuples in each table's declared column order."""

    def build(**rows) -> Tables:
        unknown = set(rows) - set(TABLE_NAMES)
        assert not unknown, unknown
        dfs = {}
        for name in TABLE_NAMES:
            data = rows.get(name, [])
            schema = TABLE_SCHEMAS[name]
            width = len(schema.fields)
            data = [tuple(r) + (None,) * (width - len(r)) for r in data]
            dfs[name] = spark.createDataFrame(data, schema=schema)
        return Tables(**dfs)

    return build
