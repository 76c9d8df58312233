from __future__ import annotations

import sys
from collections import Counter
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from rillworks.session import session

    own = tmp_path_factory.mktemp("spark")
    spark = session(
        "tests", "local[4]", spark__sql__shuffle__partitions=4, spark__ui__enabled="false", spark__ui__showConsoleProgress="false",
        spark__driver__memory="4g", spark__sql__warehouse__dir=str(own / "warehouse"), spark__checkpoint__dir=f"file://{own}/shared",
    )
    spark.sparkContext.setLogLevel("ERROR")
    yield spark
    spark.stop()


@pytest.fixture
def small():
    if not Path(SMALL).exists():
        pytest.skip("the provided tables aren't here")
    return SMALL


def multiset(rows) -> Counter:
    """Rows (dicts or tuples) as a multiset; order doesn't count."""
    return Counter(repr(sorted(r.items(), key=lambda x: x[0])) if isinstance(r, dict) else repr(r) for r in rows)
