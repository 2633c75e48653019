import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

from graphloom.session import build_session  # noqa: E402

SF = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    return build_session("local[4]", "tests", shuffle=4)


@pytest.fixture(scope="session")
def sf_dir():
    if not SF.exists():
        pytest.skip("test tables are not here")
    return str(SF)


@pytest.fixture(scope="session")
def oracle(sf_dir):
    import duckdb

    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con
