from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
DATA = os.environ.get("STRANDWORK_TEST_DATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from strandwork.session import build_session

    session = build_session(
        "tests", "local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g", "spark.sql.autoBroadcastJoinThreshold": "256k", "spark.sql.maxMetadataStringLength": "2000", "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared"))}
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def folder():
    if not Path(DATA).exists():
        pytest.skip("no test data here")
    return DATA


@pytest.fixture(scope="session")
def duck(folder):
    import duckdb

    con = duckdb.connect()
    for file in Path(folder).iterdir():
        where = file if file.is_file() else file / "*.parquet"
        con.execute(f"CREATE VIEW \"{file.name.removesuffix('.parquet')}\" AS SELECT * FROM read_parquet('{where}')")
    return con
