from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from papyrine.plans.runtime import ship_package
    from papyrine.session import local_session

    session = local_session(4, 4, "6g")
    session.sparkContext.setLogLevel("ERROR")
    ship_package(session)
    return session


@pytest.fixture
def folder(spark, tmp_path):
    """make(name, rows, schema) writes a small table; the folder's path is make.path."""

    def make(name, rows, schema):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")

    make.path = str(tmp_path)
    return make
