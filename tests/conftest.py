from __future__ import annotations

import os

import pytest

from timeloom.plans.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[8]", **{
        "spark.sql.shuffle.partitions": "4",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
    })
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def zone(spark):
    """Set the session time zone for one test."""
    before = spark.conf.get("spark.sql.session.timeZone")
    yield lambda name: spark.conf.set("spark.sql.session.timeZone", name)
    spark.conf.set("spark.sql.session.timeZone", before)


@pytest.fixture
def small_splits(spark):
    """Cut input files into blocks of this many bytes."""
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    yield lambda size: spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.fixture
def write(tmp_path):
    """Write a text file and return its path."""
    def to_file(name: str, text: str | list[str], encoding: str = "utf-8") -> str:
        path = tmp_path / name
        body = text if isinstance(text, str) else "\n".join(text) + "\n"
        path.write_bytes(body.encode(encoding))
        return os.fspath(path)
    return to_file
