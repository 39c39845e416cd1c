import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from pagelode.session import session
    return session("tests", "8")


@pytest.fixture(scope="session")
def values(spark):
    """``values(f, inputs)``: the results of a column function on a list of strings."""
    from pyspark.sql import functions as F

    def run(function, inputs, kind="string"):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, v {kind}")
        return [r[0] for r in df.coalesce(1).sortWithinPartitions("i").select(
            function(F.col("v")).alias("r")).collect()]
    return run


@pytest.fixture
def pages(spark):
    """``pages(rows)``: a page table from (url, page_no, kind, status, html[, time]) rows."""
    from datetime import datetime

    from pagelode.schema import PAGE_SCHEMA

    def make(*rows):
        full = [(*r[:5], r[5] if len(r) > 5 else datetime(2025, 1, 2, 3, 4, 5)) for r in rows]
        return spark.createDataFrame(full, PAGE_SCHEMA)
    return make
