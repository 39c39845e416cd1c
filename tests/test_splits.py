"""Large files cut inside of records, against Spark's readers that take a file as a whole."""

import json
import random

import pytest
from pyspark.sql import functions as F

from pagelode.operators import stats as A
from pagelode.sinks import export as K
from pagelode.sources import splits as P
from pagelode.streaming import state as T

SCHEMA = "a string, b string, tags array<struct<x:string,y:string>>, n long"


@pytest.fixture
def small_ranges(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def odd_text(rng):
    pieces = ['"', "\\", "}", "{", "[", "]", ",", "\n", "\r\n", "x", "é৳", '\\"', "}]", '"}', "  ", "ab"]
    return "".join(rng.choice(pieces) for _ in range(rng.randrange(12)))


def test_json_arrays_in_ranges(spark, tmp_path, small_ranges):
    rng = random.Random(1)
    want = []
    for f, indent in enumerate((None, 2, 0)):
        rows = [{"a": odd_text(rng), "b": None if i % 7 == 0 else odd_text(rng),
                 "tags": [{"x": odd_text(rng), "y": "}"} for _ in range(rng.randrange(3))], "n": f * 1000 + i, "extra": {"deep": [{"er": "]"}]}}
                for i in range(300)]
        want += rows
        (tmp_path / f"{f}.json").write_text(" " * f + json.dumps(rows, indent=indent, ensure_ascii=f == 0) + "\n")
    (tmp_path / "empty.json").write_text("[]")
    got = K.read_json_export(spark, str(tmp_path), schema=spark.createDataFrame([], SCHEMA).schema, array=True, split=True)
    key = lambda r: (r["n"], r["a"], r["b"], [(t["x"], t["y"]) for t in r["tags"]])
    assert sorted(map(key, got.collect())) == sorted(map(key, want))
    whole = K.read_json_export(spark, str(tmp_path), schema=got.schema, array=True)
    assert whole.count() == got.count()
    pieces = P.pieces_of(spark, str(tmp_path / "1.json"), "}")
    assert pieces.select("block").distinct().count() > 10


def test_csv_with_line_breaks_in_ranges(spark, tmp_path, small_ranges):
    rng = random.Random(2)
    rows = [(odd_text(rng).replace("\\", ""), "line one\nline, \"two\"\n\n" if i % 3 else "", str(i)) for i in range(900)]
    df = spark.createDataFrame(rows, "brand string, zeta string, n string").coalesce(1)
    K.write_csv(df, f"{tmp_path}/c")
    got, want = K.read_csv_export(spark, f"{tmp_path}/c", split=True), K.read_csv_export(spark, f"{tmp_path}/c")
    assert got.columns == want.columns == ["brand", "n", "zeta"]
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty() and got.count() == 900
    assert P.pieces_of(spark, f"{tmp_path}/c", "\n").select("block").distinct().count() > 10
    typed = K.read_csv_export(spark, f"{tmp_path}/c", spark.createDataFrame([], "brand string, n int, zeta string").schema, split=True)
    assert typed.agg(F.sum("n")).first()[0] == sum(range(900))


def test_replayed_and_merged_batches_count_once(spark, tmp_path):
    tables = T.BatchTables(spark, str(tmp_path))
    rows = lambda a, b: spark.range(a, b).select(F.col("id").alias("position"), (F.col("id") % 3 > 0).alias("ok"))
    for batch, (a, b) in enumerate(((101, 160), (1, 60), (60, 101), (160, 201))):
        for _ in range(2):
            tables.put("sums", batch, A.batch_sums(rows(a, b), F.col("ok")))
    want = sorted(map(tuple, A.batch_checkpoints(rows(1, 201), F.col("ok")).collect()))
    assert len(want) == 4
    for upto in (None, 0, 2, 1, 3):
        if upto is not None:
            tables.merge("sums", upto, A.merged_sums)
        assert sorted(map(tuple, T.checkpoints_so_far(tables, "sums").collect())) == want
