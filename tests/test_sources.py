import datetime as dt

import pytest
from pyspark.sql import types as T

from caseloom import session
from caseloom import sources as S

SCHEMA = T.StructType([T.StructField("k", T.LongType()), T.StructField("day", T.DateType()), T.StructField("note", T.StringType())])


def test_drifting_inputs_keep_their_order(spark, tmp_path):
    (tmp_path / "one.csv").write_text('k,Day ,note\n3,2021-01-01,"a, ""b"""\n1,bad,\n')
    (tmp_path / "two.csv").write_text("junk,k,day\n,2,2021-01-02\n,x,2021-01-03\n")
    paths = [str(tmp_path / "one.csv"), str(tmp_path / "two.csv")]
    df = S.read_harmonised(spark, paths, SCHEMA, {"Day ": "day"}, ["junk"], "csv", keep_order=True)
    rows = df.orderBy(S.tables.SOURCE_ORDER).drop(S.tables.SOURCE_ORDER).collect()
    assert [tuple(r) for r in rows] == [
        (3, dt.date(2021, 1, 1), 'a, "b"'), (1, None, None), (2, dt.date(2021, 1, 2), None), (None, dt.date(2021, 1, 3), None),
    ]


def test_parquet_order_survives_many_files(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(0, 1000, 1, 7).withColumnRenamed("id", "k").write.parquet(path)
    df = S.read_harmonised(spark, [path], keep_order=True)
    assert [r["k"] for r in df.orderBy(S.tables.SOURCE_ORDER).collect()] == list(range(1000))


def test_types_are_found(spark):
    df = spark.createDataFrame(
        [("1", "1.5", "true", "2021-01-01", "2021-01-01 10:00:00", "x", 2.0, None), (None, "2", "False", "2021-01-02", "2021-01-02T11:00", "1", None, None)],
        "a string, b string, c string, d string, e string, f string, g double, h string",
    )
    kinds = dict(S.infer_types(df).dtypes)
    assert kinds == {
        "a": "bigint", "b": "double", "c": "boolean", "d": "date", "e": "timestamp_ntz", "f": "string", "g": "bigint", "h": "string",
    }
    assert dict(S.infer_types(df, ["a"]).dtypes)["b"] == "string"


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_written_tables_are_replaced(spark, tmp_path, fmt):
    path = str(tmp_path / "t")
    rows = [(1, dt.date(2021, 1, 1), 'say "hi", ok'), (2, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    S.write_table(df.union(df), path, fmt)
    S.write_table(df, path, fmt)
    assert sorted(map(tuple, S.read_table(spark, path, SCHEMA, fmt).collect())) == rows


class _Session:
    """What the scratch folder looks at."""

    def __init__(self, conf, checkpoint=None, master="yarn"):
        self.conf, self.sparkContext, self.master, self.checkpoint = conf, self, master, checkpoint

    def getCheckpointDir(self):
        return self.checkpoint

    def setCheckpointDir(self, folder):
        self.checkpoint = folder


def test_scratch_folder_is_the_shared_one():
    shared = _Session({"spark.checkpoint.dir": "hdfs://shared/tmp/"}, "hdfs://other")
    assert session.scratch_path(shared, "x").startswith("hdfs://shared/tmp/x-")
    assert session.scratch_dir(_Session({}, "hdfs://other")) == "hdfs://other"
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.scratch_dir(_Session({}))
    local = _Session({}, master="local[2]")
    assert session.scratch_dir(local) == session.scratch_dir(local) == local.checkpoint


def test_shuffles_are_sized_by_the_input(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        session.tune(spark, 100 * 10**9)
        assert int(spark.conf.get("spark.sql.shuffle.partitions")) == 746
        session.tune(spark, 1)
        assert int(spark.conf.get("spark.sql.shuffle.partitions")) == 746
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
