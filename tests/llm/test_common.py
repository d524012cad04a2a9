import pytest
from pyspark.sql import functions as F
from vacantia.llm import common


def test_joins_with_hot_keys(spark):
    """Half of all rows under one key, and some under none: the same rows as a plain join."""
    many = spark.range(20_000).select(F.when(F.col("id") % 2 == 0, 0).when(F.col("id") % 7 == 0, None).otherwise(F.col("id")).alias("k"), "id")
    one = common.cut(many.groupBy("k").agg(F.max("id").alias("last"), F.count(F.lit(1)).alias("n")))
    got = common.spread_join(many, one, "k", 20_000)
    want = many.join(one.drop("n"), "k")
    assert got.columns == want.columns and got.exceptAll(want).isEmpty() and got.count() == want.count()
    calm = common.cut(spark.range(5000).select(F.col("id").alias("k"), F.lit(1).alias("n"), F.lit("x").alias("v")))
    assert common.spread_join(many, calm, "k", 10**9).count() == many.where("k < 5000").count()


def test_literal_rows_and_whole_rows(spark):
    rows = [{"a": -(1 << 63), "b": "é\n'\"", "c": [{"end": 3, "shard": 1}]}, {"a": None, "b": None, "c": []}]
    got = common.literal_rows(spark, rows, "a:long,b:string,c:array<struct<end:long,shard:int>>")
    assert [r.asDict(True) for r in got.collect()] == rows and common.literal_rows(spark, [], "a:long").count() == 0
    odd = spark.createDataFrame([(1, 2, 3)], "`a.b` int, `c``d` int, doc int")
    assert odd.select(common.whole(odd).alias("doc")).select("doc.*").columns == odd.columns


def test_intermediates_are_removed(spark, tmp_path):
    kept = common.write_shared(spark.range(5), "some")
    common.cut(spark.range(5))
    path = kept.inputFiles()[0]
    common.release(spark)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path).count()
    assert common.cut(spark.range(5)).count() == 5


def test_a_cluster_without_a_shared_folder_is_an_error():
    class Gone:
        def isDefined(self):  # noqa: N802
            return False

    class Context:
        master = "spark://host:7077"
        _jsc = type("J", (), {"sc": lambda self: type("S", (), {"getCheckpointDir": lambda self: Gone()})()})()

    class Session:
        sparkContext = Context()
        conf = type("C", (), {"get": lambda self, key, other=None: other})()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.shared_dir(Session())
