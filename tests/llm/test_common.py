import pytest
from pyspark.sql import functions as F

from quern.llm import common as C


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


def test_scans_with_a_split_for_each_core_stay_narrow(spark):
    cores = spark.sparkContext.defaultParallelism
    wide, few = spark.range(0, 1000, 1, cores), spark.range(0, 1000, 1, 1)
    assert exchanges(C.spread(wide)) == 0 and exchanges(C.spread(few)) > 0
    assert C.spread(few).count() == 1000


def test_encoding_a_scan_of_many_splits_has_no_shuffle(spark, tmp_path):
    from quern.llm import bpe, repetition

    cores = spark.sparkContext.defaultParallelism
    spark.range(0, 40, 1, cores * 2).select(F.col("id").alias("doc_id"), F.lit("one two").alias("text")).write.parquet(str(tmp_path / "d"))
    small, key = spark.conf.get("spark.sql.files.openCostInBytes"), "spark.sql.files.openCostInBytes"
    spark.conf.set(key, "134217728")  # a split for each file
    try:
        docs = spark.read.parquet(str(tmp_path / "d"))
        assert exchanges(bpe.encode(docs)) == 0 and exchanges(repetition.measure(docs)) == 0
        assert {tuple(r.ids) for r in bpe.encode(docs).collect()} == {tuple(bpe.BacktrackingBpe(*bpe.tokenizer_file()).encode("one two"))}
    finally:
        spark.conf.set(key, small)


def test_a_cluster_needs_a_shared_folder():
    class Session:
        class conf:
            get = staticmethod(lambda name, default: None)

        class sparkContext:
            master = "spark://head:7077"

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        C.shared_dir(Session)


def test_one_delivery_each(spark):
    df = spark.createDataFrame([("a", "x", 1), ("a", "x", 2), ("b", None, 3), (None, "y", 4)], "k string, t string, n int")
    assert sorted((r.k or "", r.t) for r in C.first_delivery(df, ["k"], ["t"]).collect()) == [("a", "x"), ("b", None)]
