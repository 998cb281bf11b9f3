"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def first_delivery(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """One row per key; rows without a key are left out. Re-delivered rows agree in ``columns``, so any of them serves;
    the least non-null value is taken to stay deterministic. Only ``columns`` are shuffled,
    after a map-side merge."""
    return df.dropna(subset=keys).groupBy(*keys).agg(*[F.min(c).alias(c) for c in columns if c not in keys])


def map_batches(df: DataFrame, schema: str, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]]) -> DataFrame:
    """mapInArrow whose function is made once per task by ``make``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            if batch.num_rows:
                yield fn(batch)

    return df.mapInArrow(run, schema)


def spread(df: DataFrame) -> DataFrame:
    """A scan before CPU-heavy work. One with at least as many splits as there are cores stays as
    it is, so large tables are never shuffled; few splits are dealt out anew. For scans and what is
    narrow over them only: the count of splits would run whatever else comes before."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(max(cores * 2, 8))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. Where none is set, one is made for a local session;
    on a cluster that is an error, as a folder of one machine would not serve the others."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    if set_dir:
        return set_dir
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    import tempfile

    made = "file://" + tempfile.mkdtemp(prefix="quern-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder; reliable, so it survives lost executors."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()
