"""Hashing embeddings, and upserts of embedding tables."""

from __future__ import annotations

import functools
import hashlib
import time
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window, functions as F

from quern.functions.text import feature_list, normalize_for_match
from quern.session import cut_lineage

WIDTH, VERSION, BATCH = 1024, "v1", 32


@functools.lru_cache(1 << 18)
def project(feature: str, version: str, width: int) -> tuple[int, float]:
    """(bucket, sign) of a feature: salted 64-bit blake2b, sign by its top bit."""
    raw = int.from_bytes(hashlib.blake2b(feature.encode(), digest_size=8, salt=version.encode()[:16]).digest(), "big")
    return raw % width, 1.0 if raw >> 63 else -1.0


def embed(df: DataFrame, key: str, text: str, width: int = WIDTH, version: str = VERSION) -> DataFrame:
    """(key, embedding): signed hashed features, scaled to length 1; a text without features
    gets the first unit vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = np.zeros((b.num_rows, width))
            for row, features in enumerate(b.column(1).to_pylist()):
                for f, n in Counter(features or ()).items():
                    bucket, sign = project(f, version, width)
                    out[row, bucket] += sign * n
            norms = np.linalg.norm(out, axis=1)
            out[norms == 0, 0] = 1.0
            out /= np.where(norms == 0, 1.0, norms)[:, None]
            offsets = pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * width)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(offsets, pa.array(out.astype(np.float32).ravel()))], [key, "embedding"])

    features = df.select(key, feature_list(normalize_for_match(F.col(text))).alias("features"))
    return features.mapInArrow(run, f"`{key}` {dict(df.dtypes)[key]}, embedding array<float>")


#: Providers by name: texts of a batch to vectors of the width asked, one each.
Provider = Callable[[list[str], int], np.ndarray]


def retrying(provider: Provider, errors: tuple[type[Exception], ...], attempts: int = 3, backoff: float = 0.05) -> Provider:
    """A provider that is asked again, after a growing wait, when it raises one of the errors."""

    def ask(texts: list[str], width: int) -> np.ndarray:
        for n in range(1, attempts + 1):
            try:
                return provider(texts, width)
            except errors:
                if n == attempts:
                    raise
                time.sleep(backoff * n)

    return ask


def checked(vectors: np.ndarray, texts: list[str], width: int) -> np.ndarray:
    """The vectors, if there is one of the right width for each text."""
    vectors = np.asarray(vectors, dtype=np.float32)
    if vectors.shape != (len(texts), width):
        raise ValueError(f"{len(texts)} texts gave vectors of shape {vectors.shape}, not {(len(texts), width)}")
    return vectors


def embed_with(df: DataFrame, key: str, text: str, provider: Provider, width: int = WIDTH, batch: int = BATCH) -> DataFrame:
    """(key, embedding) by any provider, asked for ``batch`` texts at a time, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, batch):
                part = b.slice(at, batch)
                texts = [t or "" for t in part.column(1).to_pylist()]
                out = checked(provider(texts, width), texts, width)
                offsets = pa.array(np.arange(len(texts) + 1, dtype=np.int32) * width)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(offsets, pa.array(out.ravel()))], [key, "embedding"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {dict(df.dtypes)[key]}, embedding array<float>")


def of_known_chunks(incoming: DataFrame, chunks: DataFrame) -> DataFrame:
    """Incoming embeddings, checked to belong to a chunk of the same workspace; one that does not
    fails the job."""
    known = chunks.select("chunk_id", F.col("workspace_id").alias("_owner")).distinct()
    joined = incoming.join(known, "chunk_id", "left")
    foreign = F.col("_owner").isNull() | (F.col("_owner") != F.col("workspace_id"))
    return joined.withColumn("chunk_id", F.when(foreign, F.raise_error(F.concat(F.lit("embedding of a foreign chunk: "), "chunk_id"))).otherwise(F.col("chunk_id"))).drop("_owner")


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Existing and incoming rows, the newest of each key kept; incoming ones win ties."""
    both = existing.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    w = Window.partitionBy(*keys).orderBy(F.desc("_new"), F.desc(order))
    return both.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_new")


def delete(existing: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return existing.join(gone.select(*keys).distinct(), keys, "left_anti")


def replace_versions(rows: DataFrame, path: str, versions: DataFrame | None = None, shards: int = 64) -> None:
    """Replace all rows of ``versions`` (by default those of the rows) and no others, so that
    reprocessing never duplicates. The table is kept in shards by version, not in a folder for
    each; the shards touched are read, merged and overwritten whole."""
    spark = rows.sparkSession
    shard = F.pmod(F.xxhash64("version_id"), F.lit(shards)).cast("int")
    gone = (rows if versions is None else versions).select("version_id").distinct()
    new = rows.withColumn("shard", shard)
    touched = gone.select(shard.alias("shard")).distinct()
    try:
        old = spark.read.parquet(path)
    except AnalysisException:  # nothing there yet
        old = None
    if old is not None:
        kept = old.join(F.broadcast(touched), "shard", "left_semi").join(gone, "version_id", "left_anti")  # at most a row a shard
        new = cut_lineage(new.unionByName(kept, allowMissingColumns=True))  # read before its files are overwritten
    new.repartition("shard").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(path)
    if old is not None:  # a shard left without rows is not overwritten by writing none
        left = {r.shard for r in new.select("shard").distinct().collect()}
        for r in touched.collect():  # at most a row a shard
            if r.shard not in left:
                folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/shard={r.shard}")
                folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
