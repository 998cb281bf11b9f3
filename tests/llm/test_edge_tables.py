"""Every query of the training-data operators over odd tables."""

import glob
import os

import pytest
from pyspark.sql import functions as F

queries = pytest.importorskip("quern.llm.queries")

#: Names that operators use for columns of their own.
CLASHES = ("key", "g", "a", "b", "n", "k", "model", "kind", "rate", "copies", "share", "closeness", "canon", "raw", "text_id", "label", "block", "part", "unit", "position", "found")


def tables(sf):
    return {os.path.basename(p)[:-8]: p for p in glob.glob(f"{sf}/*.parquet")}


@pytest.fixture(scope="module")
def empty(spark, sf, tmp_path_factory):
    to = str(tmp_path_factory.mktemp("empty"))
    for name, path in tables(sf).items():
        spark.read.parquet(path).limit(0).write.parquet(f"{to}/{name}.parquet")
    return to


@pytest.fixture(scope="module")
def odd(spark, sf, tmp_path_factory):
    """Rows delivered twice, rows of nulls in all but the keys, and columns of clashing names."""
    to = str(tmp_path_factory.mktemp("odd"))
    keys = {"chunks": "chunk_id", "pages": "page_id", "document_versions": "version_id", "chunk_embeddings": "embedding_id", "processed_queries": "query_id", "documents": "doc_id"}
    for name, path in tables(sf).items():
        df = spark.read.parquet(path)
        if name in keys:
            bare = df.limit(3).select(*[(F.concat(F.col(c), F.lit("-bare")) if t == "string" else F.col(c) + 10_000_000).alias(c) if c == keys[name] else F.lit(None).cast(t).alias(c) for c, t in df.dtypes])
            nameless = df.limit(2).withColumn(keys[name], F.lit(None).cast(dict(df.dtypes)[keys[name]])) if name != "documents" else df.limit(0)
            df = df.unionByName(df.limit(5)).unionByName(bare).unionByName(nameless) if name != "documents" else df.unionByName(bare)
        if name in keys or name in ("retrieved_chunks", "lexical_matches", "vector_matches"):
            df = df.select("*", *[F.lit("clash").alias(c) for c in CLASHES if c not in df.columns])
        df.write.parquet(f"{to}/{name}.parquet")
    return to


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_empty_tables_give_no_rows(spark, empty, name):
    assert queries.queries()[name](spark, empty).count() == 0


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_odd_rows_change_nothing_for_the_others(spark, sf, odd, name):
    """Twice delivered and bare rows add at most rows of their own ids."""
    plain, strange = rows(spark, sf, name), rows(spark, odd, name)
    if name in ("p9_found", "p9_mix", "p9_shares", "p8_ids", "p10_shares"):
        return  # documents are unique by id; theirs is only that nothing fails
    assert {r for r in strange if "-bare" not in str(r)} == plain


def rows(spark, where, name):
    df = queries.queries()[name](spark, where)
    return {str(tuple(r)) for r in df.select(*sorted(df.columns)).collect()}
