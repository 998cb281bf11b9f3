"""Tenant scope: the only way to read tenant tables; unbound it yields nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def deliveries(df: DataFrame, *keys: str, columns: tuple[str, ...] | None = None) -> DataFrame:
    """One row per key: the latest delivery of each; of rows delivered at one time, that with the
    greatest values. Merges map-side before its shuffle. Only ``columns`` are read and shuffled
    where they are given: a struct of all would defeat the pruning of columns."""
    order = [c for c in ("loaded_at", "created_at") if c in df.columns]
    rest = [c for c in (columns or df.columns) if c not in keys and c not in order]
    kept = [c for c in (columns or df.columns) if c not in keys]
    return df.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("r")).select(*keys, *[F.col(f"r.{c}") for c in kept])


class TenantScope:
    def __init__(self, spark: SparkSession, sf_dir: str, workspace_id: str | None = None, everyone: bool = False):
        self.spark, self.sf_dir, self.workspace_id, self.everyone = spark, sf_dir, workspace_id, everyone

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def table(self, name: str) -> DataFrame:
        """Rows of the bound workspace; ``everyone`` is for batches keyed by workspace."""
        df = self.raw(name)
        if self.everyone:
            return df
        return df.where(F.col("workspace_id") == self.workspace_id) if self.workspace_id is not None else df.where(F.lit(False))

    def add(self, name: str, rows: DataFrame) -> DataFrame:
        """Rows checked to belong to the scope; one of a foreign workspace fails the job."""
        foreign = F.col("workspace_id").isNull() | (F.col("workspace_id") != F.lit(self.workspace_id))
        return rows.withColumn("workspace_id", F.when(foreign, F.raise_error(F.lit(f"{name}: row of a foreign workspace"))).otherwise(F.col("workspace_id")))

    def get(self, name: str, key: str, value: str) -> DataFrame:
        return self.table(name).where(F.col(key) == value)

    def ready_versions(self) -> DataFrame:
        """version_id, document_id and workspace_id of versions of ready documents."""
        documents = self.table("documents").where("status = 'ready'").select("document_id", "workspace_id")
        versions = self.raw("document_versions").select("version_id", "document_id").distinct()
        return versions.join(documents, "document_id")

    def newest_documents(self, limit: int | None = None) -> DataFrame:
        """Documents of the scope, the newest first."""
        ordered = self.table("documents").orderBy(F.desc("created_at"), "document_id")
        return ordered if limit is None else ordered.limit(limit)

    def views(self) -> None:
        """Temporary views with the scope baked in, for the SQL interface."""
        for name in ("documents", "chunks", "chunk_embeddings", "processed_queries", "retrieved_chunks"):
            self.table(name).createOrReplaceTempView(f"scoped_{name}")
