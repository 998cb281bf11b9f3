"""Tables of the data model: key checks that storage would otherwise enforce."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

# The states that rows can have.
ENUMS = {
    "document_status": ("pending", "processing", "ready", "failed", "quarantined"),
    "answer_status": ("answered", "partial", "abstained"),
    "claim_verdict": ("supported", "unsupported", "contradicted", "ambiguous"),
    "entailment": ("supported", "partial", "contradicted", "unsupported"),
    "decision": ("answer", "answer_with_warning", "ask_for_clarification", "abstain", "escalate_for_review"),
    "safety_decision": ("allow", "flag", "quarantine"),
    "language": ("tam", "eng", "tanglish", "unknown"),
}

UNIQUE = {
    "document_versions": (("version_id",), ("document_id", "version_number"), ("storage_key",)), "pages": (("page_id",), ("version_id", "page_number")),
    "chunks": (("chunk_id",), ("version_id", "chunk_index")), "chunk_embeddings": (("embedding_id",), ("chunk_id", "model", "model_version")),
}
FOREIGN = {"document_versions": (("document_id", "documents", "document_id"),), "pages": (("version_id", "document_versions", "version_id"),), "chunks": (("version_id", "document_versions", "version_id"),), "chunk_embeddings": (("chunk_id", "chunks", "chunk_id"),)}


def duplicate_keys(df: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def orphans(df: DataFrame, column: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Rows whose non-null reference has no parent."""
    return df.where(F.col(column).isNotNull()).join(parent.select(F.col(parent_key).alias(column)).distinct(), column, "left_anti")


def out_of_range(df: DataFrame, *checks: Column) -> DataFrame:
    """Rows that break any check; null passes, as in storage constraints."""
    return df.where(~reduce(lambda a, b: a & b, [F.coalesce(c, F.lit(True)) for c in checks]))


def in_enum(column: str, name: str) -> Column:
    """Whether a value is one of those that the rows may have; null passes."""
    return F.col(column).isin(*ENUMS[name])


def confidence_in_range(column: str) -> Column:
    return F.col(column).between(0.0, 1.0)
