"""Append-only sinks: the audit log, security events and dead letters. What they record holds
counts, codes and ids, never the text of a document."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

AUDIT = "workspace_id string, actor_id string, action string, resource_type string, resource_id string, detail map<string,string>, at timestamp"
# Actions that are recorded.
ACTIONS = ("document.uploaded", "document.ready", "document.quarantined", "document.prompt_injection_flagged", "document.ingestion_failed", "rag.answer", "citation.resolve")


class AppendOnly:
    """A Parquet log. Each entry has an id made from its content, so entries written twice, as by
    a replayed batch, are read once. Nothing can be taken out."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path, schema

    def append(self, rows: DataFrame) -> None:
        names = [c.split()[0] for c in self.schema.split(", ")]
        missing = [n for n in names if n not in rows.columns]
        if missing:
            raise ValueError(f"missing columns: {missing}")
        kept = rows.select(*names)
        kept.withColumn("entry_id", F.sha2(F.to_json(F.struct(*names)), 256)).withColumn("day", F.to_date("at")).write.mode("append").partitionBy("day").parquet(self.path)

    def read(self) -> DataFrame:
        try:
            return self.spark.read.parquet(self.path).dropDuplicates(["entry_id"])
        except AnalysisException:  # nothing there yet
            return self.spark.createDataFrame([], f"{self.schema}, entry_id string, day date")

    def delete(self, *_: object) -> None:
        raise PermissionError("the log is append-only")


def audit_log(spark: SparkSession, path: str) -> AppendOnly:
    return AppendOnly(spark, path, AUDIT)


def _detail(**values: Column) -> Column:
    return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v.cast("string"))])


def _entry(df: DataFrame, action: Column, kind: str, resource: str, detail: Column, at: Column) -> DataFrame:
    return df.select("workspace_id", F.lit(None).cast("string").alias("actor_id"), action.alias("action"), F.lit(kind).alias("resource_type"), F.col(resource).alias("resource_id"), detail.alias("detail"), at.alias("at"))


def answer_entries(answers: DataFrame, at: Column) -> DataFrame:
    """Audit rows of composed answers (query_id, workspace_id, decision, status, confidence,
    supported, dropped)."""
    detail = _detail(decision=F.col("decision"), status=F.col("status"), confidence=F.col("confidence"), supported=F.col("supported"), dropped=F.col("dropped"))
    return _entry(answers, F.lit("rag.answer"), "query", "query_id", detail, at)


def citation_entries(resolved: DataFrame, at: Column) -> DataFrame:
    """Audit rows of resolved and of rejected references alike (ref_id, workspace_id, error)."""
    return _entry(resolved, F.lit("citation.resolve"), "reference", "ref_id", _detail(outcome=F.coalesce("error", F.lit("resolved"))), at)


def security_events(verdicts: DataFrame, at: Column) -> DataFrame:
    """Audit rows of documents that were flagged or quarantined (workspace_id, version_id,
    decision, reason, flagged, quarantined, max_score)."""
    bad = verdicts.where("decision <> 'allow'")
    action = F.when(F.col("decision") == "quarantine", "document.quarantined").otherwise("document.prompt_injection_flagged")
    detail = _detail(reason=F.col("reason"), flagged=F.col("flagged"), quarantined=F.col("quarantined"), max_score=F.col("max_score"))
    return _entry(bad, action, "document_version", "version_id", detail, at)


MESSAGE = "job_id string, workspace_id string"


def encode_message(job: Column, workspace: Column) -> Column:
    return F.to_json(F.struct(job.alias("job_id"), workspace.alias("workspace_id")))


def decode_message(message: Column) -> Column:
    """struct(job_id, workspace_id); null for what is no message."""
    m = F.from_json(message, MESSAGE)
    return F.when(m["job_id"].isNotNull() & m["workspace_id"].isNotNull(), m)


def dead_letters(messages: DataFrame, attempts: DataFrame) -> DataFrame:
    """Messages (value) of jobs that have failed for good (job_id, state), and undecodable ones."""
    m = messages.withColumn("_m", decode_message(F.col("value"))).withColumn("job_id", F.col("_m.job_id"))
    dead = m.join(attempts.where("state = 'dead'").select("job_id", "error"), "job_id", "left")
    return dead.where("_m is null or error is not null").select("value", F.when(F.col("_m").isNull(), "undecodable").otherwise(F.col("error")).alias("error"))
