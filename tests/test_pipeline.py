
from quern.operators import answers as A
from quern.plans import pipeline
from quern.scope import TenantScope

WHEN = "2024-01-01 00:00:00"


def corpus(spark, path):
    texts = {"c1": ("w", "v1", "The rent is due on the fifth day of each month. Parking is free."), "c2": ("w", "v1", "The deposit is returned within 30 days."), "c3": ("other", "v2", "The rent is due at once."), "c4": ("w", "v3", "The rent is due in a document that is not ready.")}
    chunks = [(k, ws, v, n, t, 12, 1, None, 0, len(t), "eng", None, None, WHEN, WHEN) for n, (k, (ws, v, t)) in enumerate(texts.items())]
    spark.createDataFrame(chunks, "chunk_id string, workspace_id string, version_id string, chunk_index int, content string, token_count int, page_number int, section string, char_start int, char_end int, language string, ocr_engine string, ocr_confidence double, created_at string, loaded_at string").write.parquet(f"{path}/chunks.parquet")
    spark.createDataFrame([("v1", "d1"), ("v2", "d2"), ("v3", "d3")], "version_id string, document_id string").write.parquet(f"{path}/document_versions.parquet")
    spark.createDataFrame([("d1", "w", "ready"), ("d2", "other", "ready"), ("d3", "w", "pending")], "document_id string, workspace_id string, status string").write.parquet(f"{path}/documents.parquet")
    vectors = [(f"e{k}", ws, k, "m", "v1", 2, [1.0, 0.0] if k != "c2" else [0.0, 1.0], WHEN) for k, (ws, _, _) in texts.items()]
    spark.createDataFrame(vectors, "embedding_id string, workspace_id string, chunk_id string, model string, model_version string, dimensions int, embedding array<float>, created_at string").write.parquet(f"{path}/chunk_embeddings.parquet")


def test_answers_end_to_end(spark, tmp_path):
    corpus(spark, str(tmp_path))
    asked = [("q1", "w", "when is the rent due"), ("q2", "w", "zzz"), ("q3", "nobody", "when is the rent due")]
    queries = spark.createDataFrame([(q, ws, t, t, None, None) for q, ws, t in asked], "query_id string, workspace_id string, original string, normalized string, transliterated string, expansions array<string>")
    vectors = spark.createDataFrame([("q1", "w", "m", "v1", [1.0, 0.1]), ("q3", "nobody", "m", "v1", [1.0, 0.1])], "query_id string, workspace_id string, model string, model_version string, query_vec array<float>")
    got = {r.query_id: r for r in pipeline.answer_queries(queries, TenantScope(spark, str(tmp_path), everyone=True), vectors).collect()}
    assert set(got) == {"q1", "q2", "q3"}
    claim = next(c for c in got["q1"].claims if c.citation.chunk_id == "c1")
    assert got["q1"].status in ("answered", "partial") and claim.text == "The rent is due on the fifth day of each month."
    assert {c.citation.chunk_id for c in got["q1"].claims} <= {"c1", "c2"}  # never of another workspace, nor of what is not ready
    for q in ("q2", "q3"):
        assert (got[q].answer, got[q].abstention_reason, got[q].claims, got[q].confidence) == (A.ABSTENTION, "insufficient_evidence", [], 0.0)
    bound = TenantScope(spark, str(tmp_path), "w")
    assert {r.query_id: r.status for r in pipeline.answer_queries(queries, bound, vectors).collect()} == {q: got[q].status for q in got}
    nothing = TenantScope(spark, str(tmp_path))  # fails closed
    assert {r.status for r in pipeline.answer_queries(queries, nothing, vectors).collect()} == {"abstained"}


def test_other_versions_of_a_model_are_not_compared(spark, tmp_path):
    corpus(spark, str(tmp_path))
    queries = spark.createDataFrame([("q", "w", "zzz", "zzz", None, None)], "query_id string, workspace_id string, original string, normalized string, transliterated string, expansions array<string>")
    for version, n in (("v1", 2), ("v2", 0)):
        vectors = spark.createDataFrame([("q", "w", "m", version, [1.0, 0.1])], "query_id string, workspace_id string, model string, model_version string, query_vec array<float>")
        answers = pipeline.answer_queries(queries, TenantScope(spark, str(tmp_path), everyone=True), vectors).first()
        assert answers.evidence == n


def test_answers_search_once_and_limit_before_content(spark, tmp_path, monkeypatch):
    corpus(spark, str(tmp_path))
    queries = spark.createDataFrame([("q", "w", "rent", "rent", None, None)], "query_id string, workspace_id string, original string, normalized string, transliterated string, expansions array<string>")
    vectors = spark.createDataFrame([("q", "w", "m", "v1", [1.0, 0.1])], "query_id string, workspace_id string, model string, model_version string, query_vec array<float>")
    plans = []
    monkeypatch.setattr(pipeline, "cut_lineage", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or df)
    pipeline.answer_queries(queries, TenantScope(spark, str(tmp_path), everyone=True), vectors)
    assert plans[0].count("sum((1.0 /") == 1


def test_claims_are_judged_once_and_content_stays_behind(spark, tmp_path):
    corpus(spark, str(tmp_path))
    queries = spark.createDataFrame([("q", "w", "rent", "rent", None, None)], "query_id string, workspace_id string, original string, normalized string, transliterated string, expansions array<string>")
    vectors = spark.createDataFrame([("q", "w", "m", "v1", [1.0, 0.1])], "query_id string, workspace_id string, model string, model_version string, query_vec array<float>")
    plan = pipeline.answer_queries(queries, TenantScope(spark, str(tmp_path), everyone=True), vectors)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapIn" not in plan and "content" not in plan
