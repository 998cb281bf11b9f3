import pytest
from pyspark.sql import functions as F

from quern.operators import retrieval as R
from quern.scope import TenantScope


def test_fusion_scores(spark):
    rows = [("q", "lexical", "a", 1), ("q", "lexical", "b", 2), ("q", "dense", "b", 2), ("q", "dense", "c", 1)]
    df = spark.createDataFrame(rows, "query_id string, source string, chunk_id string, rank int")
    got = {r.chunk_id: r for r in R.fuse(df).collect()}
    assert got["a"].fused_score == round(1 / 61, 9) and got["b"].fused_score == round(2 / 62, 9) and got["b"].position == 1 and got["a"].position == 2 and got["a"].dense_rank is None
    with pytest.raises(ValueError):
        R.fuse(df, 0)


def test_rerank_bounds(spark):
    rows = [("q", "a", "red door", "red door"), ("q", "b", "red door", "blue sky"), ("q", "c", "red door", None), ("p", "a", "x", "y"), ("p", "b", "x", "z")]
    df = spark.createDataFrame(rows, "query_id string, chunk_id string, query string, content string").fillna("")
    got = {(r.query_id, r.chunk_id): r for r in R.rerank(df).collect()}
    assert got["q", "a"].raw_score == 1.0 and got["q", "b"].raw_score == 0.0 and got["q", "c"].raw_score == 0.0
    assert got["p", "a"].normalized_score == got["p", "b"].normalized_score == 1.0 and got["p", "a"].rerank_rank == 1


def test_reranker_port(spark):
    df = spark.createDataFrame([("q", "a", 1, "x", "y"), ("q", "b", 2, "x", "x"), ("q", "c", 3, "x", "x")], "query_id string, chunk_id string, position int, query string, content string")

    def fails(queries, passages):
        raise RuntimeError("down")

    R.RERANKERS.update(fails=fails, short=lambda q, p: [1.0])
    got = sorted((r.rerank_rank, r.chunk_id, r.raw_score, r.normalized_score) for r in R.rerank(df, reranker="fails", tolerant=True).collect())
    assert got == [(1, "a", 0.0, 0.0), (2, "b", 0.0, 0.0), (3, "c", 0.0, 0.0)]
    for name, tolerant in (("fails", False), ("short", True)):
        with pytest.raises(Exception, match="down|scores for"):
            R.rerank(df.coalesce(1), reranker=name, tolerant=tolerant).collect()
    del R.RERANKERS["fails"], R.RERANKERS["short"]
    assert R.rerank(df.limit(0)).count() == 0


def test_top_k():
    assert [R.clamp_top_k(x) for x in (None, 3, 500)] == [10, 3, 50] and R.clamp_top_k(None, R.ANSWER_TOP_K, R.MAX_ANSWER_TOP_K) == 8 and R.clamp_top_k(99, most=R.MAX_ANSWER_TOP_K) == 20
    with pytest.raises(ValueError):
        R.clamp_top_k(0)


def test_dense_search_by_brute_force(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(3)
    vectors = [(i, "ab"[i % 2], rng.normal(size=8).round(1).tolist()) for i in range(120)] + [(200, "a", None), (201, "a", [0.0] * 8), (202, "a", [1.0]), (203, "a", [1.0] * 8), (204, "a", [1.0] * 8)]
    asked = [(1, "a", [1.0] * 8), (2, "b", rng.normal(size=8).tolist()), (3, "z", [1.0] * 8), (4, "a", [0.0] * 8), (5, "a", None)]
    v, q = spark.createDataFrame(vectors, "id int, ws string, vec array<float>"), spark.createDataFrame(asked, "query_id int, ws string, query_vec array<float>")
    for block in (8192, 16):
        monkeypatch.setattr(R, "BLOCK_ROWS", block)
        got = {(r.query_id, r["rank"]): r.id for r in R.dense_search(q, v, ["ws"], 7).collect()}
        want = {}
        for k, ws, x in asked[:2]:
            ok = [(round(-float(np.dot(x, w) / np.linalg.norm(x) / np.linalg.norm(w)), 9), i) for i, s, w in vectors if s == ws and w and len(w) == 8 and any(w)]
            want |= {(k, n): i for n, (_, i) in enumerate(sorted(ok)[:7], 1)}
        assert got == want


def test_cells_hold_every_vector(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    v = spark.createDataFrame([(i, rng.normal(size=6).tolist()) for i in range(200)], "id int, vec array<float>")
    q = v.where("id < 10").select(F.col("id").alias("query_id"), F.col("vec").alias("query_vec"))
    centres = R.train_cells(v, 8)
    rows = lambda df: sorted((r.query_id, r["rank"], r.id) for r in df.collect())
    exact = rows(R.dense_search(q, v, [], 5))
    assert rows(R.probed_search(q, v, [], centres, 8, 5)) == exact
    some = rows(R.probed_search(q, v, [], centres, 4, 5))
    assert len({(a, c) for a, _, c in some} & {(a, c) for a, _, c in exact}) >= 0.7 * len(exact)


def test_kept_index(spark, tmp_path):
    chunks = spark.createDataFrame([("w", "c1", "Rent rent due"), ("w", "c2", "rent"), ("other", "c3", "rent")], "workspace_id string, chunk_id string, content string")
    terms = spark.createDataFrame([("w", "rent"), ("w", "nothing")], "workspace_id string, term string")
    R.save_index(R.postings(chunks), str(tmp_path / "i"), 4)
    rows = lambda df: sorted((r.workspace_id, r.term, r.chunk_id, r.tf) for r in df.collect())
    assert rows(R.load_index(spark, str(tmp_path / "i"), terms, 4)) == rows(R.postings(chunks, terms)) == [("w", "rent", "c1", 2), ("w", "rent", "c2", 1)]


def test_lexical_counts_positions(spark):
    chunks = spark.createDataFrame([("w", "c1", "Rent rent due"), ("w", "c2", "rent"), ("other", "c3", "rent")], "workspace_id string, chunk_id string, content string")
    q = spark.createDataFrame([("q", "w", "rent", None, ["due", "rent"])], "query_id string, workspace_id string, normalized string, transliterated string, expansions array<string>")
    assert [(r.chunk_id, r.score, r.rank) for r in R.lexical_search(q, R.postings(chunks)).orderBy("rank").collect()] == [("c1", 0.3, 1), ("c2", 0.1, 2)]


def test_scope_fails_closed(spark, sf):
    assert TenantScope(spark, sf).table("chunks").count() == 0
    everyone = TenantScope(spark, sf, everyone=True).table("chunks")
    ws = everyone.first().workspace_id
    assert TenantScope(spark, sf, ws).table("chunks").where(f"workspace_id <> '{ws}'").count() == 0
    with pytest.raises(Exception, match="foreign"):
        TenantScope(spark, sf, "nobody").add("chunks", everyone).collect()


def test_recall_of_cells(spark):
    from quern.plans import registry

    rows = [{(r.query_id, r.id) for r in registry.queries()[n](spark, "/root/testdata/sf0.1").collect()} for n in ("dense_topk", "cell_topk")]
    assert len(rows[0] & rows[1]) >= 0.9 * len(rows[0]) > 0


def test_lexical_search_by_brute_force(spark, monkeypatch):
    import random

    rnd = random.Random(2)
    draw = lambda n: " ".join(rnd.choice(["rent", "due", "day", "வாடகை", "x1", "park", "free"]) for _ in range(n))
    chunks = [("ab"[i % 2], f"c{i:03d}", draw(i % 9)) for i in range(150)] + [("a", "null", None), (None, "c900", "rent"), ("z", "c901", "rent")]
    asked = [(f"q{i}", "ab"[i % 2], draw(i % 5), None, [draw(1)]) for i in range(30)] + [("q90", "nowhere", "rent", None, None), ("q91", "a", "absent", None, None), ("q92", None, "rent", None, None)]
    c = spark.createDataFrame(chunks, "workspace_id string, chunk_id string, content string")
    q = spark.createDataFrame(asked, "query_id string, workspace_id string, normalized string, transliterated string, expansions array<string>")
    want = set()
    for k, ws, text, _, more in asked:
        terms = set(f"{text} {' '.join(more or [])}".split())
        n = sorted((-sum(t in terms for t in (content or "").split()), i) for w, i, content in chunks if w == ws and ws)
        want |= {(k, i, round(-m * 0.1, 6), r) for r, (m, i) in enumerate(n[:7], 1) if m}
    for part, block in ((8192, 2_000_000), (4, 20)):
        monkeypatch.setattr(R, "PART_QUERIES", part)
        monkeypatch.setattr(R, "BLOCK_WORDS", block)
        for index in (c, R.postings(c)):
            assert {(r.query_id, r.chunk_id, r.score, r["rank"]) for r in R.lexical_search(q, index, 7).collect()} == want


def test_no_match_is_a_row(spark, sf):
    """Every chunk matching every query: 9 million matches, of which 3,000 leave their tile."""
    c = spark.range(3000).selectExpr("'w' workspace_id", "cast(id as string) chunk_id", "'rent is due' content")
    q = spark.range(3000).selectExpr("cast(id as string) query_id", "'w' workspace_id", "'rent' normalized", "cast(null as string) transliterated", "cast(null as array<string>) expansions")
    found = R.lexical_search(q, c, 1)
    assert found.count() == 3000 and found.select("chunk_id").distinct().collect()[0].chunk_id == "0"
    assert "FlatMapCoGroupsInArrow" in found._jdf.queryExecution().executedPlan().toString()


def test_hybrid_search_is_planned_once(spark, sf):
    from quern.plans import registry

    for name in ("hybrid_search", "search_metadata"):
        plan = registry.queries()[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("sum((1.0 /") == 1 and plan.count("FlatMapCoGroupsInArrow") == 2, name  # one fusion of one lexical and one dense search


def test_postings_are_counted_within_their_chunk(spark):
    chunks = spark.createDataFrame([("w", "c1", "Rent rent due"), ("w", "c2", None), ("w", "c3", "")], "workspace_id string, chunk_id string, content string")
    index = R.postings(chunks)
    assert sorted((r.term, r.chunk_id, r.tf) for r in index.collect()) == [("due", "c1", 1), ("rent", "c1", 2)]
    assert "Exchange" not in index._jdf.queryExecution().executedPlan().toString()


def test_content_is_moved_by_chunk_only(spark, sf):
    """Every exchange that carries content or its deliveries is by chunk; none is by version or
    workspace, and texts reach their tiles as terms."""
    from quern.plans import registry

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = registry.queries()["search_metadata"](spark, sf)
        text = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    moved = [part for part in text.split("\n\n") if "\nInput" in part and " Exchange" in part.split("\n")[0] and "content#" in part]
    assert moved and all("hashpartitioning(chunk_id#" in part for part in moved)


def test_chunks_of_several_versions(spark, tmp_path):
    from test_pipeline import corpus

    corpus(spark, str(tmp_path))
    old, late = "2024-01-01 00:00:00", "2024-02-01 00:00:00"
    chunks = spark.read.parquet(f"{tmp_path}/chunks.parquet")
    again = [("c1", "v3", late), ("c4", "v1", old), ("c9", "v2", old), ("c8", None, old)]  # now not ready; once ready; foreign document; nowhere
    more = spark.createDataFrame(again, "chunk_id string, version_id string, loaded_at string").join(chunks.where("chunk_id = 'c2'").drop("chunk_id", "version_id", "loaded_at"))
    chunks.unionByName(more).write.parquet(f"{tmp_path}/more/chunks.parquet")
    for t in ("documents", "document_versions"):
        spark.read.parquet(f"{tmp_path}/{t}.parquet").write.parquet(f"{tmp_path}/more/{t}.parquet")
    scope = TenantScope(spark, f"{tmp_path}/more", everyone=True)
    assert sorted((r.chunk_id, r.version_id) for r in R.ready_chunks(scope, "version_id").collect()) == [("c1", "v1"), ("c2", "v1"), ("c3", "v2"), ("c4", "v1"), ("c9", "v2")]
    found = spark.createDataFrame([(c,) for c in ("c1", "c2", "c3", "c4", "c8", "c9", "none")], "chunk_id string")
    assert sorted((r.chunk_id, r.version_id, r.document_id) for r in R.hydrate(found, scope).collect()) == [("c2", "v1", "d1"), ("c3", "v2", "d2")]
