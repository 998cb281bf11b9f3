import numpy as np

from quern.llm import neighbors as N


def brute(rows, threshold):
    out = set()
    for i, (a, x, g) in enumerate(rows):
        for b, y, h in rows[i + 1 :]:
            if g == h and a != b and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold:
                out.add((min(a, b), max(a, b)))
    return out


def test_pairs_against_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 16))
    rows = [(f"v{i:03}", base[i % 40] * rng.uniform(0.1, 9) + rng.normal(size=16) * 0.25, "ab"[i % 2]) for i in range(240)]
    data = [(k, [float(x) for x in v.astype(np.float32)], g, 1.0) for k, v, g in rows]
    data += data[:5] + [("null", None, "a", 1.0), ("zero", [0.0] * 16, "a", 1.0), ("nan", [float("nan")] * 16, "a", 1.0), ("short", [1.0], "a", 1.0), ("empty", [], "a", 1.0)]
    df = spark.createDataFrame(data, "id string, v array<float>, model string, unit double")
    small, N.BLOCK_ROWS = N.BLOCK_ROWS, 50
    try:
        units = N.unit_vectors(df, "id", "v", ["model"])
        got = {(r.id_a, r.id_b) for r in N.similar_pairs(units, 0.9).collect()}
        exact = brute([(k, np.asarray(v), g) for k, v, g, _ in data[:240]], 0.9)
        assert got == exact and len(exact) > 50
        near = N.nearest(units.where("key = 'v000'"), units, 3).collect()
    finally:
        N.BLOCK_ROWS = small
    x = np.asarray(data[0][1])
    others = sorted(((-(x @ (y := np.asarray(v)) / np.linalg.norm(x) / np.linalg.norm(y)), k) for k, v, g, _ in data[1:240] if g == "a"))[:3]
    assert [r.neighbor_id for r in sorted(near, key=lambda r: r.position)] == [k for _, k in others]


def test_empty(spark):
    units = N.unit_vectors(spark.createDataFrame([], "id string, v array<float>"), "id", "v", [])
    assert N.similar_pairs(units, 0.9).count() == 0


def test_nearest_of_every_chunk_embedding(spark, sf):
    import duckdb

    from quern.llm.queries import queries

    e = duckdb.sql(f"SELECT embedding_id, any_value(model) AS m, any_value(model_version) AS mv, any_value(dimensions) AS d, any_value(embedding) AS v FROM '{sf}/chunk_embeddings.parquet' GROUP BY embedding_id").fetchall()
    usable = {k: ((m, mv), np.asarray(v, float) / np.linalg.norm(v)) for k, m, mv, d, v in e if v is not None and len(v) == d and np.linalg.norm(v) > 0}
    assert 0 < len(usable) < len(e)
    small, N.BLOCK_ROWS = N.BLOCK_ROWS, 20
    try:
        rows = queries()["p3_nearest"](spark, sf).collect()
    finally:
        N.BLOCK_ROWS = small
    got = {}
    for r in sorted(rows, key=lambda r: r.position):
        got.setdefault(r.query_id, []).append(r.neighbor_id)
    exact = {k: [y for _, y in sorted((-round(float(v @ w), 9), y) for y, (h, w) in usable.items() if h == g and y != k)[:5]] for k, (g, v) in usable.items()}
    assert got == {k: ys for k, ys in exact.items() if ys}


def test_no_candidate_is_lost():
    """The carried bounds against brute force, for few rows and for many blocks of strips."""
    rng = np.random.default_rng(11)
    for n, near in ((7, 4), (3000, 512), (5000, 5000)):
        vectors = rng.normal(size=(n, 16))
        vectors /= np.linalg.norm(vectors, axis=1)[:, None]
        scale = np.abs(vectors).max(axis=1) / 127
        codes = np.rint(vectors / scale[:, None])
        loss = np.linalg.norm(vectors - codes * scale[:, None], axis=1) + N.SLACK
        side = N._Side(np.arange(n), codes.astype(np.float32), scale.astype(np.float32), loss.astype(np.float32))
        width, N.NEAR_ROWS = N.NEAR_ROWS, near
        try:
            x, y = N._candidates(side.q[:20], side, N._slack(side, side) / side.scale[:20], 6)
        finally:
            N.NEAR_ROWS = width
        found = set(zip(x.tolist(), y.tolist()))
        exact = np.argsort(-(vectors[:20] @ vectors.T), axis=1)[:, :6]
        assert {(i, int(j)) for i, row in enumerate(exact) for j in row} <= found and len(found) < 0.5 * 20 * n + 200
