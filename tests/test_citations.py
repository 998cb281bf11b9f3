def test_sentences_are_resolved_at_their_own_offsets(spark, sf):
    import duckdb

    from quern.plans import registry

    claims = {f"{r.query_id}/{r.chunk_id}": r for r in registry.queries()["top_claims"](spark, sf).collect()}
    rows = {r.ref_id: r for r in registry.queries()["citation_sentences"](spark, sf).collect()}
    assert set(rows) == set(claims) and {r.error for r in rows.values()} <= {None, "NOT_FOUND"}
    starts = dict(duckdb.sql(f"SELECT DISTINCT chunk_id, char_start FROM '{sf}/chunks.parquet'").fetchall())
    found = [(r, claims[k]) for k, r in rows.items() if r.error is None]
    assert any(c.start > 0 for _, c in found)
    assert all((r.page_quote_start, r.page_quote_end) == (starts[c.chunk_id] + c.start, starts[c.chunk_id] + c.start + len(c.sentence)) for r, c in found)
