import pytest

queries = pytest.importorskip("quern.llm.queries")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches_sql(spark, sf, oracle, name):
    ours, theirs = oracle(queries.queries()[name](spark, sf), queries.oracle_sql()[name])
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql())))
def test_runs_with_stable_columns(spark, sf, name):
    df = queries.queries()[name](spark, sf)
    assert df.count() >= 0
    assert len(set(df.columns)) == len(df.columns)
