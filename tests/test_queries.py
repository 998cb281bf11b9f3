import pytest

from quern.plans import registry

ORACLES = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, sf, oracle, name):
    ours, theirs = oracle(registry.queries()[name](spark, sf), ORACLES[name])
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(ORACLES)))
def test_runs(spark, sf, name):
    assert registry.queries()[name](spark, sf).count() >= 0


def test_llm_is_not_imported_by_the_rest():
    import pathlib
    import re

    root = pathlib.Path(registry.__file__).parents[1]
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert not re.search(r"quern\.llm|from \.+llm", p.read_text()), p


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.fixture(scope="module")
def empty(spark, sf, tmp_path_factory):
    import glob
    import os

    to = str(tmp_path_factory.mktemp("empty"))
    for p in glob.glob(f"{sf}/*.parquet"):
        spark.read.parquet(p).limit(0).write.parquet(f"{to}/{os.path.basename(p)}")
    return to


#: Queries that count or measure have a row for that there is nothing.
MEASURES = {"broken_references", "bad_values", "eval_ranking"}


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_empty_tables(spark, empty, name):
    n = registry.queries()[name](spark, empty).count()
    assert n == 0 or name in MEASURES
