"""What the plans read, and what they must not do."""

import re

import pytest

from quern.plans import registry


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def schemas(text):
    return re.findall(r"ReadSchema: struct<([^>]*)", text)


def test_only_needed_columns_are_read(spark, sf):
    q = registry.queries()
    assert not any("content" in s for s in schemas(plan(q["ready_gate"](spark, sf))))
    assert not any("embedding" in s or "ocr" in s for s in schemas(plan(q["lexical_topk"](spark, sf))))
    assert not any("text" in s for s in schemas(plan(q["broken_references"](spark, sf))))


def test_filters_reach_the_scan(spark, sf):
    text = plan(registry.queries()["filtered_chunks"](spark, sf))
    assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(language,tam\)", text) and re.search(r"PushedFilters: \[[^\]]*EqualTo\(status,ready\)", text)


@pytest.mark.parametrize("name", ["hybrid_search", "dense_topk", "cell_topk", "lexical_topk", "top_claims", "document_safety", "citation_resolve", "rrf_fusion"])
def test_no_plan_pairs_all_rows(spark, sf, name):
    text = plan(registry.queries()[name](spark, sf))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text and "BatchEvalPython" not in text


def test_texts_are_screened_once(spark, sf):
    """Chunks are screened in one pass, their borders in one for each of two views."""
    assert plan(registry.queries()["document_safety"](spark, sf)).count("MapInArrow") == 3
