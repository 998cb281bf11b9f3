import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from quern.operators import answers as A


@pytest.mark.parametrize(
    "claim,evidence,verdict",
    [
        ("The tenant pays rent within 30 days", "The tenant pays rent within thirty days.", "supported"),
        ("The tenant pays rent within 30 days", "The tenant pays rent within 60 days.", "contradicted"),
        ("The lease ends in March 2024", "The lease ends in April 2024.", "contradicted"),
        ("The deposit is refundable", "The deposit is not refundable.", "contradicted"),
        ("The deposit is refundable after inspection", "The deposit is refundable.", "partial"),
        ("The landlord repairs the roof", "Parking costs extra.", "unsupported"),
        ("the of", "The deposit is refundable.", "unsupported"),
        ("The notice names Kumar today", "The notice names Devi today and kumar.", "partial"),
    ],
)
def test_entailment(claim, evidence, verdict):
    assert A.entail(claim, evidence)[0] == verdict


def test_facts():
    f = A.facts("Within five business days of May 2024 pay 20 rupees, 7")
    assert f.quantities == {("days", 5.0), ("rupees", 20.0), (None, 7.0), ("pay", 2024.0)} and f.dates == {"2024-05"}
    assert A.facts("paid 2024-03-31").dates == {"2024-03-31"} and not A.facts("paid 2024-03-31").quantities
    assert A.facts("10 20 rupees").quantities == {(None, 10.0), ("rupees", 20.0)}
    assert A.facts("12 of the full whole net amount").quantities == {(None, 12.0)}  # farther than three tokens


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["the", "5", "seven", "days", "business", "not", "rent", "of", "unless", "20"]), max_size=14))
def test_units_by_brute_force(tokens):
    want = set()
    for k, t in enumerate(tokens):
        if A.as_number(t) is not None:
            unit = None
            for n in tokens[k + 1 : k + 4]:
                if A.as_number(n) is not None:
                    break
                if n not in A.MODIFIERS and n not in A.STOPWORDS:
                    unit = n
                    break
            want.add((unit, float(A.as_number(t))))
    assert A.facts(" ".join(tokens)).quantities == want


def test_offsets_must_recover_the_quote(spark):
    rows = [(1, "Rent is due.", "Note. Rent is due.", 6), (2, "Rent is due.", "Note. Rent is due.", 5), (3, "", "x", 0), (4, None, "x", 0), (5, "Rent is due.", "Rent is due.", None)]
    got = A.verify(spark.createDataFrame(rows, "i int, c string, e string, at int"), "c", "e", start="at").collect()
    assert {r.i: r.verdict for r in got} == {1: "supported", 2: "unsupported", 3: "unsupported", 4: "unsupported", 5: "unsupported"}


def test_a_weak_claim_is_ambiguous(spark):
    rows = [(1, "supported", "ok"), (2, "supported", "ok"), (3, "partial", "terms"), (4, "contradicted", "no")]
    df = spark.createDataFrame(rows, "i int, verdict string, reason string")
    got = {r.i: (r.verdict, r.confidence) for r in A.with_confidence(df, F.when(F.col("i") == 1, 0.5).otherwise(0.2)).collect()}
    assert got == {1: ("supported", 0.5), 2: ("ambiguous", 0.2), 3: ("ambiguous", 0.0), 4: ("contradicted", 0.0)}


def test_evidence_floor_and_best_claims(spark):
    rows = [("q", "a", 1, 0.5, "rent due", "Parking is free. The rent is due."), ("q", "b", 2, 0.1, "rent due", "The rent is due."), ("q", "c", 3, 0.9, "rent due", "High walls."), ("e", "a", 1, 0.9, "", "x"), ("n", "a", 1, 0.9, "rent", None)]
    kept = A.sufficient_evidence(spark.createDataFrame(rows, "query_id string, chunk_id string, rank int, fused_score double, query string, content string"), 0.3, 2)
    assert sorted((r.query_id, r.chunk_id) for r in kept.collect()) == [("e", "a"), ("n", "a"), ("q", "a"), ("q", "c")]
    assert [(r.query_id, r.start, r.sentence, r.claim_index) for r in A.best_claims(kept).collect()] == [("q", 16, " The rent is due.", 0)]


def test_split_and_decisions(spark):
    df = spark.createDataFrame([("the tenant pays rent and the owner repairs roofs",), ("salt and pepper",)], "c string")
    assert [r.x for r in df.select(A.split_claims(F.col("c")).alias("x")).collect()] == [["the tenant pays rent", "the owner repairs roofs"], ["salt and pepper"]]
    schema = "supported int, contradicted int, ambiguous int, unsupported int, dropped int, evidence int, confidence double, min_ocr double, ocr_unknown boolean"
    rows = [(1, 0, 0, 0, 0, 1, 0.9, None, False), (1, 0, 0, 0, 0, 1, 0.5, 0.4, True), (0, 0, 0, 1, 0, 1, None, None, False), (0, 0, 0, 0, 0, 0, None, None, False), (1, 1, 0, 0, 0, 2, 0.9, None, False), (0, 1, 0, 0, 0, 2, None, None, False)]
    got = A.decide(spark.createDataFrame(rows, schema)).collect()
    assert [r.decision for r in got] == ["answer", "answer_with_warning", "ask_for_clarification", "abstain", "escalate_for_review", "escalate_for_review"]
    assert got[1].decision_reason == "supporting confidence is moderate; cited evidence has low OCR reliability; cited evidence has OCR of unknown reliability"


def test_every_query_gets_one_row(spark):
    q = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "query_id string")
    claims = [("a", 0, " Rent is due.", "supported", 0.7, None, None), ("a", 1, "Ask the clerk.", "ambiguous", 0.1, None, None), ("c", 0, "No.", "unsupported", 0.0, None, None), ("d", 0, "Rent is due.", "supported", 0.8, None, 0.1)]
    c = spark.createDataFrame(claims, "query_id string, claim_index int, sentence string, verdict string, confidence double, ocr_engine string, ocr_confidence double")
    evidence = spark.createDataFrame([("a",), ("a",), ("c",), ("d",)], "query_id string")
    drafts = c.select("query_id").unionByName(spark.createDataFrame([("d",)], "query_id string"))  # one cites a passage outside the evidence
    got = {r.query_id: r for r in A.compose(q, c, evidence, drafts).collect()}
    assert (got["a"].status, got["a"].answer, got["a"].evidence, got["a"].dropped) == ("partial", "- Rent is due.", 2, 1)
    assert (got["b"].status, got["b"].answer, got["b"].abstention_reason, got["b"].decision) == ("abstained", A.ABSTENTION, "insufficient_evidence", "abstain")
    assert (got["c"].abstention_reason, got["c"].confidence) == ("ask_for_clarification", 0.0)
    assert got["d"].dropped == 1 and "low OCR" not in got["d"].warnings  # never read by OCR


def test_confidence(spark):
    n = F.lit(None)
    row = spark.range(1).select(A.claim_confidence(F.lit(0.0), F.lit(1.0), F.lit(1.0), n.cast("string"), n.cast("double")).alias("x")).first()
    assert row.x == 0.75


def test_withheld_answers_show_no_claims(spark):
    q = spark.createDataFrame([("a",), ("b",)], "query_id string")
    schema = "query_id string, claim_index int, sentence string, start int, verdict string, confidence double, chunk_id string, document_id string, version_id string, page_number int, section string, language string, char_start int, char_end int, ocr_engine string, ocr_confidence double"
    row = lambda q, k, v: (q, k, " Rent is due.", 5, v, 0.7, "c", "d", "v", 1, None, "eng", 10, 40, None, None)
    checked = spark.createDataFrame([row("a", 0, "unsupported"), row("a", 2, "supported"), row("b", 0, "supported"), row("b", 1, "contradicted")], schema)
    shown = A.surfaced(checked)
    assert sorted((r.query_id, r.claim_index) for r in shown.collect()) == [("a", 0), ("b", 0)]
    got = {r.query_id: r for r in A.to_answers(A.compose(q, checked, checked.select("query_id")), shown).collect()}
    claim = got["a"].claims[0]
    assert (claim.text, claim.citation.quote, claim.citation.quote_start, claim.citation.quote_end) == ("Rent is due.", " Rent is due.", 5, 18)
    assert got["b"].status == "abstained" and got["b"].claims == [] and got["b"].abstention_reason == "escalate_for_review"


def test_judged_passages_are_best_claims_verified(spark):
    rows = [("q", "a", 1, "rent due", "Parking is free. The rent is due on 3 May 2024. The rent is not due."), ("q", "b", 2, "rent due", "The rent\x1c is due."), ("q", "c", 3, "rent due", "High walls."), ("e", "a", 1, "", "x"), ("n", "a", 1, "rent", None), ("n", "b", 2, None, "rent")]
    df = spark.createDataFrame(rows, "query_id string, chunk_id string, rank int, query string, content string")
    columns = ["query_id", "chunk_id", "rank", "start", "sentence", "overlap", "claim_index", "verdict", "coverage", "reason"]
    claims = A.best_claims(df).drop("rank").join(df, ["query_id", "chunk_id"])
    judged = A.judged_passages(df)
    assert judged.count() == len(rows) and "content" not in judged.columns
    got = sorted(map(tuple, A.leading_claims(judged).select(*columns).collect()))
    assert got == sorted(map(tuple, A.verify(claims, "sentence", "content", start="start").select(*columns).collect())) and len(got) == 2
    A.facts.cache_clear()
    A.entail(" The rent is due.", "The rent is due. " + " ".join(f"Wall {n} is high." for n in range(50)))
    assert A.facts.cache_info().currsize <= 2  # only of the claim and of the sentence nearest to it
