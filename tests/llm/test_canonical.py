import unicodedata

import pytest

from quern.llm import canonical as C


def forms(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    return [r.canonical for r in C.canonicalise(df, "id", "t").orderBy("id").collect()]


def test_same_looks_same_form(spark):
    groups = [["file", "ﬁle", "ｆｉｌｅ", "fi­le", "f​ile"], ["café no", "café no", "cаfé nо"], ["a-b", "a‐b", "a‑b"], ["சரிசெய்", "௪ரிசெய்"], ["கொடு", "கொடு"]]
    for g in groups:
        assert len(set(forms(spark, g))) == 1, g


@pytest.mark.parametrize("a,b", [("File", "file"), ("café", "cafe"), ("a–b", "a-b"), ("no 1", "no 2"), ("“a”", '"a"'), ("a b", "ab"), ("1", "①"), ("2", "²"), ("1/2", "½")])
def test_visible_differences_stay(spark, a, b):
    assert len(set(forms(spark, [a, b]))) == 2


def test_null_empty_long_and_idempotent(spark):
    texts = [None, "", "​", "ｘ" * 200_000, "clаuѕe ﬃ"]
    once = forms(spark, texts)
    assert once[0] is None and once[1] == once[2] == "" and once[3] == "x" * 200_000
    assert forms(spark, once) == once


def test_every_compatibility_form_is_settled(spark):
    forms_of = C.compatibility()
    assert len(forms_of) > 1500 and all(len(unicodedata.normalize("NFKC", a)) >= 1 for a in forms_of)
    once = forms(spark, ["x" + a for a in forms_of])
    assert forms(spark, once) == once
    assert not [a for a, x in zip(forms_of, once) if a in x]


def test_classes(spark):
    rows = [("chunk", "b", "open"), ("chunk", "a", "оpen"), ("chunk", "c", "open"), ("chunk", "c", "open"), ("query", "d", "оpen"), ("chunk", "n", None)]
    got = {(r.record_kind, r.id): (r.class_id, r.strings) for r in C.lookalike_classes(spark.createDataFrame(rows, "record_kind string, id string, text string")).collect()}
    assert len(got) == 4 and len({got["chunk", i] for i in "abc"}) == 1 and got["chunk", "a"][1] == 2 and got["query", "d"][1] == 1


def test_pairs(spark):
    rows = [("chunk", "b", "open"), ("chunk", "a", "оpen"), ("chunk", "c", "open"), ("query", "d", "оpen"), ("chunk", "a", "оpen"), ("chunk", None, "open"), ("chunk", "n", None)]
    got = C.lookalike_pairs(spark.createDataFrame(rows, "record_kind string, id string, text string"))
    assert sorted(map(tuple, got.collect())) == [("chunk", "a", "b"), ("chunk", "a", "c")]
    assert C.lookalike_pairs(spark.createDataFrame([], "record_kind string, id string, text string")).count() == 0
