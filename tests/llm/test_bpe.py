import pytest
from hypothesis import given, settings, strategies as st

from quern.llm import bpe as B

P = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def mine():
    return B.BacktrackingBpe(*B.tokenizer_file())


@pytest.fixture(scope="module")
def theirs():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda x: t.encode(x, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text("aeinorst ht", max_size=80), st.text("ாிகமடத ்", max_size=40)))
def test_same_ids_and_round_trip(mine, theirs, text):
    ids = mine.encode(text)
    assert ids == theirs(text)
    assert mine.decode(ids) == text.encode()


def test_fixed_cases(mine, theirs):
    for text in ["", " ", "<|endoftext|>", "a" * 3000, "\n\n\t x", "👩‍🌾" * 50, "it's we'll"]:
        assert mine.encode(text) == theirs(text)
    assert mine.encode(None) == []


def test_table(spark):
    df = spark.createDataFrame([(1, "hello world", "x"), (2, None, "x"), (3, "", "x"), (1, "hello world", "x")], "doc_id long, text string, ids string")
    got = sorted((r.doc_id, r.ids) for r in B.encode(df).collect())
    assert got == [(1, [31373, 995]), (1, [31373, 995]), (2, []), (3, [])]
    assert {r.doc_id: r.n_tokens for r in B.encode(df, count_only=True).collect()} == {1: 2, 2: 0, 3: 0}
    assert B.encode(df.limit(0)).count() == 0
