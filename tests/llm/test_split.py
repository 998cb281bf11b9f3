import pytest
from hypothesis import given, settings, strategies as st

from quern.llm import split as P

WORDS = st.lists(st.sampled_from(["word", "a", "sentence.", "\n", "\n\n", " ", "\f", "x" * 90, "完了。", "\r\n\r\n", "\n \t\n"]), max_size=120)


@settings(max_examples=150, deadline=None)
@given(WORDS, st.integers(20, 120))
def test_pieces_cover_within_the_limit(parts, limit):
    text = " ".join(parts)
    out = list(P.pieces(text, limit, limit // 8))
    covered = set()
    for s, e, _ in out:
        assert 0 < e - s <= limit
        covered |= set(range(s, e))
    assert all(text[i].isspace() for i in range(len(text)) if i not in covered)
    assert all(b[1] > a[1] and b[0] > a[0] for a, b in zip(out, out[1:]))


def test_natural_cuts_and_hard_ones():
    text = "a" * 40 + "\n\n" + "b" * 40
    assert list(P.pieces(text, 50, 10))[0] == (0, 40, "paragraph")
    assert [e - s for s, e, _ in P.pieces("x" * 100, 30, 10)] == [30, 30, 30, 30, 20] and list(P.pieces("x" * 100, 30, 10))[0][2] == "hard"


def test_sizes_in_tokens():
    text, size = "abcdefghi " * 10, lambda t: 0 if t.isspace() else 1
    out = list(P.pieces(text, 3, 1, size))
    assert [text[s:e].split() for s, e, _ in out] == [["abcdefghi"] * 3] * 4 + [["abcdefghi"] * 2]
    long = list(P.pieces("x" * 90 + " y", 20, 5, len))  # a token above the limit is cut within
    assert all(0 < e - s <= 20 for s, e, _ in long) and long[0][0] == 0 and long[-1][1] == 92


def test_overlap_is_exact():
    text = "one two three. four five, six seven eight nine ten " * 80
    out = list(P.pieces(text))
    assert len(out) > 3 and {a[1] - b[0] for a, b in zip(out, out[1:])} == {150}
    assert {kind for _, _, kind in out[:-1]} == {"sentence"}


@settings(max_examples=200, deadline=None)
@given(WORDS, st.integers(1, 200))
def test_forced_cuts_by_brute_force(parts, limit):
    text = " ".join(parts)
    starts, ends = P.paragraphs(text)
    assert P.forced_cuts(text, limit) == [ends[k] for k in range(len(ends) - 1) if ends[k + 1] - starts[k] > limit]


@pytest.mark.parametrize("sep", ["\n\n", "\n \t\n", "\r\n\r\n", "\f", " "])
def test_forced_cuts(sep):
    a, b, c = "x" * 700, "y" * 700, "z" * 100
    assert P.forced_cuts(sep.join([a, b, c])) == [700]
    assert P.forced_cuts("x" * 1300) == [] and P.forced_cuts(a + "\n" + b) == []


def test_null_blank_and_bad_overlap():
    assert list(P.pieces(None)) == list(P.pieces(" \n ")) == []
    with pytest.raises(ValueError):
        list(P.pieces("a", 5, 5))


def test_offsets_point_into_the_page(spark):
    rows = [("c", "word " * 400, 30, None, "n"), ("e", "", 0, 2, "n"), ("n", None, 0, 1, "n")]
    df = spark.createDataFrame(rows, "chunk_id string, content string, char_start int, page_number int, piece_no string")
    got = P.split_chunks(df).collect()
    assert {r.chunk_id for r in got} == {"c"} and all(("word " * 400)[r.char_start - 30 : r.char_end - 30] == r.content and r.page_number is None for r in got)
