import pytest
from pyspark.sql import functions as F

from quern.functions import text as T


def column(spark, values, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, c string")
    return [r.x for r in df.select("i", fn(F.col("c")).alias("x")).orderBy("i").collect()]


def test_normalize(spark):
    values = ["  ＡＢＣ　“x” – y…  ", "a\u200bb\u00a0c\n d", "e\u0301", None, ""]
    want = ['ABC "x" - y...', "ab c d", "é", None, ""]
    assert column(spark, values, T.normalize) == want
    assert column(spark, want, T.normalize) == want
    assert column(spark, ["Straße"], T.normalize_for_match) == ["strasse"]


def test_tokens_and_features(spark):
    assert column(spark, ["Flat no. 5", None], T.words) == [["Flat", "no", "5"], None]
    assert column(spark, ["ab"], T.feature_list) == [["ab", "#ab", "ab#"]]
    assert column(spark, ["aa aa"], T.feature_set) == [["aa", "#aa", "aa#"]]
    assert column(spark, ["a b\tc", ""], T.token_count) == [3, 0]


def test_sentences_tile(spark):
    got = column(spark, ["One. Two!\nThree 3.5", "...", ""], T.sentences)
    assert [(s.start, s.sentence) for s in got[0]] == [(0, "One."), (4, " Two!"), (10, "Three 3."), (18, "5")] and got[1] == [] and got[2] == []


@pytest.mark.parametrize(
    "text,language",
    [("vanakkam eppadi irukku", "tanglish"), ("the rent is due now", "eng"), ("வாடகை எப்போது", "tam"), ("12 34", "unknown"), ("வாடகை ரசீது எங்கே rent", "tam"), ("please send the deposit receipt வாடகை", "eng"), ("the rent illa", "tanglish")],
)
def test_language(spark, text, language):
    assert column(spark, [text], T.detect_language)[0].language == language


def test_spelling_and_transliteration(spark):
    assert column(spark, ["Epdi iruku, sir?"], T.fold_spelling) == ["eppadi irukku, sir?"]
    assert column(spark, ["naan 12 வா", "zha", None], T.transliterate) == ["ன்ஆன் 12 வா", "ழ்அ", None]
    assert column(spark, ["  Ward Office #5 -- East  "], T.slug) == ["ward-office-5-east"]
