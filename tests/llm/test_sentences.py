import pytest

from quern.llm import sentences as S

MODEL = S.Model(
    [("s", "Latin", "The", ""), ("s", "Latin", "kadai", ""), ("a", "Latin", "dr", ""), ("a", "Latin", "no", ""), ("a", "Latin", "p.m", ""), ("a", "Latin", "rs", ""), ("a", "Tamil", "ரூ", ""), ("a", "Deva", "डॉ", ""), ("a", "Thai", "น", ""), ("h", "Latin", "Payment terms", "")]
)


def cut(text):
    units = list(S.Segmenter(MODEL).units(text))
    at = 0
    for a, b in units:  # exact, ordered, nothing but white space between
        assert at <= a < b and not text[at:a].strip() and text[a:b] == text[a:b].strip()
        at = b
    assert not text[at:].strip()
    return [text[a:b] for a, b in units]


@pytest.mark.parametrize(
    "units",
    [
        ["Dr. Ponni signed entry No. 5 on 11.08.2023 in the office.", "The fee is Rs. 10.50 only!"],
        ["The hearing ended at 3.30 p.m.", "The gate was shut."],
        ['"Keep the receipt!" the clerk shouted.', "Is that all?!"],
        ["The guard said, “Nobody came after 6 p.m. The gate was locked.”", "The end."],
        ["The amount ... if any ... will be adjusted.", "He waited..."],
        ["illa!!", "kadai kaarar ponaaru..", "kadai moodi irukku."],
        ["கட்டணம் ரூ. 1680.50 மட்டுமே.", "“வாயில் திறந்ததா?” என்று காவலர் கேட்டார்."],
        ["डॉ. सेयोली ने लिखा।", "“क्या द्वार खुला है?” पहरेदार ने पूछा।"],
        ["การประชุมเลิกเวลา 6.30 น.", "ผู้เช่าส่งคืนแบบฟอร์มภายใน 45 วัน", "ผู้สอบบัญชีเก็บสำเนา"],
    ],
)
def test_units_apart_by_spaces(units):
    assert cut(" ".join(units)) == units


def test_without_spaces():
    assert cut("负责人说：“请保留收据。”“大门还锁着吗？”保安问道。费用为3.5元。") == ["负责人说：“请保留收据。”", "“大门还锁着吗？”保安问道。", "费用为3.5元。"]
    assert cut("பிழையைக் கண்டார்.நகராட்சி எழுதியது.2 பேர் வந்தனர்.") == ["பிழையைக் கண்டார்.", "நகராட்சி எழுதியது.", "2 பேர் வந்தனர்."]


def test_layout():
    text = "## Notice\n\nPayment terms\nThe fee is\ndue now.\n- one item\n2) another item\n| a | b |\n| - | - |\n"
    assert cut(text) == ["## Notice", "Payment terms", "The fee is\ndue now.", "- one item", "2) another item", "| a | b |", "| - | - |"]


def test_empty_and_long():
    assert cut("") == [] and cut(" \n\t ") == [] and list(S.Segmenter(MODEL).units(None)) == []
    assert len(cut("The gate was shut. " * 20_000)) == 20_000


def test_learned_without_labels(spark):
    texts = [(f"d{i}", f"Dr. Kumar came! The gate was shut. The lamp, e.g. number {i}, was lit. Dr. Devi left? The bill is paid. The end.") for i in range(60)] + [("n", None), ("e", "")]
    df = spark.createDataFrame(texts, "id string, t string")
    model = S.learn(df, "t")
    rows = {(r.kind, r.a) for r in model.collect()}
    assert ("a", "dr") in rows and ("s", "The") in rows and ("a", "shut") not in rows
    units = S.sentence_units(df, "id", "t", model)
    assert units.where("id = 'd7'").count() == 6 and units.where("id in ('n', 'e')").count() == 0
    small, S.BROADCAST_ENTRIES = S.BROADCAST_ENTRIES, 0  # the way without a broadcast
    try:
        assert sorted(S.sentence_units(df, "id", "t", model).collect()) == sorted(units.collect())
    finally:
        S.BROADCAST_ENTRIES = small


def test_empty_table(spark):
    df = spark.createDataFrame([], "id string, t string")
    assert S.sentence_units(df, "id", "t", S.learn(df, "t")).count() == 0


def test_joined_model_gives_the_same_units(spark):
    texts = ["Entry S.No. 12 was signed. The end.", "See S.No.12 there. It ended.", "He waited…The gate shut. (No. 7 is here.)", "It ended.”kadai moodi… The end.", "Is it p.m.? “The gate, Dr. Devi said.” The rest, U.No. Kumar came."]
    df = spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(texts)], "id string, t string")
    rows = [("s", "Latin", "The", ""), ("s", "Latin", "kadai", ""), ("a", "Latin", "no", ""), ("a", "Latin", "dr", ""), ("a", "Latin", "p.m", ""), ("c", "Latin", "u.no", "Kumar")]
    model = spark.createDataFrame(rows, "kind string, script string, a string, b string")
    whole = sorted(S.sentence_units(df, "id", "t", model).collect())
    small, S.BROADCAST_ENTRIES = S.BROADCAST_ENTRIES, 0
    try:
        assert sorted(S.sentence_units(df, "id", "t", model).collect()) == whole
    finally:
        S.BROADCAST_ENTRIES = small


def test_every_word_looked_up_is_asked_for(spark, sf):
    import duckdb

    asked = set()

    class Seen(set):
        def __contains__(self, x):
            asked.add(x[1])
            return False

    model = S.Model([])
    model.starters = model.abbreviations = model.collocations = Seen()
    for (text,) in duckdb.sql(f"SELECT content FROM '{sf}/chunks.parquet' WHERE content IS NOT NULL").fetchall():
        asked.clear()
        list(S.Segmenter(model).units(text))
        given = {w for t in S.TOKEN.findall(text) for w in S._asked_for(t)}
        assert {w for w in asked if S.token_script(w) not in ("", "Han")} <= given


def test_tokens_of_any_length_are_looked_at_whole():
    address = "https://" + "a" * 300 + ".example/page"
    assert cut(f"See {address}.Next for the rest. The end.") == [f"See {address}.Next for the rest.", "The end."]
    assert len(cut("x" * 100_000 + ". The end.")) == 2
    assert len(cut("门锁着。" * 20_000)) == 20_000


SAMPLES = [("the tenant pays the rent to the clerk of the ward", "eng"), ("please send a copy of the receipt to the office", "eng"), ("kadai kaarar vaadagai kattitu ponaaru nu sonnaanga", "tanglish"), ("enga veetu owner advance thirumba tharen nu sonnaru", "tanglish"), ("வாடகை", "tam")]


def test_languages_of_a_script_are_told_apart():
    tell = S.Teller(SAMPLES)
    assert tell("the clerk pays the rent வாடகை 12".split()) == {"Latin": "eng"}
    assert tell("owner vaadagai thirumba tharen".split()) == {"Latin": "tanglish"} and tell(["12", "வாடகை"]) == {}
    counts = S.count_events(["The clerk pays. The rent is due", "kadai owner tharen nu sonnaru.", None, " "], tell)
    assert counts["w", "Latin/eng", "The", ""] == 2 and counts["s", "Latin/eng", "The", ""] == 1 and counts["p", "Latin/eng", "pays", "The"] == 1
    assert counts["w", "Latin/tanglish", "kadai", ""] == 1 and ("n", "Latin/tanglish", "sonnaru", "") not in counts


def test_statistics_by_language(spark):
    rows = [(f"e{i}", f"The clerk asked Dr. Kumar! The rent is due. The copy, no. {i}, is of the office. The end.") for i in range(80)]
    rows += [(f"t{i}", f"owner sonnaru! kadai kaarar thiru. Kumar vaadagai kattitu ponaaru. owner advance tharen nu sonnaru. kadai {i}.") for i in range(80)]
    df = spark.createDataFrame(rows, "id string, t string")
    model = {(r.kind, r.script, r.a) for r in S.learn(df, "t", SAMPLES).collect()}
    assert ("a", "Latin/eng", "no") in model and ("a", "Latin/tanglish", "no") not in model
    assert ("s", "Latin/eng", "The") in model and ("s", "Latin/tanglish", "owner") in model and ("s", "Latin/eng", "owner") not in model
    units = S.sentence_units(df, "id", "t", S.learn(df, "t", SAMPLES), SAMPLES).groupBy("id").count()
    assert {r["count"] for r in units.collect() if r.id[0] == "e"} == {4}
