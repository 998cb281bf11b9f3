import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import language as L


@pytest.fixture(scope="module")
def samples(sf):
    import duckdb

    return duckdb.sql(f"SELECT text, lang FROM '{sf}/language_samples.parquet' ORDER BY sample_id").fetchall()


def label(tagger, text):
    u = tagger.units([text])
    return [tagger.states[x] for x in u["language"]]


def test_held_out_accuracy(samples):
    random = np.random.default_rng(0).permutation(len(samples))
    train, test = [samples[i] for i in random[:180]], [samples[i] for i in random[180:]]
    tagger = L.Tagger(L.Classifier(train))
    right = sum(set(label(tagger, t)) == {x} for t, x in test)
    assert right >= 0.95 * len(test)


def test_mixed_text_in_segments(samples):
    by = {x: t for t, x in samples}
    tagger = L.Tagger(L.Classifier(samples))
    text = "\n".join([by["eng"], by["tam"], by["tanglish"], by["zho"]])
    u = tagger.units([text, None, "", "12 / 34", by["hin"]], offsets=True)
    seen = list(dict.fromkeys(tagger.states[x] for x, t in zip(u["language"], u["text"]) if t == 0))
    assert seen == ["eng", "tam", "tanglish", "zho"] and set(u["text"]) == {0, 4}
    assert all(0 <= a < b <= max(len(text), len(by["hin"])) for a, b in zip(u["start"], u["end"])) and ((u["confidence"] > 0) & (u["confidence"] <= 1)).all()


def test_tables_and_headings_do_not_count(samples):
    tagger = L.Tagger(L.Classifier(samples))
    by = {x: t for t, x in samples}
    u = tagger.units(["## Payment terms\n" + by["tam"] + "\n| item | amount paid |\n| the whole rent. | 5 |"])
    assert {tagger.states[x] for x in u["language"]} == {"tam"}


def test_viterbi_fast_path_equals_full(samples):
    tagger = L.Tagger(L.Classifier(samples))
    rng = np.random.default_rng(5)
    texts = [" ".join(samples[i][0] for i in rng.integers(0, len(samples), 4)) for _ in range(60)]
    for t in texts:
        together, single = tagger.units(texts), tagger.units([t])
        k = texts.index(t)
        assert [together["language"][i] for i in np.flatnonzero(together["text"] == k)] == list(single["language"])


def test_labels(spark):
    rows = [("EN",), ("ta-Latn",), ("ta_IN",), (" ",), (None,), ("und",), ("Tanglish",), ("fra",), ("zh",)]
    got = [r.x for r in spark.createDataFrame(rows, "l string").select(L.label_language(F.col("l")).alias("x")).collect()]
    assert got == ["eng", "tanglish", "tam", None, None, None, "tanglish", "fra", "zho"]


def test_segments_of_all_records(spark, sf):
    import duckdb

    from quern.llm.queries import queries

    got = {(r.record_kind, r.record_id) for r in queries()["p6_segments"](spark, sf).select("record_kind", "record_id").distinct().collect()}
    languages = {(r.record_kind, r.record_id) for r in L.record_languages(spark, sf).select("record_kind", "record_id").distinct().collect()}
    assert {k for k, _ in got} == {"chunk", "page", "version"} and languages <= got
    rows = L.record_segments(spark, sf).where("record_kind <> 'chunk'").collect()
    texts = dict(duckdb.sql(f"SELECT DISTINCT page_id, text FROM '{sf}/pages.parquet'").fetchall())
    assert rows and all(texts[r.page_id][r.seg_start : r.seg_end].strip() for r in rows)
    assert len({tuple(r) for r in rows}) == len(rows)


def test_short_thai_sentence_ending_in_an_abbreviation(samples):
    tagger = L.Tagger(L.Classifier(samples))
    thai = "การประชุมเลิกเวลา 10.30 น."
    english = next(t for t, x in samples if x == "eng")
    for text in (f"{english}\n{thai}", f"{english}\n{thai}\n{english}", f"{thai} {english}", f"{english} {thai}"):
        u = tagger.units([text])
        assert {tagger.states[x] for x, w in zip(u["language"], u["whole"]) if w} == {"eng", "tha"}
    u = tagger.units(["The clerk of the ward wrote down เวลา 10.30 น. as the hour of the meeting."])
    assert {tagger.states[x] for x, w in zip(u["language"], u["whole"]) if w} == {"eng"}
