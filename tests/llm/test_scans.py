import random

from quern.llm import scans as S

SCHEMA = "page_id string, version_id string, page_number int, text string, ocr_engine string, ocr_confidence double, type string"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[:], i
        for j, y in enumerate(b, 1):
            row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
    return row[-1]


def test_automaton_finds_all_within_the_distance():
    random.seed(1)
    word = lambda letters: "".join(random.choice(letters) for _ in range(random.randint(1, 7)))
    words = {word("abc"): 1 for _ in range(300)}
    trie = S.Trie(words)
    for _ in range(100):
        q = word("abcd")
        for k in (1, 2, 3):
            assert sorted((d, w) for d, w, _ in trie.within(q, k)) == sorted((d, w) for w in words if (d := distance(q, w)) <= k)


def test_page_numbers_and_forms():
    assert S.page_numbers("- 12 -") == {12} and 4 in S.page_numbers("iv") and 10 in S.page_numbers("lO") and not S.page_numbers("1,250.00") and not S.page_numbers("12.5")
    assert S.form("2   Minutes of the council") == S.form("Minutes of the council | 3") == "minutes of the council"


def pages():
    clean = "The committee approved the revised layout of the building and counted every voucher in the presence of the auditor who asked for a cross-check of the ledger before the meeting."
    rows = [(f"c{i}", f"clean{i}", 1, clean, None, None, "x") for i in range(30)]
    body = ["The committee appr0ved the revised lay-", "out of the building and counted every", "voucher in the presence of the auditor", "who asked for a cross-", "check of the ledger before the meet-"]
    tail = ["ing. The auditor counted every voucher", "in the presence of the committee."]
    for v in ("s1", "s2", "s3"):
        rows.append((f"{v}a", v, 1, "\n".join(["Annual ledger of the ward", "", *body, "", "- 1 -"]), "engine", None, "x"))
        rows.append((f"{v}b", v, 2, "\n".join(["Annual lcdger of the ward", "", *tail, "Total", "", "- 2 -"]), None, 0.7, "x"))
    return rows + rows[30:32] + [("n", "s1", 3, None, "engine", None, "x"), ("e", "s1", 4, "", "engine", 0.5, "x")]


def test_lines_of_scans(spark):
    got = {(r.page_id, r.line_no, r.kind) for r in S.ScanRepair(spark.createDataFrame(pages(), SCHEMA)).found().collect()}
    want = {(f"{v}a", n, k) for v in ("s1", "s2", "s3") for n, k in ((1, "running"), (9, "running"), (3, "hyphen"), (3, "misread"), (7, "hyphen"))}
    want |= {(f"{v}b", n, "running") for v in ("s1", "s2", "s3") for n in (1, 7)}
    assert got == want


def test_repaired_paragraphs(spark):
    got = {(r.page_id, r.paragraph_no): r.text for r in S.repaired(spark.createDataFrame(pages(), SCHEMA)).collect()}
    first = "The committee approved the revised layout of the building and counted every voucher in the presence of the auditor who asked for a cross-check of the ledger before the meeting."
    assert got["s1b", 0].startswith("The auditor counted") and got["s1a", 0] == first and ("s1a", 1) not in got and got["s2b", 0].endswith("in the presence of the committee. Total")


def test_no_pages(spark):
    assert S.repaired(spark.createDataFrame([], SCHEMA)).count() == 0
    assert S.ScanRepair(spark.createDataFrame([], SCHEMA)).found().count() == 0


def misread_pages(size, copies):
    """A corpus in ``size`` times the same proportions; one scan held under ``copies`` ids."""
    count = "abcdefghijklmnop"
    rows = [(f"c{k}{i}", f"c{k}{i}", 1, f"The {count[k]}oo crew changed the revised layout of the building and counted every voucher before the evening meeting about the village ledger.", None, None, "x") for k in range(size) for i in range(12)]
    rows += [(f"r{k}", f"r{k}", 1, f"The {count[k]}oo warden closed the granary of the old building and every voucher was kept in the long room.", None, None, "x") for k in range(size)]
    for k in range(size):
        rows += [(f"s{k}-{j}", f"s{k}-{j}", 1, f"The crcw cbanged the revised layout of\nthe {count[k]}oo building and closed the\nold granary. The wardcn kept a voucher.", "engine", 0.8, "x") for j in range(copies)]
    return rows


def misread_lines(spark, size, copies):
    found = S.ScanRepair(spark.createDataFrame(misread_pages(size, copies), SCHEMA)).found().where("kind = 'misread'").collect()
    return {(r.page_id, r.line_no) for r in found}


def test_misread_words_of_copied_pages(spark):
    got = misread_lines(spark, 1, 40)
    assert got == {(f"s0-{j}", n) for j in range(40) for n in (1, 3)}


def test_misread_words_whatever_the_size(spark):
    for size in (1, 4):
        assert misread_lines(spark, size, 1) == {(f"s{k}-0", n) for k in range(size) for n in (1, 3)}


def test_words_as_common_as_their_neighbours_are_no_misreadings(spark):
    rows = misread_pages(1, 1) + [(f"t{k}", f"t{k}", 1, f"Every wardens meeting was held in the\nlong room. Number {k} was kept.", "engine", 0.8, "x") for k in range(2)]
    found = S.ScanRepair(spark.createDataFrame(rows, SCHEMA)).found().where("kind = 'misread'").collect()
    assert not {r.page_id for r in found} & {"t0", "t1"}


def test_like_forms_are_all_compared():
    random.seed(4)
    right = "minutes of the ward council"
    longer = [f"{right} and {right} held by member {''.join(random.choice('abcdefgh') for _ in range(6))}" for _ in range(200)]
    assert S.Forms([*longer, right]).has_like("rninutcs of thc ward council") and not S.Forms(longer).has_like("rninutcs of thc ward council")
    word = lambda: "".join(random.choice("abc ") for _ in range(random.randint(4, 14)))
    forms = [word() for _ in range(60)]
    for f in (word() for _ in range(200)):
        assert S.Forms(forms).has_like(f) == any(S._like(f, g) for g in forms)


def test_running_lines_with_many_shards(spark):
    edges = S.summaries(spark.createDataFrame(pages(), SCHEMA).where("text is not null and text <> ''"))
    whole = {tuple(r) for r in S.running_lines(edges).select("page_id", "top_runs", "bottom_runs").collect()}
    small, S.SHARD_FORMS = S.SHARD_FORMS, 1
    try:
        assert {tuple(r) for r in S.running_lines(edges).select("page_id", "top_runs", "bottom_runs").collect()} == whole and any(t for _, t, _ in whole)
    finally:
        S.SHARD_FORMS = small


def test_words_beyond_the_local_ones(spark):
    rows = pages() + [("d", "d", 1, "The ward has ledger अ१२ and a cross-check.", None, None, "x"), ("w", "w", 1, "The auditor counted ledger अ३४\nin the presence of the committee.", "engine", 0.8, "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    columns = ["page_id", "line_no", "kind", "type", "other", "part"]
    whole = S.ScanRepair(df)
    want, found = set(whole.rows().select(*columns).collect()), set(whole.found().collect())
    small, S.LOCAL_WORDS = S.LOCAL_WORDS, 0
    try:
        joined = S.ScanRepair(df)
        assert set(joined.rows().select(*columns).collect()) == want and set(joined.found().collect()) == found
    finally:
        S.LOCAL_WORDS = small


def test_split_word_judged_by_its_neighbours(spark):
    """'bac|her' is as near to 'baccer' as to the more frequent 'bather'; the neighbours tell that
    the second half was misread, not the first."""
    clean = [(f"a{k}", f"a{k}", 1, "The lone bather came along the road to the evening market by the old mill, and everybody who stood there saw it.", None, None, "x") for k in range(60)]
    clean += [(f"b{k}", f"b{k}", 1, "The clerk and the careful baker kept every ledger in the presence of the auditor, and the ward meeting was closed by the careful baccer also.", None, None, "x") for k in range(20)]
    scan = [("s", "s", 1, "It was the clerk and the careful bac-\nher also who came along the road", "engine", 0.8, "x")]
    got = {(r.page_id, r.line_no) for r in S.ScanRepair(spark.createDataFrame(clean + scan, SCHEMA)).found().where("kind = 'misread'").collect()}
    assert got == {("s", 2)}


def test_words_are_whole_over_page_ends(spark):
    text = lambda *x: "\n".join(x)
    filler = ["The municipal office keeps every register in the hall", "and the clerk signs for each of them on every working day", "so that nothing is lost when the year comes to its end", "and the next one is begun with the same order as before"]
    known = [(f"k{i}", f"k{i}", 1, "The register is in the municipal hall. The clerk signs the agreement for each office. " * 3 + "x" * 120, None, None) for i in range(6)]
    scans = [("a", "v", 1, text(*filler, "The clerk signs the agree-"), "e", 0.9), ("b", "v", 2, text("ment for each office.", *filler), "e", 0.9), ("c", "w", 1, text(*filler, "The clerk signs the agree-"), "e", 0.9), ("d", "w", 2, text("ment for each office.", *filler), "e", 0.9), ("f", "w", 2, text("ment for each office.", *filler), "e", 0.9)]
    got = {}
    for r in S.repaired(spark.createDataFrame([(*r, "x") for r in known + scans], SCHEMA)).collect():
        got.setdefault(r.page_id, []).append(r.text)
    assert got["a"][-1].endswith("signs the agreement") and got["b"][0].startswith("for each office.")
    assert got["c"][-1].endswith("agree") or got["c"][-1].endswith("agree-")
    assert got["d"][0].startswith("ment for") and got["f"][0].startswith("ment for")  # the number occurs twice: nothing moves


def test_small_bounds_change_nothing(spark, monkeypatch):
    df = spark.createDataFrame(pages(), SCHEMA)
    rows = lambda: sorted(map(tuple, S.ScanRepair(df).found().collect()))
    want = rows()
    for name, bound in (("LOCAL_WORDS", 5), ("SHARD_WORDS", 7), ("SHARD_FORMS", 1), ("ASKED_WORDS", 1)):
        monkeypatch.setattr(S, name, bound)
    assert rows() == want
