import numpy as np

from quern.llm import repetition as R


def test_windows_hash_alike_only_if_alike():
    x = np.random.default_rng(0).integers(0, 4, 150).astype(np.uint32)
    for n in (1, 2, 3, 12, 31, 32, 47):
        h = R.rolling_hashes(x, n)
        w = [tuple(x[i : i + n]) for i in range(len(x) - n + 1)]
        assert len(h) == len(w) and all((h[i] == h[j]) == (w[i] == w[j]) for i in range(len(w)) for j in range(0, len(w), 7))


def brute(codes, n, reach=1 << 30):
    mask, seen = np.zeros(len(codes), bool), {}
    for i in range(len(codes) - n + 1):
        w = tuple(codes[i : i + n])
        if i - seen.get(w, -(1 << 40)) <= reach:
            mask[i : i + n] = True
        seen[w] = i
    return mask


def test_mask_against_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(30):
        x = rng.integers(97, 99, 60).astype(np.uint32)
        assert (R.repeated_mask(x, 6) == brute(x, 6)).all()
        assert (R.repeated_mask(x, 6, 9) == brute(x, 6, 9)).all()


def test_shares():
    a = "The tenant signed the handover note in the office. "
    assert R.repetition_share(a * 4) > 0.7 and R.repetition_share(a) == 0.0
    assert R.repetition_share("The fee is 10 rupees and payable today. THE FEE IS 20 RUPEES, and payable today!") > 0.45
    loop = "pay now pay now pay now pay now"  # too short for windows of 32
    assert R.repetition_share(loop) > 0.7 > 0.1 > R.repetition_share("pay now or ask the clerk of the ward to pay now")
    assert R.repetition_share("good " * 200) > 0.8 and R.repetition_share("村委会" * 40) > 0.6
    assert R.repetition_share("One clerk wrote by registered parcel. Another tenant paid by registered parcel.") < 0.3
    assert R.repetition_share(None) == R.repetition_share("") == R.repetition_share("12 34 !!") == 0.0
    assert R.repetition_share("ab" * 300_000) > 0.99


def test_table(spark):
    df = spark.createDataFrame([(1, "x y z " * 50, 0.5), (2, None, 0.5), (3, "", 0.5), (1, "x y z " * 50, 0.5)], "doc_id long, text string, share double")
    got = sorted((r.doc_id, r.share > 0.5) for r in R.measure(df).collect())
    assert got == [(1, True), (1, True), (2, False), (3, False)]
    assert R.measure(df.limit(0)).count() == 0
