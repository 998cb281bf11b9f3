"""Text functions as Column expressions; Arrow UDFs only where Unicode tables are needed."""

from __future__ import annotations

import functools
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F, types as T
from pyspark.sql.functions import pandas_udf

# Punctuation folded to one form.
PUNCTUATION = {
    "‘": "'", "’": "'", "‚": "'", "“": '"', "”": '"', "„": '"', "–": "-", "—": "-", "―": "-", "…": "...",
    " ": " ", "​": "", "‌": "", "‍": "", "﻿": "",
}
# Romanised Tamil words that mark the language, and words that mark nothing.
TANGLISH_MARKERS = (
    "vanakkam enna eppadi epdi iruku irukku panna pannu pannunga seri illa illai aama aamaa romba konjam yaaru yenna enga epo eppo nandri thevai venum vendum kandippa "
    "sollunga puriyala theriyuma theriyum namba"
).split()
AMBIGUOUS = ["a", "i", "na", "no", "ok", "am", "an", "en"]
# Spelling variants.
SPELLING = {
    "epdi": "eppadi", "epadi": "eppadi", "eppdi": "eppadi", "iruku": "irukku", "pannu": "panna", "pannuga": "pannunga", "pannunga": "pannunga", "vanakam": "vanakkam",
    "vanakkam": "vanakkam", "nandri": "nandri", "nanri": "nandri", "romba": "romba", "rmba": "romba", "konjm": "konjam", "yaru": "yaaru", "amaa": "aamaa", "ama": "aamaa",
}
# Letter groups and their Tamil letters.
ROMAN_TO_TAMIL = {
    "ndh": "ந்த்", "zh": "ழ்", "ng": "ங்", "nj": "ஞ்", "th": "த்", "dh": "த்", "sh": "ஷ்", "ch": "ச்", "kk": "க்க்", "aa": "ஆ", "ee": "ஈ", "ii": "ஈ", "oo": "ஊ", "uu": "ஊ",
    "ai": "ஐ", "au": "ஔ", "a": "அ", "e": "எ", "i": "இ", "o": "ஒ", "u": "உ", "k": "க்", "g": "க்", "s": "ஸ்", "t": "ட்", "d": "ட்", "n": "ன்", "p": "ப்", "b": "ப்", "m": "ம்",
    "y": "ய்", "r": "ர்", "l": "ல்", "v": "வ்", "w": "வ்", "h": "ஹ்", "j": "ஜ்", "f": "ஃப்",
}

WORDS = r"[\p{L}\p{N}]+"
LETTER_WORDS = r"[\p{L}\p{Nl}\p{No}]+"
INDEX_TERMS = r"[\p{L}\p{M}\p{N}]+"
SPACES = r"[\s\x1c-\x1f\x85\x{2028}\x{2029}\p{Z}]+"
SENTENCE = r"[^.!?।॥\n]+[.!?।॥]?"
WIDE = "".join(map(chr, range(0xFF01, 0xFF5F)))
NARROW = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F))


@pandas_udf(T.StringType())
def nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFC", x))


@pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFKC", x))


@pandas_udf(T.StringType())
def casefold(s: pd.Series) -> pd.Series:
    return s.map(lambda x: x if x is None else x.casefold())


def fold_width(c: Column) -> Column:
    return F.translate(c, WIDE, NARROW)


def normalize(c: Column) -> Column:
    """Width, NFC, punctuation, white space; null stays null."""
    one = {a: b for a, b in PUNCTUATION.items() if len(b) == 1}
    gone = "".join(a for a, b in PUNCTUATION.items() if not b)
    c = F.translate(nfc(fold_width(c)), "".join(one) + gone, "".join(one.values()))
    return F.trim(F.regexp_replace(F.replace(c, F.lit("…"), F.lit("...")), SPACES, " "))


def strip(c: Column) -> Column:
    """Without the white space at its ends, of any kind."""
    return F.regexp_replace(c, f"^{SPACES}|{SPACES}$", "")


def normalize_for_match(c: Column) -> Column:
    return casefold(normalize(c))


def words(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(f"({WORDS})"), F.lit(1))


def index_terms(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(f"({INDEX_TERMS})"), F.lit(1))


def token_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"[^\s\x1c-\x1f\x85\p{Z}]+"))


def trigrams(tokens: Column) -> Column:
    """Letter triples of each padded token, in order, with repetition."""
    per = F.transform(tokens, lambda t: F.transform(F.sequence(F.lit(1), F.length(t)), lambda i: F.substring(F.concat(F.lit("#"), t, F.lit("#")), i, F.lit(3))))
    return F.flatten(per)


def feature_list(c: Column) -> Column:
    t = words(c)
    return F.concat(t, trigrams(t))


def feature_set(c: Column) -> Column:
    return F.array_distinct(feature_list(c))


def sentences(c: Column) -> Column:
    """Array of (start, sentence): the pieces tile the text, so offsets are running lengths."""
    pieces = F.regexp_extract_all(c, F.lit(f"({SENTENCE}|[.!?।॥\\n])"), F.lit(1))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,sentence:string>>").alias("out"))
    return F.aggregate(
        pieces, zero,
        lambda acc, p: F.struct(
            (acc["at"] + F.length(p)).cast("int").alias("at"),
            F.when(p.rlike(r"^[^.!?।॥\n]"), F.concat(acc["out"], F.array(F.struct(acc["at"].alias("start"), p.alias("sentence"))))).otherwise(acc["out"]).alias("out"),
        ),
        lambda acc: F.filter(acc["out"], lambda x: F.trim(F.regexp_replace(x["sentence"], SPACES, " ")) != ""),
    )


def script_profile(c: Column) -> Column:
    """struct(tamil, latin, letters): letters of the two scripts."""
    tamil = F.regexp_count(c, F.lit(r"[\p{L}&&[\x{0B80}-\x{0BFF}]]"))
    latin = F.regexp_count(c, F.lit(r"[\p{IsLatin}&&[^ªº\x{02B0}-\x{02B8}]]"))
    return F.struct(tamil.alias("tamil"), latin.alias("latin"), (tamil + latin).alias("letters"))


def marker_ratio(c: Column) -> Column:
    ascii_words = F.filter(F.regexp_extract_all(F.lower(c), F.lit(f"({LETTER_WORDS})"), F.lit(1)), lambda w: w.rlike("^[a-z]+$") & ~w.isin(AMBIGUOUS))
    hits = F.size(F.filter(ascii_words, lambda w: w.isin(TANGLISH_MARKERS)))
    return F.when(F.size(ascii_words) > 0, hits / F.size(ascii_words)).otherwise(0.0)


def detect_language(c: Column) -> Column:
    """struct(language, confidence) of a normalised text."""
    p = script_profile(c)
    t = F.when(p["letters"] > 0, p["tamil"] / p["letters"]).otherwise(0.0)
    lat = F.when(p["letters"] > 0, p["latin"] / p["letters"]).otherwise(0.0)
    m = marker_ratio(c)

    def out(language: str, confidence: Column) -> Column:
        return F.struct(F.lit(language).alias("language"), confidence.cast("double").alias("confidence"))

    short = p["letters"] < 3
    mixed = (t >= 0.15) & (lat >= 0.15)
    english = F.least(0.6 + 0.3 * lat, F.lit(0.95))
    return (
        F.when(p["letters"] == 0, out("unknown", F.lit(0.0)))
        .when(mixed & (t >= lat), out("tam", F.least(0.55 + 0.4 * t, F.lit(0.95))))
        .when(mixed & (m > 0), out("tanglish", F.least(0.5 + 0.3 * lat, F.lit(0.9))))
        .when(mixed, out("eng", F.least(0.5 + 0.3 * lat, F.lit(0.9))))
        .when(t >= 0.85, out("tam", F.least(0.7 + 0.3 * t, F.lit(0.99))))
        .when(m >= 0.4, out("tanglish", F.least(0.6 + m, F.lit(0.95))))
        .when(m > 0, out("tanglish", 0.5 + m))
        .otherwise(out("eng", F.when(short, F.least(english, F.lit(0.5))).otherwise(english)))
    )


def fold_spelling(c: Column) -> Column:
    """Known variants of words replaced, all else kept as it stands."""
    table = F.create_map(*[F.lit(x) for kv in SPELLING.items() for x in kv])
    pieces = F.regexp_extract_all(c, F.lit(f"({LETTER_WORDS}|[^\\p{{L}}\\p{{Nl}}\\p{{No}}]+)"), F.lit(1))
    return F.array_join(F.transform(pieces, lambda p: F.coalesce(table[F.lower(p)], p)), "")


#: The letter groups, longest first, so that the first alternative that fits is the longest.
_GROUPS = re.compile("|".join(sorted(ROMAN_TO_TAMIL, key=len, reverse=True)))


@pandas_udf(T.StringType())
def transliterate(s: pd.Series) -> pd.Series:
    """Romanised words in Tamil letters; letters without an entry stay as they are."""

    def word(w: str) -> str:
        low = w.casefold()
        if len(low) != len(w) or not re.search("[a-z]", low):
            return w
        # Group by group in the folded word; what stands between keeps its own case.
        out, at = [], 0
        for m in _GROUPS.finditer(low):
            out += [w[at : m.start()], ROMAN_TO_TAMIL[m.group()]]
            at = m.end()
        return "".join([*out, w[at:]])

    return s.map(lambda x: x if x is None else " ".join(map(word, x.split(" "))))


# ---- the same in Python, for operators that need whole feature sets per text

_TOKEN = re.compile(r"[^\W_]+")
_TRANSLATED = str.maketrans({**{chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}})
_WIDE, _FOLDED = re.compile("[\uff01-\uff5e]"), re.compile(f"[{''.join(map(re.escape, PUNCTUATION))}]")


def match_form(text: str) -> str:
    """normalize_for_match of one string."""
    if not text.isascii():
        # Few letters are folded, and a translation looks every one up.
        text = unicodedata.normalize("NFC", text.translate(_TRANSLATED) if _WIDE.search(text) else text)
        text = _FOLDED.sub(lambda m: PUNCTUATION[m.group()], text)
    return " ".join(text.split()).casefold()


@functools.lru_cache(1 << 10)
def tokens_of(text: str) -> tuple[str, ...]:
    """A text is often asked for its tokens again at once, for its features and for its facts."""
    return tuple(_TOKEN.findall(match_form(text)))


@functools.lru_cache(1 << 17)
def _grams(token: str) -> tuple[str, ...]:
    """A word and its letter triples; words recur far more often than texts."""
    padded = f"#{token}#"
    return (token, *[padded[i : i + 3] for i in range(len(token))])


@functools.lru_cache(1 << 13)
def features_of(text: str) -> frozenset[str]:
    """Words and letter triples of a text, as feature_set gives them."""
    return frozenset().union(*map(_grams, set(tokens_of(text))))


def slug(c: Column) -> Column:
    s = F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9-]+", "-")
    return F.substring(F.regexp_replace(F.regexp_replace(s, "-{2,}", "-"), "^-+|-+$", ""), 1, 80)


def unique_slug(c: Column, seed: Column) -> Column:
    """A slug with six digits drawn from a seed (an id): the same on every run."""
    return F.concat_ws("-", F.nullif(slug(c), F.lit("")), F.substring(F.sha2(seed.cast("string"), 256), 1, 6))


def email_key(c: Column) -> Column:
    """The form under which mail addresses are compared."""
    return F.lower(F.trim(c))


def limitations(c: Column) -> Column:
    """What a decision of detect_language cannot tell, as codes."""
    p = script_profile(c)
    return F.array_compact(F.array(F.when(p["letters"] == 0, "no_letters"), F.when((p["letters"] > 0) & (p["letters"] < 3), "short_text"), F.when((p["tamil"] > 0) & (p["latin"] > 0), "mixed_script")))
