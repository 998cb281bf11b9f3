"""Visually identical text in one consistent form (problem 4).

DuckDB runs inside the Arrow partitions of a Spark stage: one embedded SQL expression drops
invisible characters, folds widths, ligatures, spaces and hyphens, maps look-alike letters and
compatibility forms, and composes with nfc_normalize. Compatibility forms come from the Unicode
database by the kind of their decomposition: wide and narrow forms, letters in another font,
ligatures, roman numerals, positional Arabic forms and the like. What differs visibly stays
different: capitals, visible accents, quotation marks, dashes, punctuation, and raised, lowered,
circled, squared or fractional forms.

Results: null stays null, empty stays empty, texts of any length are mapped whole; the mapping
is idempotent. Pairs are found through classes of equal strings: only classes that share a
canonical form and differ as strings are joined, so a text repeated in a third of all rows costs
no more than the pairs it must report; ``lookalike_classes`` gives one row per record instead.
Repeated deliveries of an id count once.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from quern.llm.common import checkpointed, table

# Characters that look alike, from Cyrillic, Greek, Armenian, Cherokee and Tamil.
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "ԁ": "d", "һ": "h", "ԛ": "q", "ԝ": "w", "ѵ": "v", "ӏ": "l",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "У": "Y", "Ѕ": "S", "І": "I", "Ј": "J", "Ԍ": "G", "Ԛ": "Q", "Ԝ": "W",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ο": "o", "ϲ": "c", "ν": "v", "ϳ": "j", "Ϲ": "C", "ɑ": "a", "ɡ": "g", "ı": "i",
    "ո": "n", "ս": "u", "հ": "h", "օ": "o", "ց": "g", "զ": "q", "Օ": "O", "Ս": "U", "Տ": "S", "Լ": "L",
    "Ꭰ": "D", "Ꭱ": "R", "Ꭲ": "T", "Ꭺ": "A", "Ꭻ": "J", "Ꭼ": "E", "Ꮃ": "W", "Ꮇ": "M", "Ꮋ": "H", "Ꮐ": "G", "Ꮓ": "Z", "Ꮪ": "S", "Ꮩ": "V", "Ꮮ": "L", "Ꮯ": "C", "Ꮲ": "P", "Ꮶ": "K", "Ᏼ": "B",
    "௧": "க", "௨": "உ", "௪": "ச", "௫": "ரு", "௭": "எ", "௮": "அ", "௰": "ய", "௱": "ள",
    "‐": "-", "‑": "-", "−": "-",
}
# Frequent compatibility forms of several characters; Tamil au written with its parts.
SEQUENCES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st", "…": "...", "ำ": "\u0e4d\u0e32", "ௌ": "ெள", "ஔ": "ஒள", "\r\n": "\n"}
# Decompositions that keep the look of a character, and characters whose do not.
SAME_LOOK = ("wide", "narrow", "font", "noBreak", "initial", "medial", "final", "isolated", "compat")
OTHER_LOOK = "ſϐϑϒϓϔϕϖϰϱϴϵ϶"
# Invisible characters (soft hyphen, joiners, marks, fillers, selectors) and spaces.
INVISIBLE = r"[\x{00AD}\x{034F}\x{061C}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180E}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{206F}\x{3164}\x{FE00}-\x{FE0F}\x{FEFF}\x{FFA0}]"
SPACES = r"[\x{00A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]"


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


@functools.cache
def compatibility() -> dict[str, str]:
    """Characters of a compatible look with what they stand for, by their decomposition; those
    that the other tables hold and marks set upon a space left out."""
    out = {}
    for code in range(0x80, 0x110000):
        ch = chr(code)
        kind = re.match(r"<(\w+)>", unicodedata.decomposition(ch))
        if kind and kind.group(1) in SAME_LOOK and ch not in OTHER_LOOK and ch not in SEQUENCES and ch not in LOOKALIKES:
            to = unicodedata.normalize("NFKC", ch)
            if not to.startswith((" ", "\u1160")) and to != ch and not 0xFF01 <= code <= 0xFF5E:
                out[ch] = to
    return out


def _char_class(chars: list[str]) -> str:
    """A regular-expression class of characters, as ranges."""
    codes, ranges = sorted(map(ord, chars)), []
    for c in codes:
        if ranges and c == ranges[-1][1] + 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    return "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in ranges) + "]"


def canonical_sql(column: str) -> str:
    """The DuckDB expression of the canonical form."""
    wide = "".join(map(chr, range(0xFF01, 0xFF5F)))
    narrow = "".join(chr(ord(c) - 0xFEE0) for c in wide)
    single = {a: b for a, b in LOOKALIKES.items() if len(b) == 1}
    from_set, to_set = "".join(single) + wide, "".join(single.values()) + narrow
    long = {**SEQUENCES, **{a: b for a, b in LOOKALIKES.items() if len(b) > 1}}
    rare = compatibility()
    rare_class, rare_to = _char_class(list(rare)), "[" + ", ".join(map(_quoted, rare.values())) + "]"

    def folded(e: str) -> str:
        # Each rare character that a text holds is replaced throughout; most texts hold none.
        swaps = f"list_reduce(list_concat([{e}], list_distinct(regexp_extract_all({e}, '{rare_class}'))), lambda s, c: replace(s, c, ({rare_to})[instr({_quoted(''.join(rare))}, c)]))"
        e = f"CASE WHEN regexp_matches({e}, '{rare_class}') THEN {swaps} ELSE {e} END"
        e = f"translate({e}, {_quoted(from_set)}, {_quoted(to_set)})"
        for a, b in long.items():
            e = f"replace({e}, {_quoted(a)}, {_quoted(b)})"
        return f"nfc_normalize({e})"

    bare = f"nfc_normalize(regexp_replace(regexp_replace(t0, '{INVISIBLE}', '', 'g'), '{SPACES}', ' ', 'g'))"
    # Twice: a look-alike under a combining mark composes only after it is mapped. Plain ASCII
    # stands as it is.
    steps = f"list_transform(list_transform(list_transform([t0], lambda t0: {bare}), lambda t1: {folded('t1')}), lambda t2: {folded('t2')})[1]"
    return f"(CASE WHEN regexp_full_match({column}, '[\\x00-\\x0C\\x0E-\\x7F]*') THEN {column} ELSE {steps.replace('[t0]', f'[{column}]')} END)"


def duckdb_batches(df: DataFrame, sql: str, schema: str) -> DataFrame:
    """Run a DuckDB query over every Arrow batch, which it sees as table ``batch``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        con = duckdb.connect(config={"threads": 1, "memory_limit": "512MB", "temp_directory": ""})
        try:
            for b in batches:
                if b.num_rows:
                    con.register("batch", pa.Table.from_batches([b]))
                    out = con.sql(sql).to_arrow_table()
                    con.unregister("batch")
                    yield from out.to_batches()
        finally:
            con.close()

    return df.mapInArrow(run, schema)


def canonicalise(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text, canonical)."""
    kind = dict(df.dtypes)[key]
    return duckdb_batches(
        df.select(F.col(key).alias("k"), F.col(text).alias("t")), f"SELECT k AS \"{key}\", t AS \"{text}\", {canonical_sql('t')} AS canonical FROM batch", f"`{key}` {kind}, `{text}` string, canonical string"
    )


def digests_of(records: DataFrame) -> DataFrame:
    """(record_kind, id, raw, canon) of records (record_kind, id, text), once each. Texts travel
    as 128-bit digests only."""
    return checkpointed(duckdb_batches(
        records.where("text is not null and id is not null").select("record_kind", "id", "text"),
        f"SELECT record_kind, id, md5(t0) AS raw, md5({canonical_sql('t0')}) AS canon FROM (SELECT record_kind, id, text AS t0 FROM batch)",
        "record_kind string, id string, raw string, canon string",
    ).distinct())


def lookalike_pairs(records: DataFrame) -> DataFrame:
    """(record_kind, id_a, id_b) of records (record_kind, id, text) that look the same but are
    not equal as strings."""
    digests = digests_of(records)
    strings = digests.select("record_kind", "canon", "raw").distinct()
    twin = strings.groupBy("record_kind", "canon").count().where("count > 1").select("record_kind", "canon")
    one = strings.join(twin, ["record_kind", "canon"])
    links = one.withColumnRenamed("raw", "raw_a").join(one.withColumnRenamed("raw", "raw_b"), ["record_kind", "canon"]).where("raw_a < raw_b")
    a = digests.select("record_kind", F.col("raw").alias("raw_a"), F.col("id").alias("a"))
    b = digests.select("record_kind", F.col("raw").alias("raw_b"), F.col("id").alias("b"))
    found = links.drop("canon").join(a, ["record_kind", "raw_a"]).join(b, ["record_kind", "raw_b"]).where("a <> b")
    return found.select("record_kind", F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b"))


def lookalike_classes(records: DataFrame) -> DataFrame:
    """(record_kind, id, class_id, strings): the class of each record, and how many different
    strings look like it; linear however often a text recurs."""
    digests = digests_of(records)
    sizes = digests.groupBy("record_kind", "canon").agg(F.countDistinct("raw").alias("strings"))
    return digests.join(sizes, ["record_kind", "canon"]).select("record_kind", "id", F.col("canon").alias("class_id"), "strings")


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = table(spark, sf_dir, "chunks").select(F.lit("chunk").alias("record_kind"), F.col("chunk_id").alias("id"), F.col("content").alias("text"))
    queries = table(spark, sf_dir, "processed_queries").select(F.lit("query").alias("record_kind"), F.col("query_id").alias("id"), F.col("normalized").alias("text"))
    return chunks.unionByName(queries)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike_pairs(_records(spark, sf_dir))


def p4_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record with its class of texts that look the same."""
    return lookalike_classes(_records(spark, sf_dir))


def oracle_found() -> str:
    return f"""
WITH r AS (
  SELECT DISTINCT 'chunk' AS record_kind, chunk_id AS id, content AS t FROM chunks WHERE content IS NOT NULL
  UNION SELECT DISTINCT 'query', query_id, normalized FROM processed_queries WHERE normalized IS NOT NULL),
c AS (SELECT *, {canonical_sql("t")} AS k FROM r)
SELECT a.record_kind, a.id AS id_a, b.id AS id_b
FROM c a JOIN c b ON a.record_kind = b.record_kind AND a.k = b.k AND a.id < b.id AND a.t <> b.t
"""


def oracle_classes() -> str:
    return f"""
WITH r AS (
  SELECT DISTINCT 'chunk' AS record_kind, chunk_id AS id, content AS t FROM chunks WHERE content IS NOT NULL
  UNION SELECT DISTINCT 'query', query_id, normalized FROM processed_queries WHERE normalized IS NOT NULL),
c AS (SELECT *, md5({canonical_sql("t")}) AS k FROM r)
SELECT record_kind, id, k AS class_id, n AS strings FROM c JOIN (SELECT record_kind, k, count(DISTINCT t) AS n FROM c GROUP BY 1, 2) USING (record_kind, k)
"""
