"""Share of a text that repeats other content of the same text (problem 10).

A text is reduced to its letters (case folded, marks kept; digits and punctuation give way to
single spaces). Polynomial rolling hashes of every window of the n-gram lengths are compared in
numpy; the characters under a window that already stood earlier count as repeated, as do whole
lines and sentences that stood earlier.

Each length has its own reach, as a short window says less. One of 32 letters counts wherever it
stood before: stock phrases that recur within different sentences stay below that. One of 16
counts only where it stood at most 32 letters before: a word or short phrase said over and over,
too short a loop for the long window. In scripts written without spaces, where a character
carries about as much as a syllable or word, the lengths are 12 and 6. Equal hashes of 64 bits
are taken as equal text.

Results: null, empty and letterless texts have share 0. Texts of any length are measured whole;
time is n log n. Repeated documents are measured each on its own; extra columns are ignored.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from quern.llm.common import map_batches, spread, table

#: (length, how far before at most; None: anywhere) of the windows.
SPACED, UNSPACED = ((32, None), (16, 32)), ((12, None), (6, 12))
THRESHOLD = 1 / 3
#: Marks that end a sentence or line.
ENDS = ".!?।॥。！？\n\r\f\v\x85\u2028\u2029"
BASE = np.uint64(6364136223846793005)


class _Letters(dict):
    """Translation that keeps letters and marks, turns ends into line feeds and all else into
    a space."""

    def __missing__(self, code: int) -> str:
        kept = chr(code) if unicodedata.category(chr(code))[0] in "LM" else "\n" if chr(code) in ENDS else " "
        self[code] = kept
        return kept


_letters = _Letters()


def reduced(text: str) -> list[str]:
    """The sentences and lines of a text, reduced to letters; those without any left out."""
    parts = unicodedata.normalize("NFKC", text).casefold().translate(_letters).split("\n")
    return [" ".join(words) for p in parts if (words := p.split())]


def _codes(s: str) -> np.ndarray:
    return np.frombuffer(s.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _unspaced(codes: np.ndarray) -> np.ndarray:
    """Thai, Lao, Myanmar, Khmer, kana and Han."""
    return ((codes >= 0x0E00) & (codes < 0x0F00)) | ((codes >= 0x1000) & (codes < 0x10A0)) | ((codes >= 0x1780) & (codes < 0x1800)) | ((codes >= 0x3040) & (codes < 0xA000)) | (codes >= 0x20000)


def rolling_hashes(codes: np.ndarray, length: int) -> np.ndarray:
    """Polynomial hash, modulo 2^64, of every window, by doubling: O(n log length)."""
    total, size = codes.astype(np.uint64) + np.uint64(1), 1
    out, done = None, 0
    power, n = BASE, len(codes)
    with np.errstate(over="ignore"):
        powers = {1: BASE}
        while length:
            if length & 1:  # append a block of ``size`` after the ``done`` letters so far
                room = n - done - size + 1
                out = total[:room].copy() if out is None else out[:room] * power + total[done : done + room]
                done += size
            length >>= 1
            if length:
                power_next = powers[size] * powers[size]
                total = total[: len(total) - size] * powers[size] + total[size:]
                size *= 2
                powers[size] = power_next
            power = powers[size]
    return out


def _cover(n: int, at: np.ndarray, length: int) -> np.ndarray:
    edges = np.bincount(at, minlength=n + 1) - np.bincount(at + length, minlength=n + 1)
    return np.cumsum(edges[:-1]) > 0


def repeated_mask(codes: np.ndarray, length: int, reach: int | None = None) -> np.ndarray:
    """Characters under windows that already stood earlier, at most ``reach`` letters before."""
    if len(codes) <= length:
        return np.zeros(len(codes), bool)
    hashes = rolling_hashes(codes, length)
    ordered = np.sort(hashes)
    if not (ordered[1:] == ordered[:-1]).any():  # most texts: no need to know where
        return np.zeros(len(codes), bool)
    order = np.argsort(hashes, kind="stable")
    again = hashes[order[1:]] == hashes[order[:-1]]
    if reach is not None:
        again &= order[1:] - order[:-1] <= reach
    return _cover(len(codes), order[1:][again], length)


def repetition_share(text: str | None) -> float:
    units = reduced(text) if text else []
    if not units:
        return 0.0
    seen: set[str] = set()
    codes = _codes(" ".join(units))
    mask = np.zeros(len(codes), bool)
    at = 0
    for u in units:  # whole sentences and lines; lone words do not count
        size = len(u)
        if u in seen and (" " in u or size >= UNSPACED[0][0]):
            mask[at : at + size] = True
        seen.add(u)
        at += size + 1
    for length, reach in SPACED:
        mask |= repeated_mask(codes, length, reach)
    loose = _unspaced(codes)
    if loose.any():
        for length, reach in UNSPACED:
            mask |= repeated_mask(codes, length, reach) & loose
    letters = codes != 32
    return float((mask & letters).sum() / letters.sum())


def measure(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, share): one narrow stage; each text is measured in the task that reads it."""

    def make():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array([repetition_share(t) for t in batch.column(1).to_pylist()], pa.float64())], [key, "share"])

        return run

    return map_batches(spread(df.select(key, text)), f"`{key}` {dict(df.dtypes)[key]}, share double", make)


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure(table(spark, sf_dir, "documents")).where(F.col("share") > THRESHOLD).select("doc_id")


def p10_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure(table(spark, sf_dir, "documents")).select("doc_id", F.round("share", 6).alias("share"))
