"""Splitting oversized texts at natural boundaries (problem 7).

One scan of the text gives the offsets of its tokens (words, letters of scripts without spaces,
white space), the prefix sums of their sizes, and sorted arrays of boundary offsets by rank
(paragraph, line, sentence, clause, word). How far a piece reaches is found by binary search in
the prefix sums, its end by binary search for the last boundary under that, best rank first;
without any boundary in reach the text is cut hard there. The next piece starts ``overlap``
before that end. Sizes are code points unless another measure of a token is given.

Results: null and blank texts give no pieces; texts within the limit give one. Pieces cover all
non-blank text, are at most ``limit`` long, and are exact slices content[start:end]. In code
points the overlap is exact; in another measure it is the whole tokens that fit into it, and a
token above the limit is cut within. Texts may be of any length (linear scan, logarithmic
search). Repeated chunk rows are split once per key, rows without an id not at all.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from quern.llm.common import first_delivery, table

LIMIT, OVERLAP = 1200, 150

#: A paragraph ends at a line of at most spaces and tabs, a form feed or a paragraph separator.
PARAGRAPH_BREAK = re.compile(r"(?:\r\n|\n|\r)(?:[ \t]*(?:\r\n|\n|\r))+|[ \t]*[\f\u2029][\s\u2029]*")
LINE_BREAK = re.compile(r"\r\n|[\n\r\v\x85\u2028]")
SENTENCE_END = re.compile(r"[.!?।॥。！？…]+[\"'”’)\]」』]*(?=\s|$|[⺀-鿿])")
CLAUSE_END = re.compile(r"[,;:、，；：](?=\s|$|[⺀-鿿])")
TOKEN = re.compile(r"\s+|[฀-๿⺀-鿿]|[^\s฀-๿⺀-鿿]+")
WORD_END = re.compile(r"(?<=\S)(?=\s)|(?<=[฀-๿⺀-鿿])(?=[฀-๿⺀-鿿])")


def paragraphs(text: str) -> tuple[list[int], list[int]]:
    """Sorted starts and ends of the paragraphs, outer white space excluded."""
    starts, ends, at = [], [], 0
    for brk in [*PARAGRAPH_BREAK.finditer(text), None]:
        stop = brk.start() if brk else len(text)
        part = text[at:stop]
        if body := part.strip():
            first = at + len(part) - len(part.lstrip())
            starts.append(first)
            ends.append(first + len(body))
        at = brk.end() if brk else stop
    return starts, ends


class Boundaries:
    """Token offsets, their prefix sums and the boundary offsets of one text, ranked; a cut at
    offset e ends a piece there."""

    def __init__(self, text: str, size: Callable[[str], int] | None = None):
        self.text, self.size = text, size
        self.starts, self.ends = paragraphs(text)
        self.ranks = [self.ends] + [sorted({m.start() if p is LINE_BREAK or p is WORD_END else m.end() for m in p.finditer(text)}) for p in (LINE_BREAK, SENTENCE_END, CLAUSE_END, WORD_END)]
        tokens = TOKEN.findall(text)
        self.offsets = list(accumulate(map(len, tokens), initial=0))
        #: sums[k] = size of the first k tokens.
        self.sums = self.offsets if size is None else list(accumulate(map(size, tokens), initial=0))

    def before(self, at: int) -> int:
        """Size of the text before an offset; a token that it parts counts as far as it goes in
        code points, else not."""
        k = bisect_right(self.offsets, at) - 1
        return self.sums[k] + (at - self.offsets[k] if self.size is None else 0)

    def reach(self, start: int, limit: int) -> int:
        """The farthest end such that text[start:end] stays within the limit."""
        most = self.before(start) + limit
        k = bisect_right(self.sums, most) - 1
        end = self.offsets[k]
        if self.size is None:
            return min(len(self.text), end + most - self.sums[k])
        if end <= start:  # a token above the limit
            end = self.offsets[bisect_right(self.offsets, start)]
            while end > start + 1 and self.size(self.text[start:end]) > limit:
                end = start + (end - start) // 2
        return end

    def last_under(self, rank: int, start: int, reach: int) -> int:
        """The last boundary of a rank in (start, reach], or -1."""
        k = bisect_right(self.ranks[rank], reach) - 1
        return self.ranks[rank][k] if k >= 0 and self.ranks[rank][k] > start else -1

    def cut(self, start: int, limit: int, past: int = 0) -> tuple[int, str]:
        """End of the piece that starts at ``start``, beyond ``past`` (where the piece before
        ended), and the kind of that boundary."""
        reach = self.reach(start, limit)
        if reach >= len(self.text):
            return len(self.text), "end"
        floor = start + (reach - start) // 3  # a boundary further back would leave a stub
        for rank, kind in enumerate(("paragraph", "line", "sentence", "clause", "word")):
            if (end := self.last_under(rank, max(past, start if rank == 0 else floor), reach)) > 0:
                return end, kind
        return reach, "hard"

    def step_back(self, start: int, end: int, overlap: int, limit: int) -> int:
        """Start of the piece after one from start to end."""
        if not overlap:
            return end
        if self.size is None:
            return max(start + 1, end - overlap)
        at = self.offsets[bisect_left(self.sums, self.before(end) - overlap)]
        return at if start < at < end and self.reach(at, limit) > end else end


def pieces(text: str | None, limit: int = LIMIT, overlap: int = OVERLAP, size: Callable[[str], int] | None = None) -> Iterator[tuple[int, int, str]]:
    """(start, end, boundary kind) of each piece."""
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and less than limit")
    if not text or not text.strip():
        return
    b = Boundaries(text, size)
    start, end, last = b.starts[0], 0, len(text.rstrip())
    while start < last:
        end, kind = b.cut(start, limit, end)
        end = min(end, last)
        yield start, end, kind if end < last else "end"
        if end >= last:
            return
        start = b.step_back(start, end, overlap, limit)
        while start >= end and text[start].isspace():  # white space between pieces belongs to none
            start += 1


def forced_cuts(text: str, limit: int = LIMIT) -> list[int]:
    """Ends of the paragraphs whose successor does not fit into one piece with them: the piece
    that starts with such a paragraph is cut at its end, or already within it."""
    b = Boundaries(text)

    def forced(start: int, end: int) -> bool:
        at, kind = b.cut(start, limit)
        return kind != "end" and not (kind == "paragraph" and at > end)

    return [e for s, e in zip(b.starts[:-1], b.ends) if forced(s, e)]


def split_chunks(chunks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Pieces of each chunk: (chunk_id, piece_no, content, char_start, char_end, page_number,
    boundary). char_start and char_end are moved on from the chunk's own, so they point into
    the page; page_number is the chunk's (chunks never span pages), null where it is null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [
                (c, n, text[s:e], at + s, at + e, page, kind)
                for c, text, at, page in zip(pdf["chunk_id"], pdf["content"], pdf["char_start"].fillna(0).astype("int64"), pdf["page_number"].astype("Int64"))
                for n, (s, e, kind) in enumerate(pieces(text, limit, overlap))
            ]
            yield pd.DataFrame(rows, columns=["chunk_id", "piece_no", "content", "char_start", "char_end", "page_number", "boundary"]).astype({"page_number": "Int64"})

    return chunks.select("chunk_id", "content", "char_start", "page_number").mapInPandas(
        run, "chunk_id string, piece_no int, content string, char_start long, char_end long, page_number int, boundary string"
    )


def oversized(spark: SparkSession, sf_dir: str) -> DataFrame:
    big = table(spark, sf_dir, "chunks").where(F.length("content") > LIMIT)
    return first_delivery(big, ["chunk_id"], ["content", "char_start", "page_number"])


def p7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every oversized chunk in pieces of at most 1,200 code points with an overlap of 150."""
    return split_chunks(oversized(spark, sf_dir))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([(c, e) for c, text in zip(pdf["chunk_id"], pdf["content"]) for e in (forced_cuts(text) or [-1])], columns=["chunk_id", "cut_end"])

    return oversized(spark, sf_dir).select("chunk_id", "content").mapInPandas(run, "chunk_id string, cut_end int")


_SPACE = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
_BREAK = rf"(?:\r\n|\n|\r)(?:[ \t]*(?:\r\n|\n|\r))+|[ \t]*[\f\x{{2029}}]{_SPACE}*"

#: Paragraphs as tiles between breaks, their offsets as running lengths; then neighbours that do
#: not fit.
ORACLE = rf"""
WITH c AS (SELECT chunk_id, any_value(content) AS t FROM chunks WHERE length(content) > {LIMIT} GROUP BY 1),
p0 AS (SELECT chunk_id, regexp_extract_all(t, '{_BREAK}|[^\n\r\f\x{{2029}} \t]+|[\n\r \t]') AS ps FROM c),
p AS (SELECT chunk_id, unnest(ps) AS piece, generate_subscripts(ps, 1) AS k FROM p0),
b AS (SELECT *, regexp_full_match(piece, '{_BREAK}') AS brk, sum(length(piece)) OVER (PARTITION BY chunk_id ORDER BY k) - length(piece) AS place FROM p),
g AS (SELECT *, count(*) FILTER (WHERE brk) OVER (PARTITION BY chunk_id ORDER BY k) AS n FROM b),
w AS (SELECT chunk_id, n, min(place) AS place, string_agg(piece, '' ORDER BY k) AS para FROM g WHERE NOT brk GROUP BY 1, 2),
e AS (
  SELECT chunk_id, place + length(para) - length(regexp_replace(para, '^{_SPACE}+', '')) AS s, place + length(regexp_replace(para, '{_SPACE}+$', '')) AS e
  FROM w WHERE regexp_replace(para, '{_SPACE}+', '', 'g') <> ''),
f AS (SELECT chunk_id, e AS cut_end FROM (SELECT *, lead(e) OVER (PARTITION BY chunk_id ORDER BY s) AS next FROM e) WHERE next - s > {LIMIT})
SELECT chunk_id, cut_end::INT AS cut_end FROM f UNION ALL SELECT chunk_id, -1 FROM c WHERE chunk_id NOT IN (SELECT chunk_id FROM f)
"""
