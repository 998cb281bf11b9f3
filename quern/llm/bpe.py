"""Corpus encoding with a public byte-level BPE (problem 8).

Within a pre-token the encoder walks left to right. An Aho-Corasick automaton over the token
bytes gives every token that matches at each offset, longest first. A token may follow its
predecessor only if the pair survives merging as it stands, which a lazily filled
pair-compatibility table answers from the merge trees; otherwise the next shorter match is
tried, and offsets from which no encoding exists are remembered, so each offset is left for
good at most once. Decoding slices one byte buffer through an offset table.

Results: a null text and an empty text both encode to the empty list. Texts of any length are
encoded whole. Repeated and tied rows are encoded like any other; extra columns are ignored.
"""

from __future__ import annotations

import base64
import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quern.llm.common import map_batches, spread, table

#: Pre-tokens kept per Python worker; beyond it the memory starts afresh.
CACHE_LIMIT = 300_000


def tokenizer_file(name: str = "byte_bpe_50k.tiktoken") -> tuple[bytes, str]:
    """Content of a vocabulary file and the pre-token pattern, both read on the driver."""
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        return f.read(), public_tokenizers.PATTERN


class BacktrackingBpe:
    """Exact BPE over ranks: token id = merge order, single bytes first."""

    def __init__(self, ranks_file: bytes, pattern: str):
        import ahocorasick
        import regex

        by_rank = sorted((int(r), base64.b64decode(t)) for t, r in (line.split() for line in ranks_file.splitlines() if line))
        self.tokens = [t for _, t in by_rank]
        assert [r for r, _ in by_rank] == list(range(len(by_rank))), "ids must be merge ranks"
        self.ids = {t: i for i, t in enumerate(self.tokens)}
        self.split = regex.compile(pattern).findall
        self.lengths = [len(t) for t in self.tokens]
        #: Decoding: bytes of token i are buffer[offsets[i]:offsets[i + 1]].
        self.offsets = np.concatenate([[0], np.cumsum(self.lengths)])
        self.buffer = b"".join(self.tokens)
        self.automaton = ahocorasick.Automaton()
        for i, t in enumerate(self.tokens):
            self.automaton.add_word(t.decode("latin-1"), i)
        self.automaton.make_automaton()
        self._merge_trees()
        self._compatible: dict[tuple[int, int], bool] = {}
        self._cache: dict[str, tuple[int, ...]] = {}

    def _merge_trees(self) -> None:
        """The two parts each token was merged from, found by replaying the merges below it."""
        self.parts: list[tuple[int, int] | None] = []
        self.merged: dict[tuple[int, int], int] = {}
        for i, t in enumerate(self.tokens):
            if len(t) == 1:
                self.parts.append(None)
                continue
            seq = [self.ids[t[k : k + 1]] for k in range(len(t))]
            while len(seq) > 2:
                best = min(((self.merged.get(p, i), k) for k, p in enumerate(zip(seq, seq[1:]))), default=(i, 0))
                if best[0] >= i:
                    break
                seq[best[1] : best[1] + 2] = [best[0]]
            if len(seq) != 2:  # unreachable by merging: never produced by BPE
                self.parts.append(None)
                continue
            self.parts.append((seq[0], seq[1]))
            self.merged[(seq[0], seq[1])] = i

    def _spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """(piece, rank at which it is absorbed) of the pieces that touch one edge of a token."""
        out, absorbed = [], len(self.tokens)
        while True:
            out.append((token, absorbed))
            if self.parts[token] is None:
                return out
            absorbed, token = token, self.parts[token][side]

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging the bytes of a then b leaves exactly [a, b]: no piece on the right
        edge of a merges with one on the left edge of b while both still stand alone."""
        known = self._compatible.get((a, b))
        if known is None:
            left = self._spine(b, 0)
            known = not any(
                (m := self.merged.get((x, y))) is not None and m < x_end and m <= y_end
                for x, x_end in self._spine(a, 1)
                for y, y_end in left
            )
            self._compatible[(a, b)] = known
        return known

    def encode_piece(self, piece: str) -> tuple[int, ...]:
        data = piece.encode("utf-8", "surrogatepass")
        if (whole := self.ids.get(data)) is not None and (len(data) == 1 or self.parts[whole]):
            return (whole,)
        matches: list[list[int]] = [[] for _ in data]
        for end, token in self.automaton.iter(data.decode("latin-1")):
            matches[end + 1 - self.lengths[token]].append(token)  # shorter first
        n, dead = len(data), bytearray(len(data) + 1)
        out: list[int] = []
        pos, choice = 0, len(matches[0]) - 1
        choices: list[int] = []
        while pos < n:
            while choice >= 0:
                token = matches[pos][choice]
                end = pos + self.lengths[token]
                if not dead[end] and (not out or self.compatible(out[-1], token)):
                    break
                choice -= 1
            if choice >= 0:
                out.append(token)
                choices.append(choice)
                pos = end
                choice = len(matches[pos]) - 1 if pos < n else -1
            else:
                dead[pos] = 1
                pos -= self.lengths[out.pop()]
                choice = choices.pop() - 1
        return tuple(out)

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        cache, out = self._cache, []
        if len(cache) > CACHE_LIMIT:
            cache.clear()
        for piece in self.split(text):
            ids = cache.get(piece)
            if ids is None:
                ids = self.encode_piece(piece)
                if len(piece) <= 64:
                    cache[piece] = ids
            out.extend(ids)
        return out

    def decode(self, ids: list[int]) -> bytes:
        at = np.asarray(ids, dtype=np.int64)
        return b"".join(self.buffer[s:e] for s, e in zip(self.offsets[at].tolist(), self.offsets[at + 1].tolist()))


@functools.lru_cache(maxsize=2)
def _encoder(ranks_file: bytes, pattern: str) -> BacktrackingBpe:
    return BacktrackingBpe(ranks_file, pattern)


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = "byte_bpe_50k.tiktoken", count_only: bool = False) -> DataFrame:
    """(key, ids), or (key, n_tokens) with ``count_only``; one narrow stage, without a shuffle where
    the scan has a split for each core. The vocabulary file (under 1 MB, a fixed size) is broadcast
    once."""
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(tokenizer_file(vocabulary))
    kind = dict(df.dtypes)[key]

    def make():
        bpe = _encoder(*shared.value)

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            encoded = [bpe.encode(t) for t in batch.column(1).to_pylist()]
            sizes = np.fromiter(map(len, encoded), dtype=np.int64, count=len(encoded))
            if count_only:
                return pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes)], [key, "n_tokens"])
            flat = np.fromiter((i for ids in encoded for i in ids), dtype=np.int32, count=int(sizes.sum()))
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            return pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], [key, "ids"])

        return run

    out = "n_tokens long" if count_only else "ids array<int>"
    return map_batches(spread(df.select(key, text)), f"`{key}` {kind}, {out}", make)


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"))
