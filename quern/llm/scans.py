"""Repairing the text of scanned pages (problem 5).

Words are checked against a vocabulary counted over all pages that are no scans. For every word
of a scan outside it, a Levenshtein automaton is run against a trie of the vocabulary, which
gives all words at the least distance; candidates are ranked by how often they stand between the
same neighbours, then by their count. Running headers, footers and page numbers are found from
the edges of neighbouring pages and from line forms that recur at page edges of many documents.
Lines broken within a word are joined where the joined word, rather than the hyphened one, is
known. What is left is reflowed into paragraphs.

A page is taken for a scan if it has an engine or a confidence, or the look of wrapped lines,
and no line longer than MAX_WIDTH. Results: pages without text have no lines; re-delivered pages
count once, pages without an id not at all; a page number that occurs twice in a version is compared with both neighbours.
Nothing is grouped by version, so one long version does not burden one task.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.functions import pandas_udf

from quern.llm.common import checkpointed, table
from quern.llm.sentences import plain, token_script

MAX_WIDTH, MIN_WRAPPED = 100, 5
BREAK_MARKS = "-‐¬­"
OUTER = "\"'“”‘’.,;:!?()[]{}…|।॥*•#"
#: Known words held by each worker; further ones are joined.
LOCAL_WORDS = 500_000
#: Words of one trie; larger vocabularies are searched shard by shard. Words or forms looked up by
#: one task, and the least number of tasks.
SHARD_WORDS, ASKED_WORDS, BLOCKS = 250_000, 20_000, 24
#: A misread form is so many times rarer than the word it stands for.
RARER = 10
#: Share of the misread forms sure by their count that a misreading has at least to be a usual one.
USUAL = 0.01
#: Neighbouring pages compared, line forms of one shard of the fuzzy comparison, and their likeness.
REACH, SHARD_FORMS, LIKE = 4, 100_000, 0.75
#: Letters of a running line known from its neighbours only; words of a labelled page number.
MAX_HEADER, LABEL_WORDS, BESIDE = 50, 4, 0.85
#: Scripts without spaces, whose words this check does not find.
UNSPACED = {"Han", "Thai"}
SENTENCE_WITHIN = re.compile(r"[.!?।॥][\"'”’)]* +\S")
DIGITS = re.compile(r"\d+")
NUMBERED = re.compile(r"[-–—\[(|\s]*([\dlIOo]{1,4}|[ivxlcIVXLC]{1,8})[-–—\])|\s]*")
_AS_DIGITS = str.maketrans("lIOo", "1100")
TERMINATED = re.compile(r"[.!?।॥。！？][\"'”’)\]]*$")


# ---------------------------------------------------------------- words


@functools.lru_cache(1 << 18)
def word_type(token: str) -> str:
    """Folded form of a token, outer punctuation cut; "" if it has no letters."""
    t = plain(token).casefold().strip(OUTER)
    return t if any(c.isalpha() for c in t) and token_script(t) not in UNSPACED else ""


@functools.lru_cache(1 << 18)
def masked(t: str) -> str:
    return DIGITS.sub("0", t)


def mask(c: Column) -> Column:
    """The same of a column."""
    return F.regexp_replace(c, r"\p{Nd}+", "0")


def is_code(t: str) -> bool:
    """File numbers and the like: letters and digits apart."""
    return bool(re.fullmatch(r"[a-z]{1,4}(?:[/.-]?\d+)+", t)) and "/" in t


class Automaton:
    """Levenshtein automaton of a word, its states made as they are reached: a state is the set
    of offsets in the word with their edit costs, as far as these stay within the limit."""

    def __init__(self, word: str, most: int):
        self.word, self.most, self.chars = word, most, set(word)
        self.states: dict[tuple, int] = {}
        self.sets: list[tuple] = []
        self.moves: list[dict[str, int]] = []
        self.accepts: list[int | None] = []
        self._state(tuple((i, i) for i in range(min(most, len(word)) + 1)))

    def _state(self, offsets: tuple) -> int:
        if not offsets:
            return -1
        if (n := self.states.get(offsets)) is None:
            n = self.states[offsets] = len(self.sets)
            self.sets.append(offsets)
            self.moves.append({})
            self.accepts.append(offsets[-1][1] if offsets[-1][0] == len(self.word) else None)
        return n

    def step(self, state: int, c: str) -> int:
        """The state after a letter; letters that the word lacks are all alike ("")."""
        word, most, costs = self.word, self.most, {}
        for i, cost in self.sets[state]:
            moves = [(i, cost + 1)]
            if i < len(word):
                moves.append((i + 1, cost + (word[i] != c)))
            for j, n in moves:
                if n <= most and n < costs.get(j, most + 1):
                    costs[j] = n
        for i in range(min(costs, default=0), len(word)):  # letters of the word left out
            n = costs.get(i, most) + 1
            if n <= most and n < costs.get(i + 1, most + 1):
                costs[i + 1] = n
        new = self.moves[state][c] = self._state(tuple(sorted(costs.items())))
        return new


class Trie:
    """Vocabulary trie; ``within`` intersects it with the Levenshtein automaton of a word, so no
    candidate within the distance is missed."""

    def __init__(self, words: dict[str, int]):
        self.root: dict = {}
        for w, n in words.items():
            node = self.root
            for c in w:
                node = node.setdefault(c, {})
            node[""] = n

    def within(self, word: str, most: int) -> list[tuple[int, str, int]]:
        """(distance, word, count) of all words at most that far."""
        automaton = Automaton(word, most)
        out: list[tuple[int, str, int]] = []
        step, chars = automaton.step, automaton.chars
        stack = [(self.root, "", 0)]
        while stack:
            node, prefix, state = stack.pop()
            known = automaton.moves[state]
            for c, child in node.items():
                if not c:
                    if prefix and (d := automaton.accepts[state]) is not None:
                        out.append((d, prefix, child))
                    continue
                k = c if c in chars else ""
                new = known.get(k)
                if new is None:
                    new = step(state, k)
                if new >= 0:
                    stack.append((child, prefix + c, new))
        return out

    def nearest(self, word: str) -> list[tuple[int, str, int]]:
        """All words at the least distance, up to 1 for short words, 3 for long ones."""
        limit = 0 if len(word) < 2 else 1 if len(word) < 4 else 2 if len(word) < 9 else 3
        for most in range(1, limit + 1):
            if found := self.within(word, most):
                least = min(d for d, _, _ in found)
                return [x for x in found if x[0] == least]
        return []


# ---------------------------------------------------------------- lines


def is_scan(text: str, engine: object, confidence: object) -> bool:
    lines = [x for x in text.split("\n") if x.strip()]
    if not lines or max(map(len, lines)) > MAX_WIDTH:
        return False
    known = engine is not None or (confidence is not None and confidence == confidence)
    return known or len(lines) >= MIN_WRAPPED and sorted(map(len, lines))[len(lines) // 2] >= 30


def narrow_pages(pages: DataFrame) -> DataFrame:
    """Pages without a line that no scan has: what ``is_scan`` may take for one. Most other pages
    are left out before their text is shuffled."""
    return pages.where(F.array_max(F.transform(F.split("text", "\n"), lambda x: F.length(x))) <= MAX_WIDTH)


def form(line: str) -> str:
    """What recurs of a running line: numbers at its edges cut, others masked."""
    t = " ".join(plain(line).casefold().split())
    t = re.sub(r"^[-–—|\s]*\d+[-–—|\s]+|[-–—|\s]+\d+[-–—|\s]*$", "", t)
    return DIGITS.sub("0", t).strip()


def page_numbers(line: str) -> set[int]:
    """The numbers that a line, being nothing else, may stand for: arabic, also with digits
    read as letters, or roman."""
    m = NUMBERED.fullmatch(line.strip())
    if not m:
        return set()
    s = m.group(1)
    out = set()
    if (digits := s.translate(_AS_DIGITS)).isdigit():
        out.add(int(digits))
    values = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}
    if set(low := s.lower()) <= set(values):
        out.add(sum(-values[a] if values.get(b, 0) > values[a] else values[a] for a, b in zip(low, low[1:] + " ")))
    return out


def _like(a: str, b: str, least: float = LIKE) -> bool:
    if a == b:
        return True
    if min(len(a), len(b)) < 6 or abs(len(a) - len(b)) > 0.3 * max(len(a), len(b)):
        return False
    m = SequenceMatcher(None, a, b, autojunk=False)
    return m.real_quick_ratio() >= least and m.quick_ratio() >= least and m.ratio() >= least


def _letters(f: str) -> np.ndarray:
    return np.bincount([ord(c) % 64 for c in f], minlength=64).astype(np.uint16)


def _common(places: dict[str, int], n: int, g: str) -> int:
    """Length of the longest common subsequence of g and a string of n letters with the places."""
    v = full = (1 << n) - 1
    for c in g:
        u = v & places.get(c, 0)
        v = ((v + u) | (v - u)) & full
    return n - v.bit_count()


class Forms:
    """Line forms, with a search for like ones. Only what likeness implies (near lengths, letters
    and a subsequence in common) decides which forms are compared, so none is missed."""

    def __init__(self, forms: list[str]):
        self.known = set(forms)
        self.forms = sorted((f for f in self.known if len(f) >= 6), key=len)
        self.lengths = np.array([len(f) for f in self.forms], np.int64)
        self.letters = np.stack([_letters(f) for f in self.forms]) if self.forms else np.zeros((0, 64), np.uint16)
        self._memo: dict[str, bool] = {}

    def has_like(self, f: str) -> bool:
        if f in self.known:
            return True
        if (known := self._memo.get(f)) is None:
            known = self._memo[f] = len(f) >= 6 and self._search(f)
        return known

    def _search(self, f: str) -> bool:
        n = len(f)
        a, b = np.searchsorted(self.lengths, [int(n * 0.7) - 1, int(n / 0.7) + 2])
        letters = np.minimum(self.letters[a:b], _letters(f)).sum(axis=1, dtype=np.int64)
        near = np.flatnonzero(2 * letters >= LIKE * (self.lengths[a:b] + n))
        places: dict[str, int] = {}
        for k, c in enumerate(f):
            places[c] = places.get(c, 0) | 1 << k
        candidates = (self.forms[a + i] for i in near[np.argsort(-letters[near], kind="stable")])
        return any(2 * _common(places, n, g) >= LIKE * (n + len(g)) and _like(f, g) for g in candidates)


SUMMARY = "page_id string, version_id string, page_number int, top_no int, top string, top_gap boolean, bottom_no int, bottom string, bottom_gap boolean, first_1 string, first_2 string, last_1 string, last_2 string, apart array<string>, top_known string, top_form string, bottom_known string, bottom_form string"


def _known_form(line: str) -> str | None:
    """The form of an edge line as far as it may show what runs elsewhere."""
    return None if TERMINATED.search(line) and not line.endswith(".") else form(line)


def _asked_form(line: str, at: str) -> str | None:
    """The form of an edge line where it depends on its form whether the line runs."""
    if page_numbers(line) or TERMINATED.search(line) and at == "top":
        return None
    f = form(line)
    return f if len(f) >= 4 else None


def _summary(pdf: pd.DataFrame) -> Iterator[tuple]:
    for page, version, number, text, engine, confidence in zip(pdf["page_id"], pdf["version_id"], pdf["page_number"], pdf["text"], pdf["ocr_engine"], pdf["ocr_confidence"]):
        if not is_scan(text, engine, confidence):
            continue
        rows = text.split("\n")
        solid = [i for i, x in enumerate(rows) if x.strip()]
        a, b = solid[0], solid[-1]
        blank = lambda i: not 0 <= i < len(rows) or not rows[i].strip()
        apart = [f for i in solid[1:-1] if len(rows[i]) <= 50 and blank(i - 1) and blank(i + 1) and not TERMINATED.search(rows[i].rstrip()) and (f := form(rows[i]))]
        word = lambda k, end: rows[solid[k]].split()[end] if -len(solid) <= k < len(solid) else None
        top, bottom = rows[a].strip(), rows[b].strip()
        forms = _known_form(top), _asked_form(top, "top"), _known_form(bottom), _asked_form(bottom, "bottom")
        yield page, version, number, a + 1, top, blank(a + 1), b + 1, bottom, blank(b - 1), word(0, 0), word(1, 0), word(-1, -1), word(-2, -1), apart, *forms


def summaries(pages: DataFrame) -> DataFrame:
    """One row per scanned page: its edge lines and the words there."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in SUMMARY.split(", ")]
        for pdf in batches:
            yield pd.DataFrame(list(_summary(pdf)), columns=names)

    columns = ["page_id", "version_id", "page_number", "text", "ocr_engine", "ocr_confidence"]
    return pages.select(*columns).mapInPandas(run, SUMMARY).dropDuplicates(["page_id"])


def edge_forms(edges: DataFrame) -> DataFrame:
    """(edge, form) of headers and of labelled page numbers that recur in at least two versions,
    and more often there than as lines standing alone within pages."""
    top = edges.where("top_gap").select(F.lit("top").alias("edge"), F.col("top_known").alias("form"), F.col("top").alias("line"), "version_id")
    bottom = edges.select(F.lit("bottom").alias("edge"), F.col("bottom_known").alias("form"), F.col("bottom").alias("line"), "version_id").where(F.col("line").rlike(r"\d") & (F.size(F.split("form", " ")) <= LABEL_WORDS))
    ends = F.col("line").rlike(r"[.!?।॥。！？][\"'”’)\]]*$")
    met = top.unionByName(bottom).where(~ends & F.col("form").isNotNull() & (F.length("form") >= 4)).select("edge", "form", "version_id").distinct()
    seen = met.groupBy("edge", "form").agg(F.count("version_id").alias("n"))
    within = edges.select(F.explode("apart").alias("form")).groupBy("form").agg(F.count("*").alias("m"))
    return seen.join(within, "form", "left").where((F.col("n") >= 2) & (F.coalesce("m", F.lit(0)) < F.col("n"))).select("edge", "form")


def _blocks(asked: DataFrame) -> int:
    """How many tasks share the rows asked for: as many as keep each bounded."""
    return max(BLOCKS, -(-asked.count() // ASKED_WORDS))


def like_forms(asked: DataFrame, known: DataFrame, blocks: int) -> DataFrame:
    """The rows (edge, form) of ``asked`` that are like a known form of their edge. Asked forms are
    dealt into blocks and known ones into shards; each cell of that grid is a task."""
    shards = max(1, -(-known.count() // SHARD_FORMS))
    left = asked.select("edge", "form", F.pmod(F.xxhash64("form"), F.lit(blocks)).alias("block")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    right = known.select("edge", "form", F.pmod(F.xxhash64("form"), F.lit(shards)).cast("int").alias("shard")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))

    def search(asked: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        forms = {edge: Forms(list(g["form"])) for edge, g in known.groupby("edge")} if len(asked) else {}
        return pd.DataFrame([(e, f) for e, f in zip(asked["edge"], asked["form"]) if e in forms and forms[e].has_like(f)], columns=["edge", "form"])

    return left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInPandas(search, "edge string, form string").distinct()


def running_lines(edges: DataFrame) -> DataFrame:
    """edges with ``top_runs`` and ``bottom_runs``."""
    known = checkpointed(edge_forms(edges))
    asked = checkpointed(edges.select(F.inline(F.array(*[F.struct(F.lit(e).alias("edge"), F.col(f"{e}_form").alias("form")) for e in ("top", "bottom")]))).where("form is not null").distinct())
    exact = asked.join(known, ["edge", "form"], "left_semi")
    like = exact.unionByName(like_forms(asked.join(known, ["edge", "form"], "left_anti"), known, _blocks(asked))).withColumn("like", F.lit(True))
    apart = edges.select(F.explode("apart").alias("form")).groupBy("form").agg(F.count("*").alias("m")).where("m >= 2").select("form", F.lit(True).alias("apart"))
    facts = checkpointed(asked.join(like, ["edge", "form"], "left").join(apart, "form", "left").fillna(False, ["like", "apart"]))
    steps = F.explode(F.array(*[F.lit(k) for k in range(-REACH, REACH + 1) if k]))
    # Keyed by version and page, so that neighbours meet without gathering a version.
    told = edges.select("version_id", steps.alias("step"), F.col("page_number").alias("of"), "top", "bottom").select(
        "version_id", (F.col("of") + F.col("step")).alias("page_number"), F.struct(F.col("step").alias("step"), "top", "bottom").alias("other")
    )
    others = told.groupBy("version_id", "page_number").agg(F.collect_set("other").alias("others"))
    joined = edges.drop("apart", "top_known", "bottom_known").join(others, ["version_id", "page_number"], "left")
    for e in ("top", "bottom"):
        of = facts.where(F.col("edge") == e).select(F.col("form").alias(f"{e}_key"), F.col("like").alias(f"{e}_like"), F.col("apart").alias(f"{e}_apart"))
        # Lines that ask nothing are spread by their page.
        joined = joined.withColumn(f"{e}_key", F.coalesce(f"{e}_form", F.concat(F.lit("\0"), "page_id"))).join(of, f"{e}_key", "left").drop(f"{e}_key", f"{e}_form").fillna(False, [f"{e}_like", f"{e}_apart"])

    def decide(line: str, like: bool, apart: bool, others: list, at: str) -> bool:
        own = page_numbers(line)
        beside = [(o["step"], o[at]) for o in others]
        if own:
            numbers = [(k, ms) for k, x in beside if (ms := page_numbers(x))]
            if numbers:
                return any(n - m == k for k, ms in numbers for m in ms for n in own)
            return min(own) < 1000
        f = form(line)
        if len(f) < 4 or TERMINATED.search(line) and not (at == "bottom" and like):
            return False
        if like:
            return True
        if apart:
            return False
        if len(line) > MAX_HEADER or SENTENCE_WITHIN.search(line) or line[0] in "#|":
            return False
        return any(_like(f, form(x), BESIDE) for _, x in beside if not TERMINATED.search(x))

    told_columns = ["others", "top_like", "top_apart", "bottom_like", "bottom_apart"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            others = [list(o) if o is not None else [] for o in pdf["others"]]
            yield pdf.drop(columns=told_columns).assign(
                top_runs=[decide(x, like, apart, o, "top") for x, like, apart, o in zip(pdf["top"], pdf["top_like"], pdf["top_apart"], others)],
                bottom_runs=[b != a and decide(x, like, apart, o, "bottom") for x, like, apart, o, a, b in zip(pdf["bottom"], pdf["bottom_like"], pdf["bottom_apart"], others, pdf["top_no"], pdf["bottom_no"])],
            )

    columns = [f"{n} {t}" for n, t in joined.drop(*told_columns).dtypes]
    return joined.mapInPandas(run, ", ".join([*columns, "top_runs boolean", "bottom_runs boolean"]))


# ---------------------------------------------------------------- vocabulary


def vocabulary(pages: DataFrame) -> DataFrame:
    """(type, n) over all pages that are no scans, digits masked."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            raw: Counter = Counter()
            for text, engine, confidence in zip(pdf["text"], pdf["ocr_engine"], pdf["ocr_confidence"]):
                if not is_scan(text, engine, confidence):
                    raw.update(text.split())
            types: Counter = Counter()
            for token, n in raw.items():
                if t := word_type(token):
                    types[masked(t)] += n
            yield pd.DataFrame(list(types.items()), columns=["type", "n"])

    return pages.select("text", "ocr_engine", "ocr_confidence").mapInPandas(run, "type string, n long").groupBy("type").agg(F.sum("n").alias("n"))


def corrections(types: DataFrame, words: DataFrame, size: int) -> DataFrame:
    """(type, distance, word, n) of all nearest words of each type. Types are dealt into blocks
    and the vocabulary into shards; each cell of that grid is a task."""
    shards, blocks = max(1, -(-size // SHARD_WORDS)), _blocks(types)
    left = types.select("type", F.pmod(F.xxhash64("type"), F.lit(blocks)).alias("block")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    right = words.select(F.col("type").alias("word"), "n", F.pmod(F.xxhash64("type"), F.lit(shards)).cast("int").alias("shard")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))

    def search(types: pd.DataFrame, words: pd.DataFrame) -> pd.DataFrame:
        trie = Trie(dict(zip(words["word"], words["n"]))) if len(types) else None
        rows = [(t, d, w, n) for t in types["type"] for d, w, n in trie.nearest(t)] if trie else []
        return pd.DataFrame(rows, columns=["type", "distance", "word", "n"])

    found = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInPandas(search, "type string, distance int, word string, n long")
    if shards == 1:
        return found
    least = found.groupBy("type").agg(F.min("distance").alias("distance"))
    return found.join(least, ["type", "distance"])


def edits(word: str, form: str) -> list[str]:
    """What of a word was read as what."""
    return [f"{word[i:j]}>{form[k:n]}" for op, i, j, k, n in SequenceMatcher(None, word, form, autojunk=False).get_opcodes() if op != "equal"]


@pandas_udf(T.ArrayType(T.StringType()))
def edits_of(words: pd.Series, forms: pd.Series) -> pd.Series:
    return pd.Series([edits(w, f) for w, f in zip(words, forms)])


# ---------------------------------------------------------------- lines to rows


def text_id(lines: list[str]) -> int:
    """The same for all copies of a text, whatever their running and blank lines."""
    return int.from_bytes(hashlib.blake2b("\n".join(x.strip() for x in lines).encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)


def _doubtful(token: str, known: set) -> str:
    t = word_type(token)
    return "" if not t or masked(t) in known or is_code(t) else t


def _rows(pdf: pd.DataFrame, known: set) -> Iterator[tuple]:
    """(page_id, line_no, kind, type, other, part, before, after, text_id): 'running' lines; 'word':
    a word to be looked up; 'break': a line end within a word, joined (type) or hyphened (other)."""
    for page, text, top_no, top_runs, bottom_no, bottom_runs, next_word, previous in zip(*(pdf[c] for c in ("page_id", "text", "top_no", "top_runs", "bottom_no", "bottom_runs", "next_word", "previous_word"))):
        rows = text.split("\n")
        running = {n for n, r in ((top_no, top_runs), (bottom_no, bottom_runs)) if r}
        solid = [i for i, x in enumerate(rows) if x.strip() and i + 1 not in running]
        own = text_id([rows[i] for i in solid])
        for n in sorted(running):
            yield page, n, "running", "", "", 0, "", "", own
        tokens = [rows[i].split() for i in solid]
        beside = lambda k, j: word_type(tokens[k][j]) if 0 <= k < len(tokens) and len(tokens[k]) > 1 else ""
        carried = previous if previous is not None and previous[-1:] in BREAK_MARKS and len(previous) > 1 else None
        for k, (i, ts) in enumerate(zip(solid, tokens)):
            no = i + 1
            start = 0
            if carried is not None:  # the word begun on the line before
                joined = word_type(carried[:-1] + ts[0])
                whole = carried[:-1] + "-" + ts[0]
                if joined and masked(joined) not in known and masked(word_type(whole)) not in known:
                    yield page, no, "word", joined, word_type(whole), len(word_type("x" + carried[:-1])) - 1, beside(k - 1, -2), beside(k, 1), own
                start = 1
                carried = None
            stop = len(ts)
            last = ts[-1]
            if last[-1] in BREAK_MARKS and len(last) > 1 and any(c.isalpha() for c in last):
                following = tokens[k + 1][0] if k + 1 < len(tokens) else next_word
                if following is not None and following[:1].isalpha() or following is not None and following[:1] in "@0123456789" and len(following) > 1:
                    joined, whole = word_type(last[:-1] + following), word_type(last[:-1] + "-" + following)
                    yield page, no, "break", joined, whole, len(word_type("x" + last[:-1])) - 1, last[-1], "", own
                    if joined and masked(joined) not in known and masked(whole) not in known:
                        yield page, no, "word", joined, whole, -(len(word_type("x" + last[:-1])) - 1) or -1, beside(k, -2), beside(k + 1, 1), own
                    carried = last
                elif last[-1] in "¬­":
                    yield page, no, "break", "", "", 0, last[-1], "", own
                stop -= 1
            for j in range(start, stop):
                if t := _doubtful(ts[j], known):
                    yield page, no, "word", t, "", 0, word_type(ts[j - 1]) if j else "", word_type(ts[j + 1]) if j + 1 < len(ts) else "", own


ROWS = "page_id string, line_no int, kind string, type string, other string, part int, before string, after string, text_id long"


class ScanRepair:
    """The stages over one pages table; each is a DataFrame."""

    def __init__(self, pages: DataFrame):
        self.pages = pages.where("text is not null and text <> '' and page_id is not null")
        self.narrow = narrow_pages(self.pages)
        self.words = checkpointed(vocabulary(self.pages))
        self.size = self.words.count()
        edges = checkpointed(summaries(self.narrow))
        self.edges = checkpointed(running_lines(edges))

    def _context(self) -> DataFrame:
        """Edges with the first word of the next page's text and the last of the page before."""
        e = self.edges
        first = F.when(F.col("top_runs"), F.col("first_2")).otherwise(F.col("first_1"))
        last = F.when(F.col("bottom_runs"), F.col("last_2")).otherwise(F.col("last_1"))
        after = e.groupBy("version_id", (F.col("page_number") - 1).alias("page_number")).agg(F.min(first).alias("next_word"), F.count("*").alias("next_n"))
        before = e.groupBy("version_id", (F.col("page_number") + 1).alias("page_number")).agg(F.min(last).alias("previous_word"), F.count("*").alias("previous_n"))
        twins = e.groupBy("version_id", "page_number").agg(F.count("*").alias("own_n"))
        own = e.select("page_id", "version_id", "page_number", "top_no", "top_runs", "bottom_no", "bottom_runs", first.alias("own_first"), last.alias("own_last"))
        return own.join(after, ["version_id", "page_number"], "left").join(before, ["version_id", "page_number"], "left").join(twins, ["version_id", "page_number"], "left")

    def rows(self) -> DataFrame:
        spark = self.pages.sparkSession
        head = self.words.orderBy(F.desc("n"), "type").limit(LOCAL_WORDS).select("type").collect()
        shared = spark.sparkContext.broadcast([r.type for r in head])

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            known = set(shared.value)
            names = [c.split()[0] for c in ROWS.split(", ")]
            for pdf in batches:
                yield pd.DataFrame(list(_rows(pdf, known)), columns=names)

        joined = self.narrow.select("page_id", "text").join(self._context(), "page_id")
        rows = joined.mapInPandas(run, ROWS).distinct()
        if self.size <= LOCAL_WORDS:
            return rows
        # Words beyond the local ones: those known after all are not doubtful.
        doubtful = rows.where("kind = 'word'").withColumn("joined", mask(F.col("type"))).withColumn("hyphened", mask(F.col("other")))
        for way in ("joined", "hyphened"):
            doubtful = doubtful.join(self.words.select(F.col("type").alias(way)), way, "left_anti").drop(way)
        return rows.where("kind <> 'word'").unionByName(doubtful)

    def candidates(self, rows: DataFrame) -> DataFrame:
        """All nearest known words of every doubtful one."""
        return checkpointed(corrections(checkpointed(rows.where("kind = 'word'").select("type").distinct()), self.words, self.size))

    def misread(self, rows: DataFrame, nearest: DataFrame) -> DataFrame:
        """Rows of doubtful words that were misread: far rarer than a word nearby, oddly made, or
        no more frequent than a word nearby and misread from it in usual ways. Copies of a scan
        count once, and all is in proportion, so the size of the corpus does not matter."""
        doubtful = rows.where("kind = 'word'")
        per_text = doubtful.groupBy("type", "text_id", "page_id").count().groupBy("type", "text_id").agg(F.max("count").alias("times"))
        counts = per_text.groupBy("type").agg(F.sum("times").alias("times"))
        best = nearest.groupBy("type").agg(F.max("n").alias("n"), F.max_by("word", F.struct("n", "word")).alias("word"))
        odd = F.col("type").rlike(r"[@]|\p{L}\d|\d\p{L}")
        told = checkpointed(counts.join(best, "type", "left").withColumn("sure", odd | (F.col("n") >= F.col("times") * RARER)))
        rarer = told.where(F.col("n") >= F.col("times") * RARER)
        ways = rarer.select(F.explode(F.array_distinct(edits_of("word", "type"))).alias("way")).groupBy("way").count()
        usual = [r.way for r in ways.where(F.col("count") >= F.lit(USUAL * rarer.count())).collect()]  # a few to each 1 / USUAL
        unsure = told.where(~F.coalesce("sure", F.lit(False))).select("type", "times").join(nearest.select("type", "word", "n"), "type").where("n >= times")
        taken = F.array(*[F.lit(w) for w in usual]) if usual else F.lit(None).cast("array<string>")
        likely = unsure.where(F.size(F.array_except(edits_of("word", "type"), taken)) == 0).select("type").distinct()
        return doubtful.join(told.where("sure").select("type").unionByName(likely), "type")

    def breaks(self, rows: DataFrame) -> DataFrame:
        """Line ends within a word that is written without a hyphen."""
        b = rows.where("kind = 'break'")
        words = self.words.select("type", F.col("n"))
        b = b.withColumn("m1", mask(F.col("type"))).withColumn("m2", mask(F.col("other")))
        b = b.join(words.select(F.col("type").alias("m1"), F.col("n").alias("joined_n")), "m1", "left").join(words.select(F.col("type").alias("m2"), F.col("n").alias("hyphened_n")), "m2", "left")
        j, h = F.coalesce("joined_n", F.lit(0)), F.coalesce("hyphened_n", F.lit(0))
        return b.where((j > 0) & (j >= h) | (h == 0))

    def found(self) -> DataFrame:
        rows = checkpointed(self.rows())
        nearest = self.candidates(rows)
        bad = self.misread(rows, nearest)
        # A joined word belongs to two lines; the one that differs from the nearest word counts.
        split = bad.where("part <> 0")
        best = ranked_candidates(split, nearest, neighbours(self.pages))
        split = split.join(best, ["page_id", "line_no", "type"], "left")
        left_same = F.expr("word is not null and substring(word, 1, abs(part)) = substring(type, 1, abs(part))")
        right_same = F.expr("word is not null and length(type) > abs(part) and right(word, length(type) - abs(part)) = substring(type, abs(part) + 1, length(type))")
        own = split.where(F.when(F.col("part") < 0, ~left_same | F.col("word").isNull()).otherwise(~right_same | F.col("word").isNull())).drop("word")
        misread = bad.where("part = 0").select("page_id", "line_no").unionByName(own.select("page_id", "line_no")).distinct()
        return (
            rows.where("kind = 'running'").select("page_id", "line_no", "kind")
            .unionByName(self.breaks(rows).select("page_id", "line_no", F.lit("hyphen").alias("kind")))
            .unionByName(misread.withColumn("kind", F.lit("misread")))
            .distinct()
        )


# ---------------------------------------------------------------- repaired text


def neighbours(pages: DataFrame) -> DataFrame:
    """(first, second, n): how often two words stand side by side in pages that are no scans."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pairs: Counter = Counter()
            for text, engine, confidence in zip(pdf["text"], pdf["ocr_engine"], pdf["ocr_confidence"]):
                if not is_scan(text, engine, confidence):
                    types = [masked(word_type(t)) for t in text.split()]
                    pairs.update((x, y) for x, y in zip(types, types[1:]) if x and y)
            yield pd.DataFrame([(x, y, n) for (x, y), n in pairs.items()], columns=["first", "second", "n"])

    return pages.select("text", "ocr_engine", "ocr_confidence").mapInPandas(run, "first string, second string, n long").groupBy("first", "second").agg(F.sum("n").alias("n"))


def ranked_candidates(bad: DataFrame, nearest: DataFrame, pairs: DataFrame) -> DataFrame:
    """(page_id, line_no, type, word): for each misread word the candidate that stands most often
    between the same neighbours; then the most frequent one."""
    keys = ["page_id", "line_no", "type", "before", "after"]
    c = bad.select(*keys).distinct().join(nearest.select("type", "word", F.col("n").alias("word_n")), "type")
    left = pairs.select(F.col("first").alias("before"), F.col("second").alias("word"), F.col("n").alias("left_n"))
    right = pairs.select(F.col("first").alias("word"), F.col("second").alias("after"), F.col("n").alias("right_n"))
    c = c.join(left, ["before", "word"], "left").join(right, ["word", "after"], "left")
    fit = F.coalesce("left_n", F.lit(0)) + F.coalesce("right_n", F.lit(0))
    return c.groupBy("page_id", "line_no", "type").agg(F.max_by("word", F.struct(fit, F.col("word_n"), F.col("word"))).alias("word"))


def _corrected(token: str, words: dict[str, str]) -> str:
    word = words.get(word_type(token))
    if word is None:
        return token
    core = token.strip(OUTER)
    if core[:1].isupper():
        word = word[:1].upper() + word[1:]
    return token.replace(core, word, 1)


def goes_on(last: str | None, first: str | None) -> bool:
    """Whether a word that ends a page goes on with the first one of the next."""
    if not last or not first or last[-1] not in BREAK_MARKS or len(last) < 2 or not any(c.isalpha() for c in last):
        return False
    return first[0].isalpha() or first[0] in "@0123456789" and len(first) > 1


def reflowed(text: str, running: set[int], joins: set[int], words: dict[tuple[int, str], str], ahead: str | None = None, begun: bool = False) -> list[str]:
    """Paragraphs of a page: running lines dropped, broken words joined, misread ones replaced.
    ``ahead`` is the rest of the last word, from the next page; ``begun``: the first word is the
    rest of one that stands on the page before, and is left out here."""
    out: list[list[str]] = [[]]
    glue = False
    rows = text.split("\n")
    if ahead is not None:  # a line of its own, as the rest of any broken word
        at = max((i for i, x in enumerate(rows) if x.strip() and i + 1 not in running), default=-1)
        rows[at + 1 :] = [ahead]
    for no, line in enumerate(rows, 1):
        if no in running and not (ahead is not None and no == len(rows)):
            continue
        tokens = line.split()
        if begun and tokens:
            tokens, begun = tokens[1:], False
        if not tokens:
            if not glue and out[-1]:
                out.append([])
            continue
        near = {t: w for (n, t), w in words.items() if n in (no - 1, no)}
        if glue and out[-1]:
            tokens[0] = out[-1].pop() + tokens[0]
        glue = tokens[-1][-1] in BREAK_MARKS and len(tokens[-1]) > 1
        if glue and no in joins:
            tokens[-1] = tokens[-1][:-1]
        out[-1] += [t if glue and k == len(tokens) - 1 else _corrected(t, near) for k, t in enumerate(tokens)]
    return [" ".join(p) for p in out if p]


def repaired(pages: DataFrame) -> DataFrame:
    """(page_id, paragraph_no, text) of every scanned page, in continuous paragraphs. A word that
    goes on on the next page stands whole on the page where it begins, and not on the next; where
    a page number occurs twice in the version, both parts stay where they are."""
    job = ScanRepair(pages)
    rows = checkpointed(job.rows())
    nearest = job.candidates(rows)
    words = ranked_candidates(job.misread(rows, nearest), nearest, neighbours(job.pages))
    notes = (
        rows.where("kind = 'running'").select("page_id", "line_no", "kind", F.lit("").alias("type"), F.lit("").alias("word"))
        .unionByName(job.breaks(rows).select("page_id", "line_no", F.lit("join").alias("kind"), F.lit("").alias("type"), F.lit("").alias("word")))
        .unionByName(words.select("page_id", "line_no", F.lit("word").alias("kind"), "type", "word"))
    )
    per = notes.groupBy("page_id").agg(F.collect_list(F.struct("line_no", "kind", "type", "word")).alias("notes"))  # bounded by a page
    lone = (F.col("own_n") == 1) & (F.col("next_n") == 1), (F.col("own_n") == 1) & (F.col("previous_n") == 1)
    context = job._context().select("page_id", "own_first", "own_last", F.when(lone[0], F.col("next_word")).alias("next_word"), F.when(lone[1], F.col("previous_word")).alias("previous_word"))
    scanned = context.join(job.narrow.groupBy("page_id").agg(F.min("text").alias("text")), "page_id").join(per, "page_id", "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = []
            for page, text, notes, first, last, after, before in zip(*(pdf[c] for c in ("page_id", "text", "notes", "own_first", "own_last", "next_word", "previous_word"))):
                notes = list(notes) if notes is not None else []
                lines = lambda kind: {n["line_no"] for n in notes if n["kind"] == kind}
                fixes = {(n["line_no"], n["type"]): n["word"] for n in notes if n["kind"] == "word"}
                rest = after if goes_on(last, after) else None
                found += [(page, k, p) for k, p in enumerate(reflowed(text, lines("running"), lines("join"), fixes, rest, goes_on(before, first)))]
            yield pd.DataFrame(found, columns=["page_id", "paragraph_no", "text"])

    return scanned.mapInPandas(run, "page_id string, paragraph_no int, text string")


def p5_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scanned pages as continuous paragraphs."""
    return repaired(table(spark, sf_dir, "pages"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ScanRepair(table(spark, sf_dir, "pages")).found()
