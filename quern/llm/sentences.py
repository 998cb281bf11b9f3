"""Sentence units across languages and scripts (problem 2).

A model is learned from the whole corpus without labels, in the manner of Punkt, by
log-likelihood ratios over counts gathered in one pass:

* sentence starters: words that stand after sure boundaries (! ? danda, paragraph starts) more
  often than chance;
* abbreviations: types that keep their period and are followed by digits or words that do not
  start sentences more often than periods are in general;
* collocations: pairs (abbreviation, next word) bound to each other more than chance, which
  are never parted;
* heading lines: lines without a closing mark that stand alone somewhere in the corpus.

Statistics are kept per language. As labels cannot be trusted, the language of a paragraph is
told by its script, and where languages share one, by the word scores of the classifier that
``quern.llm.language`` fits on the labelled samples. What a whole script has in common (written
abbreviations above all) is kept beside it, for languages with little text. Each period is then
classified with these statistics; scripts without periods have their own marks, Thai its spaces.
Headings, list items and table lines are units by layout.

Results: null and blank texts give no units. Units are exact slices, in order, without overlap;
only white space lies between them. Texts may be of any length (one linear scan). Re-delivered
chunks count once, for the statistics too; rows without an id are left out.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quern.llm.canonical import LOOKALIKES
from quern.llm.common import checkpointed, first_delivery, table

#: Log-likelihood ratio that a statistic must reach (chi-square, one degree, p = 0.005).
SIGNIFICANT = 7.88
#: Share of an abbreviation's periods that must lead on within the sentence.
LEADS_ON, KEEPS_PERIOD = 0.5, 0.1
#: Models of up to so many entries are broadcast; larger ones are joined to each text.
BROADCAST_ENTRIES = 500_000

HARD, SOFT = "!?।॥。！？", ".…"
CLOSERS, OPENERS = "\"'”’)]}»」』", "\"'“‘([{«「『"
INVISIBLE = re.compile("[­͏​-‏⁠-⁤﻿]")
PARAGRAPH = re.compile(r"(?:\r\n|\n|\r)(?:[^\S\n\r]*(?:\r\n|\n|\r))+|[\f ]\s*")
LINE = re.compile(r"\r\n|[\n\r ]")
LIST_MARK = re.compile(r"(?:[-‐‑*•‣◦–·]|\(?\d{1,3}[.)]|\(?[a-z][)])\s+\S")
HEADING_MARK = re.compile(r"#{1,6}\s+\S|\d{1,3}(?:\.\d{1,3})+\.?\s+[^\W\d]")
ENDS = re.compile(r"[.!?।॥。！？…][\"'”’)\]}»」』]*$")
TOKEN = re.compile(r"\S+")
RUN = re.compile(r"[.!?।॥。！？…]+")
WEB = re.compile(r"^(?:https?://|www\.)|@", re.I)
THAI = re.compile("[฀-๿]")
QUOTE = re.compile("[\"“”「」『』«»]")
UNSEEN = frozenset(c for c in map(chr, range(0x10000)) if INVISIBLE.match(c))
HARD_SET = frozenset(HARD)
LONGEST_HEADING = 60
_LIKE = {ord(a): b for a, b in LOOKALIKES.items()}


@functools.lru_cache(1 << 17)
def plain(token: str) -> str:
    """The form under which a token is counted: odd characters folded."""
    if token.isascii():
        return token
    return unicodedata.normalize("NFKC", INVISIBLE.sub("", token).translate(_LIKE)).translate(_LIKE)


def script(ch: str) -> str:
    """Latin, Tamil, Deva, Thai, Han and so on, by block; "" for what is no letter."""
    code = ord(ch)
    if code < 0x80:
        return "Latin" if ch.isalpha() else ""
    if not (ch.isalpha() or unicodedata.category(ch)[0] == "M"):
        return ""
    for name, low, high in (("Deva", 0x900, 0x97F), ("Tamil", 0xB80, 0xBFF), ("Thai", 0xE00, 0xE7F), ("Latin", 0x80, 0x24F), ("Han", 0x2E80, 0x9FFF), ("Han", 0x20000, 0x3FFFF), ("Hang", 0xAC00, 0xD7FF)):
        if low <= code <= high:
            return name
    return f"B{code >> 7:x}"


@functools.lru_cache(1 << 17)
def token_script(token: str) -> str:
    return next((s for ch in token if (s := script(ch))), "")


def heading_key(line: str) -> str:
    return " ".join(re.sub(r"^(?:#{1,6}\s+|\d{1,3}(?:\.\d{1,3})*\.?\s+)", "", plain(line.strip())).split())


def blocks(text: str) -> list[tuple[int, int]]:
    """Paragraphs as (start, end), white space not yet cut."""
    out, at = [], 0
    for m in PARAGRAPH.finditer(text):
        out.append((at, m.start()))
        at = m.end()
    out.append((at, len(text)))
    return [(a, b) for a, b in out if text[a:b].strip()]


def lines(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """Lines of a paragraph, white space cut, blank ones left out."""
    out, at = [], start
    for m in [*LINE.finditer(text, start, end), None]:
        stop = m.start() if m else end
        part = text[at:stop]
        if body := part.strip():
            first = at + len(part) - len(part.lstrip())
            out.append((first, first + len(body)))
        at = m.end() if m else end
    return out


def _core(token: str) -> str:
    return token.strip(CLOSERS + OPENERS + ",;:")


@functools.lru_cache(1 << 17)
def _parts(raw: str) -> tuple[str, str, str, bool, bool]:
    """(core, word, script, a lone period ends it, it surely ends a sentence) of a token."""
    token = plain(raw)
    core = _core(token)
    word = core.rstrip(".…!?।॥")
    sure = token[-1:] in HARD or token.endswith("..")  # after a closing quote the sentence may go on
    return core, word, token_script(word), core.endswith(".") and not core.endswith(".."), sure


class Teller:
    """Tells the language of a paragraph for each script that several languages share."""

    def __init__(self, samples: list[tuple[str, str]]):
        from quern.llm.language import Classifier

        self._model = Classifier(samples)
        self.shared = {s for s, langs in self._model.of_script.items() if len(langs) > 1}
        self._row = functools.lru_cache(1 << 17)(self._scores)

    def _scores(self, token: str) -> tuple[tuple[tuple[str, str], float], ...] | None:
        """((script, language), score above the least) of a token of a shared script."""
        script, row = self._model.scores(token)
        if script not in self.shared or not row:
            return None
        return tuple(((script, language), x - min(row.values())) for language, x in row.items())

    def __call__(self, tokens: list[str]) -> dict[str, str]:
        sums: dict[tuple[str, str], float] = {}
        for row, n in Counter(map(self._row, tokens)).items():
            for key, x in row or ():
                sums[key] = sums.get(key, 0.0) + n * x
        best: dict[str, tuple[float, str]] = {}
        for (script, language), x in sorted(sums.items()):
            if script not in best or x > best[script][0]:
                best[script] = x, language
        return {script: language for script, (_, language) in best.items()}


# ---------------------------------------------------------------- statistics


def count_events(texts: Iterable[str | None], tell: Teller | None = None) -> Counter:
    """Counts of (kind, script or script/language, a, b): s = a starts a sentence, w = word a,
    p = a with period before b, n = a without period, h = heading line a seen alone. A digit
    after a period counts as #. Tokens are counted as they stand and looked at once each."""
    out: Counter = Counter()
    tokens_in: dict[tuple, Counter] = {}  # by the languages told: (token, it surely starts a sentence)
    for text in texts:
        for start, end in blocks(text or ""):
            rows = lines(text, start, end)
            first = text[rows[0][0] : rows[0][1]]
            if len(first) <= LONGEST_HEADING and not ENDS.search(first) and (len(rows) == 1 or HEADING_MARK.match(first)) and not LIST_MARK.match(first) and first[0] != "|":
                key = heading_key(first)
                out["h", token_script(key), key, ""] += 1
            tokens = [t for a, b in rows if text[a] != "|" for t in text[a:b].split()]
            if not tokens:
                continue
            told = tuple(tell(tokens).items()) if tell else ()
            parts = list(map(_parts, tokens))
            tokens_in.setdefault(told, Counter()).update(zip(tokens, [True, *[p[4] for p in parts[:-1]]]))
            for k, (_, word, kind, period, _) in enumerate(parts[:-1]):
                if period and kind and kind != "Han":
                    following = parts[k + 1][1]
                    of = next((f"{s}/{x}" for s, x in told if s == kind), kind)
                    out["p", of, word.lower(), "#" if following[:1].isdigit() else following] += 1
    for told, counts in tokens_in.items():
        of = {s: f"{s}/{x}" for s, x in told}
        for (token, sure), n in counts.items():
            core, word, kind, _, _ = _parts(token)
            if not kind or kind == "Han":
                continue
            kind = of.get(kind, kind)
            out["w", kind, word, ""] += n
            if sure:
                out["s", kind, word, ""] += n
            if not core.endswith("."):
                out["n", kind, word.lower(), ""] += n
    return out


def _llr(k1: Column, n1: Column, k2: Column, n2: Column) -> Column:
    """Dunning's ratio for two binomials."""

    def part(k: Column, n: Column, p: Column) -> Column:
        p = F.least(F.greatest(p, F.lit(1e-12)), F.lit(1 - 1e-12))
        return k * F.log(p) + (n - k) * F.log(1 - p)

    p = (k1 + k2) / (n1 + n2)
    return 2 * (part(k1, n1, k1 / n1) + part(k2, n2, k2 / n2) - part(k1, n1, p) - part(k2, n2, p))


def learn(texts: DataFrame, column: str, samples: list[tuple[str, str]] | None = None) -> DataFrame:
    """The model, as rows (kind, script or script/language, a, b): starter, abbreviation,
    collocation, heading. Counts are merged per batch before their shuffle; every text of the
    corpus is counted."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tell = Teller(samples) if samples else None
        for pdf in batches:
            counts = count_events(pdf[column], tell)
            yield pd.DataFrame([(*k, n) for k, n in counts.items()], columns=["kind", "script", "a", "b", "n"])

    events_of = texts.select(column).mapInPandas(run, "kind string, script string, a string, b string, n long")
    told = checkpointed(events_of.groupBy("kind", "script", "a", "b").agg(F.sum("n").alias("n")))  # read several times below
    of_scripts = told.withColumn("script", F.split("script", "/")[0]).groupBy("kind", "script", "a", "b").agg(F.sum("n").alias("n"))
    counts = checkpointed(of_scripts.unionByName(told.where("script like '%/%'")))
    words = counts.where("kind in ('w', 's')").groupBy("script", "a").agg(F.sum(F.when(F.col("kind") == "w", F.col("n"))).alias("n"), F.coalesce(F.sum(F.when(F.col("kind") == "s", F.col("n"))), F.lit(0)).alias("k"))
    sums = words.groupBy("script").agg(F.sum("n").alias("all_n"), F.sum("k").alias("all_k"))
    w = words.join(sums, "script")
    rest_n, rest_k = F.greatest(F.col("all_n") - F.col("n"), F.lit(1)), F.col("all_k") - F.col("k")
    starters = w.where((F.col("k") / F.col("n") > rest_k / rest_n) & (_llr(F.col("k"), F.col("n"), rest_k, rest_n) >= SIGNIFICANT)).select("script", "a")

    pairs = counts.where("kind = 'p'").select("script", F.col("a").alias("type"), F.col("b").alias("next"), "n")
    # A language knows the starters of its script too.
    languages = told.where("script like '%/%'").select(F.col("script").alias("language"), F.split("script", "/")[0].alias("script")).distinct()
    lent = starters.join(F.broadcast(languages), "script").select(F.col("language").alias("script"), "a")  # a few languages
    known = checkpointed(starters.unionByName(lent).distinct().select("script", F.col("a").alias("next"), F.lit(1).alias("starts")))
    leads = pairs.join(known, ["script", "next"], "left").withColumn("on", F.when(F.col("starts").isNull(), F.col("n")).otherwise(0))
    types = leads.groupBy("script", "type").agg(F.sum("n").alias("n"), F.sum("on").alias("k"))
    bare = counts.where("kind = 'n'").select("script", F.col("a").alias("type"), F.col("n").alias("bare"))
    # A language against its own types, a script against all scripts together: in some, only
    # abbreviations have periods at all.
    own, sums = F.when(F.col("script").contains("/"), F.col("script")).otherwise(""), (F.sum("n").alias("all_n"), F.sum("k").alias("all_k"))
    of_languages = types.where("script like '%/%'").groupBy(F.col("script").alias("own")).agg(*sums)
    all_types = of_languages.unionByName(types.where("script not like '%/%'").agg(*sums).select(F.lit("").alias("own"), "all_n", "all_k"))
    t = types.withColumn("own", own).join(F.broadcast(all_types), "own").drop("own").join(bare, ["script", "type"], "left").fillna(0, ["bare"])  # a row for each language
    rest_n, rest_k = F.greatest(F.col("all_n") - F.col("n"), F.lit(1)), F.col("all_k") - F.col("k")
    abbreviations = checkpointed(t.where(
        (F.col("k") / F.col("n") >= LEADS_ON) & (F.col("n") / (F.col("n") + F.col("bare")) >= KEEPS_PERIOD) & (F.col("k") / F.col("n") > rest_k / rest_n)
        & (_llr(F.col("k"), F.col("n"), rest_k, rest_n) >= SIGNIFICANT)
    ).select("script", F.col("type"), "n"))

    nexts = pairs.groupBy("script", "next").agg(F.sum("n").alias("next_n"))
    c = pairs.where("next <> '#'").join(abbreviations.withColumnRenamed("n", "type_n"), ["script", "type"]).join(nexts, ["script", "next"]).withColumn("own", own).join(F.broadcast(all_types.select("own", "all_n")), "own").drop("own")
    rest_k, rest_n = F.col("next_n") - F.col("n"), F.greatest(F.col("all_n") - F.col("type_n"), F.lit(1))
    collocations = c.where((F.col("n") > 1) & (F.col("n") / F.col("type_n") > rest_k / rest_n) & (_llr(F.col("n"), F.col("type_n"), rest_k, rest_n) >= SIGNIFICANT)).join(
        known, ["script", "next"], "left_anti"
    )
    empty = F.lit("").alias("b")
    return (
        starters.select(F.lit("s").alias("kind"), "script", "a", empty)
        .unionByName(abbreviations.select(F.lit("a").alias("kind"), "script", F.col("type").alias("a"), empty))
        .unionByName(collocations.select(F.lit("c").alias("kind"), "script", F.col("type").alias("a"), F.col("next").alias("b")))
        .unionByName(told.where("kind = 'h'").select(F.lit("h").alias("kind"), "script", "a", empty))
    )


class Model:
    def __init__(self, rows: list[tuple[str, str, str, str]]):
        self.starters = {(s, a) for k, s, a, _ in rows if k == "s"}
        self.abbreviations = {(s, a) for k, s, a, _ in rows if k == "a"}
        self.collocations = {(s, a, b) for k, s, a, b in rows if k == "c"}
        self.headings = {a for k, _, a, _ in rows if k == "h"}
        #: Scripts with entries by language.
        self.parted = {s.partition("/")[0] for k, s, _, _ in rows if k != "h" and "/" in s}


# ---------------------------------------------------------------- segmentation


def _quotes(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """Quoted passages (opening, closing offset) that close within the paragraph."""
    out, opened, plain_open = [], [], -1
    for m in QUOTE.finditer(text, start, end):
        at, ch = m.start(), m.group()
        if ch == '"':
            before = text[at - 1] if at > start else " "
            after = text[at + 1] if at + 1 < end else " "
            if plain_open < 0 and (before.isspace() or before in OPENERS or not after.isspace()):
                plain_open = at
            elif plain_open >= 0:
                out.append((plain_open, at))
                plain_open = -1
        elif ch in "“「『«":
            opened.append(at)
        elif opened:
            out.append((opened.pop(), at))
    return sorted(out)


def _token_before(text: str, at: int, start: int) -> str:
    """What stands of a token before an offset in it."""
    first = at
    while first > start and not text[first - 1].isspace():
        first -= 1
    return text[first:at]


@functools.lru_cache(1 << 14)
def _letter_count(piece: str) -> int:
    return sum(unicodedata.category(c)[0] == "L" for c in piece)


class Segmenter:
    def __init__(self, model: Model, tell: Teller | None = None):
        self.m, self.tell = model, tell

    def units(self, text: str | None) -> Iterator[tuple[int, int]]:
        for start, end in blocks(text or ""):
            rows = lines(text, start, end)
            self._rows, self._told = (text, rows), None
            yield from self._paragraph(text, rows)

    def _has(self, entries: set[tuple], script: str, *words: str) -> bool:
        """Whether the model has an entry for the script or for the paragraph's language in it."""
        if (script, *words) in entries:
            return True
        if self.tell is None or script not in self.m.parted:
            return False
        if self._told is None:
            text, rows = self._rows
            self._told = self.tell([t for a, b in rows if text[a] != "|" for t in text[a:b].split()])
        return (f"{script}/{self._told.get(script)}", *words) in entries

    def _layout(self, text: str, rows: list[tuple[int, int]], k: int, run_on: bool) -> bool:
        """Whether a line is a unit by layout: table line, list item or heading."""
        line = text[rows[k][0] : rows[k][1]]
        if line[0] == "|":
            return True
        if LIST_MARK.match(line) and not (run_on and line[0] not in "*•‣◦" and not LIST_MARK.match(text[rows[k - 1][0] : rows[k - 1][1]])):
            return True
        if run_on or len(line) > LONGEST_HEADING or ENDS.search(line):
            return line.startswith("#") and bool(HEADING_MARK.match(line))
        if HEADING_MARK.match(line):
            return True
        key = heading_key(line)
        return key in self.m.headings and not (token_script(key) == "Thai" and " " in key)

    def _paragraph(self, text: str, rows: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
        prose: list[tuple[int, int]] = []
        run_on = False
        for k, (a, b) in enumerate(rows):
            if self._layout(text, rows, k, run_on):
                if prose:
                    yield from self._prose(text, prose[0][0], prose[-1][1])
                    prose = []
                yield a, b
                run_on = False
            else:
                prose.append((a, b))
                line = text[a:b]
                run_on = not ENDS.search(line) and script(line[-1]) != "Thai"
        if prose:
            yield from self._prose(text, prose[0][0], prose[-1][1])

    def _prose(self, text: str, start: int, end: int) -> Iterator[tuple[int, int]]:
        quotes = _quotes(text, start, end)
        opens = [a for a, _ in quotes]
        begin = start
        for cut in self._cuts(text, start, end, quotes, opens):
            if cut <= begin:
                continue
            yield begin, cut
            begin = cut
            while begin < end and text[begin].isspace():
                begin += 1
            self._begin = begin
        if begin < end:
            yield begin, begin + len(text[begin:end].rstrip())

    def _cuts(self, text: str, start: int, end: int, quotes: list[tuple[int, int]], opens: list[int]) -> Iterator[int]:
        self._begin = start
        closing = {b: a for a, b in quotes} if quotes else {}
        marks = [(m.start(), m.end(), True) for m in RUN.finditer(text, start, end)]
        if THAI.search(text, start, end):
            marks += [(m.start(), m.end(), False) for m in re.finditer(r"\s+", text[start:end]) for m in [_Shift(m, start)]]
            marks.sort()
        for a, b, is_run in marks:
            if not is_run:
                if self._thai_space(text, a, b, start, end) and not self._inside(a, quotes, opens):
                    yield a
                continue
            stop = b
            closed = -1
            while stop < end and text[stop] in CLOSERS:
                if text[stop] in "\"”」』»":
                    opening = closing.get(stop)
                    if opening is None and text[stop] == '"':
                        break
                    closed = start if opening is None else opening
                elif text[stop] == "'" and stop + 1 < end and text[stop + 1].isalnum():
                    break
                stop += 1
            if self._inside(stop - 1 if closed < 0 else stop, quotes, opens):
                continue
            if stop < end and text[stop] in HARD + SOFT + ",;:、，；":
                continue
            if self._ends(text, a, b, stop, start, end, closed):
                yield stop

    @staticmethod
    def _inside(at: int, quotes: list[tuple[int, int]], opens: list[int]) -> bool:
        if not opens:
            return False
        k = bisect_right(opens, at) - 1
        return any(quotes[i][0] < at < quotes[i][1] for i in range(k, max(-1, k - 3), -1))

    def _thai_space(self, text: str, a: int, b: int, start: int, end: int) -> bool:
        before = text[a - 1] if a > start else ""
        after = text[b] if b < end else ""
        if before == "." and a - 2 >= start and script(text[a - 2]) == "Thai":
            return script(after) == "Thai" or after in OPENERS
        if not after or script(before) != "Thai":
            return False
        if after.isdigit() or unicodedata.category(after) == "Nd":
            return False
        follow = TOKEN.match(text, b, end).group()
        return script(after) == "Thai" or after in "“\"‘" or (bool(script(after)) and not any(c.isdigit() for c in follow))

    def _ends(self, text: str, a: int, b: int, stop: int, start: int, end: int, closed: int) -> bool:
        if stop >= end:
            return True
        spaced = text[stop].isspace()
        at = stop
        while at < end and (text[at].isspace() or text[at] in UNSEEN):
            at += 1
        if at >= end:
            return True
        run, after = text[a:b], text[at]
        following = TOKEN.match(text, at, end).group()
        if closed >= 0:
            led_in = text[max(start, closed - 1) : closed] if closed > start else ""
            led_in = (led_in if led_in.strip() else text[start:closed].rstrip())[-1:] in (",", ":", "，", "：")
            if after.islower():
                return led_in and self._has(self.m.starters, token_script(following), _parts(following)[1])
            return closed > self._begin or after.isupper()
        plain_mark = run[0].isascii() or after.isascii()  # between others a text without spaces may be long
        token = _token_before(text, a, start) if plain_mark or "…" in run else ""
        if not spaced and plain_mark and WEB.search(token + run + following):
            return False
        if not HARD_SET.isdisjoint(run):
            return spaced or not (after.isascii() and (after.islower() or not after.isalnum())) or after in OPENERS
        if "…" in run or len(run) > 2:
            attached = a > start and not text[a - 1].isspace()
            goes_on = after.islower() and not self._has(self.m.starters, token_script(following), _parts(following)[1])
            return attached and not goes_on and (after.isupper() or after in "“\"" or token_script(following) not in ("", token_script(token)) or after.islower())
        if len(run) == 2:
            return spaced or after.isalpha()
        return self._period(text, a, token, spaced, after, following)

    def _period(self, text: str, a: int, token: str, spaced: bool, after: str, following: str) -> bool:
        word = plain(token).lstrip(OPENERS)
        kind = token_script(word)
        lower = word.lower()
        piece = lower.rpartition(".")[2]
        following = _core(plain(following)).rstrip(".…!?।॥")
        letters = _letter_count(piece)
        short = letters <= 1 and not piece[:1].isdigit()
        known = ("." in lower and short) or self._has(self.m.abbreviations, kind, lower) or self._has(self.m.abbreviations, kind, piece)
        if not spaced:
            if word[-1:].isdigit() and after.isdigit():
                return False
            if after in OPENERS:
                return not known
            if not after.isalnum():
                return False
            if known or short or "/" in following and after.islower():
                return False
            if after.isascii():
                return not after.islower() and not (after.isupper() and letters <= 2)
            return bool(letters > 1 or word[-1:].isdigit())
        if len(piece) == 1 and word[-1:].isupper():  # an initial
            return self._has(self.m.starters, kind, following)
        if not known:
            return True
        if after.isdigit() or after.islower() or self._has(self.m.collocations, kind, lower, following):
            return False
        return token_script(following) not in ("", kind) or self._has(self.m.starters, token_script(following), following)


class _Shift:
    def __init__(self, m: re.Match, by: int):
        self._m, self._by = m, by

    def start(self) -> int:
        return self._m.start() + self._by

    def end(self) -> int:
        return self._m.end() + self._by


# ---------------------------------------------------------------- operator


@functools.lru_cache(1 << 14)
def _asked_for(token: str) -> frozenset[str]:
    """All words that the segmenter may look up for a token: what starts it or follows a mark,
    closing or odd character within it, and what stands before each mark, whole and from its
    last period on. The model has no words of Han or without letters."""
    out = set()
    marks = list(RUN.finditer(token))
    after = {0, *(m.end() for m in marks), *(i + 1 for i, c in enumerate(token) if c in CLOSERS or INVISIBLE.match(c))}
    for at in after:
        rest = token[at:]
        if next((s for c in rest if (s := script(c))), "Han") != "Han":
            out |= {_parts(rest)[1], _core(plain(rest)).rstrip(".…!?।॥")}
    for m in marks:
        lower = plain(token[: m.start()]).lstrip(OPENERS).lower()
        out |= {lower, lower.rpartition(".")[2]}
    return frozenset(w for w in out if token_script(w) not in ("", "Han"))


def _needed(texts: DataFrame, key: str, column: str, model: DataFrame) -> DataFrame:
    """(key, model) with the entries that a text can use, for models too large to broadcast."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = set()
            for k, text in zip(pdf[key], pdf[column]):
                for a, b in blocks(text or ""):
                    rows |= {(k, heading_key(text[s:e])) for s, e in lines(text, a, b) if e - s <= LONGEST_HEADING}
                    for t in TOKEN.findall(text[a:b]):
                        rows |= {(k, w) for w in _asked_for(t)}
            yield pd.DataFrame(sorted(rows), columns=[key, "a"])

    used = texts.mapInPandas(run, f"`{key}` string, a string").distinct().join(model, "a")
    return used.groupBy(key).agg(F.collect_list(F.struct("kind", "script", "a", "b")).alias("model"))


def sentence_units(texts: DataFrame, key: str, column: str, model: DataFrame, samples: list[tuple[str, str]] | None = None) -> DataFrame:
    """(key, sent_start, sent_end) of each unit of each text; ``samples`` as given to ``learn``."""
    texts = texts.select(key, column)
    schema = f"`{key}` string, sent_start int, sent_end int"
    head = model.limit(BROADCAST_ENTRIES + 1).collect()
    shared = None
    if len(head) <= BROADCAST_ENTRIES:
        shared = texts.sparkSession.sparkContext.broadcast([tuple(r) for r in head])
    else:
        texts = texts.join(_needed(texts, key, column, model), key, "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tell = Teller(samples) if samples else None
        one = Segmenter(Model(shared.value), tell) if shared else None
        for pdf in batches:
            own = [one] * len(pdf) if one else [Segmenter(Model([tuple(r.values()) if isinstance(r, dict) else tuple(r) for r in (m if m is not None else [])]), tell) for m in pdf["model"]]
            rows = [(k, s, e) for k, t, g in zip(pdf[key], pdf[column], own) for s, e in g.units(t)]
            yield pd.DataFrame(rows, columns=[key, "sent_start", "sent_end"])

    return texts.mapInPandas(run, schema)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.language import fit_rows

    samples = fit_rows(table(spark, sf_dir, "language_samples"))
    chunks = first_delivery(table(spark, sf_dir, "chunks"), ["chunk_id"], ["content"])
    return sentence_units(chunks, "chunk_id", "content", learn(chunks, "content", samples), samples)
