"""Languages of documents and of their segments (problem 6).

Script ranges narrow the candidates of each word: most scripts leave one language, Latin leaves
several. Words of a shared script are scored by a classifier fitted on the labelled samples
(word counts where the word was seen, character n-grams where not). Viterbi over the words then
labels spans; switching costs little at a sentence boundary and much within a sentence, so
borrowed words, names and codes do not part a sentence.

A language counts for a record if it has a whole sentence (or list item), or the greater part of
the letters. Table lines, headings and unfinished lines between others (running lines) are no
sentences.

The samples are the only labelled rows used: at most MAX_SAMPLES of them, their bound; all else
is per text. Results: texts that are null, blank or without letters have no segments; texts of
any length are labelled whole; re-delivered rows count once, rows without an id not at all. Words of a script that no sample
has get language 'und'.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quern.llm.common import checkpointed, first_delivery, table
from quern.llm.sentences import plain, token_script

#: Bound of the labelled rows collected to fit the classifier.
MAX_SAMPLES = 20_000
#: Cost of a switch within a sentence and at its end; score of a word outside its script; the
#: most that one word can say.
WITHIN, BETWEEN, FOREIGN, CLIP = 8.0, 1.5, 5.0, 3.0
#: Words, or letters where words are not spaced, that a sentence has at least.
MIN_WORDS, MIN_UNSPACED = 3, 4
#: Letters of a unit in a script without marks at sentence ends.
MIN_UNMARKED = 22
UNSPACED = {"Han", "Thai"}
UNMARKED = {"Thai"}

#: Tokens end at white space and after the marks that always end a sentence; line ends are tokens.
TOKEN = re.compile(r"[^\s!?।॥。！？]+[!?।॥。！？]*[\"'”’)\]」』]*|[!?।॥。！？]+[\"'”’)\]」』]*|[\n\r\f\u2028\u2029]+")
#: A period with a letter after it, where white space is missing: the sentence may end there.
GLUED = re.compile(r"(?<=\.)(?=[^\W\d_a-z])")
ENDING = re.compile(r"(?:[!?।॥。！？…]|\.{1,2}|\.{4,})[\"'”’)\]」』]*$")
LETTERS = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
#: Table lines, marked and numbered headings.
FURNITURE = re.compile(r"^[ \t]*(?:\|.*|#{1,6}[ \t].*|\d{1,3}(?:\.\d{1,3})+\.?[ \t]+[^\W\d][^.!?।॥。！？\n]{0,70})$", re.M)
#: Letters before a period below which it is taken for an abbreviation's.
SHORT_LATIN, SHORT_OTHER = 4, 3

# Notations of the six languages.
CODES = {
    "en": "eng", "eng": "eng", "english": "eng", "ta": "tam", "tam": "tam", "tamil": "tam", "hi": "hin", "hin": "hin", "hindi": "hin",
    "zh": "zho", "zho": "zho", "chi": "zho", "chinese": "zho", "th": "tha", "tha": "tha", "thai": "tha", "tanglish": "tanglish",
}
MISSING = ("", "unknown", "und", "none", "null")


def label_language(label: Column) -> Column:
    """The language that a label names: null if it names none, else a code or the label itself."""
    low = F.lower(F.trim(F.regexp_replace(label, r"[\s\p{Z}]+", " ")))
    first = F.split(low, "[-_]")[0]
    known = F.create_map(*[F.lit(x) for kv in CODES.items() for x in kv])
    return F.when(label.isNull() | low.isin(*MISSING), None).when(low.rlike("^(ta|tam|tamil)[-_]latn"), "tanglish").otherwise(F.coalesce(known[first], first))


class Classifier:
    """Scores of words among the languages of one script."""

    def __init__(self, samples: list[tuple[str, str]]):
        self.of_script: dict[str, list[str]] = defaultdict(list)
        by_script: dict[str, Counter] = defaultdict(Counter)
        tokens: dict[str, list[tuple[str, str]]] = defaultdict(list)
        for text, lang in samples:
            for w in (text or "").split():
                word = plain(w)
                if s := token_script(word):
                    by_script[s][lang] += 1
                    if core := self.key(word):
                        tokens[s].append((core, lang))
        for s, langs in by_script.items():
            most = max(langs.values())
            # A language owns a script with a tenth of the words of its main user; others quote it.
            self.of_script[s] = sorted(x for x, n in langs.items() if n >= most / 10)
        self.languages = sorted({x for v in self.of_script.values() for x in v})
        self.words: dict[str, dict[str, list[float]]] = {}
        self.grams: dict[str, dict[str, np.ndarray]] = {}
        self._memo: dict[str, dict[str, float]] = {}
        for s, langs in self.of_script.items():
            if len(langs) > 1:
                self._fit(s, langs, [t for t in tokens[s] if t[1] in langs])

    @staticmethod
    def key(word: str) -> str:
        m = LETTERS.search(word)
        return m.group().casefold() if m else ""

    @staticmethod
    def _grams(word: str) -> list[str]:
        w = f"<{word}>"
        return [w[i : i + n] for n in (2, 3, 4) for i in range(len(w) - n + 1)]

    def _fit(self, s: str, langs: list[str], tokens: list[tuple[str, str]]) -> None:
        at = {x: i for i, x in enumerate(langs)}
        words, grams = defaultdict(lambda: np.zeros(len(langs))), defaultdict(lambda: np.zeros(len(langs)))
        for w, x in tokens:
            words[w][at[x]] += 1
        for w, counts in words.items():  # types, not tokens: frequent words shall not fill the n-grams
            for g in self._grams(w):
                grams[g] += counts > 0
        totals, kinds = sum(words.values()), sum(grams.values())
        self.words[s] = {w: np.log((c + 0.25) / totals).tolist() for w, c in words.items()}
        self.grams[s] = {g: np.log((c + 0.5) / kinds) for g, c in grams.items()}

    def scores(self, raw: str) -> tuple[str, dict[str, float] | None]:
        """(script, score by language) of a token; None if it says nothing."""
        word = plain(raw)
        s = token_script(word)
        if not s or s == "Latin" and any(c.isdigit() for c in word):  # codes and dates
            return s, None
        if (known := self._memo.get(word)) is not None:
            return s, known
        langs = self.of_script.get(s)
        if not langs:
            out = {"und": 0.0}
        elif len(langs) == 1:
            out = {langs[0]: 0.0}
        else:
            core = self.key(word)
            v = self.words[s].get(core)
            if v is None:
                hits = [g for x in self._grams(core) if (g := self.grams[s].get(x)) is not None]
                v = (np.mean(hits, axis=0) * min(4, len(hits)) if hits else np.zeros(len(langs))).tolist()
            top = max(v)
            out = {x: max(y - top, -CLIP) for x, y in zip(langs, v)}
        if len(self._memo) > 300_000:
            self._memo.clear()
        self._memo[word] = out
        return s, out


ENDS, LINE, ITEM, UNMARKED_SCRIPT, SHORT_END = 1, 2, 4, 8, 16


class Tagger:
    """Labels batches of texts. Distinct tokens are analysed once per worker; the rest is
    table look-ups and numpy over the tokens of a whole batch."""

    MEMO_LIMIT = 400_000

    def __init__(self, model: Classifier):
        self.model = model
        self.states = [*model.languages, "und"]
        self._reset()

    def _reset(self) -> None:
        self.memo: dict[str, tuple[tuple[int, int], ...]] = {}
        self.kinds: dict[tuple, int] = {}
        self.emit, self.letters, self.flags, self.script = [], [], [], []
        self.scripts = {"": 0}
        self._frozen = None

    def _kind(self, piece: str, last: bool) -> int:
        """Index of what a piece of a token means; pieces that mean the same share it."""
        if not piece.strip():
            row, letters, flags, script = None, 0, LINE, ""
        else:
            script, row = self.model.scores(piece)
            letters = sum(1 for c in piece if unicodedata.category(c)[0] in "LM") if row is not None else 0
            flags = ITEM if re.fullmatch(r"[-‐‑*•‣◦–·]|\(?\d{1,3}[.)]", piece) else 0
            if m := ENDING.search(piece):
                stem = unicodedata.normalize("NFD", piece[: m.start()].rpartition(".")[2])
                size = sum(1 for c in stem if unicodedata.category(c)[0] == "L")
                lone = m.group()[0] == "." and m.group()[1:2] != "."
                if not (lone and 0 < size < (SHORT_LATIN if script == "Latin" else SHORT_OTHER)) and not (flags & ITEM):
                    flags |= ENDS
                elif script in UNMARKED:
                    flags |= SHORT_END
            if script in UNMARKED:
                flags |= UNMARKED_SCRIPT
        values = tuple(-FOREIGN if row is None or x not in row else row[x] for x in self.states) if row is not None else (0.0,) * len(self.states)
        if row is None:
            script = ""
        key = (values, letters, flags, script)
        if (known := self.kinds.get(key)) is None:
            known = self.kinds[key] = len(self.emit)
            self.emit.append(values)
            self.letters.append(letters)
            self.flags.append(flags)
            self.script.append(self.scripts.setdefault(script, len(self.scripts)))
            self._frozen = None
        return known

    def _look(self, token: str) -> tuple[tuple[int, int], ...]:
        """(kind, length) of each piece of a token not met before."""
        pieces = [p for p in GLUED.split(token) if p] if "." in token[:-1] else [token]
        out = tuple((self._kind(p, k + 1 == len(pieces)), len(p)) for k, p in enumerate(pieces))
        self.memo[token] = out
        return out

    def units(self, texts: list[str | None], offsets: bool = False) -> dict[str, np.ndarray]:
        """Arrays over the units of all texts: text, language, letters, whole, confidence, and
        start and end if ``offsets``."""
        if len(self.memo) > self.MEMO_LIMIT:
            self._reset()
        memo, look = self.memo, self._look
        ids: list[int] = []
        sizes, starts, ends = [], [], []
        for text in texts:
            before = len(ids)
            if text:
                body = FURNITURE.sub(lambda m: " " * len(m.group()), text) if "|" in text or "#" in text or text.find(".") >= 0 else text
                if offsets:
                    for m in TOKEN.finditer(body):
                        at = m.start()
                        for kind, size in memo.get(m.group()) or look(m.group()):
                            ids.append(kind)
                            starts.append(at)
                            at += size
                            ends.append(at)
                else:
                    for token in TOKEN.findall(body):
                        for kind, _ in memo.get(token) or look(token):
                            ids.append(kind)
            sizes.append(len(ids) - before)
        return self._tag(np.asarray(ids, np.int64), np.asarray(sizes), starts, ends)

    def _tag(self, ids: np.ndarray, sizes: np.ndarray, starts: list[int], ends: list[int]) -> dict[str, np.ndarray]:
        if self._frozen is None:
            self._frozen = (np.array(self.emit or [(0.0,) * len(self.states)]), np.array(self.letters or [0]), np.array(self.flags or [0]), np.array(self.script or [0]))
        emit_t, letters_t, flags_t, script_t = self._frozen
        text_of = np.repeat(np.arange(len(sizes)), sizes)
        n = len(ids)
        none = {k: np.zeros(0, t) for k, t in (("text", np.int64), ("language", np.int64), ("letters", np.int64), ("whole", bool), ("confidence", float), ("start", np.int64), ("end", np.int64))}
        if not n:
            return none
        emit, letters, flags, script = emit_t[ids], letters_t[ids], flags_t[ids], script_t[ids]
        # Atoms: stretches within which a switch is dear. They end at sentence ends, line ends
        # and, in scripts without marks, at a change of script.
        known = np.where(script > 0, np.arange(n), -1)
        last_known = np.maximum.accumulate(known)
        previous = np.concatenate([[0], script[np.maximum(last_known, 0)][:-1]])
        thai = (flags & UNMARKED_SCRIPT) > 0
        previous_thai = np.concatenate([[False], thai[np.maximum(last_known, 0)][:-1]])
        change = (script > 0) & (previous > 0) & (script != previous) & (thai | previous_thai)
        new_text = np.concatenate([[True], text_of[1:] != text_of[:-1]])
        after_end = np.concatenate([[True], (flags[:-1] & (ENDS | LINE)) > 0])
        first = np.flatnonzero(new_text | after_end | change)
        atom = np.cumsum(new_text | after_end | change) - 1
        scores = np.add.reduceat(emit, first, axis=0)
        best = emit.max(axis=1)
        loss = np.add.reduceat(best, first) - scores.max(axis=1)
        atom_text = text_of[first]
        label = scores.argmax(axis=1)
        weight = np.add.reduceat(letters, first)
        token_label = None
        # Texts whose atoms with letters agree are settled; the others go through Viterbi.
        low = np.full(len(sizes), 1 << 30)
        high = np.full(len(sizes), -1)
        has = weight > 0
        np.minimum.at(low, atom_text[has], label[has])
        np.maximum.at(high, atom_text[has], label[has])
        agreed = low == high
        deep = np.zeros(len(sizes), bool)
        deep[atom_text[loss > WITHIN - BETWEEN]] = True
        settled = agreed[atom_text] & ~deep[atom_text]
        label = np.where(settled, np.where(high[atom_text] >= 0, high[atom_text], label), label)
        spans = np.searchsorted(atom_text, np.arange(len(sizes) + 1))
        for t in np.flatnonzero(~agreed & (high >= 0) | deep):
            a, b = spans[t], spans[t + 1]
            if deep[t]:
                i, j = first[a], first[b] if b < len(first) else n
                cost = np.where((flags[i : j - 1] & (ENDS | LINE)) > 0, BETWEEN, WITHIN)
                path = _viterbi(emit[i:j], cost)
                if token_label is None:
                    token_label = label[atom]
                token_label[i:j] = path
            else:
                label[a:b] = _viterbi(scores[a:b], np.full(b - a - 1, BETWEEN))
                if token_label is not None:
                    token_label[first[a] : first[b] if b < len(first) else n] = np.repeat(label[a:b], np.diff(np.append(first[a:b], first[b] if b < len(first) else n)))
        if token_label is None:
            token_label = label[atom]
        # Units: sentences, list items, unfinished lines that differ from what follows.
        item_line = ((flags & ITEM) > 0) & (new_text | np.concatenate([[True], (flags[:-1] & LINE) > 0]))
        differs = np.concatenate([[True], token_label[1:] != token_label[:-1]])
        soft = np.concatenate([[True], ((flags[:-1] & LINE) > 0)]) | change
        ended = np.concatenate([[True], (flags[:-1] & ENDS) > 0])
        breaks = new_text | ended | item_line | differs & soft
        u = np.flatnonzero(breaks)
        unit_letters = np.add.reduceat(letters, u)
        words = np.add.reduceat((letters > 0).astype(np.int64), u)
        tail = np.append(u[1:], n) - 1
        # A unit's language is that of most of its letters.
        per = np.zeros((len(u), len(self.states)))
        np.add.at(per, (np.cumsum(breaks) - 1, token_label), letters)
        lang = per.argmax(axis=1)
        unspaced = np.isin(script, [v for k, v in self.scripts.items() if k in UNSPACED])
        is_unspaced = np.add.reduceat(unspaced.astype(np.int64), u) > 0
        is_unmarked = np.add.reduceat(thai.astype(np.int64), u) > 0
        closed = ((flags[tail] & ENDS) > 0) | item_line[u]
        enough = np.where(is_unspaced, unit_letters >= MIN_UNSPACED, words >= MIN_WORDS)
        # Without marks, an abbreviation that ends a unit closes it, if the unit began a sentence.
        solid = np.where((flags & LINE) > 0, -1, np.arange(n))
        last = np.maximum(np.maximum.accumulate(solid)[tail], u)
        begins = new_text | ended | np.concatenate([[True], (flags[:-1] & LINE) > 0])
        closed |= ((flags[last] & SHORT_END) > 0) & begins[u]
        whole = enough & closed | is_unmarked & (unit_letters >= MIN_UNMARKED)
        sums = np.add.reduceat(emit, u, axis=0)
        own = sums[np.arange(len(u)), lang]
        rest = sums.copy()
        rest[np.arange(len(u)), lang] = -np.inf
        gap = (own - rest.max(axis=1)) / np.sqrt(np.maximum(words, 1))
        keep = unit_letters > 0
        out = {"text": text_of[u], "language": lang, "letters": unit_letters, "whole": whole, "confidence": 1 / (1 + np.exp(-np.clip(gap, -30, 30)))}
        if starts:
            out["start"] = np.asarray(starts)[u]
            out["end"] = np.asarray(ends)[last]
        return {k: v[keep] for k, v in out.items()}


def _viterbi(scores: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """Best path; ``cost`` of a switch between neighbours."""
    steps, n = scores.shape
    at = np.arange(n)
    best, back = scores[0].copy(), np.zeros((steps, n), np.int64)
    for k in range(1, steps):
        top = int(best.argmax())
        stay = best >= best[top] - cost[k - 1]
        back[k] = np.where(stay, at, top)
        best = np.where(stay, best, best[top] - cost[k - 1]) + scores[k]
    path = np.zeros(steps, np.int64)
    path[-1] = best.argmax()
    for k in range(steps - 1, 0, -1):
        path[k - 1] = back[k, path[k]]
    return path


def _summaries(texts: DataFrame, keys: list[str], column: str, samples: list[tuple[str, str]]) -> DataFrame:
    """(keys, language, whole, letters, sure): per text and language its whole sentences, its
    letters and the letters weighted by confidence."""
    shared = texts.sparkSession.sparkContext.broadcast(samples)
    kinds = dict(texts.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(Classifier(shared.value))
        states = pa.array(tagger.states)
        width = len(tagger.states)
        for batch in batches:
            if not batch.num_rows:
                continue
            u = tagger.units(batch.column(len(keys)).to_pylist())
            cell = u["text"] * width + u["language"]
            size = batch.num_rows * width
            whole, letters, sure = (np.bincount(cell, weights=w, minlength=size) for w in (u["whole"], u["letters"], u["letters"] * u["confidence"]))
            at = np.flatnonzero(letters)
            rows = pa.array(at // width)
            columns = [batch.column(k).take(rows) for k in range(len(keys))]
            yield pa.RecordBatch.from_arrays([*columns, states.take(pa.array(at % width)), pa.array(whole[at].astype(np.int64)), pa.array(letters[at].astype(np.int64)), pa.array(sure[at])], [*keys, "language", "whole", "letters", "sure"])

    return texts.select(*keys, column).mapInArrow(run, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", language string, whole long, letters long, sure double")


def language_segments(texts: DataFrame, key: str, column: str, samples: list[tuple[str, str]]) -> DataFrame:
    """(key, seg_start, seg_end, language, confidence): sentences and other units by offset."""
    shared = texts.sparkSession.sparkContext.broadcast(samples)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(Classifier(shared.value))
        states = pa.array(tagger.states)
        for batch in batches:
            if batch.num_rows:
                u = tagger.units(batch.column(1).to_pylist(), offsets=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(u["text"])), pa.array(u["start"].astype(np.int32)), pa.array(u["end"].astype(np.int32)), states.take(pa.array(u["language"])), pa.array(u["confidence"])], [key, "seg_start", "seg_end", "language", "confidence"])

    return texts.select(key, column).mapInArrow(run, f"`{key}` {dict(texts.dtypes)[key]}, seg_start int, seg_end int, language string, confidence double")


def counted(rows: DataFrame) -> DataFrame:
    """(record_kind, record_id, label, language, confidence) of the languages that count."""
    keys = ["record_kind", "record_id"]
    groups = rows.groupBy(*keys).agg(F.max("label").alias("label"), F.sum("letters").alias("all_letters"), F.collect_list(F.struct("language", "whole", "letters", "sure")).alias("of"))  # a row a language
    found = groups.select(*keys, "label", "all_letters", F.inline("of")).where("whole > 0 or letters * 2 > all_letters")
    return found.select(*keys, "label", "language", F.round(F.col("sure") / F.col("letters"), 6).alias("confidence"))


def fit_rows(samples: DataFrame) -> list[tuple[str, str]]:
    rows = samples.where("text is not null and lang is not null").select("text", "lang", F.xxhash64("text").alias("h")).orderBy("h", "text", "lang").limit(MAX_SAMPLES).collect()
    return [(r.text, r.lang) for r in rows]


def record_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(record_kind, record_id, label, language, confidence) of every chunk, page and version."""
    samples = fit_rows(table(spark, sf_dir, "language_samples"))
    versions = first_delivery(table(spark, sf_dir, "document_versions"), ["version_id"], ["language"])
    none = F.lit(None).cast("string")
    texts = table(spark, sf_dir, "chunks").select(F.lit("chunk").alias("record_kind"), F.col("chunk_id").alias("record_id"), none.alias("version_id"), F.col("language").alias("label"), F.col("content").alias("text")).unionByName(
        table(spark, sf_dir, "pages").select(F.lit("page").alias("record_kind"), F.col("page_id").alias("record_id"), "version_id", F.col("language").alias("label"), "text")
    )
    done = _summaries(texts.where("text is not null and record_id is not null"), ["record_kind", "record_id", "version_id", "label"], "text", samples)
    # Re-delivered rows were tagged alike; they are dropped here, where rows are small.
    rows = checkpointed(done.groupBy("record_kind", "record_id", "language").agg(*[F.max(c).alias(c) for c in ("version_id", "label", "whole", "letters", "sure")]))
    of_versions = rows.where("record_kind = 'page'").groupBy("version_id", "language").agg(*[F.sum(c).alias(c) for c in ("whole", "letters", "sure")])
    of_versions = of_versions.join(versions.withColumnRenamed("language", "label"), "version_id").select(F.lit("version").alias("record_kind"), F.col("version_id").alias("record_id"), "label", "language", "whole", "letters", "sure")
    return counted(rows.drop("version_id").unionByName(of_versions))


def p6_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record with its languages and their confidence."""
    return record_languages(spark, sf_dir).select("record_kind", "record_id", "language", "confidence")


def record_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(record_kind, record_id, page_id, seg_start, seg_end, language, confidence) of every chunk,
    page and version; the segments of a version are those of its pages. page_id is null for
    chunks; offsets are those of the chunk's content or the page's text."""
    samples = fit_rows(table(spark, sf_dir, "language_samples"))
    chunks = first_delivery(table(spark, sf_dir, "chunks"), ["chunk_id"], ["content"]).where("content is not null")
    pages = table(spark, sf_dir, "pages")
    versions = table(spark, sf_dir, "document_versions").select("version_id").distinct()
    of_version = first_delivery(pages, ["page_id"], ["version_id"]).join(versions, "version_id")
    pages = first_delivery(pages, ["page_id"], ["text"]).where("text is not null").join(of_version, "page_id", "left")
    none = F.lit(None).cast("string")
    texts = chunks.select(F.struct("chunk_id", none.alias("page_id"), none.alias("version_id")).alias("of"), F.col("content").alias("text")).unionByName(
        pages.select(F.struct(none.alias("chunk_id"), "page_id", "version_id").alias("of"), "text")
    )
    records = F.array(*[F.struct(F.lit(k).alias("record_kind"), F.col(f"of.{k}_id").alias("record_id")) for k in ("chunk", "page", "version")])
    found = language_segments(texts, "of", "text", samples)
    rest = [F.col("of.page_id").alias("page_id"), "seg_start", "seg_end", "language", "confidence"]
    return found.select(F.inline(F.filter(records, lambda r: r["record_id"].isNotNull())), *rest)


def p6_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language segments of every chunk, page and version, as offsets into the content or text."""
    return record_segments(spark, sf_dir)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = record_languages(spark, sf_dir).withColumn("named", label_language(F.col("label")))
    cases = found.groupBy("record_kind", "record_id").agg(
        F.collect_set("language").alias("languages"), F.max(~F.coalesce(F.col("named") == F.col("language"), F.lit(False))).alias("differs")
    )
    return cases.where((F.size("languages") > 1) | F.col("differs")).select("record_kind", "record_id", F.explode("languages").alias("language"))
