"""Extractive claims, their facts, entailment against evidence, and composed answers."""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from quern.functions.text import WORDS, features_of, normalize_for_match, strip, tokens_of, words
from quern.session import dealt_for_work

# Words that carry numbers, dates, polarity, conditions, or no content.
NUMBER_WORDS = {
    "zero": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11, "twelve": 12, "thirteen": 13, "fourteen": 14,
    "fifteen": 15, "sixteen": 16, "seventeen": 17, "eighteen": 18, "nineteen": 19, "twenty": 20, "thirty": 30, "forty": 40, "fifty": 50, "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90, "hundred": 100,
}
MONTHS = {m: i for i, m in enumerate("january february march april may june july august september october november december".split(), 1)}
MODIFIERS = "business calendar working full whole net".split()
NEGATIONS = "not no never without cannot cant wont dont doesnt didnt isnt arent wasnt werent neither nor none excluding".split()
CONDITIONS = "unless except if provided subject when whenever until only".split()
STOPWORDS = "a an the of to in on at by for and or is are was were be been being it its this that these those with as from will shall may must can within into per".split()
# Thresholds, weights and the text of a refusal.
MIN_OVERLAP, MAX_CLAIMS, MIN_CLAUSE_WORDS, SUPPORT, PARTIAL = 0.1, 3, 3, 0.9, 0.5
WEIGHTS = {"fused": 0.25, "rerank": 0.35, "overlap": 0.30, "ocr": 0.10}
CLAIM_FLOOR, ANSWER_CONFIDENCE, LOW_OCR = 0.3, 0.6, 0.5
EVIDENCE_FLOOR, MAX_EVIDENCE, MIN_EVIDENCE = 0.0, 6, 1
ABSTENTION = "I don't have enough evidence in this workspace to answer that. Try rephrasing, narrowing to a document, or uploading a source."

_RAW_WORD = re.compile(r"[^\W_]+")
_ISO = re.compile(r"\b\d{4}-\d{2}-\d{2}\b")
_SENTENCE = re.compile(r"[^.!?।॥\n]+[.!?।॥]?")
_NEAR = 3


# ---------------------------------------------------------------- evidence and claims


def sufficient_evidence(passages: DataFrame, floor: float = EVIDENCE_FLOOR, most: int = MAX_EVIDENCE) -> DataFrame:
    """The first ``most`` passages of each query whose fused score reaches the floor, by rank."""
    kept = passages.where(F.col("fused_score") >= floor)
    return kept.withColumn("_n", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "chunk_id"))).where(F.col("_n") <= most).drop("_n")


@functools.lru_cache(1 << 11)
def _sentences(text: str) -> tuple[tuple[int, str, frozenset[str]], ...]:
    """(start, sentence, features) of each sentence; a passage serves many queries."""
    return tuple((m.start(), m.group(), features_of(bare)) for m in _SENTENCE.finditer(text) if (bare := m.group().strip()))


def _best(query: str | None, text: str | None) -> tuple[int, str, float] | None:
    """(start, sentence, overlap) of the sentence that covers most of the query."""
    asked = features_of(query) if query else ()
    if not asked or not text:
        return None
    share, start, sentence = max(((len(asked & f) / len(asked), -at, s) for at, s, f in _sentences(text)), default=(0.0, 0, ""))
    return (-start, sentence, round(share, 9)) if share >= MIN_OVERLAP else None


def _leading(claims: DataFrame, limit: int) -> DataFrame:
    """The first claims of each query, numbered from 0."""
    w = Window.partitionBy("query_id").orderBy(F.desc("overlap"), "rank", "chunk_id")
    return claims.withColumn("claim_index", F.row_number().over(w) - 1).where(F.col("claim_index") < limit)


def best_claims(rows: DataFrame, limit: int = MAX_CLAIMS) -> DataFrame:
    """Per query the best sentence of each passage, then the best passages. ``rows`` has
    query_id, query, chunk_id, content and rank (of the passage)."""

    columns = ["query_id", "chunk_id", "rank", "query", "content"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [(q, c, r, *b) for q, c, r, query, text in zip(*(pdf[n] for n in columns)) if (b := _best(query, text))]
            yield pd.DataFrame(found, columns=["query_id", "chunk_id", "rank", "start", "sentence", "overlap"])

    kinds = dict(rows.dtypes)
    claims = dealt_for_work(rows.select(*columns), "chunk_id", "query_id").mapInPandas(run, f"query_id {kinds['query_id']}, chunk_id {kinds['chunk_id']}, rank {kinds['rank']}, start int, sentence string, overlap double")
    return _leading(claims, limit)


def judged_passages(rows: DataFrame, analyser: str = "lexical") -> DataFrame:
    """rows without their content, each with the best sentence of its passage (start, sentence,
    overlap; null where it has none) and the verdict, coverage and reason of that sentence. A
    passage is met once, for both, and goes no further; rows of one chunk should come together."""
    judge = ANALYSERS[analyser]
    names = [c for c in rows.columns if c != "content"]
    added = {"start": pa.int32(), "sentence": pa.string(), "overlap": pa.float64(), "verdict": pa.string(), "coverage": pa.float64(), "reason": pa.string()}

    def one(query: str | None, text: str | None) -> tuple:
        found = _best(query, text)
        return (*found, *_verdict(judge, found[1], text, found[0])) if found else (None,) * len(added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = pa.Table.from_batches([batch])
            out = [one(q, text) for q, text in zip(t.column("query").to_pylist(), t.column("content").to_pylist())]
            columns = [pa.array(c, kind) for c, kind in zip(zip(*out) if out else [()] * len(added), added.values())]
            yield pa.RecordBatch.from_arrays([*(t.column(n).combine_chunks() for n in names), *columns], [*names, *added])

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, ", ".join(f"`{n}` {kinds[n]}" for n in names) + ", start int, sentence string, overlap double, verdict string, coverage double, reason string")


def leading_claims(judged: DataFrame, limit: int = MAX_CLAIMS) -> DataFrame:
    """Of judged passages the claims that best_claims gives, with their verdicts."""
    return _leading(judged.where("sentence is not null"), limit)


def split_claims(c: Column) -> Column:
    """Clauses of a sentence, if every one has enough words; else the sentence."""
    parts = F.filter(F.transform(F.split(c, r"(?i);|\band\b"), lambda x: strip(x)), lambda x: x != "")
    whole = F.forall(parts, lambda x: F.regexp_count(x, F.lit(WORDS)) >= MIN_CLAUSE_WORDS)
    return F.when((F.size(parts) >= 2) & whole, parts).otherwise(F.array(strip(c)))


def polarity(c: Column) -> Column:
    """struct(negated, conditional, names): names are capitalised words but the first."""
    tokens = words(normalize_for_match(c))
    raw = words(c)
    names = F.filter(raw, lambda t, i: (i > 0) & t.rlike(r"^\p{Lu}") & ~F.lower(t).isin(list(NUMBER_WORDS)))
    return F.struct(
        F.exists(tokens, lambda t: t.isin(NEGATIONS)).alias("negated"), F.exists(tokens, lambda t: t.isin(CONDITIONS)).alias("conditional"),
        F.array_sort(F.array_distinct(F.transform(names, lambda t: F.lower(t)))).alias("names"),
    )


# ---------------------------------------------------------------- facts and entailment


def as_number(token: str) -> float | None:
    return float(token) if token.isdecimal() else NUMBER_WORDS.get(token)


@dataclass
class Facts:
    """What a span asserts. Quantities are (unit, value), unit None for bare numbers."""

    words: frozenset[str] = frozenset()
    content: set[str] = field(default_factory=set)
    quantities: set[tuple[str | None, float]] = field(default_factory=set)
    dates: set[str] = field(default_factory=set)
    names: set[str] = field(default_factory=set)
    negated: bool = False
    conditional: bool = False

    def values(self, unit: str | None) -> set[float]:
        return {v for u, v in self.quantities if u == unit}


@functools.lru_cache(1 << 13)
def _word_set(text: str) -> frozenset[str]:
    return frozenset(tokens_of(text))


@functools.lru_cache(1 << 13)
def facts(text: str) -> Facts:
    """One walk from the last token to the first. The unit of a number is the nearest word that
    the walk has passed since the last number, if at most three tokens away."""
    tokens = tokens_of(text)
    undated = tokens_of(_ISO.sub(" ", text)) if _ISO.search(text) else tokens
    out = Facts(words=frozenset(tokens), dates=set(_ISO.findall(text)))
    unit, unit_at = None, 0
    for at in range(len(undated) - 1, -1, -1):
        token = undated[at]
        value = as_number(token)
        if value is not None:
            out.quantities.add((unit if unit is not None and unit_at - at <= _NEAR else None, float(value)))
            unit = None
            continue
        if token not in STOPWORDS:
            if token not in MODIFIERS:
                unit, unit_at = token, at
            if token not in NEGATIONS:
                out.content.add(token)
    years = [t if len(t) == 4 and t.isdigit() else None for t in tokens] + [None, None]
    out.dates |= {f"{years[k + 1] or years[k + 2] or 'month'}-{MONTHS[t]:02d}" for k, t in enumerate(tokens) if t in MONTHS}
    out.negated, out.conditional = not out.words.isdisjoint(NEGATIONS), not out.words.isdisjoint(CONDITIONS)
    out.names = {t.casefold() for t in _RAW_WORD.findall(text)[1:] if t[0].isupper() and t.lower() not in NUMBER_WORDS}
    return out


def _plain_numbers(values: set[float]) -> str:
    return ", ".join(f"{v:g}" for v in sorted(values))


def _nearest(content: set[str], spans: list[str]) -> str:
    """The first of the spans that hold most of the words. What holds all of them, as a verbatim
    quote does, ends the search."""
    best, most = spans[0], -1
    for s in spans:
        if (n := len(content & _word_set(s))) > most:
            best, most = s, n
            if n == len(content):
                break
    return best


def entail(claim: str, evidence: str) -> tuple[str, float, str]:
    """(verdict, coverage, reason) of a claim against the evidence sentence nearest to it: the
    first finding that holds, in order, decides."""
    c = facts(claim.strip())
    if not c.content and all(u is None for u, _ in c.quantities):
        return "unsupported", 0.0, "empty claim"
    e = facts(_nearest(c.content, [s for s in map(str.strip, _SENTENCE.findall(evidence)) if s] or [evidence]))
    coverage = len(c.content & e.content) / len(c.content) if c.content else 1.0
    near, close = coverage >= PARTIAL, coverage >= SUPPORT
    clashes = [u for u, _ in sorted(c.quantities, key=str) if u is not None and e.values(u) and c.values(u).isdisjoint(e.values(u))]
    missing = {"numbers": c.quantities - e.quantities, "dates": c.dates - e.dates, "names": c.names - e.names}
    unmet = [what for what, rest in missing.items() if rest]
    findings: tuple[tuple[bool, str, Callable[[], str]], ...] = (
        (near and bool(clashes), "contradicted", lambda: f"number mismatch: {_plain_numbers(c.values(clashes[0]))} against {_plain_numbers(e.values(clashes[0]))} {clashes[0]}"),
        (near and bool(c.dates) and bool(e.dates) and c.dates.isdisjoint(e.dates), "contradicted", lambda: "date mismatch"),
        (close and c.negated != e.negated, "contradicted", lambda: "negation mismatch"),
        (close and not unmet, "supported", lambda: "confirmed"),
        (not near, "unsupported", lambda: "too few terms"),
        (bool(unmet), "partial", lambda: f"{unmet[0]} not confirmed"),
        (e.conditional and not c.conditional, "partial", lambda: "condition omitted"),
        (True, "partial", lambda: "terms not confirmed"),
    )
    return next((verdict, coverage, reason()) for holds, verdict, reason in findings if holds)


#: Analysers by name: (claim, evidence) to (verdict, coverage, reason).
ANALYSERS: dict[str, Callable[[str, str], tuple[str, float, str]]] = {"lexical": entail}


def _verdict(judge: Callable[[str, str], tuple[str, float, str]], c: object, e: object, at: object, placed: bool = True) -> tuple[str, float, str]:
    """What is found of claim ``c`` in evidence ``e``; ``placed``: it must stand there at ``at``."""
    if not isinstance(c, str) or not isinstance(e, str):
        return "unsupported", 0.0, "empty claim"
    if placed and (not c or at is None or at != at or at < 0 or e[int(at) : int(at) + len(c)] != c):
        return "unsupported", 0.0, "offsets do not recover the quote"
    return judge(c, e)


def verify(claims: DataFrame, claim: str, evidence: str, start: str | None = None, analyser: str = "lexical") -> DataFrame:
    """claims with verdict, coverage and reason; null texts are unsupported. With ``start``, the
    offset of the claim in the evidence, a claim that does not stand there word for word is
    unsupported whatever the evidence says."""
    judge = ANALYSERS[analyser]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [_verdict(judge, c, e, at, start is not None) for c, e, at in zip(pdf[claim], pdf[evidence], pdf[start] if start else [None] * len(pdf))]
            yield pdf.assign(verdict=[o[0] for o in out], coverage=[o[1] for o in out], reason=[o[2] for o in out])

    schema = ", ".join(f"`{n}` {t}" for n, t in claims.dtypes)
    return claims.mapInPandas(run, schema + ", verdict string, coverage double, reason string")


def clamp(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))


def claim_confidence(fused: Column, rerank_raw: Column, overlap: Column, engine: Column, ocr: Column) -> Column:
    """Weighted evidence for a claim; rerank falls back to fused, unknown OCR counts as clean."""
    clean = F.when(engine.isNotNull() & ocr.isNotNull(), clamp(ocr)).otherwise(1.0)
    parts = WEIGHTS["fused"] * clamp(fused) + WEIGHTS["rerank"] * clamp(F.coalesce(rerank_raw, fused)) + WEIGHTS["overlap"] * clamp(overlap) + WEIGHTS["ocr"] * clean
    return F.round(parts, 6)


def query_overlap(query: Column, span: Column) -> Column:
    """Share of the query's distinct words found in the span."""
    q, s = F.array_distinct(words(normalize_for_match(query))), words(normalize_for_match(span))
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, s)) / F.size(q)).otherwise(0.0)


def with_confidence(checked: DataFrame, confidence: Column) -> DataFrame:
    """Verified claims with their confidence. Only supported ones have any; one below the floor
    hardly bears on the query and is ambiguous, as is one that is supported in part."""
    c = checked.withColumn("confidence", F.when(F.col("verdict") == "supported", confidence).otherwise(0.0))
    weak = (F.col("verdict") == "supported") & (F.col("confidence") < CLAIM_FLOOR)
    return c.withColumn("reason", F.when(weak, "weakly connected to the query").otherwise(F.col("reason"))).withColumn(
        "verdict", F.when(weak | (F.col("verdict") == "partial"), "ambiguous").otherwise(F.col("verdict"))
    )


def citation(c: str = "") -> Column:
    """The passage that a claim cites, as one struct."""
    name = lambda n, source=None: F.col(f"{c}{source or n}").alias(n)
    return F.struct(
        name("chunk_id"), name("document_id"), name("version_id"), name("quote", "sentence"), name("quote_start", "start"), (F.col(f"{c}start") + F.length(f"{c}sentence")).alias("quote_end"),
        name("page_number"), name("section"), name("language"), name("char_start"), name("char_end"), name("ocr_engine"), name("ocr_confidence"),
    )


def surfaced(checked: DataFrame) -> DataFrame:
    """The claims that may be shown: supported ones, numbered anew from 0 in their order."""
    w = Window.partitionBy("query_id").orderBy("claim_index", "chunk_id")
    return checked.where("verdict = 'supported'").withColumn("claim_index", F.row_number().over(w) - 1)


# ---------------------------------------------------------------- decisions and answers


def decide(df: DataFrame) -> DataFrame:
    """df with decision, its reason and warnings, from counts per query: supported, contradicted,
    ambiguous, unsupported, dropped, evidence, confidence, min_ocr, ocr_unknown."""
    c = F.col
    conf = F.coalesce(c("confidence"), F.lit(0.0))
    warnings = F.concat_ws(
        "; ", F.when(conf < ANSWER_CONFIDENCE, "supporting confidence is moderate"),
        F.when((c("ambiguous") > 0) | (c("unsupported") > 0) | (c("dropped") > 0), "some proposed claims were dropped as unverifiable"),
        F.when(c("min_ocr") < LOW_OCR, "cited evidence has low OCR reliability"), F.when(c("ocr_unknown"), "cited evidence has OCR of unknown reliability"),
    )
    some = c("supported") > 0
    decision = (
        F.when(c("contradicted") > 0, "escalate_for_review")
        .when(~some & (c("evidence") == 0), "abstain")
        .when(~some, "ask_for_clarification")
        .when(warnings != "", "answer_with_warning")
        .otherwise("answer")
    )
    reason = (
        F.when(some & (c("contradicted") > 0), "supported and contradicted claims coexist in the evidence")
        .when(c("contradicted") > 0, "evidence contradicts the query and no claim could be supported")
        .when(~some & (c("evidence") == 0), "insufficient_evidence")
        .when(~some, "evidence was retrieved but no claim could be verified")
        .when(warnings != "", warnings)
        .otherwise("well-supported by cited evidence")
    )
    return df.withColumn("warnings", F.when(some, warnings).otherwise("")).withColumn("decision", decision).withColumn("decision_reason", reason)


def compose(queries: DataFrame, claims: DataFrame, evidence: DataFrame, drafts: DataFrame | None = None) -> DataFrame:
    """One row per query, answered or not: supported claims as a list, the decision and its
    reason. ``claims`` are verified (query_id, claim_index, sentence, verdict, confidence,
    ocr_engine, ocr_confidence), ``evidence`` the passages kept. ``drafts`` are the claims
    proposed, by default those verified: what is missing among the verified cites a passage
    outside the evidence and counts as dropped without a verdict."""
    is_ = lambda v: F.count_if(F.col("verdict") == v).alias(v)
    ok = F.col("verdict") == "supported"
    read = ok & F.col("ocr_engine").isNotNull()
    per = claims.groupBy("query_id").agg(
        is_("supported"), is_("contradicted"), is_("ambiguous"), is_("unsupported"), F.count("*").alias("verified"), F.round(F.avg(F.when(ok, F.col("confidence"))), 6).alias("confidence"),
        F.min(F.when(read, F.col("ocr_confidence"))).alias("min_ocr"), F.coalesce(F.bool_or(read & F.col("ocr_confidence").isNull()), F.lit(False)).alias("ocr_unknown"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(ok, F.struct("claim_index", "sentence")))), lambda x: F.concat(F.lit("- "), strip(x["sentence"]))), "\n").alias("answer"),
    )
    kept = evidence.groupBy("query_id").agg(F.count("*").alias("evidence"))
    full = queries.select("query_id").join(kept, "query_id", "left").join(per, "query_id", "left")
    if drafts is None:
        full = full.withColumn("proposed", F.col("verified"))
    else:
        full = full.join(drafts.groupBy("query_id").agg(F.count("*").alias("proposed")), "query_id", "left")
    full = full.fillna(0, ["supported", "contradicted", "ambiguous", "unsupported", "verified", "evidence", "proposed"]).fillna({"ocr_unknown": False})
    out = decide(full.withColumn("dropped", F.col("proposed") - F.col("supported")))
    answered = F.col("decision").isin("answer", "answer_with_warning")
    status = F.when(~answered, "abstained").when(F.col("dropped") > 0, "partial").otherwise("answered")
    why = F.when(~answered, F.when(F.col("evidence") < MIN_EVIDENCE, "insufficient_evidence").otherwise(F.col("decision")))
    return out.select(
        "query_id", "decision", "decision_reason", status.alias("status"), F.when(answered, F.col("answer")).otherwise(ABSTENTION).alias("answer"),
        F.when(answered, F.col("confidence")).otherwise(0.0).alias("confidence"), "warnings", why.alias("abstention_reason"), "evidence", "supported", "dropped",
    )


def to_answers(composed: DataFrame, shown: DataFrame) -> DataFrame:
    """Composed answers with their claims as an array of (claim_index, text, confidence, citation).
    An answer that was withheld shows none, even where claims were supported."""
    claims = shown.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("claim_index", strip(F.col("sentence")).alias("text"), "confidence", citation().alias("citation")))).alias("claims"))  # at most MAX_CLAIMS
    joined = composed.join(claims, "query_id", "left")
    none = F.array().cast(joined.schema["claims"].dataType)
    return joined.withColumn("claims", F.when(F.col("status") == "abstained", none).otherwise(F.coalesce("claims", none)))
