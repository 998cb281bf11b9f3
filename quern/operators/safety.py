"""Screening of texts for injected instructions: rules over three views, hidden and encoded
payloads, windows over chunk borders, and verdicts per document.

A text is screened in one Arrow pass, as the views need Unicode tables and the findings offsets.
Each rule names words of which any match holds one; a rule is only run over a view that has one,
so ordinary text costs a few substring searches."""

from __future__ import annotations

import base64
import binascii
import re
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

# Rule name, category, severity and pattern.
RULES = (
    ("ignore_previous", "instruction_override", "high", r"\b(?:ignore|disregard|forget|discard|override)\b[^.\n]{0,40}\b(?:previous|prior|earlier|above|preceding|all|your|the|these|those|any)\b[^.\n]{0,30}\b(?:instruction|instructions|prompt|prompts|direction|directions|rule|rules|context|message|messages|command|commands|guideline|guidelines|question|query)\b"),
    ("instructions_ignore", "instruction_override", "high", r"\b(?:instruction|instructions|prompt|prompts|rule|rules|guideline|guidelines)\b[\w\s\-]{0,25}\b(?:ignore|disregard|forget|override|purakkani\w*)\b"),
    ("tamil_ignore_previous", "instruction_override", "high", r"(?:முந்தைய|முன்னைய|மேலுள்ள|மேற்கண்ட|அனைத்து)[^.\n]{0,60}அறிவுறுத்தல்[^.\n]{0,35}புறக்கணி"),
    ("system_prompt_mention", "exfiltration", "medium", r"\b(?:system|developer)\s+prompt\b"),
    ("indirect_read_override", "indirect_trigger", "high", r"\b(?:when|whenever|after|once|as soon as)\b[^.\n]{0,25}\byou\b[^.\n]{0,15}\b(?:read|process|see|analyz\w+|summariz\w+|encounter|receiv\w+)\b[^.\n]{0,40}\b(?:ignore|disregard|instead|always|do not|don't|reply|respond|answer|say|output|forget)\b"),
    ("new_instructions", "instruction_override", "medium", r"\b(?:here are|these are|follow)\b[^.\n]{0,20}\b(?:new|updated|real|actual)\b[^.\n]{0,20}\b(?:instruction|instructions|rule|rules|prompt)\b"),
    ("do_not_follow", "instruction_override", "medium", r"\b(?:do not|don't|no longer)\b[^.\n]{0,20}\b(?:follow|obey|adhere to|comply)\b[^.\n]{0,30}\b(?:instruction|instructions|rule|rules|prompt|guideline|guidelines)\b"),
    ("system_prompt_reveal", "exfiltration", "high", r"\b(?:reveal|show|print|repeat|output|display|expose|tell me|give me)\b[^.\n]{0,30}\b(?:system|initial|original|hidden|secret|developer)\b[^.\n]{0,10}\b(?:prompt|instruction|instructions|message|rules|configuration)\b"),
    ("tamil_system_prompt_reveal", "exfiltration", "high", r"(?:கணினி|அமைப்பு|மறைக்கப்பட்ட|ரகசிய)[^.\n]{0,30}(?:தூண்டுத|அறிவுறுத்தல)[^.\n]{0,35}(?:வெளிப்படுத்து|காட்டு|அச்சிடு|தெரிவி)"),
    ("exfiltrate_secrets", "exfiltration", "high", r"\b(?:reveal|show|print|send|leak|exfiltrate|forward|email|post|upload|disclose)\b[^.\n]{0,30}\b(?:api[ _-]?key|secret|password|credential|token|private key|env(?:ironment)? variable)\b"),
    ("role_impersonation", "role_impersonation", "high", r"(?:^|[\n>\-\*\s])(?:system|assistant|developer)\s*(?:message|prompt)?\s*:\s*(?:(?:please\s+)?(?:ignore|disregard|forget|override|reveal|show|print|output|leak|exfiltrate|bypass|disable|disclose|expose)\b[^.\n]{0,35}\b(?:instruction|instructions|prompt|prompts|rule|rules|guideline|guidelines|guardrail|guardrails|safety|filter|filters|secret|password|credential|token)\b|(?:send|email|forward|post|upload)\b[^.\n]{0,30}\b(?:api[ _-]?key|secret|password|credential|token|private key)\b|[^.\n]{0,25}\b(?:assistant|ai|model|you|i)\b[^.\n]{0,25}\b(?:must|should|will|shall|need to|have to|am going to)\b[^.\n]{0,30}\b(?:ignore|disregard|forget|override|reveal|show|print|output|send|email|forward|post|upload|leak|exfiltrate|bypass|disable|disclose|expose)\b[^.\n]{0,35}\b(?:instruction|instructions|prompt|prompts|rule|rules|guideline|guidelines|guardrail|guardrails|safety|filter|filters|api[ _-]?key|secret|password|credential|token|private key)\b)"),
    ("you_are_now", "role_impersonation", "high", r"\byou (?:are|act|will act|must act|shall act) (?:now |from now on )?(?:an? |the )?(?:dan\b|do anything now|jailbroken|unrestricted|developer mode|no(?:t| longer) bound|unfiltered)"),
    ("pretend_bypass", "role_impersonation", "medium", r"\b(?:pretend|imagine|act as if|roleplay)\b[^.\n]{0,30}\b(?:no (?:rules|restrictions|guidelines|limits)|without (?:rules|restrictions|filter)|you can do anything|unrestricted)\b"),
    ("override_safety", "instruction_override", "high", r"\b(?:bypass|disable|turn off|switch off|ignore|override|circumvent)\b[^.\n]{0,25}\b(?:safety|guardrail|guardrails|filter|filters|moderation|content policy|restriction|restrictions|safeguard|safeguards)\b"),
    ("indirect_trigger", "indirect_trigger", "medium", r"\b(?:when|whenever|as soon as|after|once)\b[^.\n]{0,20}\b(?:you (?:read|process|see|analyze|summariz\w+|encounter)|reading|processing)\b[^.\n]{0,30}\b(?:you (?:must|should|will|have to|need to)|instead|always|do not|ignore|reply|respond|say|output)\b"),
    ("tool_use_request", "exfiltration", "medium", r"\b(?:call|invoke|execute|run|use)\b[^.\n]{0,15}\b(?:tool|function|command|shell|api|endpoint|url)\b[^.\n]{0,25}\b(?:http|https|curl|wget|fetch|post|get)\b"),
)
# Words of which a match of the rule holds at least one.
NEEDS = {
    "ignore_previous": ("ignore", "disregard", "forget", "discard", "override"), "instructions_ignore": ("ignore", "disregard", "forget", "override", "purakkani"), "tamil_ignore_previous": ("அறிவுறுத்தல்",),
    "system_prompt_mention": ("prompt",), "indirect_read_override": ("when", "after", "once", "as soon as"), "new_instructions": ("instruction", "rule", "prompt"),
    "do_not_follow": ("instruction", "rule", "prompt", "guideline"), "system_prompt_reveal": ("prompt", "instruction", "message", "rules", "configuration"), "tamil_system_prompt_reveal": ("தூண்டுத", "அறிவுறுத்தல"),
    "exfiltrate_secrets": ("api", "secret", "password", "credential", "token", "private key", "variable"), "role_impersonation": ("system", "assistant", "developer"), "you_are_now": ("you ",),
    "pretend_bypass": ("pretend", "imagine", "act as if", "roleplay"), "override_safety": ("bypass", "disable", "turn off", "switch off", "ignore", "override", "circumvent"),
    "indirect_trigger": ("when", "as soon as", "after", "once"), "tool_use_request": ("tool", "function", "command", "shell", "api", "endpoint", "url"),
}
# Weights, invisible characters, look-alike letters, words that are spaced out, words of a payload, shapes of encoded and spaced text.
WEIGHT = {"low": 0.25, "medium": 0.5, "high": 0.9}
INVISIBLE = "​‌‍⁠﻿­᠎"
HOMOGLYPHS = ("аеорсхѕіјԁɡⅼνοΙЅΑЕОРС", "aeopcxsijdglvoISAEOPC")
SPACED_WORDS = ("ignore", "system", "reveal", "bypass", "override", "jailbreak")
PAYLOAD = re.compile(r"\b(?:ignore|disregard|override|system prompt|you are now|reveal|api[ _-]?key|password|secret|bypass|jailbreak|do anything now)\b", re.I)
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{24,}={0,2}")
HEX = re.compile(r"(?:[0-9a-fA-F]{2}[\s:]?){16,}")
SPACED_RUN = re.compile(r"(?:\w[ \t\u00a0\-_.]){3,}\w")
SPACED_LETTERS = re.compile(r"(?:\b\w[ \t\u00a0\-_.]){5,}\w\b")
SPACERS = str.maketrans("", "", " \t\u00a0-_.")
# Categories, limits of a decision, letters around a border and a finding.
CATEGORIES = ("instruction_override", "exfiltration", "role_impersonation", "indirect_trigger", "obfuscation", "encoded_payload")
MANY_INVISIBLE, FLAG_AT, QUARANTINE_AT, BORDER, AROUND, LONGEST_EXCERPT = 4, 0.5, 0.8, 160, 40, 120

_COMPILED = tuple((name, category, severity, re.compile(pattern, re.I), NEEDS[name]) for name, category, severity, pattern in RULES)
_UNSEEN = str.maketrans("", "", INVISIBLE)
_LIKE = str.maketrans(*HOMOGLYPHS)
#: Letters that match others when case is ignored, beyond what folding shows.
_CASELESS = str.maketrans({"İ": "i", "ı": "i"})

#: (rule, category, severity, start, end, excerpt)
Finding = tuple[str, str, str, int, int, str]


def folded(text: str) -> str:
    """The text as it is compared: compatibility forms, no invisible letters, look-alikes mapped,
    lower case."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text).translate(_UNSEEN).translate(_LIKE)
    return text.lower()


def despaced(text: str) -> str:
    """Runs of single letters with spacers between them closed up."""
    return SPACED_RUN.sub(lambda m: m.group().translate(SPACERS), text)


def excerpt(text: str, start: int, end: int) -> str:
    """One line of bounded length around a finding, fit for a log."""
    left, right = max(0, start - AROUND), min(len(text), end + AROUND)
    line = " ".join(text[left:right].translate(_UNSEEN).split())
    if len(line) > LONGEST_EXCERPT:
        line = line[:LONGEST_EXCERPT].rstrip() + "…"
    return ("…" if left else "") + line + ("…" if right < len(text) else "")


def decoded_payload(blob: str, kind: str) -> bool:
    """Whether an encoded block holds readable text with instructions."""
    try:
        if kind == "hex":
            digits = re.sub(r"[\s:]", "", blob)
            text = bytes.fromhex(digits[: len(digits) // 2 * 2]).decode()
        else:
            text = base64.b64decode(blob + "=" * (-len(blob) % 4), altchars=b"-_", validate=True).decode()
    except (ValueError, binascii.Error):
        return False
    readable = sum(ch.isprintable() or ch.isspace() for ch in text)
    return bool(text) and readable >= 0.8 * len(text) and bool(PAYLOAD.search(text))


def _by_rules(text: str) -> Iterator[Finding]:
    """Matches in the text itself, in its folded view if that differs (offsets bounded by the
    text), and one mark at the start for the despaced view, whose offsets mean nothing here."""
    fold = folded(text)
    flat = despaced(fold)
    views = [(text, text.translate(_CASELESS).casefold(), "")]
    if fold != text.lower():
        views.append((fold, fold.translate(_CASELESS).casefold(), ":obfuscated"))
    flat_key = flat.translate(_CASELESS).casefold() if flat != fold else None
    size = len(text)
    for name, category, severity, pattern, needs in _COMPILED:
        for view, key, suffix in views:
            if any(w in key for w in needs):
                for m in pattern.finditer(view):
                    a, b = min(m.start(), size), min(m.end(), size)
                    yield name + suffix, category, severity, a, b, excerpt(text, a, b)
        if flat_key is not None and any(w in flat_key for w in needs) and pattern.search(flat):
            yield f"{name}:obfuscated", category, severity, 0, min(size, 1), excerpt(text, 0, min(size, 1))


def _hidden(text: str) -> Iterator[Finding]:
    """Invisible letters, spaced-out words and encoded instructions."""
    unseen = 0 if text.isascii() else sum(map(text.count, INVISIBLE))
    if unseen >= MANY_INVISIBLE:
        yield "invisible_characters", "obfuscation", "medium", 0, min(len(text), 1), f"{unseen} invisible characters"
    for m in SPACED_LETTERS.finditer(text):
        run = m.group().translate(SPACERS).lower()
        if run in SPACED_WORDS or PAYLOAD.search(run):
            yield "letter_spacing", "obfuscation", "medium", *m.span(), excerpt(text, *m.span())
    for kind, shape in (("base64", BASE64), ("hex", HEX)):
        for m in shape.finditer(text):
            if decoded_payload(m.group(), kind):
                yield f"{kind}_instruction", "encoded_payload", "high", *m.span(), excerpt(text, *m.span())


#: Classifiers by name: a text to (probability, further findings).
CLASSIFIERS: dict[str, Callable[[str], tuple[float, list[Finding]]]] = {}


def findings(text: str | None, classifier: Callable[[str], tuple[float, list[Finding]]] | None = None) -> tuple[list[Finding], float]:
    """Findings in a text, once per rule and place, and the classifier's probability."""
    if not text or not text.strip():
        return [], 0.0
    probability, extra = classifier(text) if classifier else (0.0, [])
    first: dict[tuple[str, int, int], Finding] = {}
    for f in [*_by_rules(text), *_hidden(text), *extra]:
        first.setdefault((f[0], f[3], f[4]), f)
    return list(first.values()), min(max(probability, 0.0), 1.0)


SIGNAL = "struct<rule:string,category:string,severity:string,start:int,end:int,excerpt:string>"
_ARROW_SIGNAL = pa.list_(pa.struct([*[(n, pa.string()) for n in ("rule", "category", "severity")], ("start", pa.int32()), ("end", pa.int32()), ("excerpt", pa.string())]))


def score(weights: Column, probability: Column | None = None) -> Column:
    """Probabilistic or over weights, strongest first and whole, later ones halved; then with the
    probability of a classifier."""
    ordered = F.sort_array(weights, asc=False)
    rest = F.aggregate(F.slice(ordered, 2, F.greatest(F.size(ordered), F.lit(1))), F.lit(1.0), lambda a, w: a * (1 - w / 2))
    clean = F.when(F.size(ordered) > 0, (1 - ordered[0]) * rest).otherwise(1.0)
    return F.round(1 - (clean if probability is None else clean * (1 - probability)), 6)


def decision(value: Column, any_high: Column, flag_at: float = FLAG_AT, quarantine_at: float = QUARANTINE_AT) -> Column:
    if not 0 < flag_at <= quarantine_at <= 1:
        raise ValueError("needs 0 < flag_at <= quarantine_at <= 1")
    return F.when(any_high | (value >= quarantine_at), "quarantine").when(value >= flag_at, "flag").otherwise("allow")


def assess(df: DataFrame, text: str, classifier: str | None = None) -> DataFrame:
    """df with signals, score, decision and categories (first seen first). Blank and null texts
    are allowed."""
    at, model = df.columns.index(text), CLASSIFIERS[classifier] if classifier else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("rule", "category", "severity", "start", "end", "excerpt")
        for batch in batches:
            found = [findings(t, model) for t in batch.column(at).to_pylist()]
            signals = pa.array([[dict(zip(names, f)) for f in fs] for fs, _ in found], _ARROW_SIGNAL)
            yield pa.RecordBatch.from_arrays([*batch.columns, signals, pa.array([p for _, p in found], pa.float64())], [*batch.schema.names, "signals", "_probability"])

    schema = ", ".join(f"`{n}` {t}" for n, t in df.dtypes)
    out = df.mapInArrow(run, f"{schema}, signals array<{SIGNAL}>, _probability double")
    weight = F.create_map(*[x for k, v in WEIGHT.items() for x in (F.lit(k), F.lit(v))])
    out = out.withColumn("score", score(F.transform("signals", lambda e: weight[e["severity"]]), F.col("_probability"))).drop("_probability")
    out = out.withColumn("decision", decision(F.col("score"), F.exists("signals", lambda e: e["severity"] == "high")))
    return out.withColumn("categories", F.array_distinct(F.transform("signals", lambda e: e["category"])))


_VERDICT = ("decision", "score", "signals", "categories")


def _assessed(df: DataFrame, text: str, name: str, classifier: str | None) -> DataFrame:
    """df with the assessment of a text as one struct."""
    return assess(df, text, classifier).withColumn(name, F.struct(*_VERDICT)).drop(*_VERDICT)


def scan_chunks(chunks: DataFrame, classifier: str | None = None) -> DataFrame:
    """(version_id, chunk_index, phase, decision, score, signals, categories): every chunk (phase
    0) and every border to the next one (phase 1), unless either side is quarantined anyway.

    Each chunk is screened once; it then hands its end to the border after it and its start to
    the border before it, which meet by version and number, so no version is gathered. A border
    is screened with a space between the two texts and, where a word may be parted, without; the
    higher score counts. Findings there are named so and have offsets 0, as they belong to
    neither text."""
    single = _assessed(chunks.select("version_id", "chunk_index", "content"), "content", "own", classifier)
    tail = F.regexp_replace(F.expr(f"right(content, {BORDER})"), r"[\s\p{Z}]+$", "")
    head = F.regexp_replace(F.substring("content", 1, BORDER), r"^[\s\p{Z}]+", "")
    bad, n, empty = F.col("own.decision") == "quarantine", F.col("chunk_index"), F.lit(None).cast("string")
    nothing = F.lit(None).cast(single.schema["own"].dataType)

    def part(phase: int, at: Column, own: Column, tail: Column, head: Column, bad: Column) -> Column:
        apart = F.xxhash64("content") if phase == 0 else F.lit(0).cast("long")  # numbers may recur within a version
        return F.struct(F.lit(phase).alias("phase"), at.alias("chunk_index"), apart.alias("apart"), own.alias("own"), tail.alias("tail"), head.alias("head"), bad.alias("bad"))

    dealt = single.select("version_id", F.inline(F.array(part(0, n, F.col("own"), empty, empty, F.lit(False)), part(1, n, nothing, tail, empty, bad), part(1, n - 1, nothing, empty, head, bad))))
    met = dealt.groupBy("version_id", "phase", "chunk_index", "apart").agg(F.first("own", ignorenulls=True).alias("own"), F.max("tail").alias("tail"), F.max("head").alias("head"), F.bool_or("bad").alias("bad"))
    both = ~F.col("bad") & (F.col("tail") != "") & (F.col("head") != "")
    inner = F.col("tail").rlike(r"[\p{L}\p{N}]$") & F.col("head").rlike(r"^[\p{L}\p{N}]")
    views = met.withColumn("_spaced", F.when(both, F.concat_ws(" ", "tail", "head"))).withColumn("_glued", F.when(both & inner, F.concat("tail", "head"))).where("phase = 0 or _spaced is not null").drop("tail", "head", "bad", "apart")
    seen = _assessed(_assessed(views, "_spaced", "_a", classifier), "_glued", "_b", classifier)
    seen = seen.withColumn("_best", F.when(F.col("_b.score") > F.col("_a.score"), F.col("_b")).otherwise(F.col("_a")))
    marked = F.transform("_best.signals", lambda e: F.struct(F.concat(e["rule"], F.lit(":boundary")).alias("rule"), e["category"].alias("category"), e["severity"].alias("severity"), F.lit(0).alias("start"), F.lit(0).alias("end"), e["excerpt"].alias("excerpt")))
    border = F.struct("_best.decision", "_best.score", marked.alias("signals"), "_best.categories")
    return seen.select("version_id", "chunk_index", "phase", F.when(F.col("phase") == 0, F.col("own")).otherwise(border).alias("v")).select("version_id", "chunk_index", "phase", "v.*")


def scan_documents(chunks: DataFrame, classifier: str | None = None) -> DataFrame:
    """(version_id, decision, reason, max_score, flagged, quarantined) per version."""
    return verdicts(scan_chunks(chunks, classifier))


def verdicts(every: DataFrame) -> DataFrame:
    """Verdicts from (version_id, chunk_index, phase, decision, score, categories). Categories are
    listed as they are first met: chunks in order, then borders."""
    bad = F.col("decision") != "allow"
    first = [F.min(F.when(bad & F.array_contains("categories", c), F.struct("phase", "chunk_index", F.array_position("categories", c).alias("k"), F.lit(c).alias("c")))).alias(f"_{c}") for c in CATEGORIES]
    per = every.groupBy("version_id").agg(F.count_if(F.col("decision") == "quarantine").alias("quarantined"), F.count_if(F.col("decision") == "flag").alias("flagged"), F.max("score").alias("max_score"), *first)
    listed = F.transform(F.array_sort(F.array_compact(F.array(*[f"_{c}" for c in CATEGORIES]))), lambda x: x["c"])
    verdict = F.when(F.col("quarantined") > 0, "quarantine").when(F.col("flagged") > 0, "flag").otherwise("allow")
    named = F.when(F.size(listed) > 0, F.array_join(listed, ", ")).otherwise("instruction_like_content")
    reason = F.when(verdict != "allow", F.concat(F.lit("prompt_injection: "), named))
    return per.select("version_id", verdict.alias("decision"), reason.alias("reason"), "max_score", "flagged", "quarantined")
