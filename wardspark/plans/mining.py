"""Policy mining: documents to sections, obligation sentences, and draft rules."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.patterns import ascii_lower, java, js_trim

#: Phrases that mark an obligation.
OBLIGATIONS = (
    "must", "must not", "should", "should not", "prohibit", "prohibited", "require", "required", "approval", "approved", "do not",
    "never", "only", "redact", "remove", "de-identify", "deidentify", "confidential", "personal data", "sensitive", "regulated",
)
#: The phrases that hold no other: a text with any phrase has one of these.
SHORTEST = tuple(p for p in OBLIGATIONS if not any(q in p for q in OBLIGATIONS if q != p))
#: Categories with their labels and words.
CATEGORIES = (
    ("client_identifying_info", "client identifying information", r"\b(?:client|customer|patient|candidate|employee)\b"),
    ("personal_data", "personal data", r"\b(?:personal data|pii|personally identifiable|identifier|name|email|phone|address)\b"),
    ("confidential_data", "confidential data", r"\b(?:confidential|internal only|non-public|sensitive)\b"),
    ("regulated_financial_context", "regulated financial context", r"\b(?:financial|loan|bank|insurance|credit|investment|payment|account)\b"),
    ("medical_context", "medical context", r"\b(?:medical|health|hipaa|clinical|patient|diagnosis|treatment)\b"),
    ("hr_context", "HR context", r"\b(?:hr|human resources|candidate|recruiting|employee|performance|payroll)\b"),
    ("legal_context", "legal context", r"\b(?:legal|privileged|attorney|contract|litigation|matter)\b"),
    ("secrets_credentials", "secrets and credentials", r"\b(?:api key|secret|token|password|credential|private key)\b"),
    ("source_code", "source code", r"\b(?:source code|repository|proprietary code|codebase)\b"),
    ("intellectual_property", "intellectual property", r"\b(?:ip|intellectual property|trade secret|roadmap|proprietary)\b"),
    ("prompt_injection", "prompt injection", r"\b(?:prompt injection|jailbreak|ignore previous|bypass|override instructions)\b"),
)
REDACTING = r"\b(?:redact|remove|de-identify|deidentify|mask|anonymize)\b"
FORBIDDING = r"\b(?:block|prohibit|prohibited|must not|do not|never|forbidden)\b"
#: Outcomes in order of priority with the patterns that must all match; what no row fits is the last word.
ACTIONS = (
    ("transform", (FORBIDDING, REDACTING)), ("block", (FORBIDDING,)), ("require_approval", (r"\b(?:approval|approved|permission|review required|human review)\b",)),
    ("transform", (REDACTING,)), ("warn", ()),
)
DESTINATIONS = (
    ("personal", (r"\b(?:personal|consumer|free account|public ai|unapproved)\b",)), ("unapproved", (r"\bunauthorized\b",)),
    ("approved", (r"\b(?:approved|enterprise|company account|managed account)\b",)), ("any", ()),
)
PROVIDERS = (("chatgpt", ("chatgpt",)), ("openai", ("openai",)), ("anthropic", ("anthropic|claude",)), ("gemini", ("gemini|google ai",)), ("any", ()))
CRITICAL = r"\b(?:api key|secret|password|private key|hipaa|payment|bank account|ssn|social security)\b"
GRAVE = ("regulated_financial_context", "medical_context", "legal_context", "hr_context")
FALLBACKS = {"transform": "block", "warn": "require_approval", "block": "block", "require_approval": "require_approval"}
#: Names of rules by action, around the label of their first category.
TITLES = {
    "transform": ("Redact ", " before external AI use"), "block": ("Do not submit ", " to unapproved AI"), "require_approval": ("Require approval for ", " in AI workflows"),
    "warn": ("Review ", " before AI use"),
}
LONG_LINE, FULL_PARAGRAPH, LEAST_TEXT, MOST_RULES = 450, 700, 40, 8


def clamp_text(value: Column, limit: int) -> Column:
    clean = js_trim(F.regexp_replace(value, java(r"\s+"), " "))
    return F.when(F.length(clean) > limit, F.concat(js_trim(F.substring(clean, 1, limit - 1)), F.lit("..."))).otherwise(clean)


def _trimmed(value: Column) -> Column:
    """js_trim of a value that is at hand, searched only if its first or last character is white space or ends a line."""
    ends = F.concat(F.substring(value, 1, 1), F.substring(value, -1, 1))
    return F.when(ends.rlike(java(r"[\s\x85]")), js_trim(value)).otherwise(value)


def sentences(text: Column) -> Column:
    """Cut at the white space between an end mark and a capital or digit. The space comes first in the pattern, so that little is tried at other places."""
    return F.filter(F.transform(F.split(text, java(r"\s(?<=[.!?]\s)\s*(?=[A-Z0-9])")), _trimmed), lambda s: s != "")


def _bare(line: Column) -> Column:
    return js_trim(F.regexp_replace(line, java(r"^(\d+(\.\d+)*[.)]?|[A-Za-z][.)]|[-*])\s+"), ""))


def _bound(value: Column, f) -> Column:
    """f of a value that is computed once, however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _cut(items: Column, starts) -> Column:
    """An array cut before each place i for which starts(array, i) holds: by slices, so linear in its length."""

    def cut(m: Column) -> Column:
        places = F.filter(F.sequence(F.lit(0), F.size(m) - 1), lambda i: (i == 0) | starts(m, i))
        pieces = _bound(places, lambda p: F.transform(p, lambda i, k: F.slice(m, i + 1, F.coalesce(F.get(p, k + 1), F.size(m)) - i)))
        return F.when(F.size(m) > 0, pieces).otherwise(F.slice(F.array(m), 1, 0))

    return _bound(items, cut)


def _paragraphs(block: Column) -> Column:
    """Lines gathered into paragraphs, each ended by the line that makes it longer than FULL_PARAGRAPH."""

    def step(acc: Column, x: Column) -> Column:
        now = F.concat_ws(" ", acc["now"], x["part"])
        full = F.length(now) > FULL_PARAGRAPH
        return F.struct(F.when(~full, now).alias("now"), F.when(full, F.array_append(acc["out"], now)).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.lit(None).cast("string").alias("now"), F.array().cast("array<string>").alias("out"))
    return F.aggregate(block, start, step, lambda acc: F.when(acc["now"].isNull(), acc["out"]).otherwise(F.array_append(acc["out"], acc["now"])))


def section_array(text: Column) -> Column:
    """Candidate sections of a text, array<struct<heading, text>>, cut out of its lines by place: no shuffle.

    Lines under a heading are joined; a line longer than 450 characters is cut into its sentences
    by itself, and a paragraph ends with the line that makes it longer than 700. Of a paragraph with several sentences, those with an obligation are sections of
    their own; the sentences of a long line each stand. Sections have more than 40 characters. A null text gives null.
    """
    lines = F.filter(F.transform(F.split(F.replace(text, F.lit("\r"), F.lit("")), "\n"), _trimmed), lambda x: x != "")
    bared = F.transform(lines, lambda x: F.struct(x.alias("line"), _bare(x).alias("bare"), (F.length(x) > LONG_LINE).alias("is_long")))

    def marked(x: Column) -> Column:
        heading = F.length(x["bare"]).between(3, 120) & (
            x["line"].rlike(java(r"^\d+(\.\d+)*\s+[A-Z]")) | x["bare"].rlike(r"^[A-Z][A-Z0-9 /&,-]{5,}$") | x["bare"].rlike(java(r"^[A-Z][a-z]+(\s+[A-Z][a-z]+){1,7}:?$"))
        )
        title = F.when(heading, clamp_text(F.regexp_replace(x["bare"], ":$", ""), 120))
        return F.struct(title.alias("title"), x["is_long"].alias("is_long"), F.when(x["is_long"], x["line"]).otherwise(x["bare"]).alias("part"))

    def pieces(group: Column) -> Column:
        heading = F.coalesce(F.get(group, F.lit(0))["title"], F.lit("Imported AI usage policy"))
        blocks = _cut(F.filter(group, lambda x: x["title"].isNull()), lambda m, i: F.get(m, i)["is_long"] | F.get(m, i - 1)["is_long"])
        piece = lambda is_long: lambda t: F.struct(heading.alias("heading"), t.alias("paragraph"), F.lit(is_long).alias("is_long"))
        cut = lambda b: F.when(F.get(b, F.lit(0))["is_long"], F.transform(F.transform(b, lambda x: x["part"]), piece(True))).otherwise(F.transform(_paragraphs(b), piece(False)))
        return F.flatten(F.transform(blocks, cut))

    groups = _cut(F.transform(bared, marked), lambda m, i: F.get(m, i)["title"].isNotNull())
    paragraphs = F.flatten(F.transform(groups, pieces))
    clean = F.transform(paragraphs, lambda p: F.struct(p["heading"].alias("heading"), p["is_long"].alias("is_long"), F.regexp_replace(p["paragraph"], java(r"\s+"), " ").alias("clean")))
    split = F.transform(clean, lambda p: F.struct(p["heading"].alias("heading"), p["is_long"].alias("is_long"), p["clean"].alias("clean"), sentences(p["clean"]).alias("ss")))

    def parts(p: Column) -> Column:
        binding = F.filter(p["ss"], _obliges)
        several = _bound(binding, lambda b: F.when(F.size(b) > 0, b).otherwise(F.array(js_trim(p["clean"]))))
        whole = F.when((F.size(p["ss"]) <= 1) | p["is_long"], p["ss"]).otherwise(several)
        return F.transform(F.filter(whole, lambda t: F.length(t) > LEAST_TEXT), lambda t: F.struct(p["heading"].alias("heading"), t.alias("text")))

    return F.flatten(F.transform(split, parts))


def sections(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ordinal, heading, text): the sections of section_array, a row each. Rows that repeat an id are cut each by itself."""
    found = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(section_array(F.col(text_col))).alias("n", "section"))
    return found.select("doc_id", (F.col("n") + 1).alias("ordinal"), "section.heading", "section.text")


def _any_of(lower: Column, phrases) -> Column:
    return reduce(Column.__or__, [F.contains(lower, F.lit(p)) for p in phrases])


def _obliges(text: Column) -> Column:
    """Whether a text has any phrase of obligation."""
    return F.exists(F.array(ascii_lower(text)), lambda t: _any_of(t, SHORTEST))


def _worded(lower: Column, pattern: str) -> Column:
    """Whether a lower-case text matches a pattern of words, r"\b(?:a|b)\b", or of parts, "a|b": each word is looked for by
    itself first, and its boundaries only where it occurs."""
    inner = re.fullmatch(r"\\b(?:\(\?:)?([a-z |-]+)\)?\\b", pattern)
    if not inner:
        return _any_of(lower, pattern.split("|"))
    bounded = lambda w: F.contains(lower, F.lit(w)) & lower.rlike(rf"{w}(?<![A-Za-z0-9_]{w})(?![A-Za-z0-9_])")
    return reduce(Column.__or__, map(bounded, inner[1].split("|")))


def _categories(text: Column) -> Column:
    held = lambda t: F.array_compact(F.array(*[F.when(_worded(t, p), F.lit(c)) for c, _, p in CATEGORIES]))
    return _bound(ascii_lower(text), held)


def _binds(text: Column) -> Column:
    return _obliges(text) | (F.size(_categories(text)) >= 2)


def _obligations(text: Column) -> Column:
    lower = F.lower(text)
    out = F.lit(0)
    for phrase in OBLIGATIONS:
        out = out + F.contains(lower, F.lit(phrase)).cast("int")
    return out


def _first(lower: Column, table: tuple) -> Column:
    """The outcome of the first row of a table all of whose patterns match."""
    out = F.lit(None).cast("string")
    for outcome, patterns in reversed(table):
        hit = F.lit(True)
        for pattern in patterns:
            hit = hit & _worded(lower, pattern)
        out = F.when(hit, outcome).otherwise(out)
    return out


def inferred_rules(candidates: DataFrame, top: int = MOST_RULES) -> DataFrame:
    """Draft rules of sections (doc_id, ordinal, heading, text): at most ``top`` a document, by confidence.

    Documents without a section that binds come out with no rule; see with_fallback.
    """
    return _best(_drafted(candidates.where(_binds(F.col("text")))), "doc_id", top).select(*RULE_COLUMNS)


def mined(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", top: int = MOST_RULES) -> DataFrame:
    """Draft rules of documents, or the general warning for those without any, in one pass over the texts.

    Each row is a document of its own, whatever its id: ids that are null or repeat are not mixed. Null texts count as
    empty. Only what binds is shuffled.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = docs.select(F.col(id_col).alias("doc_id"), text.alias("whole"), F.filter(section_array(text), lambda s: _binds(s["text"])).alias("found"))
    found = found.select("doc_id", F.monotonically_increasing_id().alias("_row"), F.when(F.size("found") == 0, clamp_text(F.col("whole"), 1400)).alias("excerpt"), "found")
    rows = found.select("doc_id", "_row", F.col("excerpt").alias("_excerpt"), F.posexplode_outer("found").alias("ordinal", "section"))
    rows = rows.select("doc_id", "_row", "_excerpt", "ordinal", "section.heading", "section.text").repartition("_row")
    best = _best(_drafted(rows), "_row", top)
    bare = F.col("_excerpt").isNotNull()
    general = _general(F.col("_excerpt"))
    return best.select("doc_id", *[F.when(bare, general[c]).otherwise(F.col(c)).alias(c) for c in RULE_COLUMNS[1:]])


def _drafted(base: DataFrame) -> DataFrame:
    """Rows of sections with what a rule says of each."""
    lower = F.lower(F.col("text"))
    base = base.select("*", _categories(F.col("text")).alias("categories"), _obligations(F.col("text")).alias("obligations"))
    base = base.select("*", _first(lower, ACTIONS).alias("action"), _first(lower, DESTINATIONS).alias("destination_type"), _first(lower, PROVIDERS).alias("ai_provider"))
    strict = F.col("action").isin("block", "require_approval")
    severity = (
        F.when(lower.rlike(CRITICAL), "critical").when(strict, F.when(F.size("categories") >= 2, "high").otherwise("medium"))
        .when(F.arrays_overlap("categories", F.array(*map(F.lit, GRAVE))), "high").when(F.size("categories") > 0, "medium").otherwise("low")
    )
    fallback = F.element_at(F.create_map(*[F.lit(x) for pair in FALLBACKS.items() for x in pair]), F.col("action"))
    confidence = F.least(F.lit(96), 42 + F.col("obligations") * 9 + F.size("categories") * 7 + F.when(strict, 8).otherwise(0))
    labels = F.create_map(*[F.lit(x) for c, label, _ in CATEGORIES for x in (c, label)])
    first = F.element_at(labels, F.get("categories", F.lit(0)))
    sentence = js_trim(F.get(F.split("text", "[.!?]"), F.lit(0)))
    plain = clamp_text(F.regexp_replace(F.when(sentence == "", "Imported AI usage policy").otherwise(sentence), r"(?i)^(employees|users|staff)\s+", ""), 84)
    around = F.element_at(F.create_map(*[x for k, pair in TITLES.items() for x in (F.lit(k), F.array(*map(F.lit, pair)))]), F.col("action"))
    name = F.coalesce(F.concat(F.get(around, F.lit(0)), first, F.get(around, F.lit(1))), plain)
    key = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower("name"), "[^a-z0-9]+", "-"), "^-+|-+$", ""), "-", "_")
    rules = base.select("*", severity.alias("severity"), fallback.alias("fallback_action"), confidence.alias("confidence"), name.alias("name"))
    rules = rules.withColumn("rule_key", key).withColumn(
        "id", F.concat(F.lit("import_"), F.substring(F.sha2(F.concat("heading", F.lit(":"), "text"), 256), 1, 10))
    )
    return rules.withColumns({
        "source_section": F.col("heading"), "excerpt": clamp_text(F.col("text"), 1400),
        "data_categories": F.when(F.size("categories") > 0, F.col("categories")).otherwise(F.array(F.lit("ai_usage_policy"))),
    })


def _best(rules: DataFrame, key: str, top: int) -> DataFrame:
    """Of equal rules of a document the surest, and of those the first ``top``."""
    kept = Window.partitionBy(key, "rule_key", "action", "destination_type").orderBy(F.desc("confidence"), "ordinal", "id")
    rules = rules.withColumn("_k", F.row_number().over(kept)).where("_k = 1")
    best = Window.partitionBy(key).orderBy(F.desc("confidence"), "ordinal", "id")
    return rules.withColumn("place", F.row_number().over(best)).where(F.col("place") <= top)


RULE_COLUMNS = (
    "doc_id", "place", "id", "rule_key", "name", "source_section", "excerpt", "data_categories", "ai_provider", "destination_type", "action",
    "fallback_action", "severity", "confidence",
)


def _general(excerpt: Column) -> dict[str, Column]:
    """The warning for a document without rules, of confidence 35."""
    return {
        "place": F.lit(1), "id": F.concat(F.lit("import_"), F.substring(F.sha2(excerpt, 256), 1, 10)),
        "rule_key": F.lit("review_imported_ai_policy"), "name": F.lit("Review imported AI policy before external AI use"),
        "source_section": F.lit("Imported document"), "excerpt": excerpt, "data_categories": F.array(F.lit("ai_usage_policy")),
        "ai_provider": F.lit("any"), "destination_type": F.lit("any"), "action": F.lit("warn"), "fallback_action": F.lit("require_approval"),
        "severity": F.lit("medium"), "confidence": F.lit(35),
    }


def with_fallback(docs: DataFrame, rules: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rules, and a general warning of confidence 35 for documents without any. See mined for both in one pass."""
    bare = docs.select(F.col(id_col).alias("doc_id"), F.col("text")).join(rules.select("doc_id").distinct(), "doc_id", "left_anti")
    general = _general(clamp_text(F.col("text"), 1400))
    return rules.unionByName(bare.select("doc_id", *[c.alias(n) for n, c in general.items()]).select(*rules.columns))
