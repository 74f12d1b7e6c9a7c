"""Text scan as column expressions: candidates, overlap resolution, placeholders, flags, risk, action.

Everything here is built from Spark functions, so a scan is one projection over the table: it
needs no shuffle and runs at the speed of the regular expressions. Offsets are in code points.
Names of persons are found by rules over capitals, lists and cues (names.py); candidates of other
recognisers come in as external ones.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .names import names, validated
from .patterns import (
    BASE_RISK,
    CONTEXT_WORDS,
    CONTEXTS,
    DETECTORS,
    ENTITY_TYPES,
    FLAG_TEXTS,
    PLACEHOLDER,
    SENSITIVE,
    SENSITIVITY_BOOST,
    SEVERITY_WEIGHTS,
    TOP_RISK,
    ascii_lower,
    java,
    js_trim,
    may_match,
)
from .spans import spans

CANDIDATE = "struct<start:int,rank:int,doubt:double,ordinal:int,stop:int,type:string,value:string,confidence:double,detector:string>"
RANK = {t: -priority for t, (_, priority, _, _) in ENTITY_TYPES.items()}


#: Validated candidates of these types have at least this confidence.
FLOORS = {"EMAIL": 0.96, "SECRET": 0.98, "PHONE": 0.90}


def credible_phone(value: Column) -> Column:
    """Ten digits, or eleven after a 1, and formatting or a country code."""
    digits = F.regexp_replace(value, r"\D", "")
    return ((F.length(digits) == 10) | ((F.length(digits) == 11) & digits.startswith("1"))) & (value.rlike(java(r"[\s().-]")) | value.rlike(r"^\+?1"))


def _type_map(value) -> Column:
    return F.create_map(*[F.lit(x) for t, v in ENTITY_TYPES.items() for x in (t, value(t, v))])


def candidates(text: Column, lower: Column) -> Column:
    """Candidates of all pattern detectors that pass their validator, in order of detection; lower is ascii_lower(text)."""
    parts = []
    for ordinal, (kind, name, confidence, ignore, pattern) in enumerate(DETECTORS):
        at = spans(text, java(pattern, ignore), may_match(name, text, lower, ignore))
        if kind == "PHONE":  # credible by its digits; it must show formatting or a country code
            at = F.filter(at, lambda x: credible_phone(x["value"]))
        parts.append(_shaped(at, kind, name, confidence, ordinal))
    return F.concat(*parts)


def _shaped(at: Column, kind: str, name: str, confidence: float, ordinal: int) -> Column:
    return F.transform(
        at,
        lambda x: F.struct(
            x["start"],
            F.lit(RANK[kind]).alias("rank"),
            F.lit(-confidence).alias("doubt"),
            F.lit(ordinal).alias("ordinal"),
            x["stop"],
            F.lit(kind).alias("type"),
            x["value"].alias("value"),
            F.lit(confidence).alias("confidence"),
            F.lit(name).alias("detector"),
        ),
    ).cast(f"array<{CANDIDATE}>")


def external_candidates(text: Column, given: Column) -> Column:
    """Candidates from elsewhere (array of type, start, stop, value, confidence, detector) that agree with the text.

    Kept if the type is known, offsets lie in the text, the text there is the value, and the
    confidence is finite; it is clamped to 0..1, and white space at the ends is cut. Addresses of mail and secrets have at
    least the confidence of detected ones, phones must be credible by their digits and formatting, and all must reach the type's threshold. Persons are
    validated like detected names, with the signals that they bring.
    """
    thresholds, ranks = _type_map(lambda t, v: v[0]), _type_map(lambda t, v: RANK[t])
    floors = _type_map(lambda t, v: FLOORS.get(t, 0.0))
    agree = F.filter(
        given,
        lambda c: c["type"].isin(*ENTITY_TYPES) & (c["start"] >= 0) & (c["stop"] > c["start"]) & (c["stop"] <= F.length(text))
        & (F.substring(text, c["start"] + 1, c["stop"] - c["start"]) == c["value"])
        & ~F.isnan(c["confidence"]) & (F.abs(c["confidence"]) < float("inf")),
    )
    bare = lambda c: js_trim(c["value"])
    lead = lambda c: F.length(F.regexp_extract(c["value"], java(r"^\s*"), 0))
    trimmed = F.transform(agree, lambda c: F.struct(
        c["type"].alias("type"), (c["start"] + lead(c)).alias("start"), (c["start"] + lead(c) + F.length(bare(c))).alias("stop"), bare(c).alias("value"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), c["confidence"])).alias("confidence"), c["detector"].alias("detector"), c["signals"].alias("signals"),
    ))
    ok = F.filter(trimmed, lambda c: (c["value"] != "") & ((c["type"] != "PHONE") | credible_phone(c["value"])))
    shaped = F.transform(
        ok,
        lambda c, i: F.struct(
            c["start"].cast("int").alias("start"), F.element_at(ranks, c["type"]).alias("rank"),
            (-F.greatest(c["confidence"], F.element_at(floors, c["type"]))).alias("doubt"), (i + 1000).alias("ordinal"),
            c["stop"].cast("int").alias("stop"), c["type"].alias("type"), c["value"].alias("value"),
            F.greatest(c["confidence"], F.element_at(floors, c["type"])).alias("confidence"),
            F.coalesce(c["detector"], F.lit("external_candidate")).alias("detector"),
        ),
    ).cast(f"array<{CANDIDATE}>")
    others = F.filter(shaped, lambda c: (c["type"] != "PERSON") & (c["confidence"] >= F.element_at(thresholds, c["type"])))
    people = F.transform(
        F.filter(ok, lambda c: c["type"] == "PERSON"),
        lambda c: F.struct(
            c["start"].cast("int").alias("start"), c["stop"].cast("int").alias("stop"), c["value"].alias("value"), c["confidence"].alias("base"),
            F.coalesce(c["detector"], F.lit("external_candidate")).alias("detector"), F.coalesce(c["signals"], F.array().cast("array<string>")).alias("signals"),
        ),
    )
    return F.concat(others, people_candidates(validated(text, people), 2000))


def people_candidates(found: Column, ordinal: int) -> Column:
    """Validated names in the shape of candidates."""
    return F.transform(
        found,
        lambda x, i: F.struct(
            x["start"], F.lit(RANK["PERSON"]).alias("rank"), (-x["confidence"]).alias("doubt"), (i + ordinal).alias("ordinal"), x["stop"], F.lit("PERSON").alias("type"),
            x["value"], x["confidence"], x["detector"],
        ),
    ).cast(f"array<{CANDIDATE}>")


def resolved(found: Column) -> Column:
    """Entities without overlaps: candidates in order of place, type priority and confidence meet the first
    accepted one that they overlap, and replace it on a higher score (twice the priority plus confidence),
    or on the same score if they are longer.

    Of the accepted ones only those that end after a candidate's start are looked at: candidates come by their starts, so the others
    overlap none that follows. Those are done, and the work is linear in the candidates of a text."""
    kind = f"array<{CANDIDATE}>"

    def score(c: Column) -> Column:
        return c["confidence"] - 2 * c["rank"]

    def meet(accepted: Column, c: Column) -> Column:
        first = F.get(F.filter(accepted, lambda a: (a["start"] < c["stop"]) & (c["start"] < a["stop"])), F.lit(0))
        return F.get(F.transform(F.array(first), lambda x: met(accepted, c, x)), F.lit(0))

    def met(accepted: Column, c: Column, first: Column) -> Column:
        longer = (c["stop"] - c["start"]) > (first["stop"] - first["start"])
        better = (score(c) > score(first)) | ((score(c) == score(first)) & longer)
        return (
            F.when(first.isNull(), F.concat(accepted, F.array(c)))
            .when(better, F.transform(accepted, lambda a: F.when(a == first, c).otherwise(a)))
            .otherwise(accepted)
        )

    def step(acc: Column, c: Column) -> Column:
        over = F.filter(acc["open"], lambda a: a["stop"] <= c["start"])
        done = F.when(F.exists(acc["open"], lambda a: a["stop"] <= c["start"]), F.concat(acc["done"], over)).otherwise(acc["done"])
        still = F.filter(acc["open"], lambda a: a["stop"] > c["start"])
        return F.struct(done.alias("done"), F.get(F.transform(F.array(still), lambda o: meet(o, c)), F.lit(0)).alias("open"))

    none = F.array().cast(kind)
    start = F.struct(none.alias("done"), none.alias("open"))
    return F.array_sort(F.aggregate(F.array_sort(found), start, step, lambda acc: F.concat(acc["done"], acc["open"])))


def stable_key(kind: Column, value: Column) -> Column:
    """What values of a type that share a placeholder have in common: white space is collapsed, names ignore case."""
    key = F.trim(F.regexp_replace(value, java(r"\s+"), " "))
    return F.when(kind == "PERSON", F.lower(key)).otherwise(key)


def placeholder_ids(text: Column, entities: Column) -> Column:
    """One placeholder per entity: by type, numbered by first appearance of the value, after numbers in the text."""
    keys = F.array_distinct(
        F.transform(entities, lambda e: F.struct(e["type"].alias("type"), stable_key(e["type"], e["value"]).alias("key")))
    )
    seen = F.transform(
        F.regexp_extract_all(text, F.lit(PLACEHOLDER), F.lit(0)),
        lambda p: F.struct(F.regexp_extract(p, PLACEHOLDER, 1).alias("type"), F.regexp_extract(p, PLACEHOLDER, 2).cast("int").alias("n")),
    )

    def identify(e: Column) -> Column:
        base = F.coalesce(F.array_max(F.transform(F.filter(seen, lambda s: s["type"] == e["type"]), lambda s: s["n"])), F.lit(0))
        mine = F.transform(F.filter(keys, lambda k: k["type"] == e["type"]), lambda k: k["key"])
        key = stable_key(e["type"], e["value"])
        return F.concat(F.lit("["), e["type"], F.lit("_"), (base + F.array_position(mine, key)).cast("string"), F.lit("]"))

    return F.transform(entities, identify)


def spliced(text: Column, entities: Column, ids: Column) -> Column:
    """The text with each entity replaced by its placeholder."""
    pieces = F.transform(
        entities,
        lambda e, i: F.concat(
            F.substring(text, _from(entities, i) + 1, e["start"] - _from(entities, i)), F.get(ids, i)
        ),
    )
    last = F.when(F.size(entities) > 0, F.element_at(entities, -1)["stop"]).otherwise(0)
    return F.concat(F.array_join(pieces, ""), F.substring(text, last + 1, F.length(text)))


def _from(entities: Column, i: Column) -> Column:
    return F.when(i > 0, F.get(entities, i - 1)["stop"]).otherwise(0)


def context_flags(lower: Column) -> Column:
    """Names of the regulated contexts and instruction bypasses of a text, from ascii_lower.

    Word by word: whether the text holds it at all is found fast, and only then whether it stands there as a word.
    """
    found = []
    for name, single, parts, phrases in CONTEXT_WORDS:
        whole = lambda w: F.contains(lower, F.lit(w)) & lower.rlike(rf"{w}(?<![a-z0-9_]{w})(?![a-z0-9_])")
        hit = reduce(Column.__or__, map(whole, single))
        if phrases:
            some = reduce(Column.__or__, [F.contains(lower, F.lit(p)) for p in parts])
            hit = hit | (some & lower.rlike(f"(?<![a-z0-9_]){phrases}(?![a-z0-9_])"))
        found.append(F.when(hit, F.lit(name)))
    return F.array_compact(F.array(*found))


def flagged(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """(keep..., flags): flags without resolving overlaps or redacting, the scan for text that is not sent on.

    Null texts are scanned as empty. Each text is lower-cased once, and searched
    with those regular expressions only whose literals it holds.
    """
    base = docs.select(*keep, F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    base = base.select("*", ascii_lower(F.col("_text")).alias("_lower"))
    text, lower, found = F.col("_text"), F.col("_lower"), []
    for kind in ("EMAIL", "PHONE", "SECRET", "ADDRESS", "ACCOUNT"):
        hits = []
        for _, name, _, ignore, pattern in [d for d in DETECTORS if d[0] == kind]:
            hit = text.rlike(java(pattern, ignore))
            if kind == "PHONE":
                phones = F.regexp_extract_all(text, F.lit(java(pattern)), F.lit(0))
                hit = F.exists(phones, lambda m: m.rlike(java(r"[\s().-]")) | m.rlike(r"^\+?1"))
            hits.append(may_match(name, text, lower, ignore) & hit)
        found.append(F.when(reduce(Column.__or__, hits), F.lit(ENTITY_TYPES[kind][2])))
    flags = F.concat(F.filter(F.array(*found), lambda x: x.isNotNull()), context_flags(lower))
    return base.select(*keep, flags.alias("flags"))


def severity(flag: Column) -> Column:
    named = {v[2]: v[3] for v in ENTITY_TYPES.values() if v[2]} | {n: s for n, s, _ in CONTEXTS}
    return F.element_at(F.create_map(*[F.lit(x) for pair in named.items() for x in pair]), flag)


def flag_details(flags: Column, stage: Column | str = "preflight") -> Column:
    """array<struct<type, label, severity, stage, evidence>> of flag names, in their order."""
    say = lambda i: F.create_map(*[F.lit(x) for n, t in FLAG_TEXTS.items() for x in (n, t[i])])
    at = F.lit(stage) if isinstance(stage, str) else stage
    return F.transform(flags, lambda f: F.struct(f.alias("type"), F.try_element_at(say(0), f).alias("label"), severity(f).alias("severity"), at.alias("stage"), F.try_element_at(say(1), f).alias("evidence")))


def risk_score(flags: Column, sensitivity: Column | None = None) -> Column:
    """Base plus the weight of each flag's severity, plus a boost for sensitive workspaces, at most 100."""
    weights = F.create_map(*[F.lit(x) for pair in SEVERITY_WEIGHTS.items() for x in pair])
    total = F.aggregate(flags, F.lit(BASE_RISK), lambda n, f: n + F.element_at(weights, severity(f)))
    boost = F.when(sensitivity.isin(*SENSITIVE), SENSITIVITY_BOOST).otherwise(0) if sensitivity is not None else F.lit(0)
    return F.least(F.lit(TOP_RISK), total + boost)


def risk_level(score: Column) -> Column:
    return F.when(score >= 85, "critical").when(score >= 60, "high").when(score >= 35, "medium").otherwise("low")


def scan_action(flags: Column) -> Column:
    """block on instruction bypass, redact on secrets or personal data, warn on regulated contexts, else allow."""
    has = lambda *names: F.arrays_overlap(flags, F.array(*map(F.lit, names)))
    return (
        F.when(has("prompt_injection"), "block")
        .when(has("secret", "email", "phone", "address", "account", "possible_name"), "redact")
        .when(has("regulated_financial", "regulated_legal", "regulated_medical", "regulated_hr"), "warn")
        .otherwise("allow")
    )


EXTERNAL = "array<struct<type:string,start:int,stop:int,value:string,confidence:double,detector:string,signals:array<string>>>"


def scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", external: str | None = None, sensitivity: str = "Internal", persons: str | None = "hybrid", products: tuple[str, ...] = ()
) -> DataFrame:
    """One row per document: id, entities, redacted, redaction_map, entity_counts, flags, risk_score, action.

    Null texts are scanned as empty. ``external`` names a column of further candidates (EXTERNAL).
    The field ``signals`` may be missing from it.
    ``persons`` is the profile of the rules for names (see names.names), or None for none of them; ``products`` are words that no name holds.
    """
    given = []
    if external:
        has = docs.schema[external].dataType.elementType.fieldNames()
        fields = ("type", "start", "stop", "value", "confidence", "detector", "signals")
        shaped = F.transform(F.col(external), lambda c: F.struct(*[(c[f] if f in has else F.lit(None)).alias(f) for f in fields])).cast(EXTERNAL)
        given = [F.coalesce(shaped, F.array().cast(EXTERNAL)).alias("given")]
    base = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *given)
    base = base.select("*", ascii_lower(F.col("text")).alias("lower"))
    if persons:  # a step of its own, as later ones read it more than once
        base = base.select("*", people_candidates(names(F.col("text"), persons, products, F.col("lower")), 100).alias("people"))
    found = [candidates(F.col("text"), F.col("lower")), *([F.col("people")] if persons else [])]
    if external:
        found.append(external_candidates(F.col("text"), F.col("given")))
    found = F.concat(*found)
    step = base.select(id_col, "text", found.alias("found"), context_flags(F.col("lower")).alias("contexts"))
    step = step.select(id_col, "text", "contexts", resolved(F.col("found")).alias("entities"))
    step = step.select("*", placeholder_ids(F.col("text"), F.col("entities")).alias("ids"))
    kinds = F.array_distinct(F.transform("entities", lambda e: e["type"]))
    flag_of = _type_map(lambda t, v: v[2] or "")
    flags = F.concat(F.filter(F.transform(kinds, lambda k: F.element_at(flag_of, k)), lambda f: f != ""), F.col("contexts"))
    step = step.select(
        id_col,
        F.transform(F.arrays_zip(F.col("entities").alias("e"), F.col("ids").alias("i")), lambda z: F.struct(
            z["i"].alias("id"), z["e"]["type"].alias("type"), z["e"]["value"].alias("original"), z["e"]["start"].alias("start"),
            z["e"]["stop"].alias("stop"), z["e"]["confidence"].alias("confidence"), z["e"]["detector"].alias("detector"))).alias("entities"),
        spliced(F.col("text"), F.col("entities"), F.col("ids")).alias("redacted"),
        flags.alias("flags"),
    )
    unique = F.array_distinct(F.transform("entities", lambda e: F.struct(e["id"].alias("id"), e["type"].alias("type"))))
    return step.select(
        "*",
        F.transform(unique, lambda u: F.struct(u["id"], F.get(F.filter("entities", lambda e: e["id"] == u["id"]), F.lit(0))["original"].alias("original"))).alias("redaction_map"),
        F.map_from_entries(F.transform(F.array_distinct(F.transform(unique, lambda u: u["type"])), lambda t: F.struct(t, F.size(F.filter(unique, lambda u: u["type"] == t))))).alias("entity_counts"),
        risk_score(F.col("flags"), F.lit(sensitivity)).alias("risk_score"),
        scan_action(F.col("flags")).alias("action"),
    )


def entity_rows(scanned: DataFrame, *keep: str) -> DataFrame:
    """(keep..., e): a row per entity of a scan. The explode is an outer one: Spark would infer a filter from an
    inner one and evaluate the whole scan again for it."""
    return scanned.select(*keep, F.explode_outer("entities").alias("e")).where("e is not null")


def rehydrated(text: Column, redaction_map: Column) -> Column:
    """struct<text, replaced, unresolved, spans>: known placeholders put back, secrets and unknown ones left.

    redaction_map: array of (id, original). spans are the places of what was put back in the new text, in code points.
    """
    marks = F.regexp_extract_all(text, F.lit(PLACEHOLDER), F.lit(0))
    between = F.split(text, PLACEHOLDER, -1)

    def original(p: Column) -> Column:
        return F.when(~p.startswith("[SECRET_"), F.get(F.filter(redaction_map, lambda m: m["id"] == p), F.lit(0))["original"])

    pieces = F.transform(between, lambda b, i: F.concat(b, F.coalesce(original(F.get(marks, i)), F.get(marks, i), F.lit(""))))
    missing = F.filter(marks, lambda p: original(p).isNull())
    # What stands before each mark and what takes its place, walked once for the places in the new text.
    steps = F.transform(marks, lambda p, i: F.struct(F.length(F.get(between, i)).alias("gap"), p.alias("id"), original(p).alias("value")))
    kind = "array<struct<id:string,start:int,stop:int>>"

    def walk(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        stop = start + F.length(F.coalesce(x["value"], x["id"]))
        new = F.struct(x["id"].alias("id"), start.alias("start"), stop.alias("stop"))
        return F.struct(stop.alias("at"), F.when(x["value"].isNotNull(), F.array_append(acc["out"], new)).otherwise(acc["out"]).cast(kind).alias("out"))

    spans_ = F.aggregate(steps, F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out")), walk, lambda acc: acc["out"])
    return F.struct(
        F.array_join(pieces, "").alias("text"),
        (F.size(marks) - F.size(missing)).alias("replaced"),
        F.array_distinct(missing).alias("unresolved"),
        spans_.alias("spans"),
    )
