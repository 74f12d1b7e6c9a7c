"""Names of persons as column expressions: candidates, context, confidence.

A text is searched for runs of capitalised words, for lists after words that introduce people, and
for two words after a cue. Only what these find is looked at word by word, in arrays within the row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .patterns import ascii_lower, java
from .spans import pieces, spans

# Words, phrases and weights of the rules for names.
FALSE_WORDS = (
    "a", "about", "access", "account", "action", "admin", "ai", "api", "application", "approval", "ask", "base", "best", "boss", "business", "birthday", "builder",
    "case", "candidate", "center", "chat", "claims", "client", "code", "company", "contact", "context", "contract", "compiler", "customer", "dashboard", "data", "dear",
    "defense", "defensive", "draft", "email", "encryption", "endpoint", "engineering", "employee", "failed", "family", "financial", "files", "follow", "folders",
    "friends", "governance", "graphql", "hello", "help", "human", "intelligence", "instrumentation", "invitations", "injection", "is", "less", "loan", "list", "manager",
    "management", "meeting", "message", "medical", "model", "motion", "my", "network", "notice", "null", "office", "operations", "patient", "platform", "planning",
    "plan", "policy", "portal", "product", "project", "provider", "prompt", "protocol", "records", "out", "query", "reaching", "react", "regex", "request", "report",
    "resources", "rest", "response", "review", "reviewing", "risk", "sales", "search", "security", "success", "support", "state", "stored", "system", "team", "technical",
    "template", "typescript", "admins", "users", "validator", "tell", "the", "to", "token", "transfer", "update", "up", "user", "write", "work", "workspace", "york",
    "you",
)
FALSE_PHRASES = (
    "artificial intelligence platform", "customer support team", "monday client meeting", "new york", "new york office", "openai api", "q3 risk review",
    "react state update", "representational state transfer",
)
COMPANY_WORDS = ("anthropic", "api", "chat", "chatgpt", "claude", "gemini", "google", "northstar", "openai")
FIRST_NAMES = (
    "alex", "aisha", "alice", "bob", "david", "jane", "jean-pierre", "joao", "joão", "john", "jose", "josé", "li", "ludwig", "maria", "maría", "mary", "mary-kate", "mike",
    "mohammed", "nguyễn", "saoirse", "sarah", "wei",
)
PARTICLES = ("al", "bint", "bin", "da", "de", "del", "der", "di", "dos", "du", "la", "le", "van", "von")
LIST_STOPS = (
    "are", "arrived", "abt", "about", "after", "because", "before", "by", "called", "came", "can", "coming", "could", "is", "left", "next", "needs", "re", "regarding",
    "should", "that", "the", "to", "today", "tomorrow", "tonight", "was", "were", "will", "would",
)
INTRODUCERS = r"\b(?:(?:my|the|these|those|our)\s+)?(?:friends|people|recipients|invitees|attendees|employees|candidates|patients|reviewers|approvers|contacts|customers|clients|team\s+members|participants|guests|coworkers|colleagues)\b(?:\s+(?:are|include|includes))?|\b(?:invite(?:\s+(?:my\s+friends|these\s+people|the\s+attendees|the\s+recipients))?|send(?:\s+this)?\s+to|email(?:\s+the\s+recipients)?|copy|cc|message|contact|ask|tell|write\s+to|reply\s+to)\b"
#: In lower case, of which a text holds at least one if it holds an introducer.
INTRODUCING = (
    "friends", "people", "recipients", "invit", "attendees", "employees", "candidates", "patients", "reviewers", "approvers", "contact", "customers", "clients", "members",
    "participants", "guests", "coworkers", "colleagues", "send", "email", "copy", "cc", "message", "ask", "tell", "write", "reply",
)
CUES = r"\b(?:to|from|for|ask|named|name is|customer|client|employee|candidate|patient|email|message)\s+([\p{L}\p{M}]+(?:[-'’][\p{L}\p{M}]+)?\s+[\p{L}\p{M}]+(?:[-'’][\p{L}\p{M}]+)?)\b"
BEFORE = r"\b(?:to|from|for|ask|tell|reply to|email|message|write|draft|named|name is|dear|hi|hello|customer|client|patient|employee|candidate)\s+$"
AFTER = r"^\s*(?:approved|emailed|called|said|asked|denied|requested|received|submitted|signed|needs|wants)\b"
EMAIL_NEAR = r"\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"
ROLE_NEAR = r"\b(?:employee|candidate|patient|customer|client|manager|reviewer|approver)\b"
LOCAL_CUES = r"\b(?:ask|tell|email|message|contact|reply to|customer|client|patient|employee|candidate|reviewer|approver)\b"
LOCAL_ACTIONS = r"\b(?:approved|emailed|called|said|asked|signed|reviewed|completed|sent)\b"
WEIGHTS = {
    "comma_separated_human_list": 0.08, "conversation_stable": 0.24, "coordinated_human_context": 0.1, "detector_agreement": 0.12, "direct_human_recipient": 0.14,
    "human_action_context": 0.12, "human_list_context": 0.22, "inherited_human_action_context": 0.14, "local_person_candidate": 0.12, "near_name_context": 0.18,
    "near_human_action": 0.16, "near_email": 0.14, "near_person_role": 0.1, "ner_person": 0.16,
}
STRONG = (
    "human_list_context", "human_action_context", "inherited_human_action_context", "coordinated_human_context", "comma_separated_human_list", "direct_human_recipient",
    "near_email", "conversation_stable",
)
HUMAN = (
    "near_name_context", "near_human_action", "near_email", "near_person_role", "conversation_stable", "human_list_context", "human_action_context",
    "inherited_human_action_context", "coordinated_human_context", "direct_human_recipient",
)
THRESHOLD, MOST = 0.74, 0.97

_LETTER = r"[\p{L}\p{M}]"
# What repeats as a group never gives back what it took: a word's end is a word's end however much was read. So the
# possessive forms find the same, and Java repeats them in a loop instead of a call for each word, of which some thousands overflow its stack.
TOKEN = rf"{_LETTER}+(?:[-'’]{_LETTER}+)*+"
_ENDS = rf"(?!{_LETTER})(?![-'’]{_LETTER})"
# The capital comes first, so that little else is tried at most places.
_CAPITAL = rf"\p{{Lu}}(?<!{_LETTER}\p{{Lu}})(?<!{_LETTER}[-'’]\p{{Lu}})"
_REST = rf"{_LETTER}*(?:[-'’]{_LETTER}+)*+"
_PARTICLE = rf"(?i:{'|'.join(sorted(PARTICLES, key=len, reverse=True))}){_ENDS}"
RUN = rf"{_CAPITAL}{_REST}(?:\s+(?:\p{{Lu}}{_REST}|{_PARTICLE}))++{_ENDS}"
FOUND = "array<struct<start:int,stop:int,value:string,base:double,detector:string,signals:array<string>>>"


def _has(values: Column, names) -> Column:
    return F.arrays_overlap(values, F.array(*map(F.lit, names)))


def _lower(token: Column) -> Column:
    return F.replace(F.lower(token), F.lit("’"), F.lit("'"))


def capitalised(token: Column) -> Column:
    """An upper-case first letter, and not an acronym of several upper-case letters."""
    return token.rlike(r"^\p{Lu}") & (token.rlike(r"\p{Ll}") | ~token.rlike(r"\p{L}.*\p{L}"))


def _strings(names: list) -> Column:
    return F.array(*names).cast("array<string>")


def _named(items: Column, base, detector, signals) -> Column:
    """Candidates of spans (start, stop, value); the rest from functions of a span."""
    shape = lambda x: F.struct(x["start"], x["stop"], x["value"], base(x).cast("double").alias("base"), detector(x).alias("detector"), signals(x).alias("signals"))
    return F.transform(items, shape).cast(FOUND)


def _windows(text: Column) -> Column:
    """Spans of two to five words in a row that begin and end capitalised, particles between them allowed, with n words."""

    def kinds(run: Column) -> Column:
        return F.transform(spans(run["value"], TOKEN), lambda t: F.struct(t["start"], t["stop"], capitalised(t["value"]).alias("cap"), _lower(t["value"]).isin(*PARTICLES).alias("particle")))

    def of_run(run: Column) -> Column:
        cut = F.transform(
            F.sequence(F.lit(0), F.size(run["kinds"]) - 2),
            lambda i: F.transform(F.sequence(F.lit(2), F.least(F.lit(5), F.size(run["kinds"]) - i)), lambda n: F.slice(run["kinds"], i + 1, n)),
        )
        good = F.filter(F.flatten(cut), lambda w: F.get(w, F.lit(0))["cap"] & F.element_at(w, -1)["cap"] & F.forall(w, lambda t: t["cap"] | t["particle"]))
        return F.transform(good, lambda w: F.struct(
            (run["start"] + F.get(w, F.lit(0))["start"]).alias("start"), (run["start"] + F.element_at(w, -1)["stop"]).alias("stop"),
            F.substring(run["value"], F.get(w, F.lit(0))["start"] + 1, F.element_at(w, -1)["stop"] - F.get(w, F.lit(0))["start"]).alias("value"), F.size(w).alias("n"),
        ))

    # What a lambda reads more than once is a field made before it, as lambdas don't keep common parts.
    runs = F.transform(spans(text, java(RUN)), lambda r: F.struct(r["start"], r["value"], kinds(r).alias("kinds")))
    return F.flatten(F.transform(runs, of_run))


def capitalised_names(text: Column) -> Column:
    return _named(
        _windows(text), lambda x: 0.62 + F.when(x["n"] > 2, 0.04).otherwise(0.0),
        lambda x: F.when(x["n"] > 2, "capitalized_multi_token_name").otherwise("capitalized_two_token_name"), lambda x: _strings([]),
    )


def local_names(text: Column) -> Column:
    """The same spans with the evidence of the second detector: cues, addresses and actions up to 80 characters away."""

    def signals(near: Column) -> Column:
        found = F.array(
            F.lit("local_person_candidate"), F.when(near.rlike(java(LOCAL_CUES, True)), "near_name_context"),
            F.when(near.rlike(java(EMAIL_NEAR, True)), "near_email"), F.when(near.rlike(java(LOCAL_ACTIONS, True)), "near_human_action"),
        )
        return F.array_compact(found)

    seen = F.transform(_windows(text), lambda x: F.struct(x["start"], x["stop"], x["value"], x["n"], _around(text, x["start"], x["stop"], 80).alias("near")))
    return _named(seen, lambda x: 0.70 + F.when(x["n"] > 2, 0.04).otherwise(0.0), lambda x: F.lit("local_person_detector_v1"), lambda x: signals(x["near"]))


def _around(text: Column, start: Column, stop: Column, reach: int) -> Column:
    first = F.greatest(F.lit(0), start - reach)
    return F.substring(text, first + 1, stop + reach - first)


def listed_names(text: Column, lower: Column | None = None) -> Column:
    """Names in lists after an introducer: up to 220 characters of the sentence, cut at commas, semicolons and 'and'. lower is ascii_lower(text)."""

    def tail(m: Column) -> Column:
        rest = F.substring(text, m["stop"] + 1, F.length(text))
        return F.struct((m["stop"] + F.length(F.regexp_extract(rest, java(r"^[\s:=\[(\"'`]*"), 0))).alias("at"))

    def segment(m: Column) -> Column:
        return F.struct(m["at"], F.regexp_extract(F.substring(text, m["at"] + 1, F.lit(220)), r"^[^.!?\]]*", 0).alias("value"))

    def listed(m: Column) -> Column:
        items = F.filter(pieces(m["value"], java(r"\s*(?:,|;|\band\b)\s*", True)), lambda x: x["value"] != "")
        words = F.transform(items, lambda x: F.struct(x["start"], x["value"], spans(x["value"], TOKEN).alias("tokens")))
        stops = lambda x: F.array_min(F.transform(x["tokens"], lambda t, k: F.when((k >= 2) & _lower(t["value"]).isin(*LIST_STOPS), k)))
        cut = F.transform(words, lambda x: F.struct(x["start"], x["value"], F.slice(x["tokens"], F.lit(1), F.coalesce(stops(x), F.size(x["tokens"]))).alias("tokens")))
        return F.struct(m["at"], cut.alias("items"), m["value"].rlike(java(r"\b(?:and)\b|[,;]", True)).alias("joined"))

    def of_list(m: Column) -> Column:
        several = F.size(m["items"]) > 1
        joined = several | m["joined"]

        def of_item(x: Column, i: Column) -> Column:
            first, last = F.get(x["tokens"], F.lit(0))["start"], F.element_at(x["tokens"], -1)["stop"]
            signals = F.array_compact(F.array(
                F.lit("human_list_context"), F.when(i == 0, "human_action_context").otherwise("inherited_human_action_context"),
                F.when(joined, "coordinated_human_context"), F.when(several, "comma_separated_human_list"),
            ))
            at = m["at"] + x["start"]
            return F.when(F.size(x["tokens"]).between(2, 5), F.struct(
                (at + first).alias("start"), (at + last).alias("stop"), F.substring(x["value"], first + 1, last - first).alias("value"), F.lit(0.72).alias("base"),
                F.when(joined, "coordinated_human_sequence").otherwise("human_list_context_name").alias("detector"), signals.alias("signals"),
            ))

        return F.array_compact(F.transform(m["items"], of_item))

    of_introducer = lambda ms: F.transform(F.transform(F.transform(F.transform(ms, tail), segment), listed), of_list)
    some = F.exists(F.array(ascii_lower(text) if lower is None else lower), lambda t: reduce(Column.__or__, [F.contains(t, F.lit(w)) for w in INTRODUCING]))
    found = F.flatten(of_introducer(spans(text, java(INTRODUCERS, True), some))).cast(FOUND)
    # Lists may be introduced twice; the first introducer counts.
    first = lambda acc, x: F.when(F.exists(acc, lambda y: (y["start"] == x["start"]) & (y["stop"] == x["stop"])), acc).otherwise(F.array_append(acc, x))
    return F.aggregate(found, F.array().cast(FOUND), first)


def cued_names(text: Column) -> Column:
    """Two words of any case after a cue in lower case.

    Left out are those that validation would refuse by their first word: it is neither capitalised nor a particle nor a known
    first name, and there is no address in the text that could speak for it.
    """
    pattern = java(CUES)
    after = lambda m: F.regexp_extract(m["value"], f"^{pattern}", 1)
    items = F.transform(spans(text, pattern), lambda m: F.struct((m["stop"] - F.length(after(m))).alias("start"), m["stop"].alias("stop"), after(m).alias("value")))
    first = lambda m: _lower(F.regexp_extract(m["value"], rf"^{TOKEN}", 0))
    items = F.when(F.contains(text, F.lit("@")), items).otherwise(F.filter(items, lambda m: m["value"].rlike(r"^\p{Lu}") | first(m).isin(*FIRST_NAMES, *PARTICLES)))
    return _named(items, lambda x: F.lit(0.7), lambda x: F.lit("lowercase_context_name"), lambda x: F.array(F.lit("near_name_context")))


def validated(text: Column, found: Column, products: tuple[str, ...] = ()) -> Column:
    """(start, stop, value, confidence, detector, signals) of the candidates that are names, with their confidence.

    ``products`` are further words, in lower case, that no name holds, such as a product's own name."""
    words = lambda c: F.transform(F.regexp_extract_all(c["value"], F.lit(TOKEN), F.lit(0)), lambda t: F.struct(t.alias("text"), _lower(t).alias("lower")))
    shaped = F.filter(found, lambda c: c["value"].rlike(java(rf"^{TOKEN}(?:\s+{TOKEN}){{1,4}}$")))
    shaped = F.transform(shaped, lambda c: F.struct(*[c[n].alias(n) for n in ("start", "stop", "value", "base", "detector", "signals")], words(c).alias("words")))
    lows = lambda c: F.transform(c["words"], lambda t: t["lower"])
    real = lambda c: F.filter(lows(c), lambda w: ~w.isin(*PARTICLES))
    phrase = lambda c: F.lower(F.regexp_replace(c["value"], java(r"\s+"), " "))
    gated = F.filter(
        shaped,
        lambda c: (F.size(real(c)) >= 2) & ~phrase(c).isin(*FALSE_PHRASES) & ~_has(lows(c), (*FALSE_WORDS, *products)) & ~_has(lows(c), COMPANY_WORDS)
        & ~c["value"].rlike(java(r"\b(?:my boss|my company|my project|you)\b", True)),
    )

    def signals(c: Column) -> Column:
        before = F.lower(F.substring(text, F.greatest(F.lit(0), c["start"] - 42) + 1, F.least(F.lit(42), c["start"])))
        after = F.lower(F.substring(text, c["stop"] + 1, F.lit(56)))
        near = _around(text, c["start"], c["stop"], 70)
        more = F.array_compact(F.array(
            F.when(before.rlike(java(BEFORE)), "near_name_context"), F.when(after.rlike(java(AFTER)), "near_human_action"),
            F.when(near.rlike(java(EMAIL_NEAR, True)), "near_email"), F.when(near.rlike(java(ROLE_NEAR, True)), "near_person_role"),
        ))
        return F.array_distinct(F.concat(c["signals"], more))

    every = lambda c, test: F.forall(c["words"], lambda t: test(t["text"]) | t["lower"].isin(*PARTICLES))
    lowered = lambda t: t.rlike(r"^\p{Ll}")
    seen = F.transform(gated, lambda c: F.struct(
        c["start"].alias("start"), c["stop"].alias("stop"), c["value"].alias("value"), c["base"].alias("base"), c["detector"].alias("detector"), signals(c).alias("signals"),
        real(c).alias("real"), F.size(c["words"]).alias("n"), every(c, capitalised).alias("title"), every(c, lowered).alias("lower"),
    ))
    outside = lambda c: F.contains(c["detector"], F.lit("ner")) | F.contains(c["detector"], F.lit("person_detector")) | _has(c["signals"], ("ner_person", "local_person_candidate"))
    plausible = lambda c: F.size(c["real"]).between(2, 3) & (_has(c["signals"], STRONG) | F.get(c["real"], F.lit(0)).isin(*FIRST_NAMES))
    kept = F.filter(seen, lambda c: (~c["lower"] | plausible(c) | outside(c)) & (c["title"] | c["lower"] | outside(c)))
    weights = F.create_map(*[F.lit(x) for pair in WEIGHTS.items() for x in pair])
    part = lambda test, x: F.when(test, x).otherwise(0.0)

    def confidence(c: Column) -> Column:
        fixed = (
            c["base"] + part(c["title"], 0.05) + part(c["lower"], 0.02) + part(c["n"] > 2, 0.04) + part(F.size(c["real"]) < c["n"], 0.05) + part(outside(c), 0.16)
            + part(_has(c["signals"], STRONG), 0.08) + part(_has(c["signals"], HUMAN), 0.04)
        )
        return F.aggregate(c["signals"], fixed, lambda n, s: n + F.coalesce(F.element_at(weights, s), F.lit(0.0)))

    rated = F.transform(kept, lambda c: F.struct(c["start"], c["stop"], c["value"], confidence(c).alias("confidence"), c["detector"], c["signals"]))
    named = F.transform(rated, lambda c: F.struct(c["start"], c["stop"], c["value"], F.least(F.lit(MOST), c["confidence"]).alias("confidence"), c["detector"], c["signals"]))
    return F.filter(named, lambda c: c["confidence"] >= THRESHOLD)


def names(text: Column, profile: str = "hybrid", products: tuple[str, ...] = (), lower: Column | None = None) -> Column:
    """Validated names. ``core`` has the rules on capitals, lists and cues; ``hybrid`` adds the second detector,
    whose candidates have the spans of the first with more confidence and so stand in their place."""
    if profile not in ("core", "hybrid"):
        raise ValueError("profile must be core or hybrid")
    first = local_names(text) if profile == "hybrid" else capitalised_names(text)
    return validated(text, F.concat(first, listed_names(text, lower), cued_names(text)), products)


def provenance(text: Column) -> Column:
    """array<struct<start, stop, value, source>> of validated names: found by the rules ('heuristic'), by the second detector ('local') or by both.

    Names are taken before overlaps are resolved and meet by their place.
    """
    place = lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("stop"), x["value"].alias("value"))
    rules = F.array_distinct(F.transform(validated(text, F.concat(capitalised_names(text), listed_names(text), cued_names(text))), place))
    second = F.array_distinct(F.transform(validated(text, local_names(text)), place))
    both = F.struct(rules.alias("rules"), second.alias("second"))

    def told(x: Column, name: str) -> Column:
        return F.struct(x["start"], x["stop"], x["value"], F.lit(name).alias("source"))

    # One evaluation of both: what a lambda reads is a field made before it.
    of = lambda b: F.array_sort(F.concat(
        F.transform(F.array_intersect(b["rules"], b["second"]), lambda x: told(x, "both")),
        F.transform(F.array_except(b["rules"], b["second"]), lambda x: told(x, "heuristic")),
        F.transform(F.array_except(b["second"], b["rules"]), lambda x: told(x, "local")),
    ))
    return F.get(F.transform(F.array(both), of), F.lit(0))


def ner_names(text: Column, tokens: Column, detector: str = "local_ner_model") -> Column:
    """Candidates of a recogniser's tokens (entity, score, start, stop): labelled person tokens in a row, over gaps of
    spaces, hyphens and apostrophes, are one span with their mean score; a B- label opens a new one. Spans are
    trimmed to letters; tokens out of range end a span; a missing score is 0.9."""
    shape = "struct<start:int,stop:int,total:double,n:int>"
    state = F.struct(F.array().cast(f"array<{shape}>").alias("done"), F.lit(False).alias("open"))
    person = lambda t: F.upper(F.trim(t["entity"])).rlike(r"^(?:[BI]-)?(?:PER|PERSON)$") & (t["start"] >= 0) & (t["stop"] > t["start"]) & (t["stop"] <= F.length(text))

    def step(acc: Column, t: Column) -> Column:
        score = F.when(F.abs(t["score"]) < float("inf"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), t["score"]))).otherwise(0.9)
        last = F.element_at(acc["done"], -1)
        goes_on = acc["open"] & ~F.upper(F.trim(t["entity"])).startswith("B-") & F.substring(text, last["stop"] + 1, t["start"] - last["stop"]).rlike(java(r"^[\s'’-]*$"))
        new = F.struct(t["start"].cast("int").alias("start"), t["stop"].cast("int").alias("stop"), score.alias("total"), F.lit(1).alias("n"))
        more = F.struct(last["start"].alias("start"), t["stop"].cast("int").alias("stop"), (last["total"] + score).alias("total"), (last["n"] + 1).alias("n"))
        grown = F.when(goes_on, F.array_append(F.slice(acc["done"], F.lit(1), F.size(acc["done"]) - 1), more)).otherwise(F.array_append(acc["done"], new))
        hit = F.coalesce(person(t), F.lit(False))
        return F.struct(F.when(hit, grown).otherwise(acc["done"]).cast(f"array<{shape}>").alias("done"), hit.alias("open"))

    merged = F.aggregate(tokens, state, step, lambda acc: acc["done"])

    def trimmed(s: Column) -> Column:
        value = F.substring(text, s["start"] + 1, s["stop"] - s["start"])
        lead = F.length(F.regexp_extract(value, rf"^[^\p{{L}}\p{{M}}]*", 0))
        bare = F.regexp_replace(value, r"^[^\p{L}\p{M}]+|[^\p{L}\p{M}]+$", "")
        return F.struct((s["start"] + lead).alias("start"), (s["start"] + lead + F.length(bare)).alias("stop"), bare.alias("value"), (s["total"] / s["n"]).alias("base"))

    found = F.filter(F.transform(merged, trimmed), lambda s: s["value"] != "")
    return _named(found, lambda s: s["base"], lambda s: F.lit(detector), lambda s: F.array(F.lit("ner_person")))
