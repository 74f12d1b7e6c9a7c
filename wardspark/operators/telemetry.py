"""Governance telemetry: normalisation, windowed metrics, daily series, distributions, top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.patterns import js_trim
from ..functions.scan import risk_level

#: What events, actions and levels are called.
EVENT_TYPES = ("message_sent_to_ai", "message_blocked", "attachment_governed", "attachment_blocked", "assistant_response_rehydrated", "extension_error")
ACTIONS = ("allow", "warn", "redact", "block", "clean", "redacted", "blocked", "unsupported", "too_large", "failed", "binary")
VIOLATIONS = ("warn", "redact", "block", "redacted", "blocked")
LEVELS = ("low", "medium", "high", "critical")
WINDOW_DAYS = {"7d": 6, "30d": 29}
#: Parts of flag texts and the category that they stand for.
FLAG_CATEGORIES = (
    ("PII exposure", "personal|person|name|email|phone|address|account|customer id"),
    ("Regulated context", "regulated|financial|legal|medical|health|hr|employment"),
    ("Secrets/API keys", "secret|api key|credential|token"),
    ("Prompt injection", "prompt injection|jailbreak|bypass|ignore instructions"),
)


def clamped(value: Column, low: int, high: int) -> Column:
    """Rounded half up and clamped; missing or non-finite values are 0."""
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))
    return F.greatest(F.lit(low), F.least(F.lit(high), F.floor(F.when(finite, value).otherwise(0.0) + 0.5))).cast("int")


def text_or(value: Column, default: str, limit: int) -> Column:
    """The first ``limit`` characters, or the default if the value is missing or blank."""
    return F.when(js_trim(value) != "", F.substring(value, 1, limit)).otherwise(default)


def slug(value: Column, limit: int = 80) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(value), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, limit)


def normalised(events: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Raw payload rows to the normalised event row; every field has a default and a limit.

    Expects the columns event_type, surface, company_slug, user_label, install_id,
    conversation_key, action, risk_score, risk_level, flags (array), entity_counts (map),
    redaction_count, attachment_count, metadata (map), occurred_at (timestamp), event_id. A
    missing time stays missing. Columns of ``keep`` pass through.
    """
    kind = F.when(F.col("event_type").isin(*EVENT_TYPES), F.col("event_type")).otherwise("extension_error")
    action = F.when(F.col("action").isin(*ACTIONS), F.col("action")).when(kind.contains("blocked"), "block").otherwise("allow")
    score = clamped(F.col("risk_score").cast("double"), 0, 100)
    counts = F.map_filter("entity_counts", lambda k, v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    label = text_or(F.col("user_label"), "Test user", 120)
    return events.select(
        "event_id",
        kind.alias("event_type"),
        text_or(F.col("surface"), "chatgpt", 80).alias("surface"),
        F.when(js_trim("company_slug") != "", slug(F.col("company_slug"))).otherwise("test-company").alias("company_slug"),
        label.alias("user_label"),
        text_or(F.col("install_id"), "unknown-install", 160).alias("install_id"),
        F.substring(F.sha2(F.coalesce(F.substring("conversation_key", 1, 240), F.lit("unknown-conversation")), 256), 1, 32).alias("conversation_key_hash"),
        action.alias("action"),
        score.alias("risk_score"),
        F.when(F.col("risk_level").isin(*LEVELS), F.col("risk_level")).otherwise(risk_level(score)).alias("risk_level"),
        F.slice(F.transform(F.filter(F.coalesce("flags", F.array().cast("array<string>")), lambda f: js_trim(f) != ""), lambda f: F.substring(f, 1, 120)), 1, 20).alias("flags"),
        F.coalesce(F.transform_values(F.transform_keys(counts, lambda k, v: F.substring(k, 1, 60)), lambda k, v: F.greatest(F.lit(0), F.floor(v + 0.5)).cast("int")), F.create_map().cast("map<string,int>")).alias("entity_counts"),
        clamped(F.col("redaction_count").cast("double"), 0, 10000).alias("redaction_count"),
        clamped(F.col("attachment_count").cast("double"), 0, 1000).alias("attachment_count"),
        _labelled(F.coalesce("metadata", F.create_map().cast("map<string,string>")), label).alias("metadata"),
        F.col("occurred_at").alias("created_at"),
        *(keep or []),
    )


def _labelled(metadata: Column, label: Column) -> Column:
    """Metadata with the user's label unless it brings one; keys and values are limited."""
    own = F.create_map(F.lit("userLabel"), label)
    limited = F.transform_values(F.transform_keys(metadata, lambda k, v: F.substring(k, 1, 80)), lambda k, v: F.substring(v, 1, 240))
    return F.when(F.map_contains_key(metadata, "userLabel"), limited).otherwise(F.map_concat(own, limited))


def in_window(events: DataFrame, time_range: str, anchor: Column, ts: str = "created_at") -> DataFrame:
    """Events from the start of the day so many days before the anchor day; 'all' keeps all; unknown is 7d."""
    if time_range == "all":
        return events
    return events.where(F.to_date(ts) >= F.date_sub(F.to_date(anchor), WINDOW_DAYS.get(time_range, WINDOW_DAYS["7d"])))


def _count(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def is_violation() -> Column:
    return F.col("action").isin(*VIOLATIONS)


def is_flagged() -> Column:
    return is_violation() | (F.col("event_type") == "message_blocked") | (F.col("risk_score") >= 35)


def metrics(events: DataFrame, by: list[str] | None = None) -> DataFrame:
    """All dashboard metrics of each group in one pass."""
    kind = F.col("event_type")
    sent, blocked = kind == "message_sent_to_ai", kind == "message_blocked"
    redacted = sent & F.col("action").isin("redact", "redacted")
    out = events.groupBy(*(by or [])).agg(
        _count(kind != "assistant_response_rehydrated").alias("governed_events"),
        _count(sent).alias("messages_sent"),
        _count(blocked).alias("messages_blocked"),
        _count(redacted).alias("messages_redacted"),
        _count(is_violation()).alias("policy_violations"),
        _count(kind.isin("attachment_governed", "attachment_blocked")).alias("governed_uploads"),
        F.coalesce(F.sum(F.when(kind != "assistant_response_rehydrated", F.col("redaction_count"))), F.lit(0)).alias("protected_identifiers"),
    )
    percent = lambda a, b: F.when(b > 0, F.floor(100.0 * a / b + 0.5)).otherwise(0).cast("long")
    return out.withColumn("block_percent", percent(F.col("messages_blocked"), F.col("messages_sent") + F.col("messages_blocked"))).withColumn(
        "redaction_percent", percent(F.col("messages_redacted"), F.col("messages_sent"))
    )


def chart_rows(events: DataFrame, limit: int | None = 5000, order: str = "event_id") -> DataFrame:
    """The events that a chart is made of. With the limit, which is parity with a store that gives no more, the oldest of each company survive; None takes all."""
    if limit is None:
        return events
    oldest = F.row_number().over(Window.partitionBy("company_slug").orderBy("created_at", order))
    return events.withColumn("_k", oldest).where(F.col("_k") <= limit).drop("_k")


def daily_usage(events: DataFrame, by: list[str] | None = None, others: DataFrame | None = None) -> DataFrame:
    """(by..., day, requests, flagged) for every day of each group from its first to its last, zeros included.

    ``others`` are rows of a second source with the same fields (created_at, event_type, action, risk_score), counted with the events.
    """
    by = by or []
    if others is not None:
        fields = [*by, "created_at", "event_type", "action", "risk_score"]
        events = events.select(*fields).unionByName(others.select(*fields))
    daily = events.groupBy(*by, F.to_date("created_at").alias("day")).agg(
        _count(F.col("event_type").isin("message_sent_to_ai", "message_blocked")).alias("requests"), _count(is_flagged()).alias("flagged")
    )
    ends = events.groupBy(*by).agg(F.min(F.to_date("created_at")).alias("a"), F.max(F.to_date("created_at")).alias("b"))
    calendar = ends.where("a is not null").select(*by, F.explode(F.sequence("a", "b")).alias("day"))
    return calendar.join(daily, [*by, "day"], "left").select(*by, "day", F.coalesce("requests", F.lit(0)).alias("requests"), F.coalesce("flagged", F.lit(0)).alias("flagged"))


def risk_distribution(events: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by..., level, n, percent) of all four levels of each group, rehydrations left out."""
    by = by or []
    kept = F.when(F.col("event_type") != "assistant_response_rehydrated", F.col("risk_level"))
    counts = events.groupBy(*by).agg(*[F.count(F.when(kept == level, 1)).alias(level) for level in LEVELS])
    total = sum((F.col(level) for level in LEVELS[1:]), F.col(LEVELS[0]))
    out = counts.select(*by, total.alias("total"), *LEVELS).unpivot([*by, "total"], list(LEVELS), "level", "n")
    return out.select(*by, "level", "n", F.when(F.col("total") > 0, F.floor(100.0 * F.col("n") / F.col("total") + 0.5)).otherwise(0).cast("long").alias("percent"))


def categories(flags: Column, event_type: Column, action: Column) -> Column:
    """Dashboard categories of an event, in a fixed order; 'Policy screened' if there is none."""
    lower = F.transform(flags, F.lower)
    found = [F.when(_any(lower, part), name) for name, part in FLAG_CATEGORIES]
    found.append(F.when(event_type.startswith("attachment"), "Attachment governance"))
    found.append(F.when(action.isin("block", "blocked") | event_type.contains("blocked"), "Blocked request"))
    some = F.filter(F.array(*found), lambda x: x.isNotNull())
    return F.when(F.size(some) > 0, some).otherwise(F.array(F.lit("Policy screened")))


def _any(lower: Column, pattern: str) -> Column:
    return F.exists(lower, lambda f: f.rlike(pattern))


def risk_categories(events: DataFrame, top: int = 6) -> DataFrame:
    """(category, events) of the most frequent categories among events with a violation, a block or risk; ties by name."""
    risky = events.where(is_violation() | F.col("event_type").contains("blocked") | (F.col("risk_score") >= 35))
    each = risky.select(F.explode(categories(F.col("flags"), F.col("event_type"), F.col("action"))).alias("category"))
    return each.groupBy("category").agg(F.count(F.lit(1)).alias("events")).orderBy(F.desc("events"), "category").limit(top)


def provider_usage(events: DataFrame, messages: DataFrame, top: int = 6) -> DataFrame:
    """(provider, requests): messages by the surface plus chat messages by provider label; ties by name."""
    surface = events.where(F.col("event_type").isin("message_sent_to_ai", "message_blocked")).select(F.lit("ChatGPT").alias("provider"))
    own = messages.select(F.when(js_trim("provider_label") != "", js_trim("provider_label")).otherwise("Workspace Chat").alias("provider"))
    counted = surface.unionByName(own).groupBy("provider").agg(F.count(F.lit(1)).alias("requests"))
    return counted.orderBy(F.desc("requests"), "provider").limit(top)


def recent_events(events: DataFrame, top: int = 8) -> DataFrame:
    """The latest events that are errors or blocked or carry a violation, with their labels; ties by id."""
    kind, action = F.col("event_type"), F.col("action")
    picked = events.where(kind.isin("message_blocked", "attachment_blocked") | is_violation()).orderBy(F.desc("created_at"), F.desc("event_id")).limit(top)
    category = (
        F.when(kind == "message_blocked", "Message blocked").when(kind == "attachment_blocked", "Attachment blocked")
        .when(kind == "attachment_governed", "Governed upload").when(action.isin("redact", "redacted"), "PII redaction")
        .when(action == "warn", "Policy warning").otherwise("Extension telemetry")
    )
    taken = (
        F.when((kind == "message_sent_to_ai") & (action == "redact"), "Redacted and sent").when(kind == "message_sent_to_ai", "Sent through ChatGPT")
        .when(kind == "message_blocked", "Blocked before AI").when(kind == "attachment_governed", "Protected copy uploaded")
        .when(kind == "attachment_blocked", "Original upload blocked").when(kind == "assistant_response_rehydrated", "Response rehydrated locally")
        .otherwise("Logged")
    )
    return picked.select("event_id", "created_at", "event_type", "action", "risk_score", "risk_level", category.alias("category"), taken.alias("action_taken"))


def active_users(events: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(user, last_seen, events) from the events themselves."""
    return events.groupBy(*(by or []), "install_id").agg(F.max("created_at").alias("last_seen"), F.count(F.lit(1)).alias("events"))


# What the dashboard says of an event.
POLICY_TEXTS = (
    "{} blocked submission before external AI routing.", "{} redacted identifiers before external AI routing.", "{} detected policy-sensitive context.",
    "Extension telemetry captured metadata only.",
)
PREVIEWS = (
    "Extension governed an attachment. Raw file content was not stored.", ("Extension allowed a ", " message after local governance."),
    ("Extension blocked a ", " message before AI submission."), "Extension event logged without raw content.",
)
#: Fields of a payload beside those of normalised(): their limit and what a blank one is.
FURTHER_TEXTS = {
    "company_name": (120, "Test Company"), "message_length_bucket": (40, "unknown"), "employee_user_id": (160, "unknown-employee"), "ai_provider": (80, "chatgpt"),
    "destination_type": (80, "personal"), "content_type": (80, "prompt"),
}
RULE_TEXTS = {"rule_id": 160, "rule_key": 160, "policy_action": 80, "policy_severity": 80}
PAYLOAD = (
    "event_id long, event_type string, surface string, company_slug string, company_name string, user_label string, install_id string, conversation_key string, action string, "
    "risk_score double, risk_level string, flags array<string>, entity_counts map<string,double>, redaction_count double, attachment_count double, message_length_bucket string, "
    "metadata map<string,string>, occurred_at string, organization_id string, employee_user_id string, rule_id string, rule_key string, rule_version double, "
    "policy_bundle_version double, policy_action string, policy_severity string, ai_provider string, destination_type string, content_type string, detected_categories array<string>"
)


def parsed(lines: DataFrame, column: str = "value") -> DataFrame:
    """Payload rows of JSON lines; works on streams. Lines that are no JSON object come out with nulls only."""
    return lines.select(F.from_json(column, PAYLOAD, {"mode": "PERMISSIVE"}).alias("p")).select("p.*").withColumn("occurred_at", F.try_to_timestamp("occurred_at"))


def normalised_whole(payloads: DataFrame) -> DataFrame:
    """normalised() with the fields of rules, bundles and destinations; zero versions and blank rule texts are null, as they are stored."""
    versions = {c: F.when(clamped(F.col(c), 0, 100_000) != 0, clamped(F.col(c), 0, 100_000)) for c in ("rule_version", "policy_bundle_version")}
    kept = lambda name, limit: F.substring(F.coalesce(name, F.lit("")), 1, limit)
    categories = F.filter(F.coalesce("detected_categories", F.array().cast("array<string>")), lambda c: js_trim(c) != "")
    organisation = F.when(js_trim("organization_id") != "", F.substring("organization_id", 1, 120)).when(F.col("company_slug").isNotNull(), slug(F.col("company_slug"))).otherwise("test-company")
    further = payloads.select(
        F.struct(
            *[text_or(F.col(n), default, limit).alias(n) for n, (limit, default) in FURTHER_TEXTS.items()], organisation.alias("organization_id"),
            *[F.when(kept(n, limit) != "", kept(n, limit)).alias(n) for n, limit in RULE_TEXTS.items()], *[v.alias(c) for c, v in versions.items()],
            F.slice(F.transform(categories, lambda c: F.substring(c, 1, 120)), 1, 40).alias("detected_categories"),
        ).alias("further"),
        *payloads.columns,
    )
    base = normalised(further, keep=["further"])
    return base.select(*[c for c in base.columns if c != "further"], "further.*")


def described(events: DataFrame, guard: str = "The guard") -> DataFrame:
    """(event_id, preview, policy_text) of events with message_length_bucket: what is shown in place of content."""
    kind, action = F.col("event_type"), F.col("action")
    say = lambda parts: F.concat(F.lit(parts[0]), F.col("message_length_bucket"), F.lit(parts[1]))
    preview = F.when(kind.startswith("attachment"), PREVIEWS[0]).when(kind == "message_sent_to_ai", say(PREVIEWS[1])).when(kind == "message_blocked", say(PREVIEWS[2])).otherwise(PREVIEWS[3])
    texts = [t.format(guard) for t in POLICY_TEXTS]
    blocked = (kind == "message_blocked") | action.isin("block", "blocked")
    policy = F.when(blocked, texts[0]).when(action.isin("redact", "redacted"), texts[1]).when(action == "warn", texts[2]).otherwise(texts[3])
    return events.select("event_id", preview.alias("preview"), policy.alias("policy_text"))


def governance_events(scans: DataFrame) -> DataFrame:
    """Scanned chats (flags, action, requires_review, risk_score, provider_label and others) as governance events.

    Adds category, action_taken, status, severity and provider.
    """
    has = lambda *names: F.arrays_overlap("flags", F.array(*map(F.lit, names)))
    action, label = F.col("action"), F.coalesce("provider_label", F.lit(""))
    named = lambda part: F.contains(label, F.lit(part))
    return scans.select(
        "*",
        F.when(has("secret"), "Secrets/API keys").when(has("prompt_injection"), "Prompt injection").when(F.exists("flags", lambda f: f.startswith("regulated_")), "Regulated advice")
        .when(has("email", "phone", "address", "account", "possible_name"), "PII exposure").otherwise("Policy screened").alias("category"),
        F.when(action == "block", "Blocked").when(action == "redact", "Redacted and logged").when(action == "warn", "Warned and logged").otherwise("Allowed and logged").alias("action_taken"),
        F.when(action == "block", "Incident created").when(F.col("requires_review"), "Needs review").otherwise("Resolved").alias("status"),
        risk_level(F.col("risk_score")).alias("severity"),
        F.when(named("Anthropic"), "Anthropic").when(named("Gemini"), "Gemini").when(named("OpenAI"), "OpenAI").otherwise("Internal").alias("provider"),
    )


def day_label(day: Column, buckets: Column) -> Column:
    """The weekday for up to seven buckets, else month and day."""
    return F.when(buckets <= 7, F.date_format(day, "EEE")).otherwise(F.date_format(day, "MMM d"))


def key_figures(metrics: DataFrame, by: list[str]) -> DataFrame:
    """(by..., label, value): metrics with active_users as labelled figures with thousands separators."""
    figures = (("Total AI requests", "messages_sent"), ("High-risk events", "policy_violations"), ("Blocked requests", "messages_blocked"), ("Active users", "active_users"))
    rows = [F.struct(F.lit(label).alias("label"), F.format_number(F.col(c), 0).alias("value")) for label, c in figures]
    rows.append(F.struct(F.lit("Estimated spend").alias("label"), F.lit("$0").alias("value")))
    return metrics.select(*by, F.explode(F.array(*rows)).alias("f")).select(*by, "f.*")


def latest_scans(scans: DataFrame, by: list[str], sequence: str = "sequence") -> DataFrame:
    """Of each key's scan results those of the newest sequence; older ones that arrive late are dropped. Ties keep one row."""
    order = Window.partitionBy(*by).orderBy(F.desc(sequence))
    return scans.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
