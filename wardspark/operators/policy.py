"""Policy engine: detected categories, rule matching, precedence, merged decision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import js_trim

PRECEDENCE = {"block": 5, "redact": 3, "warn": 2, "allow": 1}
SEVERITY = {"critical": 4, "high": 3, "medium": 2, "low": 1}
#: What an entity type or a flag stands for in rules.
ENTITY_CATEGORIES = {
    "PERSON": ("personal_data", "client_identifying_info"),
    "EMAIL": ("personal_data", "client_identifying_info"),
    "PHONE": ("personal_data", "client_identifying_info"),
    "ADDRESS": ("personal_data", "client_identifying_info", "address"),
    "ACCOUNT": ("client_identifying_info", "account", "payment_information"),
    "SECRET": ("secret",),
}
FLAG_CATEGORIES = {
    "regulated_financial": ("regulated_financial_context",),
    "regulated_medical": ("regulated_medical_context", "veterinary_medical_record"),
    "regulated_legal": ("regulated_legal_context",),
    "regulated_hr": ("regulated_hr_context",),
    "prompt_injection": ("prompt_injection",),
    "email": ("personal_data", "client_identifying_info"),
    "phone": ("personal_data", "client_identifying_info"),
    "address": ("personal_data", "client_identifying_info"),
    "account": ("personal_data", "client_identifying_info"),
    "possible_name": ("personal_data", "client_identifying_info"),
}


def _lookup(table: dict[str, tuple[str, ...]]) -> Column:
    return F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])


def rank(value: Column, table: dict[str, int]) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in table.items() for x in p]), value), F.lit(0))


def detected_categories(flags: Column, entity_counts: Column | None = None) -> Column:
    """Sorted distinct rule categories of a text's flags and entity types with a positive count."""
    none = F.array().cast("array<string>")
    parts = [F.flatten(F.transform(flags, lambda f: F.coalesce(F.element_at(_lookup(FLAG_CATEGORIES), f), none)))]
    if entity_counts is not None:
        held = F.map_keys(F.map_filter(entity_counts, lambda k, v: v > 0))
        parts.append(F.flatten(F.transform(held, lambda t: F.coalesce(F.element_at(_lookup(ENTITY_CATEGORIES), t), none))))
    return F.array_sort(F.array_distinct(F.concat(*parts)))


def execution_action(action: Column, fallback: Column, sanitizable: Column) -> Column:
    """What a matched rule does: transform redacts what can be sanitised and falls back otherwise."""
    blocks = lambda a: a.isin("block", "require_approval")
    return (
        F.when(blocks(action), "block").when(action == "warn", "warn")
        .when((action == "transform") & sanitizable, "redact")
        .when((action == "transform") & F.coalesce(blocks(fallback), F.lit(False)), "block")
        .when((action == "transform") & F.coalesce(fallback == "warn", F.lit(False)), "warn")
        .otherwise("allow")
    )


def _scope(rule: Column, actual: Column) -> Column:
    r = F.lower(js_trim(F.coalesce(rule, F.lit(""))))
    return r.isin("", "all", "any") | (r == F.lower(js_trim(actual)))


def evaluate(signals: DataFrame, rules: DataFrame, key: str = "doc_id", guard: str = "The guard") -> DataFrame:
    """One row per signal row: key, categories, triggered, action, rule_key, rule_version, severity, explanation.

    signals: key, flags, entity_counts, redaction_count, sanitizable, ai_provider, destination_type,
    user_scope, department_scope. rules: rule_key, version, data_categories (array), scopes, ai_provider,
    destination_type, action, fallback_action, severity, source_policy, source_section, explanation.

    The rule table, which people write, is one array that every row is decided against in place: signals are
    computed once and not shuffled, and a null or repeated key changes nothing. The rule of highest
    precedence, then severity, then smallest key wins. No rule or no category: allow, not triggered.
    """
    found = signals.select("*", detected_categories(F.col("flags"), F.col("entity_counts")).alias("categories"))
    entry = F.struct(
        "rule_key", F.col("version").alias("rule_version"), F.array_distinct(F.transform("data_categories", F.lower)).alias("data_categories"), "ai_provider",
        "destination_type", "user_scope", "department_scope", "action", "fallback_action", "severity", "source_policy", "source_section", F.col("explanation").alias("says"),
    )
    found = found.select("*", rules.agg(F.collect_list(entry).alias("rules")).scalar().alias("rules"))
    sanitizable = (F.col("redaction_count") > 0) & F.col("sanitizable")

    def fits(r: Column) -> Column:
        return (
            F.arrays_overlap(r["data_categories"], F.col("categories"))
            & _scope(r["ai_provider"], F.col("ai_provider"))
            & ((r["destination_type"] == "any") | (r["destination_type"] == F.col("destination_type")))
            & _scope(r["user_scope"], F.coalesce("user_scope", F.lit("all")))
            & _scope(r["department_scope"], F.coalesce("department_scope", F.lit("all")))
        )

    def ranked(r: Column) -> Column:
        act = execution_action(r["action"], r["fallback_action"], sanitizable)
        return F.struct(
            (-rank(act, PRECEDENCE)).alias("p"), (-rank(r["severity"], SEVERITY)).alias("s"), r["rule_key"].alias("rule_key"), r["rule_version"].alias("rule_version"),
            act.alias("action"), r["severity"].alias("severity"), r["source_policy"].alias("source_policy"), r["source_section"].alias("source_section"), r["says"].alias("says"),
        )

    decided = found.select(key, "categories", F.array_min(F.transform(F.filter("rules", fits), ranked)).alias("d"))
    doing = (
        F.when(F.col("d.action") == "block", "blocking this submission").when(F.col("d.action") == "redact", "transforming it with local redaction")
        .when(F.col("d.action") == "warn", "warning before submission").otherwise("allowing the submission")
    )
    shown = F.array_join(F.transform("categories", lambda c: F.replace(c, F.lit("_"), F.lit(" "))), ", ")
    text = F.concat(
        F.lit(f"{guard} detected "), shown, F.lit(". "), F.col("d.source_policy"), F.lit(" "), F.col("d.source_section"), F.lit(": "),
        F.col("d.says"), F.lit(f" {guard} is "), doing, F.lit("."),
    )
    return decided.select(
        key, "categories", F.col("d").isNotNull().alias("triggered"), F.coalesce("d.action", F.lit("allow")).alias("action"),
        F.col("d.rule_key").alias("rule_key"), F.col("d.rule_version").alias("rule_version"), F.col("d.severity").alias("severity"),
        F.when(F.col("d").isNull(), "No published company policy rule matched.").otherwise(text).alias("explanation"),
    )


def merged_action(scanner: Column, policy: Column) -> Column:
    """The stronger of the scanner's and the policy's action."""
    return F.when(rank(policy, PRECEDENCE) > rank(scanner, PRECEDENCE), policy).otherwise(scanner)
