"""Versioned rule store: latest versions, lifecycle, bundles with checksums, buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.canonical import checksum
from ..functions.patterns import js_trim

from .telemetry import slug

STATUSES = ("draft", "approved", "rejected", "archived")


def latest_versions(rules: DataFrame, scope: str = "company_slug") -> DataFrame:
    """The row of the highest version of each rule key."""
    order = Window.partitionBy(scope, "rule_key").orderBy(F.desc("version"), F.desc("id"))
    return rules.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank")


def next_versions(rules: DataFrame, scope: str = "company_slug") -> DataFrame:
    return rules.groupBy(scope, "rule_key").agg((F.coalesce(F.max(F.greatest("version", F.lit(0))), F.lit(0)) + 1).alias("next_version"))


def status_counts(rules: DataFrame, scope: str = "company_slug") -> DataFrame:
    """All four counts of each company, zeros included."""
    return rules.groupBy(scope).agg(*[F.count(F.when(F.col("status") == s, 1)).alias(s) for s in STATUSES])


def with_published(rules: DataFrame, bundle: DataFrame, scope: str = "company_slug") -> DataFrame:
    """Rules flagged published if the bundle has them by id, or by key and version: two equi-joins, not one with OR."""
    ids = bundle.select(F.col(scope).alias("_s1"), F.col("id").alias("_id")).distinct().withColumn("_by_id", F.lit(True))
    keys = bundle.select(F.col(scope).alias("_s2"), F.col("rule_key").alias("_k"), F.col("version").alias("_v")).distinct().withColumn("_by_key", F.lit(True))
    out = rules.join(ids, (F.col(scope) == F.col("_s1")) & (F.col("id") == F.col("_id")), "left")
    out = out.join(keys, (F.col(scope) == F.col("_s2")) & (F.col("rule_key") == F.col("_k")) & (F.col("version") == F.col("_v")), "left")
    return out.select(*rules.columns, (F.col("_by_id").isNotNull() | F.col("_by_key").isNotNull()).alias("published"))


def buckets(flagged: DataFrame) -> DataFrame:
    """Rules with their place in the admin view; the first that fits."""
    bucket = (
        F.when(F.col("status") == "draft", "draft").when(F.col("status") == "rejected", "rejected")
        .when(F.col("published") & F.col("active"), "published").when(F.col("published"), "removal_pending")
        .when(F.col("active"), "pending_publish").when(F.col("status") == "archived", "archived").otherwise("previous")
    )
    return flagged.withColumn("bucket", bucket)


def set_status(rules: DataFrame, changes: DataFrame, scope: str = "company_slug") -> DataFrame:
    """Rules after changes (id, new_status): approving activates a version and deactivates its siblings."""
    wanted = changes.select(F.col("id").alias("_id"), "new_status")
    touched = rules.join(wanted, F.col("id") == F.col("_id"), "left").drop("_id")
    approved = touched.where("new_status = 'approved'").groupBy(scope, "rule_key").agg(F.max("version").alias("_approved"))
    out = touched.join(approved, [scope, "rule_key"], "left")
    active = (
        F.when(F.col("_approved").isNotNull(), (F.col("new_status") == "approved") & (F.col("version") == F.col("_approved")))
        .when(F.col("new_status").isNotNull(), F.lit(False))
        .otherwise(F.col("active"))
    )
    columns = {"status": F.coalesce("new_status", "status"), "active": F.coalesce(active, F.lit(False))}
    return out.select(*[columns[c].alias(c) if c in columns else F.col(c) for c in rules.columns])


def delete_rules(rules: DataFrame, ids: DataFrame) -> DataFrame:
    """Rules without the given ids; approved rules stay."""
    gone = ids.select(F.col("id").alias("_id")).withColumn("_gone", F.lit(True))
    return rules.join(gone, F.col("id") == F.col("_id"), "left").where(F.col("_gone").isNull() | (F.col("status") == "approved")).select(*rules.columns)


def bundle_entry(columns: list[str]) -> Column:
    """A rule as JSON with its fields in sorted order, nulls left out."""
    return F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]))


def publish(rules: DataFrame, bundle: DataFrame, versions: DataFrame, columns: list[str], scope: str = "company_slug") -> DataFrame:
    """The next bundle of each company: version, rule_count, checksum, id, rules.

    Candidates are approved rules that are active or in the last bundle; each key's highest version
    goes in, sorted by key. versions (company, version) has the last bundle's version; companies
    without candidates publish nothing.
    """
    able = with_published(rules, bundle, scope).where("status = 'approved' and (active or published)")
    entries = latest_versions(able, scope).select(scope, F.struct("rule_key", bundle_entry(columns).alias("json")).alias("e"))
    # A bundle is one record that is sent whole to clients; rules are written by hand.
    made = entries.groupBy(scope).agg(F.array_sort(F.collect_list("e")).alias("es"), F.count(F.lit(1)).alias("rule_count"))
    last = versions.groupBy(scope).agg(F.max("version").alias("last"))
    made = made.join(last, scope, "left").withColumn("version", F.greatest(F.coalesce("last", F.lit(0)), F.lit(0)) + 1)
    body = F.concat(F.lit("["), F.array_join(F.transform("es", lambda e: e["json"]), ","), F.lit("]"))
    made = made.withColumn("checksum", F.sha2(F.concat(F.col(scope), F.lit(":"), F.col("version").cast("string"), F.lit(":"), body), 256))
    bundle_id = F.concat(F.lit("bundle_"), F.col(scope), F.lit("_"), F.col("version").cast("string"), F.lit("_"), F.substring("checksum", 1, 12))
    return made.select(scope, "version", "rule_count", "checksum", bundle_id.alias("id"), F.transform("es", lambda e: e["json"]).alias("rules"))


# What the fields of a draft can be and what they are without.
DRAFT_ACTIONS, DESTINATIONS = ("allow", "transform", "warn", "require_approval", "block"), ("any", "approved", "enterprise", "personal", "unapproved")
SEVERITIES = ("low", "medium", "high", "critical")
DRAFT_TEXTS = {
    "name": (300, "Untitled policy rule"), "source_policy": (300, "External AI Usage Policy"), "source_section": (300, "Imported policy section"), "excerpt": (3000, ""),
    "user_scope": (160, "all"), "department_scope": (160, "all"), "ai_provider": (80, "chatgpt"),
}


def rule_slug(value: Column) -> Column:
    """Lower-case letters and digits, in groups joined by underscores, at most 80 characters."""
    return F.replace(slug(value), F.lit("-"), F.lit("_"))


#: Names that imported rules have in JSON, for the columns of draft_fields.
IMPORTED = {
    "rule_key": "ruleKey", "name": "name", "source_policy": "sourcePolicyName", "source_section": "sourceSection", "excerpt": "supportingExcerpt", "user_scope": "userScope", "department_scope": "departmentScope",
    "ai_provider": "aiProvider", "destination_type": "destinationType", "action": "action", "fallback_action": "fallbackAction", "severity": "severity",
}


def imported_drafts(lines: DataFrame, value: str = "value") -> DataFrame:
    """Rules in JSON as inputs of draft_fields, with the other columns of ``lines``. Fields that are no strings are blank; categories may be a list, of
    which strings count, or a text. What is no JSON object is no row."""
    v = F.try_parse_json(F.col(value))
    said = lambda path: F.when(F.schema_of_variant(F.try_variant_get(v, path, "variant")) == "STRING", F.try_variant_get(v, path, "string")).otherwise("")
    listed = F.try_variant_get(v, "$.dataCategories", "array<variant>")
    strings = F.filter(listed, lambda x: F.schema_of_variant(x) == "STRING")
    categories = F.when(listed.isNotNull(), F.array_join(F.transform(strings, lambda x: F.try_variant_get(x, "$", "string")), "\n")).otherwise(said("$.dataCategories"))
    good = lines.where(F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False)))
    return good.select(*[c for c in lines.columns if c != value], *[said(f"$.{j}").alias(c) for c, j in IMPORTED.items()], categories.alias("data_categories"))


# The rule that serves a company until it has published its own.
FALLBACK_RULE = {
    "id": "rule_external_ai_client_info_v1", "ruleKey": "external_ai_client_info", "version": 1, "name": "Do not submit client identifiers to personal AI", "sourcePolicyName": "External AI Usage Policy",
    "sourceSection": "4.2 - Client Information", "dataCategories": ["client_identifying_info", "personal_data", "address", "account", "veterinary_medical_record", "payment_information"],
    "userScope": "all", "departmentScope": "all", "aiProvider": "chatgpt", "destinationType": "personal", "action": "transform", "fallbackAction": "block", "severity": "high",
}


def fallback_bundles(companies: DataFrame, scope: str = "company_slug") -> DataFrame:
    """(scope, id, version, status, checksum, rule_count): the bundle that each company has without a store, with its canonical checksum."""
    rule = F.struct(*[(F.array(*map(F.lit, v)) if isinstance(v, list) else F.lit(v)).alias(k) for k, v in FALLBACK_RULE.items()])
    body = F.struct(F.lit(1).alias("schemaVersion"), F.col(scope).alias("companySlug"), F.lit(1).alias("version"), F.array(rule).alias("rules"))
    made = companies.select(scope, body.alias("body"))
    sums = made.select(scope, checksum(F.col("body"), made.schema["body"].dataType).alias("checksum"))
    return sums.select(scope, F.concat(F.lit("bundle_"), scope, F.lit("_1_"), F.substring("checksum", 1, 12)).alias("id"), F.lit(1).alias("version"), F.lit("published").alias("status"), "checksum", F.lit(1).alias("rule_count"))


def draft_fields(inputs: DataFrame, scope: str = "company_slug") -> DataFrame:
    """Drafts as they are stored: scope, rule_key and the limited, defaulted fields.

    inputs: scope, rule_key, name, source_policy, source_section, excerpt, data_categories (text cut at commas and lines),
    user_scope, department_scope, ai_provider, destination_type, action, fallback_action, severity. Blank texts
    get defaults, and so do unknown actions (warn), destinations (personal) and severities (low). At most 40 categories stay.
    """

    def text(name: str) -> Column:
        limit, default = DRAFT_TEXTS[name]
        kept = F.substring(js_trim(F.coalesce(name, F.lit(""))), 1, limit)
        return F.when(kept == "", default).otherwise(kept).alias(name)

    known = lambda name, values, default: F.when(F.col(name).isin(*values), F.col(name)).otherwise(default).alias(name)
    key = F.coalesce(F.when(F.col("rule_key") != "", F.col("rule_key")), F.when(F.col("name") != "", F.col("name")), F.lit("policy-rule"))
    categories = F.filter(F.transform(F.split(F.coalesce("data_categories", F.lit("")), "[\n,]"), rule_slug), lambda c: c != "")
    return inputs.select(
        scope, rule_slug(key).alias("rule_key"), *[text(n) for n in ("name", "source_policy", "source_section", "excerpt")], F.slice(categories, 1, 40).alias("data_categories"),
        *[text(n) for n in ("user_scope", "department_scope", "ai_provider")], known("destination_type", DESTINATIONS, "personal"), known("action", DRAFT_ACTIONS, "warn"),
        known("fallback_action", DRAFT_ACTIONS, "warn"), known("severity", SEVERITIES, "low"),
    )


def created_drafts(rules: DataFrame, drafts: DataFrame, order: str, scope: str = "company_slug") -> DataFrame:
    """Drafts with their versions: those of a key follow its highest version in the order of a column of drafts. They are inactive."""
    last = next_versions(rules, scope)
    n = F.row_number().over(Window.partitionBy(scope, "rule_key").orderBy(order))
    out = drafts.withColumn("_n", n).join(last, [scope, "rule_key"], "left")
    version = (F.coalesce("next_version", F.lit(1)) + F.col("_n") - 1).cast("int")
    return out.select(*drafts.columns, version.alias("version"), F.lit("draft").alias("status"), F.lit(False).alias("active"))


def edited_drafts(rules: DataFrame, edits: DataFrame) -> DataFrame:
    """Rules after edits (id and new values of some columns): only drafts change."""
    columns = [c for c in edits.columns if c != "id"]
    new = edits.select(F.col("id").alias("_id"), F.struct(*columns).alias("_new"))
    hit = F.col("_new").isNotNull() & (F.col("status") == "draft")
    out = rules.join(new, F.col("id") == F.col("_id"), "left")
    return out.select(*[F.when(hit, F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in rules.columns])


def superseded(bundles: DataFrame, made: DataFrame, scope: str = "company_slug") -> DataFrame:
    """Bundles after publishing: the new ones are published, and those of the same companies that were are superseded."""
    fresh = made.select(scope, "version", "rule_count", "id", F.lit("published").alias("status"))
    touched = made.select(F.col(scope).alias("_s")).distinct()
    old = bundles.join(touched, F.col(scope) == F.col("_s"), "left")
    status = F.when(F.col("_s").isNotNull() & (F.col("status") == "published"), "superseded").otherwise(F.col("status"))
    return old.select(scope, "version", "rule_count", "id", status.alias("status")).unionByName(fresh)


def latest_bundles(bundles: DataFrame, scope: str = "company_slug") -> DataFrame:
    """Each company's published bundle of the highest version; companies without one have no row."""
    order = Window.partitionBy(scope).orderBy(F.desc("version"), F.desc("id"))
    return bundles.where("status = 'published'").withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def bundle_pages(bundles: DataFrame, page: int = 10, recent: int = 3, scope: str = "company_slug") -> DataFrame:
    """The newest bundles of each company, the first of them marked recent."""
    order = Window.partitionBy(scope).orderBy(F.desc("version"), F.desc("id"))
    placed = bundles.withColumn("place", F.row_number().over(order)).where(F.col("place") <= page)
    return placed.withColumn("recent", F.col("place") <= recent)


def admin_snapshot(rules: DataFrame, bundles: DataFrame, bundle_rules: DataFrame, scope: str = "company_slug") -> DataFrame:
    """One row per company: rules by status, published rules, bundles and the latest version; companies without bundles have nulls and zeros."""
    counts = status_counts(rules, scope)
    live = with_published(rules, bundle_rules, scope).groupBy(scope).agg(F.count(F.when(F.col("published"), 1)).alias("published"))
    held = bundles.groupBy(scope).agg(F.count(F.lit(1)).alias("bundles"))
    latest = latest_bundles(bundles, scope).select(scope, F.col("version").alias("latest_version"))
    return counts.join(live, scope, "left").join(held, scope, "left").join(latest, scope, "left").fillna(0, ["published", "bundles"])
