"""Attachments: names, types, what they hold, what is done with each file and with its batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import PLACEHOLDER, js_trim
from ..shared import kept as kept_table
from ..functions.scan import scan

# Sizes, extensions and types of files.
MOST_TEXT_BYTES, MOST_DOCUMENT_BYTES = 256 * 1024, 5 * 1024 * 1024
TEXT_EXTENSIONS = ("bash", "c", "cc", "cpp", "csv", "h", "hpp", "ini", "java", "js", "json", "jsx", "md", "py", "sh", "sql", "toml", "ts", "tsx", "txt", "xml", "yaml", "yml")
TEXT_TYPES = (
    "application/csv", "application/json", "application/javascript", "application/sql", "application/typescript", "application/x-csh", "application/x-httpd-php",
    "application/x-javascript", "application/x-python-code", "application/x-sh", "application/x-shellscript", "application/x-sql", "application/x-toml",
    "application/x-typescript", "application/x-yaml", "application/xml", "application/yaml", "application/vnd.ms-excel",
)
GENERIC_TYPES = (
    "application/octet-stream", "application/binary", "application/x-binary", "application/x-empty", "application/x-unknown", "application/unknown", "binary/octet-stream",
)
WORD_TYPE = "application/vnd.openxmlformats-officedocument.wordprocessingml.document"
OTHER_TYPES = (
    "application/gzip", "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    "application/x-7z-compressed", "application/x-msdownload", "application/x-rar-compressed", "application/zip",
)
OTHER_PREFIXES = r"^(?:audio|image|video)/"
TYPE_OF_EXTENSION = {
    "json": "application/json", "xml": "application/xml", "js": "application/javascript", "jsx": "application/javascript", "ts": "application/typescript",
    "tsx": "application/typescript", "csv": "text/csv", "md": "text/markdown", "py": "text/x-python", "yaml": "application/x-yaml", "yml": "application/x-yaml",
}
SIZE_BUCKETS = ((10 * 1024, "0-10kb"), (100 * 1024, "10-100kb"), (MOST_TEXT_BYTES, "100-256kb"), (MOST_DOCUMENT_BYTES, "256kb-5mb"))


def _base(name: Column) -> Column:
    return F.regexp_extract(name, r"[^\\/]*$", 0)


def stem(name: Column) -> Column:
    """The file name without its extension; a name that starts or ends with its only dot is all stem."""
    return F.regexp_replace(_base(name), r"(?<=.)\.[^.]+$", "")


def suffix(name: Column) -> Column:
    """The extension with its dot, as it is written."""
    return F.regexp_extract(_base(name), r"(?<=.)\.[^.]+$", 0)


def extension(name: Column) -> Column:
    found = F.lower(F.substring(suffix(name), F.lit(2), F.length(name)))
    return F.when(found == "", F.when(F.lower(_base(name)) == "bash", "bash").otherwise("")).otherwise(found)


def media_type(value: Column) -> Column:
    return F.lower(js_trim(F.get(F.split(F.coalesce(value, F.lit("")), ";"), F.lit(0))))


def is_text_type(value: Column) -> Column:
    kind = media_type(value)
    return (
        F.when(kind.isin("", *TEXT_TYPES, *GENERIC_TYPES) | kind.startswith("text/"), True)
        .when(kind.isin(*OTHER_TYPES) | kind.rlike(OTHER_PREFIXES), False)
        .otherwise(kind.rlike(r"\b(?:csv|json|javascript|sql|toml|typescript|xml|yaml)\b"))
    )


def type_category(value: Column) -> Column:
    kind = media_type(value)
    has = lambda part: F.contains(kind, F.lit(part))
    return (
        F.when(kind == "", "unknown").when(kind.startswith("text/"), "text").when(kind.isin(*GENERIC_TYPES), "generic").when(kind.isin("application/pdf", WORD_TYPE), "document")
        .when(has("json"), "json").when(has("xml"), "xml").when(has("yaml"), "yaml").when(has("javascript") | has("typescript"), "code")
        .when(kind.isin(*OTHER_TYPES) | kind.rlike(OTHER_PREFIXES), "unsupported").otherwise("application")
    )


def safe_type(value: Column, name: Column) -> Column:
    kind, ext = media_type(value), extension(name)
    given = (kind != "") & ext.isin(*TEXT_EXTENSIONS) & is_text_type(value) & ~kind.isin(*GENERIC_TYPES)
    by_name = F.element_at(F.create_map(*[F.lit(x) for pair in TYPE_OF_EXTENSION.items() for x in pair]), ext)
    return F.when(given, kind).otherwise(F.coalesce(by_name, F.lit("text/plain")))


def looks_binary(text: Column) -> Column:
    """A null or replacement character, or more than 2 % control characters."""
    controls = F.length(F.regexp_replace(text, r"[^\x{0}-\x{8}\x{b}\x{c}\x{e}-\x{1f}\x{7f}-\x{9f}]", ""))
    return F.contains(text, F.lit("\0")) | F.contains(text, F.lit("�")) | ((F.length(text) > 0) & (controls > 0.02 * F.length(text)))


def classified(name: Column, kind: Column, size: Column, text: Column, extraction: Column) -> Column:
    """The first of what speaks against reading a file, or supported_text."""
    document = F.coalesce(extraction.isin("pdf_text", "docx_text"), F.lit(False))
    return (
        F.when(document & (size > MOST_DOCUMENT_BYTES), "too_large").when(document & (js_trim(F.coalesce(text, F.lit(""))) == ""), "read_failed")
        .when(~document & ~extension(name).isin(*TEXT_EXTENSIONS), "unsupported_type").when(~document & ~is_text_type(kind), "unsupported_mime")
        .when(~document & (size > MOST_TEXT_BYTES), "too_large").when(text.isNull(), "read_failed").when(looks_binary(text), "binary_content").otherwise("supported_text")
    )


def size_bucket(size: Column) -> Column:
    out = F.lit("over_limit")
    for most, name in reversed(SIZE_BUCKETS):
        out = F.when(size <= most, name).otherwise(out)
    return out


def length_bucket(length: Column) -> Column:
    return F.when(length <= 0, "empty").when(length <= 250, "0-250").when(length <= 1000, "251-1000").when(length <= 4000, "1001-4000").otherwise("4000+")


def file_slug(value: Column) -> Column:
    out = F.regexp_replace(F.regexp_replace(value, r"\s+", "_"), r"[^\p{L}\p{N}\[\]_.-]+", "_")
    return F.substring(F.regexp_replace(F.regexp_replace(out, "_{2,}", "_"), "^_+|_+$", ""), 1, 120)


def governed_names(files: DataFrame, sensitivity: str = "Internal") -> DataFrame:
    """files with safe_name, name_flags, name_entities, name_risk: file names without what a scan finds in them.

    The stem is scanned as it is and with its separators as spaces; the form with more entities, then more
    risk, then the former counts. Rows go through both scans as one value, so ids may repeat or be missing.
    """
    kept = files.columns
    found = lambda name: F.struct("redacted", "entities", "flags", "risk_score").alias(name)
    plain = stem(F.col("name"))
    one = scan(files.select(F.struct(*kept).alias("file"), F.coalesce(plain, F.lit("")).alias("form")), "file", "form", sensitivity=sensitivity).select("file", found("one"))
    one = kept_table(one, "plain-names")  # each scan is planned by itself: three in one plan take minutes to plan
    spaced = F.regexp_replace(F.coalesce(stem(F.col("file.name")), F.lit("")), "[._-]+", " ")
    two = scan(one.select(F.struct("file", "one").alias("row"), spaced.alias("form")), "row", "form", sensitivity=sensitivity).select("row.file", "row.one", found("two"))
    weight = lambda x: F.struct(F.size(x["entities"]), x["risk_score"])
    best = two.select("file.*", F.when(weight(F.col("two")) > weight(F.col("one")), F.col("two")).otherwise(F.col("one")).alias("b"))
    slugged = F.when(F.size("b.entities") > 0, file_slug(F.col("b.redacted"))).otherwise(F.regexp_replace(file_slug(stem(F.col("name"))), PLACEHOLDER, "redacted"))
    safe = F.concat(F.when(slugged == "", "attachment").otherwise(slugged), suffix(F.col("name")))
    return best.select(*kept, safe.alias("safe_name"), F.col("b.flags").alias("name_flags"), F.transform("b.entities", lambda e: F.struct(e["id"], e["type"])).alias("name_entities"), F.col("b.risk_score").alias("name_risk"))


def document_copy(redacted: Column, name: Column, extraction: Column, warnings: Column, guard: str = "The guard") -> Column:
    """The text that stands for a document: a heading and the redacted text; other files are the text itself."""
    label = F.when(extraction == "pdf_text", "PDF").otherwise("DOCX")
    notes = F.when(F.size(F.coalesce(warnings, F.array().cast("array<string>"))) > 0, F.concat(F.lit("\nExtraction notes: "), F.array_join(warnings, " ")))
    whole = F.concat_ws(
        "\n", F.lit(f"{guard} governed document text copy"), F.concat(F.lit("Source: "), label), F.concat(F.lit("Governed file: "), name),
        F.lit("Boundary: original binary document was not uploaded."), notes, F.lit("---"), F.when(redacted != "", redacted),
    )
    return F.when(F.coalesce(extraction.isin("pdf_text", "docx_text"), F.lit(False)), whole).otherwise(redacted)


def governed(files: DataFrame, sensitivity: str = "Internal") -> DataFrame:
    """One row per file: what is done with it and why.

    files: id, name, mime_type, size, text, extraction (native_text, pdf_text, docx_text or null), warnings. Files that
    can't be read are refused by their class. Of the others, name and text are scanned; an
    instruction bypass blocks the file, anything found is redacted, and else it is clean.
    """
    text = F.coalesce("text", F.lit(""))
    kind = classified(F.col("name"), F.col("mime_type"), F.col("size"), F.col("text"), F.col("extraction"))
    base = kept_table(governed_names(files.select("*", kind.alias("class")), sensitivity), "governed-names")
    body = F.when(F.col("class") == "supported_text", text).otherwise("")
    scanned = scan(base.select(F.struct(*[c for c in base.columns if c != "text"]).alias("file"), body.alias("body")), "file", "body", sensitivity=sensitivity)
    joined = scanned.select("file.*", "redacted", F.col("flags").alias("body_flags"), F.transform("entities", lambda e: F.struct(e["id"], e["type"])).alias("body_entities"), F.col("risk_score").alias("body_risk"))
    none = F.array().cast("array<struct<id:string,type:string>>")
    read = F.col("class") == "supported_text"
    entities = F.when(read, F.array_distinct(F.concat(F.coalesce("name_entities", none), "body_entities"))).otherwise(none)
    flags = F.array_distinct(F.concat(F.coalesce("name_flags", F.array().cast("array<string>")), "body_flags"))
    joined = joined.select("*", entities.alias("entities"), flags.alias("all_flags"))
    count = F.size(F.array_distinct(F.transform("entities", lambda e: e["id"])))
    refused = F.when(F.col("class").isin("unsupported_type", "unsupported_mime"), "unsupported").when(F.col("class") == "too_large", "too_large").when(F.col("class") == "read_failed", "failed").when(F.col("class") == "binary_content", "binary")
    action = F.coalesce(refused, F.when(F.array_contains("all_flags", "prompt_injection"), "blocked").when(count > 0, "redacted").otherwise("clean"))
    safe = F.coalesce("safe_name", F.concat(F.lit("attachment"), suffix(F.col("name"))))
    out = joined.select(
        "id", action.alias("action"), safe.alias("safe_name"), extension(F.col("name")).alias("extension"), safe_type(F.col("mime_type"), F.col("name")).alias("mime_type"),
        type_category(F.col("mime_type")).alias("mime_category"), size_bucket(F.col("size")).alias("size_bucket"),
        F.when(read, F.greatest(F.coalesce("name_risk", F.lit(0)), "body_risk")).otherwise(0).alias("risk_score"), F.when(read, count).otherwise(0).alias("redaction_count"),
        "entities", F.when(~read, F.col("class")).when(action == "blocked", "policy_block").alias("blocked_reason"), "extraction", "warnings", F.col("redacted").alias("_redacted"),
    )
    sent = F.when(F.col("action").isin("clean", "redacted"), document_copy(F.col("_redacted"), F.col("safe_name"), F.col("extraction"), F.col("warnings")))
    return out.select(*[c for c in out.columns if c not in ("_redacted", "warnings")], sent.alias("sanitized_text"))


def batch_verdicts(results: DataFrame, by: str = "batch_id") -> DataFrame:
    """One row per batch: a file that is neither clean nor redacted blocks all of it.

    results: by, id, action, risk_score, redaction_count, safe_name, blocked_reason. The file of the smallest id
    that blocks gives the reason.
    """
    bad = ~F.col("action").isin("clean", "redacted")
    n, total = F.col("files"), F.col("redactions")
    files = F.concat(n.cast("string"), F.lit(" file"), F.when(n == 1, "").otherwise("s"))
    summed = results.groupBy(by).agg(
        F.count(F.lit(1)).alias("files"), F.count(F.when(bad, 1)).alias("refused"), F.max("risk_score").alias("risk_score"), F.sum("redaction_count").alias("redactions"),
        F.array_sort(F.collect_set("action")).alias("actions"), F.array_sort(F.collect_set("blocked_reason")).alias("blocked_reasons"),
        F.min(F.when(bad, F.struct("id", "safe_name", "action"))).alias("first"),
    )
    text = (
        F.when(F.col("refused") > 0, F.concat(n.cast("string"), F.lit("-file upload blocked: "), F.col("first.safe_name"), F.lit(" ("), F.col("first.action"), F.lit(").")))
        .when(total > 0, F.concat(total.cast("string"), F.lit(" identifier"), F.when(total == 1, "").otherwise("s"), F.lit(" protected across "), files, F.lit(".")))
        .otherwise(F.concat(files, F.lit(" governed locally.")))
    )
    return summed.select(by, F.when(F.col("refused") > 0, "block").otherwise("allow").alias("batch_action"), "files", "refused", "risk_score", "redactions", "actions", "blocked_reasons", text.alias("summary"))


def with_attachments(action: Column, review: Column, flags: Column) -> Column:
    """struct<action, requires_review>: a prompt's decision after what its attachments were flagged for."""
    has = lambda *names: F.arrays_overlap(flags, F.array(*map(F.lit, names)))
    regulated = F.exists(flags, lambda f: f.startswith("regulated_"))
    stop = has("secret", "prompt_injection")
    personal = has("email", "phone", "address", "account", "possible_name")
    out = F.when(stop, "block").when(action == "block", "block").when(personal, "redact").when((action == "allow") & regulated, "warn").otherwise(action)
    more = F.when(stop, True).when(action == "block", review).when(personal, review | regulated).when((action == "allow") & regulated, True).otherwise(review)
    return F.struct(out.alias("action"), more.alias("requires_review"))


def merged_counts(maps: Column) -> Column:
    """Entity counts of several texts added up by type; maps is an array of maps."""
    entries = F.flatten(F.transform(F.filter(maps, lambda m: m.isNotNull()), F.map_entries))
    kinds = F.array_sort(F.array_distinct(F.transform(entries, lambda e: e["key"])))
    return F.map_from_entries(F.transform(kinds, lambda k: F.struct(k, F.aggregate(F.filter(entries, lambda e: e["key"] == k), F.lit(0).cast("long"), lambda n, e: n + e["value"]))))


def count_text(counts: Column) -> Column:
    """'2 EMAIL, 1 PHONE' by name of type; 'none' without any."""
    some = F.array_sort(F.filter(F.map_entries(counts), lambda e: e["value"] > 0))
    return F.when(F.size(some) > 0, F.array_join(F.transform(some, lambda e: F.concat(e["value"].cast("string"), F.lit(" "), e["key"])), ", ")).otherwise("none")
