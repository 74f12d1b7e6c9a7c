"""A governed chat request from prompt to answer, as one chain of columns: no step leaves its row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import js_trim
from ..functions.scan import flagged, rehydrated, risk_level, risk_score, scan
from .attachments import count_text, with_attachments

# Models by name and label, their provider and what they read.
MODELS = (
    ("gpt-4.1", "GPT-4.1", "openai", ("text", "image", "document_text", "file_metadata")), ("gpt-4.1-mini", "GPT-4.1 Mini", "openai", ("text", "document_text", "file_metadata")),
    ("claude-sonnet", "Claude Sonnet", "anthropic", ("text", "image", "document_text", "file_metadata")), ("gemini-pro", "Gemini Pro", "gemini", ("text", "image", "document_text", "file_metadata")),
    ("internal-mock", "Internal Mock", "mock", ("text", "image", "document_text", "file_metadata")),
)
# Words that ask for a message, and what the provider is told for each case.
WRITING = r"(?<![A-Za-z0-9_])(?:email|message|letter|response|reply|draft|write)(?![A-Za-z0-9_])"
INSTRUCTIONS = {
    "regulated_writing": "The user is asking for help drafting a regulated communication. Respond with useful neutral wording, use placeholders for redacted identifiers, avoid making final decisions, and do not ask for the redacted identifiers again.",
    "writing": "The user is asking for help drafting communication. Preserve the work intent, use existing numbered placeholders for redacted identifiers, and avoid asking for those identifiers again.",
    "redact": "Personal data was redacted. Continue the task using existing numbered placeholders and do not request redacted identifiers unless the task cannot proceed without them.",
    "warn": "A policy warning exists. Help the user complete the task in a safer, policy-aware way.",
    "other": "Answer the user's sanitized request directly while respecting governance and privacy defaults.",
}
REFUSAL = "This request was blocked before provider routing. Remove secrets or instruction-bypass language, then try again."


def _model_key(value: Column) -> Column:
    return F.regexp_replace(F.lower(js_trim(value)), r"\s+", "-")


def model(value: Column) -> Column:
    """struct<id, label, provider, inputs> of a model named by id or label; the first for unknown ones."""
    shape = "struct<id:string,label:string,provider:string,inputs:array<string>>"
    entry = lambda m: F.struct(F.lit(m[0]).alias("id"), F.lit(m[1]).alias("label"), F.lit(m[2]).alias("provider"), F.array(*map(F.lit, m[3])).alias("inputs")).cast(shape)
    names = {name: m for m in reversed(MODELS) for name in (m[0], m[1].lower().replace(" ", "-"))}
    table = F.create_map(*[x for name, m in names.items() for x in (F.lit(name), entry(m))])
    return F.coalesce(F.try_element_at(table, _model_key(F.coalesce(value, F.lit("")))), entry(MODELS[0]))


def input_kinds(attachments: Column) -> Column:
    """What a request holds, from its attachments (array of kind, text)."""
    some = lambda test: F.exists(attachments, test)
    return F.array_compact(F.array(
        F.lit("text"), F.when(F.size(attachments) > 0, "file_metadata"), F.when(some(lambda a: a["kind"] == "image"), "image"),
        F.when(some(lambda a: a["kind"].isin("text", "document") & (js_trim(F.coalesce(a["text"], F.lit(""))) != "")), "document_text"),
    ))


def support_problem(kinds: Column, supported: Column) -> Column:
    """Why a model can't take a request, or null."""
    missing = F.array_except(kinds, supported)
    return (
        F.when(F.array_contains(missing, "image"), "This model does not support image input. Choose a vision-capable model.")
        .when(F.array_contains(missing, "document_text"), "This model does not support document text input. Choose a model with document support.")
        .when(F.size(missing) > 0, F.concat(F.lit("This model does not support "), F.array_join(missing, ", "), F.lit(" input.")))
    )


def normalised_requests(requests: DataFrame) -> DataFrame:
    """Requests with their defaults; rows without a prompt come out with a problem.

    requests: request_id, prompt, model, use_case, sensitivity, conversation_id, attachments (array of kind, text,
    flags, risk_score).
    """
    or_ = lambda name, default: F.when(js_trim(name) != "", F.col(name)).otherwise(default).alias(name)
    none = F.array().cast(requests.schema["attachments"].dataType)
    conversation = F.when(js_trim("conversation_id").isin("", "ephemeral", "new-chat"), None).otherwise(F.substring("conversation_id", 1, 160))
    return requests.select(
        "request_id", js_trim(F.coalesce("prompt", F.lit(""))).alias("prompt"), model(F.col("model")).alias("model"), or_("use_case", "General"), or_("sensitivity", "Internal"),
        conversation.alias("conversation_id"), F.coalesce("attachments", none).alias("attachments"),
        F.when(js_trim(F.coalesce("prompt", F.lit(""))) == "", "Prompt is required.").alias("problem"),
    )


def instruction(prompt: Column, flags: Column, action: Column) -> Column:
    writes = F.lower(prompt).rlike(WRITING)
    regulated = F.exists(flags, lambda f: f.startswith("regulated_"))
    say = {k: F.lit(v) for k, v in INSTRUCTIONS.items()}
    return F.when(writes & regulated, say["regulated_writing"]).when(writes, say["writing"]).when(action == "redact", say["redact"]).when(action == "warn", say["warn"]).otherwise(say["other"])


# The lines of the context that goes to a provider with a prompt, and how they name what is missing.
CONTEXT_LINES = (
    ("Use case: ", "use_case"), ("Sensitivity: ", "sensitivity"), ("Thinking mode: ", "thinking"), ("Policy decision: ", "action"), ("Risk score: ", "risk_score"), ("Risk level: ", "risk_level"),
    ("Detected flags: ", "flags"), ("Redacted entities: ", "entities"), ("Placeholder IDs: ", "placeholders"),
    ("Placeholder rule: Private entities are represented by stable numbered placeholders. Preserve existing placeholders exactly; do not rename, merge, or invent them.", None),
    ("Selected tools: ", "tools"), ("Attachments metadata: ", "files"), ("Attachment scan results: ", "scans"), ("Redacted prompt preview: ", "preview"),
    ("Logging behavior: rawContentStored=false, redactedPreviewStored=true, metadataStored=true", None), ("Instruction: ", "instruction"),
)


def prompt_context(fields: dict[str, Column]) -> Column:
    """The governance context that stands before a prompt. fields: use_case, sensitivity, thinking (boolean), action, risk_score, flags (array),
    entity_counts (map), placeholders (array), tools (array), attachments (array of name, type, status, flags, visual_scan_limited), preview, instruction."""
    listed = lambda a: F.when(F.size(a) > 0, F.array_join(a, ", ")).otherwise("none")
    files, counts = fields["attachments"], count_text(fields["entity_counts"])
    scans = F.transform(files, lambda a: F.concat(
        a["name"], F.lit(": status="), F.coalesce(a["status"], F.lit("metadata")), F.lit(", flags="), listed(F.coalesce(a["flags"], F.array().cast("array<string>"))),
        F.when(a["visual_scan_limited"], ", visual_scan_limited=true").otherwise("")))
    shown = fields | {
        "thinking": F.when(fields["thinking"], "enabled").otherwise("disabled"), "risk_level": risk_level(fields["risk_score"]), "risk_score": fields["risk_score"].cast("string"), "flags": listed(fields["flags"]),
        "entities": F.when(counts == "none", "None").otherwise(counts), "placeholders": listed(fields["placeholders"]), "tools": listed(fields["tools"]),
        "files": F.when(F.size(files) > 0, F.array_join(F.transform(files, lambda a: F.concat(a["name"], F.lit(" ("), a["type"], F.lit(")"))), ", ")).otherwise("No file content attached."),
        "scans": F.when(F.size(files) > 0, F.array_join(scans, "; ")).otherwise("none"),
    }
    lines = [F.lit(head) if name is None else F.concat(F.lit(head), F.coalesce(shown[name], F.lit(""))) for head, name in CONTEXT_LINES]
    return F.concat_ws("\n", F.lit("Governance context:"), *lines)


def plain_answer(preview: Column, use_case: Column, entities: Column) -> Column:
    """A provider without a model, for tests: greets the first person by placeholder and repeats what was sent."""
    person = F.get(F.filter(entities, lambda e: e["type"] == "PERSON"), F.lit(0))["id"]
    return F.concat(F.lit("Hi "), F.coalesce(person, F.lit("there")), F.lit(". Draft for "), use_case, F.lit(": "), preview)


def answered(requests: DataFrame, provider: Callable[[Column, Column, Column], Column] = plain_answer) -> DataFrame:
    """One row per request: the decision, what the provider was told and said, and the answer with known placeholders put back.

    The prompt is scanned and redacted; flags and risks of attachments count too. A blocked request, one that
    its model can't read, and one without a prompt do not reach the provider. Answers are scanned for flags only.
    ``provider`` makes a column of an answer from the redacted prompt, the use case and the entities.
    """
    # The request goes through the scan as one value: no join, so repeated and missing ids stay requests of their own.
    base = normalised_requests(requests).select(F.struct("*").alias("request"), "prompt")
    sensitive = F.col("sensitivity")
    joined = scan(base, "request", "prompt").select("request.*", "entities", "redacted", "redaction_map", "entity_counts", "flags", "action")
    extra = F.flatten(F.transform("attachments", lambda a: F.coalesce(a["flags"], F.array().cast("array<string>"))))
    review = F.array_contains("flags", "prompt_injection") | F.exists("flags", lambda f: f.startswith("regulated_"))
    told = joined.select(
        "request_id", "prompt", "model", "use_case", "sensitivity", "conversation_id", "entities", "redacted", "redaction_map", "entity_counts", "flags", extra.alias("attachment_flags"),
        with_attachments(F.col("action"), review, extra).alias("decision"), risk_score(F.col("flags"), sensitive).alias("prompt_risk"),
        F.coalesce(F.array_max(F.transform("attachments", lambda a: a["risk_score"])), F.lit(0)).alias("attachment_risk"),
        F.coalesce("problem", support_problem(input_kinds(F.col("attachments")), F.col("model.inputs"))).alias("problem"),
    )
    called = F.col("problem").isNull() & (F.col("decision.action") != "block")
    said = told.select(
        "*", called.alias("provider_called"), instruction(F.col("prompt"), F.col("flags"), F.col("decision.action")).alias("instruction"),
        F.when(called, provider(F.col("redacted"), F.col("use_case"), F.col("entities"))).when(F.col("problem").isNull(), REFUSAL).alias("reply"),
    )
    done = _checked(said).select("*", rehydrated(F.coalesce("reply", F.lit("")), F.col("redaction_map")).alias("h"))
    risk = F.greatest("prompt_risk", "attachment_risk", risk_score(F.col("reply_flags"), sensitive))
    return done.select(
        "request_id", F.col("model.id").alias("model"), F.col("model.provider").alias("provider"), "problem", F.col("decision.action").alias("action"),
        F.col("decision.requires_review").alias("requires_review"), "provider_called", "instruction", F.col("redacted").alias("preview"), F.when(F.col("problem").isNull(), F.col("h.text")).alias("answer"),
        risk.alias("risk_score"), risk_level(risk).alias("risk_level"), F.array_distinct(F.concat("flags", "attachment_flags", "reply_flags")).alias("flags"),
        F.size("redaction_map").alias("redactions"), count_text(F.col("entity_counts")).alias("redacted_types"), F.transform("redaction_map", lambda m: m["id"]).alias("placeholders"),
        F.col("h.replaced").alias("restored"), F.size("h.unresolved").alias("unresolved"),
    )


def _checked(said: DataFrame) -> DataFrame:
    """With the flags of the reply."""
    packed = said.select(F.struct("*").alias("said"), F.col("reply"))
    out = flagged(packed, ["said"], "reply")
    return out.select("said.*", F.col("flags").alias("reply_flags"))
