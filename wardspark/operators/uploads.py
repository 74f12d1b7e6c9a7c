"""Files sent to a chat, and policy documents sent for import: what is accepted as what, and what is refused."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scan import scan

# What is accepted by type and by extension, and how extensions are named.
IMAGE_TYPES, IMAGE_EXTENSIONS = ("image/png", "image/jpeg", "image/webp"), (".png", ".jpg", ".jpeg", ".webp")
TEXT_TYPES = ("text/plain", "text/markdown", "text/csv", "application/csv", "application/json")
TEXT_EXTENSIONS = (".txt", ".md", ".csv", ".json", ".ts", ".tsx", ".js", ".jsx", ".py", ".yml", ".yaml", ".log")
WORD_TYPE = "application/vnd.openxmlformats-officedocument.wordprocessingml.document"
DOCUMENT_TYPES, DOCUMENT_EXTENSIONS = ("application/pdf", WORD_TYPE), (".pdf", ".docx")
TYPE_OF_EXTENSION = {
    ".txt": "text/plain", ".md": "text/markdown", ".csv": "text/csv", ".json": "application/json", ".ts": "text/plain", ".tsx": "text/plain", ".js": "text/plain", ".jsx": "text/plain",
    ".py": "text/plain", ".yml": "text/plain", ".yaml": "text/plain", ".log": "text/plain", ".pdf": "application/pdf", ".docx": WORD_TYPE, ".png": "image/png", ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".webp": "image/webp",
}
LABELS = {".csv": "CSV", ".md": "MD", ".json": "Code", ".ts": "Code", ".tsx": "Code", ".js": "Code", ".jsx": "Code", ".py": "Code"}
MOST_BYTES, MOST_CHARS = 5 * 1024 * 1024, 80_000
IMAGE_RISK, DOCUMENT_RISK = 18, 10
MOST_IMPORT_BYTES, LEAST_IMPORT_CHARS = 8 * 1024 * 1024, 80


def _named(values: dict, key: Column, other: str) -> Column:
    table = F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
    return F.coalesce(F.try_element_at(table, key), F.lit(other))


def upload_kind(name: Column, mime_type: Column) -> Column:
    """struct<kind, mime_type, label>: image, text, metadata or unsupported; a missing type follows from the extension."""
    extension = F.lower(F.regexp_extract(F.coalesce(name, F.lit("")), r"(\.[^.]*)$", 1))
    kind_of = F.coalesce(F.when(mime_type != "", mime_type), _named(TYPE_OF_EXTENSION, extension, "application/octet-stream"))
    kind = (
        F.when(kind_of.isin(*IMAGE_TYPES) & extension.isin(*IMAGE_EXTENSIONS), "image").when(kind_of.isin(*TEXT_TYPES) | extension.isin(*TEXT_EXTENSIONS), "text")
        .when(kind_of.isin(*DOCUMENT_TYPES) | extension.isin(*DOCUMENT_EXTENSIONS), "metadata").otherwise("unsupported")
    )
    label = F.when(kind == "image", "Image").when(kind == "text", _named(LABELS, extension, "TXT")).when(kind == "metadata", F.when(extension == ".docx", "DOCX").otherwise("PDF"))
    return F.struct(kind.alias("kind"), kind_of.alias("mime_type"), label.alias("label"))


def upload_problem(size: Column, kind: Column) -> Column:
    """Why a file is refused, or null."""
    return F.when(F.coalesce(size, F.lit(0)) <= 0, "empty").when(size > MOST_BYTES, "too_large").when(kind == "unsupported", "unsupported_type")


def uploaded(files: DataFrame) -> DataFrame:
    """A row per file (name, mime_type, size, content): its columns but the content, then kind, label, problem, action, risk_score, flags, status, redacted, data.

    Texts are decoded with replacement and scanned, the first 80,000 characters of them. Images pass with a warning
    and their content in base64, documents with their metadata alone. Refused files have a problem and nothing else.
    """
    kind = upload_kind(F.col("name"), F.col("mime_type"))
    base = files.select("*", kind.alias("k")).withColumn("problem", upload_problem(F.col("size"), F.col("k.kind")))
    read = F.col("problem").isNull() & (F.col("k.kind") == "text")
    text = F.when(read, F.substring(F.make_valid_utf8(F.coalesce(F.col("content").cast("string"), F.lit(""))), 1, MOST_CHARS)).otherwise("")
    image = F.col("problem").isNull() & (F.col("k.kind") == "image")
    rest = [c for c in files.columns if c not in ("content", "mime_type")]
    packed = base.select(F.struct(*rest, "k", "problem", read.alias("read"), F.when(image, F.regexp_replace(F.base64("content"), "[\r\n]", "")).alias("data")).alias("file"), text.alias("body"))
    done = scan(packed, "file", "body").select("file.*", "flags", "redacted", F.col("risk_score").alias("scanned"), F.col("action").alias("decided"))
    ok, own = F.col("problem").isNull(), F.col("k.kind")
    by = lambda image_, document, text_: F.when(ok, F.when(own == "image", image_).when(own == "metadata", document).otherwise(text_))
    return done.select(
        *rest, F.col("k.mime_type").alias("mime_type"), own.alias("kind"), F.col("k.label").alias("label"), "problem", by(F.lit("warn"), F.lit("allow"), F.col("decided")).alias("action"),
        by(F.lit(IMAGE_RISK), F.lit(DOCUMENT_RISK), F.col("scanned")).alias("risk_score"), F.when(F.col("read"), F.col("flags")).otherwise(F.array().cast("array<string>")).alias("flags"),
        by(F.lit("extracted"), F.lit("metadata_only"), F.when(F.col("decided") == "block", "blocked").otherwise("extracted")).alias("status"), F.when(F.col("read"), F.col("redacted")).alias("redacted"), "data",
    )


def import_problem(size: Column, text: Column) -> Column:
    """Why a policy document can't be imported, or null: more than 8 MiB, or fewer than 80 characters of text."""
    return F.when(size > MOST_IMPORT_BYTES, "too_large").when(F.length(F.coalesce(text, F.lit(""))) < LEAST_IMPORT_CHARS, "too_little_text")
