"""Uploads, flag texts, places of restored values and imported rules on literal cases."""

from pyspark.sql import functions as F

from wardspark.functions import scan as S
from wardspark.operators import evaluation, rules, uploads


def test_uploads_by_kind(spark):
    rows = [
        (1, "a.md", "", 9, bytearray(b"mail x@a.org \xff")), (2, "b.png", "image/png", 3, bytearray(b"\x01" * 99)), (3, "c.docx", None, 9, None), (4, "d.exe", "", 9, None), (5, "e.txt", "", 0, None),
        (6, "f.txt", "", 6 << 20, None), (None, "g.png", "text/plain", 9, bytearray(b"please jailbreak")), (1, "noext", "text/plain", 9, None),
    ]
    df = spark.createDataFrame(rows, "id long, name string, mime_type string, size long, content binary")
    got = {r.name: r for r in uploads.uploaded(df).collect()}
    assert len(got) == 8 and {n: (r.kind, r.label, r.problem) for n, r in got.items()} == {
        "a.md": ("text", "MD", None), "b.png": ("image", "Image", None), "c.docx": ("metadata", "DOCX", None), "d.exe": ("unsupported", None, "unsupported_type"), "e.txt": ("text", "TXT", "empty"),
        "f.txt": ("text", "TXT", "too_large"), "g.png": ("text", "TXT", None), "noext": ("text", "TXT", None),
    }
    assert got["a.md"].redacted == "mail [EMAIL_1] �" and (got["a.md"].action, got["a.md"].status) == ("redact", "extracted")
    assert (got["b.png"].action, got["b.png"].risk_score, got["b.png"].data, got["b.png"].redacted) == ("warn", 18, "AQEB" * 33, None)
    assert (got["c.docx"].action, got["c.docx"].risk_score, got["c.docx"].status) == ("allow", 10, "metadata_only")
    assert (got["g.png"].action, got["g.png"].status) == ("block", "blocked") and got["f.txt"].action is None and got["f.txt"].flags == []


def test_imports_need_text(spark):
    df = spark.createDataFrame([("x" * 79, 10), ("x" * 80, 10), (None, 10), ("x" * 99, 9 << 20)], "text string, size long")
    assert [r[0] for r in df.select(uploads.import_problem(F.col("size"), F.col("text"))).collect()] == ["too_little_text", None, "too_little_text", "too_large"]


def test_flags_say_what_they_stand_on(spark):
    df = spark.createDataFrame([(["email", "prompt_injection", "other"],)], "flags array<string>")
    got = [tuple(x) for x in df.select(S.flag_details(F.col("flags"), "attachment")).first()[0]]
    assert got[0] == ("email", "Email address", "medium", "attachment", "Email-like pattern detected.") and got[1][2] == "critical" and got[2][1] is None


def test_places_of_restored_values(spark):
    df = spark.createDataFrame([("é[EMAIL_1]\U0001f600 [SECRET_1] [EMAIL_2][EMAIL_1]", [("[EMAIL_1]", "a@x"), ("[SECRET_1]", "s")])], "t string, m array<struct<id:string,original:string>>")
    h = df.select(S.rehydrated(F.col("t"), F.col("m")).alias("h")).first().h
    assert [(s.id, h.text[s.start : s.stop]) for s in h.spans] == [("[EMAIL_1]", "a@x")] * 2 and h.replaced == 2


def test_imported_rules(spark):
    lines = ['{"name": "No names", "dataCategories": ["A b", 3, null, "c"], "action": 5}', '{"dataCategories": "x, y"}', "[1]", "nonsense", None, '{"name": null, "dataCategories": {}}']
    df = spark.createDataFrame([(i, v) for i, v in enumerate(lines)], "n int, value string")
    got = {r.n: (r.name, r.data_categories, r.action) for r in rules.imported_drafts(df).collect()}
    assert got == {0: ("No names", "A b\nc", ""), 1: ("", "x, y", ""), 5: ("", "", "")}


def test_entity_keys(spark):
    assert spark.range(1).select(evaluation.entity_key(F.lit("PERSON"), F.lit("  Ann \n LEE "))).first()[0] == "PERSON::ann lee"
