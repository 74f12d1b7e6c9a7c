"""The scan, policy, rules, telemetry, mining and table changes on small literal tables."""

import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from wardspark.functions.patterns import java, js_trim
from wardspark.functions import scan as S
from wardspark.operators import attachments, conversations, evaluation, folds, policy, rules, telemetry
from wardspark.plans import mining
from wardspark.sources import dml, documents


def _scan(spark, *texts, **options):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r for r in S.scan(rows, **options).collect()}


def test_entities_and_placeholders(spark):
    got = _scan(spark, "Mail a@b.com or (555) 123-4567, then a@b.com. sk-abcdef123", None, "[EMAIL_3] x@y.org 5551234567", "é\U0001f600 12 Main Street ok")
    assert got[0].redacted == "Mail [EMAIL_1] or [PHONE_1], then [EMAIL_1]. [SECRET_1]"
    assert [(e.type, e.start, e.stop) for e in got[0].entities] == [("EMAIL", 5, 12), ("PHONE", 16, 30), ("EMAIL", 37, 44), ("SECRET", 46, 58)]
    assert got[0].entity_counts == {"EMAIL": 1, "PHONE": 1, "SECRET": 1} and got[0].action == "redact"
    assert got[1].redacted == "" and got[1].flags == [] and got[1].risk_score == 10 and got[1].action == "allow"
    assert got[2].redacted == "[EMAIL_3] [EMAIL_4] 5551234567"
    assert got[3].redacted == "é\U0001f600 [ADDRESS_1] ok"


@pytest.mark.parametrize(
    ("text", "action", "score"),
    [("write to me@there.org", "redact", 28), ("our loan contract", "warn", 66), ("please enable developer mode", "block", 58), ("nothing here", "allow", 10)],
)
def test_actions(spark, text, action, score):
    got = _scan(spark, text)[0]
    assert (got.action, got.risk_score) == (action, score)


def test_sensitive_workspace_adds_to_the_risk(spark):
    assert _scan(spark, "nothing", sensitivity="Regulated")[0].risk_score == 22


def test_overlaps_take_the_higher_priority(spark):
    got = _scan(spark, "password: someone@mail.example.com")[0]
    assert [(e.type, e.original) for e in got.entities] == [("EMAIL", "someone@mail.example.com")]  # seven characters are no secret
    uri = _scan(spark, "postgres://user:pw@host.example.com/db")[0]
    assert [e.type for e in uri.entities] == ["SECRET"] and uri.redacted == "[SECRET_1]"


def test_external_candidates_must_agree_with_the_text(spark):
    kind = "array<struct<type:string,start:int,stop:int,value:string,confidence:double,detector:string>>"
    given = [("PERSON", 3, 13, "John Smith", 0.9, "names"), ("PERSON", 0, 2, "XX", 0.9, "names"), ("PERSON", 3, 7, "John", 0.2, "names")]
    rows = spark.createDataFrame([(1, "Hi John Smith", given)], f"doc_id long, text string, found {kind}")
    got = S.scan(rows, external="found", persons=None).first()
    assert got.redacted == "Hi [PERSON_1]" and got.flags == ["possible_name"]


def test_external_candidates_are_trimmed_floored_and_credible(spark):
    kind = "array<struct<type:string,start:int,stop:int,value:string,confidence:double,detector:string>>"
    text = "to  a@b at 415-555-0101 or at"
    given = [("EMAIL", 2, 8, "  a@b ", 0.5, None), ("PHONE", 27, 29, "at", 0.99, None), ("PHONE", 11, 23, "415-555-0101", 0.1, None), ("ACCOUNT", 24, 26, "or", 0.5, None), ("OTHER", 2, 4, "  ", 0.9, None)]
    got = S.scan(spark.createDataFrame([(1, text, given)], f"doc_id long, text string, found {kind}"), external="found", persons=None).first()
    assert [(e.type, e.start, e.stop, e.confidence) for e in got.entities] == [("EMAIL", 4, 7, 0.96), ("PHONE", 11, 23, 0.9)]


def test_rehydration_leaves_secrets_and_unknown(spark):
    rows = spark.createDataFrame([("Hi [PERSON_1], [SECRET_1] [PERSON_99]", [("[PERSON_1]", "Ann Lee"), ("[SECRET_1]", "x")])], "text string, m array<struct<id:string,original:string>>")
    got = rows.select(S.rehydrated(F.col("text"), F.col("m")).alias("h")).first().h
    assert (got.text, got.replaced, got.unresolved) == ("Hi Ann Lee, [SECRET_1] [PERSON_99]", 1, ["[SECRET_1]", "[PERSON_99]"])


def _decide(spark, flags, sanitizable, rule_rows, destination="personal"):
    signals = spark.createDataFrame([(1, flags, {}, 1, sanitizable, "chatgpt", destination, "all", "all")], "doc_id long, flags array<string>, entity_counts map<string,int>, redaction_count int, sanitizable boolean, ai_provider string, destination_type string, user_scope string, department_scope string")
    table = spark.createDataFrame(rule_rows, "rule_key string, version int, data_categories array<string>, ai_provider string, destination_type string, action string, fallback_action string, severity string, user_scope string, department_scope string, source_policy string, source_section string, explanation string")
    return policy.evaluate(signals, table).first()


def test_policy_precedence_and_fallback(spark):
    rule = lambda key, cats, action, severity="high", provider="any", destination="any": (key, 1, cats, provider, destination, action, "block", severity, "all", "", "P", "1", "E.")
    transform = rule("t", ["Personal_Data"], "transform")
    assert _decide(spark, ["email"], True, [transform]).action == "redact"
    assert _decide(spark, ["email"], False, [transform]).action == "block"
    got = _decide(spark, ["email"], True, [transform, rule("b", ["personal_data"], "block", "low")])
    assert got.rule_key == "b" and got.triggered and "blocking" in got.explanation
    none = _decide(spark, ["regulated_legal"], True, [transform], "enterprise")
    assert none.action == "allow" and not none.triggered
    assert _decide(spark, ["email"], True, [rule("o", ["personal_data"], "block", provider="gemini")]).action == "allow"


def test_rule_lifecycle(spark):
    r = spark.createDataFrame([("c", "k", 1, "a", "approved", True), ("c", "k", 2, "b", "draft", False), ("c", "z", 1, "d", "draft", False)], "company_slug string, rule_key string, version int, id string, status string, active boolean")
    after = {x.id: x for x in rules.set_status(r, spark.createDataFrame([("b", "approved")], "id string, new_status string")).collect()}
    assert after["b"].active and not after["a"].active and after["d"].status == "draft"
    assert {x.id for x in rules.delete_rules(r, spark.createDataFrame([("a",), ("d",)], "id string")).collect()} == {"a", "b"}
    nothing = r.where("false").select("company_slug", "id", "rule_key", "version")
    made = rules.publish(r, nothing, nothing.select("company_slug", "version"), ["rule_key", "version"]).collect()
    assert [(b.version, b.rule_count, b.rules) for b in made] == [(1, 1, ['{"rule_key":"k","version":1}'])]


def test_telemetry_defaults_and_limits(spark):
    kind = "event_id long, event_type string, surface string, company_slug string, user_label string, install_id string, conversation_key string, action string, risk_score double, risk_level string, flags array<string>, entity_counts map<string,double>, redaction_count long, attachment_count long, metadata map<string,string>, occurred_at timestamp"
    nan = float("nan")
    rows = [(1, "message_blocked", " ", "My Co!", None, None, None, "what", nan, None, None, None, None, None, None, None), (2, "x", "web", None, "u", "i", "c", "warn", 84.5, "odd", ["", " a "], {"A": 1.5, "B": nan}, 99999, -4, {"userLabel": "own"}, dt.datetime(2024, 1, 1))]
    a, b = telemetry.normalised(spark.createDataFrame(rows, kind)).orderBy("event_id").collect()
    assert (a.surface, a.company_slug, a.user_label, a.action, a.risk_score, a.risk_level, a.flags) == ("chatgpt", "my-co", "Test user", "block", 0, "low", [])
    assert (b.event_type, b.company_slug, b.risk_score, b.risk_level, b.flags, b.entity_counts) == ("extension_error", "test-company", 85, "critical", [" a "], {"A": 2})
    assert b.redaction_count == 10000 and b.attachment_count == 0 and b.metadata == {"userLabel": "own"}


def test_daily_usage_fills_gaps(spark):
    e = spark.createDataFrame([(dt.datetime(2024, 1, 1), "message_sent_to_ai", "allow", 0), (dt.datetime(2024, 1, 3), "message_blocked", "block", 90)], "created_at timestamp, event_type string, action string, risk_score int")
    assert [(r.requests, r.flagged) for r in telemetry.daily_usage(e).orderBy("day").collect()] == [(1, 0), (0, 0), (1, 1)]
    assert telemetry.daily_usage(e.limit(0)).count() == 0
    assert {r.level: r.n for r in telemetry.risk_distribution(e.limit(0).withColumn("risk_level", F.lit("low"))).collect()} == {"low": 0, "medium": 0, "high": 0, "critical": 0}


def test_streamed_counts_hold_days_of_a_long_span(spark, tmp_path, monkeypatch):
    from wardspark import catalog
    from wardspark.streaming import live

    one_by_one = live.event_stream
    monkeypatch.setattr(live, "event_stream", lambda s, folder, schema: one_by_one(s, folder, schema, files_at_once=1))
    e = spark.range(400).selectExpr("id as event_id", "id % 8 as user_id", "cast(20 as double) as value", "'{}' as props", "timestamp'2023-01-01' + make_interval(0, 0, 0, cast(id % 200 as int) * 3) as ts")
    e.repartition(4).write.parquet(str(tmp_path / "events.parquet"))
    got = catalog.streamed_daily_counts(spark, str(tmp_path)).collect()
    sent = sum(1 for i in range(400) if catalog._TYPES[i % 6] in ("message_sent_to_ai", "message_blocked"))
    assert len({r.day for r in got}) == 200 and sum(r.requests for r in got) == sent


def test_presence_forgets_days_that_are_over(spark, tmp_path):
    from wardspark.streaming import live

    at = lambda day, hour: dt.datetime(2024, 1, day, hour)
    schema = "company_slug string, install_id string, created_at timestamp"
    for part in ([("c", "a", at(1, 3)), ("c", "a", at(1, 9)), ("c", "b", at(1, 4))], [("c", "a", at(5, 1))], [("c", "b", at(1, 8)), ("c", "a", at(9, 1))]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = live.event_stream(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema)
        out = live.run_once(live.presence(stream), str(tmp_path / "out"), str(tmp_path / "state"))
    # What comes after its day is over is late.
    assert sorted((r.install_id, r.last_seen) for r in out.collect()) == [("a", at(1, 9)), ("a", at(5, 1)), ("b", at(1, 4))]


def test_mined_rules(spark):
    text = "AI USAGE POLICY\nEmployees must not submit client names or personal data to public AI tools. Approval is required before legal contracts are shared with ChatGPT.\nData Handling\n- Staff should redact customer email addresses before using Gemini."
    docs = spark.createDataFrame([(1, text), (2, "Lunch is at noon.")], "doc_id long, text string")
    got = mining.with_fallback(docs, mining.inferred_rules(mining.sections(docs))).collect()
    by = {(r.doc_id, r.action): r for r in got}
    assert by[1, "block"].source_section == "AI USAGE POLICY" and by[1, "block"].destination_type == "personal"
    assert by[1, "require_approval"].ai_provider == "chatgpt" and by[1, "transform"].ai_provider == "gemini"
    assert by[2, "warn"].confidence == 35 and by[2, "warn"].rule_key == "review_imported_ai_policy"


def test_long_lines_and_tabs_of_policies(spark):
    long = "Customer records and bank account details stay in house always. Staff must not paste secrets into tools that the firm does not run. " + "Filler words go on here. " * 20
    docs = spark.createDataFrame([(1, long), (2, "\tDATA RULES\n\t-\tEmployees must not share customer records with outside tools.\n\tMore text follows in this same paragraph of rules.")], "doc_id long, text string")
    got = {(r.doc_id, r.text): r.heading for r in mining.sections(docs).collect()}
    assert (1, "Customer records and bank account details stay in house always.") in got
    assert got[2, "Employees must not share customer records with outside tools."] == "DATA RULES"


def test_white_space_is_more_than_spaces(spark):
    assert spark.range(1).select(telemetry.text_or(F.lit("\n\t\u00a0"), "none", 9)).first()[0] == "none"


def test_paragraphs_end_with_the_line_that_fills_them(spark):
    line = lambda i: f"line {i} " + "x" * 392
    docs = spark.createDataFrame([(1, "\n".join(line(i) for i in range(9)))], "doc_id long, text string")
    got = [r.text for r in mining.sections(docs).orderBy("ordinal").collect()]
    assert got == [f"{line(i)} {line(i + 1)}" for i in range(0, 8, 2)] + [line(8)]


def test_each_row_is_mined_by_itself(spark):
    rule = "Employees must not paste source code into outside tools."
    rows = [(1, rule), (1, "Lunch is at noon."), (None, rule), (None, rule), (None, None), (2, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("place", F.lit("other"))
    got = mining.mined(docs)
    assert sorted((str(r.doc_id), r.place, r.action, r.confidence) for r in got.collect()) == [
        ("1", 1, "block", 75), ("1", 1, "warn", 35), ("2", 1, "warn", 35), ("None", 1, "block", 75), ("None", 1, "block", 75), ("None", 1, "warn", 35),
    ]
    assert got.where("confidence = 35 and excerpt is null").isEmpty() and mining.mined(docs.limit(0)).isEmpty()
    plain = docs.where("text is not null and doc_id is not null").withColumn("doc_id", F.monotonically_increasing_id())
    apart = mining.with_fallback(plain, mining.inferred_rules(mining.sections(plain)))
    assert mining.mined(plain).exceptAll(apart).isEmpty() and apart.count() == 3


def test_words_of_policies_end_at_accents(spark):
    docs = spark.createDataFrame([(1, "Notes of d\u00e9hr must stay inside the walls of the firm.")], "doc_id long, text string")
    assert mining.mined(docs).first().data_categories == ["hr_context"]


def test_policy_of_many_lines(spark):
    text = "\n".join(f"Data Rules\nStaff number {i} must not send records to any tool." for i in range(50_000))
    began = time.time()
    got = mining.mined(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    first = {f"Staff number {i} must not send records to any tool." for i in range(8)}
    assert {r.excerpt for r in got} == first and {r.source_section for r in got} == {"Data Rules"}
    assert time.time() - began < 60


def test_folded_messages(spark):
    m = spark.createDataFrame([(1, 0, "invite olga petrova and sven lindqvist to the picnic"), (1, 1, "then [EMAIL_4] and x@a.org"), (2, 0, "olga petrova stays home")], "conv_id long, turn long, text string")
    v = folds.fold(m).vault
    assert {(r.conv_id, r.original, r.placeholder) for r in v.collect()} == {(1, "olga petrova", "[PERSON_1]"), (1, "sven lindqvist", "[PERSON_2]"), (1, "x@a.org", "[EMAIL_5]")}
    later = spark.createDataFrame([(1, 2, "Sven Lindqvist sings; OLGA PETROVA too, xolga petrova not"), (2, 1, "olga petrova stays home")], m.schema)
    got = {r.conv_id: r for r in folds.fold(later, v).messages.collect()}
    assert got[1].redacted == "[PERSON_2] sings; [PERSON_1] too, xolga petrova not" and got[1].risk_score == 40 and got[1].flags == ["possible_name"]
    assert got[2].redacted == "olga petrova stays home" and got[2].risk_score == 10
    told = spark.createDataFrame([(7, 0, "Hi [PERSON_1]")], m.schema)
    draft = spark.createDataFrame([(7, "[PERSON_1]", "Ann Lee")], "conv_id long, placeholder string, original string")
    assert conversations.rehydrate_messages(told, v, draft).first().text == "Hi Ann Lee"


def test_moved_vaults(spark):
    kind = "conv_id string, type string, original string, placeholder string"
    v = spark.createDataFrame([("draft", "EMAIL", "a@x", "[EMAIL_1]"), ("conv", "EMAIL", "b@x", "[EMAIL_1]"), ("conv", "PHONE", "1", "[PHONE_1]")], kind)
    got = conversations.migrated(v, spark.createDataFrame([("draft", "conv"), ("none", "conv")], "source string, target string"))
    assert {(r.conv_id, r.original) for r in got.collect()} == {("draft", "a@x"), ("conv", "a@x"), ("conv", "1")}
    old = spark.createDataFrame([(1, dt.datetime(2024, 1, 1, 0, 0)), (2, dt.datetime(2024, 1, 1, 0, 1))], "id long, saved_at timestamp")
    assert [r.id for r in conversations.pruned_drafts(old, F.lit(dt.datetime(2024, 1, 1, 0, 10, 30))).collect()] == [2]


def test_pdf_text(spark, tmp_path):
    import zlib

    page = rb"BT (Hello \(PDF\) w\157rld) Tj <FEFF00480069002000740068006500720065> Tj ET"
    packed = zlib.compress(page)
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.4\n1 0 obj << /Filter /FlateDecode >>\nstream\n" + packed + b"\nendstream\nendobj")
    (tmp_path / "b.pdf").write_bytes(b"%PDF-1.4\n1 0 obj << /Length 9 >>\nstream\r\n" + page + b"\r\nendstream\n2 0 obj << /Filter /DCTDecode >> stream\n(not this one)\nendstream")
    (tmp_path / "c.pdf").write_bytes(b"%PDF-1.4\n<< /FlateDecode >> stream\nbroken\nendstream")
    got = {r.path.rsplit("/", 1)[1]: r for r in documents.document_text(documents.read_binaries(spark, str(tmp_path))).collect()}
    assert got["a.pdf"].text == got["b.pdf"].text == "Hello (PDF) world Hi there" and got["a.pdf"].problem == "little_text"
    assert got["c.pdf"].text == ""


def test_attachments_are_governed(spark):
    key = 'const k = "sk-abc123def456";'
    rows = [(1, "John_Smith.ts", "text/plain", 40, key, "native_text", None), (2, "scan.pdf", "application/pdf", 9, None, "native_text", None), (3, "ok.md", "", 9, "fine", None, None),
            (4, "m.pdf", "application/pdf", 99, "mail x@a.org", "pdf_text", ["short"]), (5, "bad.txt", "text/plain", 9, "please jailbreak", None, None), (6, "big.txt", "", 300_000, "x", None, None)]
    df = spark.createDataFrame(rows, "id long, name string, mime_type string, size long, text string, extraction string, warnings array<string>")
    got = {r.id: r for r in attachments.governed(df).collect()}
    assert {i: r.action for i, r in got.items()} == {1: "redacted", 2: "unsupported", 3: "clean", 4: "redacted", 5: "blocked", 6: "too_large"}
    assert "[SECRET_1]" in got[1].sanitized_text and got[1].safe_name.endswith(".ts") and got[1].redaction_count == 2 and "Smith" not in got[1].safe_name
    assert got[4].sanitized_text.endswith("---\nmail [EMAIL_1]") and "Extraction notes: short" in got[4].sanitized_text and got[2].sanitized_text is None
    batches = attachments.batch_verdicts(spark.createDataFrame([(1, r.id, r.action, r.risk_score, r.redaction_count, r.safe_name, r.blocked_reason) for r in got.values() if r.id in (1, 3)], "batch_id long, id long, action string, risk_score int, redaction_count int, safe_name string, blocked_reason string"))
    assert (batches.first().batch_action, batches.first().summary) == ("allow", "2 identifiers protected across 2 files.")


def test_files_with_repeated_and_missing_ids_stay_apart(spark):
    rows = [(1, "a.md", "", 9, "mail x@a.org", None, None), (1, "b.md", "", 9, "fine", None, None), (None, "c.md", "", 9, "mail y@a.org", None, None)]
    df = spark.createDataFrame(rows, "id long, name string, mime_type string, size long, text string, extraction string, warnings array<string>")
    done = attachments.governed(df)
    assert sorted((r.id or 0, r.safe_name, r.action, r.sanitized_text) for r in done.collect()) == [(0, "c.md", "redacted", "mail [EMAIL_1]"), (1, "a.md", "redacted", "mail [EMAIL_1]"), (1, "b.md", "clean", "fine")]
    assert "Exchange" not in done._jdf.queryExecution().executedPlan().toString()


def test_scores_of_empty_denominators(spark):
    none = spark.createDataFrame([], "id long, type string")
    some = spark.createDataFrame([(1, "a"), (2, "a")], "id long, type string")
    got = evaluation.scores(evaluation.matched(some, none, ["id", "type"]), ["type"]).first()
    assert (got.tp, got.fp, got.fn, got.precision, got.recall, got.f1) == (0, 0, 2, 1.0, 0.0, 0.0)
    assert evaluation.false_alert_rate(some, none, "id").first().rate == 0.0


def test_vault_numbers_by_first_place(spark):
    m = spark.createDataFrame([(1, 0, "x@a.org"), (1, 1, "y@a.org and x@a.org"), (2, 0, "y@a.org")], "conv_id long, turn long, text string")
    v = folds.fold(m).vault
    assert {(r.conv_id, r.original, r.placeholder) for r in v.collect()} == {(1, "x@a.org", "[EMAIL_1]"), (1, "y@a.org", "[EMAIL_2]"), (2, "y@a.org", "[EMAIL_1]")}
    told = spark.createDataFrame([(1, 2, "to [EMAIL_2]"), (3, 0, "[EMAIL_1]")], "conv_id long, turn long, text string")
    assert {r.text for r in conversations.rehydrate_messages(told, v).collect()} == {"to y@a.org", "[EMAIL_1]"}


def test_table_changes(spark):
    t = spark.createDataFrame([(1, "a"), (2, None)], "k long, v string")
    assert sorted(dml.upsert(t, spark.createDataFrame([(2, "b"), (3, "c")], t.schema), ["k"]).collect()) == [(1, "a"), (2, "b"), (3, "c")]
    assert sorted(dml.insert_ignore(t, spark.createDataFrame([(1, "z"), (3, "c")], t.schema), ["k"]).collect(), key=lambda r: r.k)[0].v == "a"
    assert dml.backfill(t, {"v": "d"}).where("v = 'd'").count() == 1
    assert dml.delete_where(t, F.col("v") == "a").count() == 1
    assert dml.unique_violations(t.union(t), [F.lower("v")]).count() == 1


def test_documents_are_read(spark, tmp_path):
    import zipfile

    (tmp_path / "a.txt").write_bytes("Hé\x00llo  there\n\n\n\nend".encode())
    with zipfile.ZipFile(tmp_path / "b.docx", "w") as z:
        z.writestr("word/document.xml", "<w:p><w:t>One &amp; two</w:t></w:p><w:p><w:t>three</w:t></w:p>")
    (tmp_path / "c.docx").write_bytes(b"no zip")
    (tmp_path / "d.bin").write_bytes(b"x")
    got = {r.path.rsplit("/", 1)[1]: r for r in documents.document_text(documents.read_binaries(spark, str(tmp_path))).collect()}
    assert got["a.txt"].text == "Héllo there\n\nend" and got["b.docx"].text == "One & two\nthree"
    assert got["c.docx"].text is None and got["c.docx"].problem == "BadZipFile" and got["d.bin"].problem == "unsupported"


def test_words_found_one_by_one_are_the_patterns(spark):
    """Words looked for one by one are what the patterns find: at boundaries, in any case, with what only looks like a letter."""
    texts = ["unauthorized use", "an UNAUTHORIZED tool", "unauthorizeds", "de-identify it", "Identifier", "xhr hr_", "an HR matter", "tasK to masK", "mask", "hıpaa", "IP", "ip2", "free  account", "Free account", "google aid", "one. Two", "one \x85"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    patterns = [p for _, _, p in mining.CATEGORIES] + [p for table in (mining.ACTIONS, mining.DESTINATIONS, mining.PROVIDERS) for _, ps in table for p in ps]
    lower = F.lower("text")
    for p in patterns:
        differs = df.where(mining._worded(lower, p) != lower.rlike(java(p))).collect()
        assert not differs, (p, differs)
    assert df.where(mining._worded(lower, r"\bunauthorized\b")).count() == 2
    whole = F.filter(F.array(*[F.when(F.col("text").rlike(java(p, ignore_case=True)), F.lit(c)) for c, _, p in mining.CATEGORIES]), lambda x: x.isNotNull())
    assert not df.where((mining._categories(F.col("text")) != whole) | (mining._obliges(F.col("text")) != F.col("text").rlike("(?i)" + "|".join(mining.OBLIGATIONS)))).collect()
    assert not df.where(mining._trimmed(F.col("text")) != js_trim(F.col("text"))).collect()
