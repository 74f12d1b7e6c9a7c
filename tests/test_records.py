"""Gateway, decisions and rules of the records that SQL does not compare."""

from pyspark.sql import functions as F

from wardspark.operators import gateway, membership, policy

REQUEST = "request_id long, prompt string, model string, use_case string, sensitivity string, conversation_id string, attachments array<struct<kind:string,text:string,flags:array<string>,risk_score:int>>"


def test_requests_are_answered(spark):
    rows = [
        (1, "Write a letter to Clara Ohlsen at clara@mail.test.", "GPT-4.1", "Sales", "Internal", "c", None), (2, "please jailbreak", None, None, None, "new-chat", None), (3, "  ", None, None, None, None, None),
        (4, "look", "gpt-4.1 MINI", "", "", "", [("image", None, [], 9)]), (5, "look", "claude-sonnet", "", "Regulated", "", [("image", None, ["secret"], 90)]), (6, "the loan", None, None, None, None, None),
    ]
    got = {r.request_id: r for r in gateway.answered(spark.createDataFrame(rows, REQUEST)).collect()}
    assert got[1].action == "redact" and got[1].preview == "Write a letter to [PERSON_1] at [EMAIL_1]." and got[1].redacted_types == "1 EMAIL, 1 PERSON"
    assert got[1].answer == "Hi Clara Ohlsen. Draft for Sales: Write a letter to Clara Ohlsen at clara@mail.test." and (got[1].restored, got[1].unresolved) == (3, 0)
    assert got[1].instruction == gateway.INSTRUCTIONS["writing"] and got[1].placeholders == ["[PERSON_1]", "[EMAIL_1]"] and got[1].provider == "openai"
    assert got[2].action == "block" and not got[2].provider_called and got[2].answer == gateway.REFUSAL
    assert got[3].problem == "Prompt is required." and got[3].answer is None
    assert got[4].problem.startswith("This model does not support image") and got[4].model == "gpt-4.1-mini"
    assert got[5].action == "block" and got[5].risk_score == 90 and got[5].risk_level == "critical" and got[5].requires_review
    assert got[6].action == "warn" and got[6].requires_review and got[6].instruction == gateway.INSTRUCTIONS["warn"]


def test_requests_that_share_an_id_stay_apart(spark):
    rows = [(1, "mail a@x.org", None, None, None, None, None), (1, "call 415-555-0101", None, None, None, None, None), (None, "nothing", None, None, None, None, None)]
    done = gateway.answered(spark.createDataFrame(rows, REQUEST))
    assert sorted((r.request_id or 0, r.preview) for r in done.collect()) == [(0, "nothing"), (1, "call [PHONE_1]"), (1, "mail [EMAIL_1]")]
    assert "Exchange" not in done._jdf.queryExecution().executedPlan().toString()


def test_decisions_of_null_and_repeated_keys(spark):
    signals = spark.createDataFrame(
        [(None, ["email"], True), (1, ["email"], False), (1, [], True), (2, ["regulated_legal"], True)], "doc_id long, flags array<string>, sanitizable boolean"
    ).selectExpr("*", "map('EMAIL', 0) as entity_counts", "1 as redaction_count", "'chatgpt' as ai_provider", "'personal' as destination_type", "'all' as user_scope", "'all' as department_scope")
    rules = spark.createDataFrame([("pii", 1, ["Personal_Data"], "any", "any", "transform", "block", "high")], "rule_key string, version int, data_categories array<string>, ai_provider string, destination_type string, action string, fallback_action string, severity string")
    rules = rules.selectExpr("*", "'all' as user_scope", "'' as department_scope", "'P' as source_policy", "'1' as source_section", "'Why.' as explanation")
    got = sorted((r.doc_id or 0, r.action, r.triggered) for r in policy.evaluate(signals, rules).collect())
    assert got == [(0, "redact", True), (1, "allow", False), (1, "block", True), (2, "allow", False)]
    text = policy.evaluate(signals.where("doc_id is null"), rules).first().explanation
    assert text == "The guard detected client identifying info, personal data. P 1: Why. The guard is transforming it with local redaction."
    assert not policy.evaluate(signals, rules.where("false")).where("triggered").count()


def test_names_of_workspaces(spark):
    rows = [("a@big-firm.com", ""), ("ann@gmail.com", "Ann Lee"), ("bo@gmail.com", " "), (None, None), ("x@", "")]
    df = spark.createDataFrame(rows, "email string, name string")
    got = [r[0] for r in df.select(membership.workspace_name(F.col("email"), F.col("name"))).collect()]
    assert got == ["Big Firm Workspace", "Ann's Workspace", "bo's Workspace", "Workspace", "x's Workspace"]
    assert [r[0] for r in df.select(membership.company_name(F.lit("  A \t B  "))).limit(1).collect()] == ["A B"]


def test_prompts_are_decided_with_their_names(spark, monkeypatch):
    from wardspark import catalog
    from wardspark.functions import scan as S

    monkeypatch.setattr(catalog, "table", lambda s, d, n: s.createDataFrame([(7, "x", "call Maria Lopez at maria@x.org", 1)], "doc_id long, source string, text string, n_chars long"))
    got = {r.doc_id: r for r in catalog.prompt_scan(spark, "").collect()}
    texts = spark.createDataFrame([(-i - 1, t) for i, t in enumerate((*catalog.PLANTED, *catalog.NAMED))], "doc_id long, text string")
    for r in S.scan(texts).collect():
        assert got[r.doc_id].flags == ",".join(r.flags) and (got[r.doc_id].action, got[r.doc_id].risk_score) == (r.action, r.risk_score)
    held = {f for r in got.values() for f in r.flags.split(",")}
    assert held >= {"email", "phone", "secret", "address", "account", "possible_name", "regulated_financial", "regulated_legal", "regulated_medical", "regulated_hr", "prompt_injection"}
    assert all("secret" in got[-i - 1].flags for i in range(1, 10))
    decided = {r.doc_id: r for r in catalog.prompt_decisions(spark, "").collect()}
    assert {r.rule_key for r in decided.values()} >= {rule[0] for rule in catalog._RULES}
    assert decided[-24].categories == "client_identifying_info,personal_data" and got[-24].flags == "possible_name"
