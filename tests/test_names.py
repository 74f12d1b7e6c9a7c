"""Names of persons: sentences with the names that they hold, and phrases that are none."""

import pytest
from pyspark.sql import functions as F

from wardspark.functions import names, scan
from wardspark.functions.patterns import java
from wardspark.functions.spans import spans

# Golden rows, taken as they stand; FIXTURES.md B names their source.
GOLDEN = {
    "Draft an email to John Smith at john@gmail.com.": ["John Smith"],
    "Representational State Transfer is an architectural style.": [],
    "friends and family plan": [],
}
FOUND = {
    "Please write a letter to Clara Ohlsen, whose address is clara@mail.test.": ["Clara Ohlsen"],
    "Fergus O'Malley signed the lease on Tuesday": ["Fergus O'Malley"],
    "Could somebody ask Fergus O’Malley whether it rained?": ["Fergus O’Malley"],
    "It was Inés Ibáñez Soler who paid": ["Inés Ibáñez Soler"],
    "Marie-Claude Petit emailed us an invoice": ["Marie-Claude Petit"],
    "Pieter van der Meer called twice": ["Pieter van der Meer"],
    "Lúcia dos Reis said no": ["Lúcia dos Reis"],
    "Trần Thị Mai approved it": ["Trần Thị Mai"],
    "invite my friends olga petrova, sven lindqvist, rosa marquez.": ["olga petrova", "sven lindqvist", "rosa marquez"],
    "cc olga petrova and sven lindqvist": ["olga petrova", "sven lindqvist"],
    "tonight the guests are marie-claude petit, pieter van der meer, and lúcia dos reis": ["marie-claude petit", "pieter van der meer", "lúcia dos reis"],
    "ask tomas novak to bring chairs": ["tomas novak"],
    "email olga petrova; sven lindqvist; rosa marquez about the picnic": ["olga petrova", "sven lindqvist", "rosa marquez"],
    "our colleagues olga petrova and rosa marquez are late": ["olga petrova", "rosa marquez"],
}
NONE = (
    "Security Review Meeting started late.", "The Customer Dashboard broke again.", "Loan Application Form was printed.", "Support Portal Login is down.",
    "the people records are stored twice", "invite users to the portal", "message account management", "copy the report and the contract", "send this to billing support",
    "ask engineering and sales about it", "", "İzmir", "NATO UNESCO IBM", "Clara went home", "olga petrova sings",
)


def test_names_of_sentences(spark):
    want = GOLDEN | FOUND | dict.fromkeys(NONE, [])
    texts = [*want]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [e.original for e in r.entities if e.type == "PERSON"] for r in scan.scan(df).collect()}
    assert {texts[i]: v for i, v in got.items()} == want


def test_places_and_placeholders(spark):
    text = "😀 Write a note to Clara Ohlsen at clara@mail.test. CLARA went home."
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    r = scan.scan(df).first()
    assert [(e.id, e.type, e.start, e.stop) for e in r.entities][:2] == [("[PERSON_1]", "PERSON", 18, 30), ("[EMAIL_1]", "EMAIL", 34, 49)]
    assert r.redacted.startswith("😀 Write a note to [PERSON_1] at [EMAIL_1].") and r.action == "redact" and set(r.flags) == {"possible_name", "email"}
    assert not [e for e in scan.scan(df, persons=None).first().entities if e.type == "PERSON"]


def test_external_names_must_agree_with_the_text(spark):
    text, name = "met inés ibáñez soler behind the house", "inés ibáñez soler"
    start = text.index(name)
    given = lambda value: [("PERSON", start, start + len(name), value, 0.94, "local_ner_candidate_test", ["ner_person"])]
    df = spark.createDataFrame([(1, text, given(name)), (2, text, given("Inés Ibáñez Soler")), (3, text, None)], f"doc_id long, text string, given {scan.EXTERNAL}")
    got = {r.doc_id: [(e.original, e.start) for e in r.entities] for r in scan.scan(df, external="given", persons="core").collect()}
    assert got == {1: [(name, start)], 2: [], 3: []}


@pytest.mark.parametrize(
    "text, tokens, expected",
    [
        ("Inés Ibáñez Soler paid", [("B-PER", 0.9, 0, 4), ("I-PER", 0.8, 5, 11), ("I-PER", 0.7, 12, 17)], [("Inés Ibáñez Soler", 0, 17, 0.8)]),
        ("Ann Lee and Bo Ek", [("B-PER", None, 0, 3), ("I-PER", 0.9, 4, 7), ("O", 0.9, 8, 11), ("PERSON", 2.0, 12, 14), ("per", 0.5, 15, 17)], [("Ann Lee", 0, 7, 0.9), ("Bo Ek", 12, 17, 0.75)]),
        ("Ann Lee, Bo", [("I-PER", 0.9, 0, 3), ("I-PER", 0.9, 4, 8), ("I-PER", 0.7, 9, 11)], [("Ann Lee, Bo", 0, 11, 0.833333)]),
        ("Ann; Bo", [("I-PER", 0.9, 0, 4), ("I-PER", 0.9, 5, 7)], [("Ann; Bo", 0, 7, 0.9)]),
        ("Ann Bo", [("B-PER", 0.9, 0, 3), ("B-PER", 0.7, 4, 6), ("I-PER", 0.7, 4, 60), ("I-LOC", 0.7, 0, 2)], [("Ann", 0, 3, 0.9), ("Bo", 4, 6, 0.7)]),
    ],
)
def test_recogniser_tokens_become_spans(spark, text, tokens, expected):
    df = spark.createDataFrame([(text, tokens)], "text string, tokens array<struct<entity:string,score:double,start:int,stop:int>>")
    got = df.select(names.ner_names(F.col("text"), F.col("tokens")).alias("x")).first().x
    assert [(c.value, c.start, c.stop, round(c.base, 6)) for c in got] == expected


def test_words_of_products_are_no_names(spark):
    df = spark.createDataFrame([(1, "Clara Wardley called")], "doc_id long, text string")
    assert [e.original for e in scan.scan(df).first().entities] == ["Clara Wardley"]
    assert scan.scan(df, products=("wardley",)).first().entities == []


def test_long_runs_of_capitals(spark):
    """Patterns that call themselves for each word of a run overflow the stack on thousands of them."""
    text = F.concat(F.repeat(F.lit("Avery "), 20_000), F.lit("de la Bryn-"), F.repeat(F.lit("Cole-"), 20_000), F.lit("Dee now"))
    got = spark.range(1).select(spans(text, java(names.RUN)).alias("x"), F.length(text).alias("n")).selectExpr("size(x) AS runs", "x[0].start AS start", "n - x[0].stop AS after").first()
    assert tuple(got) == (1, 0, 4)


def test_resolved_looks_at_open_candidates(spark):
    """Candidates meet only what still reaches their start, in a chain of overlaps and under one that reaches over all."""
    kind = f"array<{scan.CANDIDATE}>"
    one = lambda i: F.struct((i * 2).alias("start"), F.lit(-2).alias("rank"), F.lit(-0.9).alias("doubt"), i.alias("ordinal"), (i * 2 + 3).alias("stop"), F.lit("PERSON").alias("type"), F.lit("a").alias("value"), F.lit(0.9).alias("confidence"), F.lit("d").alias("detector"))
    found = spark.range(1).select(F.transform(F.sequence(F.lit(0), F.lit(1_000)), one).cast(kind).alias("found"))
    assert found.select(scan.resolved(F.col("found")).alias("x")).select(F.transform("x", lambda e: e["start"]).alias("s")).first().s == list(range(0, 2_001, 4))
    outer = "array(named_struct('start', 0, 'stop', 90), named_struct('start', 1, 'stop', 5), named_struct('start', 10, 'stop', 20), named_struct('start', 85, 'stop', 95))"
    full = F.transform(F.expr(outer), lambda x, i: F.struct(x["start"], F.lit(-2), F.lit(-0.9), i, x["stop"], F.lit("PERSON"), F.lit("a"), F.lit(0.9), F.lit("d"))).cast(kind)
    assert [(e.start, e.stop) for e in spark.range(1).select(scan.resolved(full).alias("x")).first().x] == [(0, 90)]
