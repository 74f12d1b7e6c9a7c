"""Pages, canonical JSON, drafts, bundles, runs, browser PDF text and provenance on literal cases."""

import datetime as dt
import json
import zlib
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from wardspark.functions import canonical, names
from wardspark.operators import pages
from wardspark.sources import documents, drafts
from wardspark.streaming import bundles, runs

HTML = [
    "<p>Hi [EMAIL_1] &amp; <code>[EMAIL_1]</code></p><pre>a<b>[EMAIL_1]</b></div>x</pre>y",
    "<div><PRE>in</div>out<kbd/>still<samp>no</samp></kbd>after",
    "<p role='code'>no</p><span role=\"code\" class=x>no</span><i role=codex>yes</i><br role=code>yes",
    "a < b <!-- [EMAIL_1] <code> --> c <3 <!doctype html> d<textarea>[EMAIL_1]</textarea><script>if (a<b) '</p>'</script>e",
    "<code><code>x</code>y</code>z</code>[PHONE_1]<pre>open to the end",
    '<a title="x > <code>">t</a><b', "", "plain & &lt;text&gt; é\U0001f600<p>[EMAIL_1]",
]


class Plain(HTMLParser):
    """The same rules on the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack, self.out, self.raw = [], "", None

    def handle_starttag(self, tag, attrs):
        if tag in pages.RAW:
            self.raw = tag
        elif tag not in pages.VOID:
            self.stack.append((tag, tag in pages.CODE or (dict(attrs).get("role") or "").lower() == "code"))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag == self.raw:
            self.raw = None
        elif tag in [n for n, _ in self.stack]:
            while self.stack.pop()[0] != tag:
                pass

    def handle_data(self, data):
        if not self.raw and not any(hidden for _, hidden in self.stack):
            self.out += data


def plain(html):
    p = Plain()
    p.feed(html)
    p.close()
    return p.out


@pytest.mark.parametrize("html", HTML[:5] + HTML[6:])
def test_text_nodes_equal_another_parser(html):
    found = list(pages.text_pieces(html))
    assert "".join(t for _, _, t in found) == plain(html)
    assert all(html[a:b] and a < b for a, b, _ in found)


def test_pages_are_restored(spark):
    df = spark.createDataFrame([*enumerate(HTML), (98, None), (0, HTML[0])], "page_id long, html string").withColumn("nodes_of", F.lit("clash"))
    vault = F.array(F.struct(F.lit("[EMAIL_1]").alias("id"), F.lit("a@x.org").alias("original")))
    got = pages.restored_pages(df, vault).collect()
    by = {r.page_id: r for r in got}
    assert len(got) == len(HTML) + 2 and by[98].text == "" and by[98].restored == 0
    assert by[0].text == "Hi a@x.org & y" and by[0].restored == 1
    assert (by[4].text, by[4].unresolved) == ("z[PHONE_1]", ["[PHONE_1]"]) and by[7].text.endswith("a@x.org")
    long = spark.createDataFrame([(1, "<p>[EMAIL_1]<b>x</b>" * 50_000)], "page_id long, html string")
    assert pages.restored_pages(long, vault).first().restored == 50_000


def test_canonical_json_equals_a_sorted_dump(spark):
    rows = [
        (1, {"z": 1.0, "a": [{"y": None, "b": "é\"\\\n\x01/"}], "m": {"k2": [1, 2], "k1": []}, "t": True, "n": 10**15}),
        (2, {"z": -0.25, "a": [], "m": {}, "t": None, "n": None}), (3, {"z": None, "a": None, "m": None, "t": False, "n": 0}), (4, None), (5, {"z": 1e21, "a": [None], "m": {"": None}, "t": True, "n": -1}),
    ]
    kind = "struct<z:double,a:array<struct<y:int,b:string>>,m:map<string,array<int>>,t:boolean,n:long>"
    df = spark.createDataFrame(rows, f"id long, v {kind}")
    got = {r.id: r.j for r in df.select("id", canonical.canonical_json(df["v"], df.schema["v"].dataType).alias("j"))
           .collect()}
    for i, v in rows:
        assert json.loads(got[i]) == (v if v is None else {k: v[k] for k in v}), i
        if i != 5:  # a float without a fraction is a whole number here
            want = None if v is None else v | {"z": int(v["z"]) if v["z"] in (1.0,) else v["z"]}
            assert got[i] == json.dumps(want, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def test_drafts_in_batch_and_as_a_stream(spark, tmp_path):
    spark.dataSource.register(drafts.DraftSource)
    folder = tmp_path / "in"
    folder.mkdir()
    line = lambda i, **more: json.dumps({"surface": "chat", "conversation": f"draft:{i}", "seq": i, "kind": "draft", "text": f"t{i} é", "at": "2024-01-01T00:00:00"} | more)
    (folder / "a.jsonl").write_text("\n".join([line(1), "", "not json", line(2, seq="x")]) + "\n")
    (folder / "_tmp.json").write_text("half")
    (folder / "c.txt").write_text("no")
    batch = spark.read.format("drafts").load(str(folder))
    got = sorted((r.seq or 0, r.text or "", r.problem or "") for r in batch.collect())
    assert got == [(0, "", "JSONDecodeError"), (0, "", "ValueError"), (1, "t1 é", "")]

    def run():
        stream = spark.readStream.format("drafts").load(str(folder))
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
        return sorted((r.seq or 0, r.problem or "") for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert len(run()) == 3
    (folder / "b.json").write_text(line(7) + "\n" + line(8))
    assert run() == sorted((r.seq or 0, r.problem or "") for r in spark.read.format("drafts").load(str(folder)).collect()) and len(run()) == 5


def test_files_are_dealt_by_size():
    assert [p.names for p in drafts.parts([(1, "a", 5), (2, "b", 6), (3, "c", 1)], most=10)] == [["a"], ["b", "c"]]


RULES = [("pii", 1, ["personal_data"], "any", "any", "block", "block", "high", "all", "", "P", "1", "E")]


def test_bundles_are_kept_when_reading_fails(spark):
    now, answers = [0.0], []

    def read():
        got = answers.pop(0)
        if isinstance(got, Exception):
            raise got
        return got

    cache = bundles.BundleCache(read, clock=lambda: now[0])
    table = spark.createDataFrame(RULES, bundles.RULE)
    answers.append(OSError("down"))
    assert cache.get() is None and "down" in cache.problem
    now[0] = 61
    answers.append(table)
    first = cache.get()
    assert len(first[0]) == 1
    now[0] = 100
    assert cache.get() is first  # still fresh, nothing is read
    now[0] = 130
    answers.append(OSError("down"))
    assert cache.get() is first and cache.table(spark, bundles.RULE).count() == 1
    now[0] = 200
    answers.append(table.where("false"))
    assert cache.get() is first  # serves this once
    now[0] = 210
    assert cache.get() is None and cache.table(spark, bundles.RULE).count() == 0
    now[0] = 300
    answers.append(None)
    assert cache.get() is first


def test_decisions_change_with_the_bundle(spark, tmp_path):
    schema = "doc_id long, flags array<string>, entity_counts map<string,int>, redaction_count int, sanitizable boolean, ai_provider string, destination_type string, user_scope string, department_scope string"
    serve, now, got = [None], [0.0], {}

    def read():
        if serve[0] == "fail":
            raise OSError("down")
        return serve[0] and spark.createDataFrame(serve[0], bundles.RULE)

    cache = bundles.BundleCache(read, clock=lambda: now[0])
    keep = lambda df, _: got.update({r.doc_id: (r.action, r.rule_version) for r in df.collect()})
    allow = [(*RULES[0][:1], 2, *RULES[0][2:5], "warn", *RULES[0][6:])]
    for i, rules in enumerate([RULES, "fail", allow, None]):
        serve[0], now[0] = rules, now[0] + 100
        spark.createDataFrame([(i, ["email"], {}, 1, True, "x", "personal", "all", "all")], schema).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        bundles.decide(stream, cache, keep).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    assert got == {0: ("block", 1), 1: ("block", 1), 2: ("warn", 2), 3: ("warn", 2)}


def test_replayed_runs_change_nothing(spark, tmp_path):
    schema = "run_id long, conversation_id string, company_slug string, title string, provider string, model string, action string, preview string, answer_preview string, risk_score int, flags array<string>, provider_called boolean, at timestamp"
    at = lambda n: dt.datetime(2024, 1, 1, 0, n)
    one = [(1, "c", "co", "First", "openai", "m", "redact", "[EMAIL_1]", "Hi", 28, ["email"], True, at(1)), (2, "c", "co", "Second", "openai", "m", "block", "x", None, 58, [], False, at(2)), (3, None, "co", None, "mock", "m", "allow", "", "a", 10, None, True, at(3))]
    two = [(4, "c", "co", "Third", "openai", "m", "allow", "y", "b", 10, [], True, at(0))]
    root = str(tmp_path / "store")

    def state():
        return {t: sorted(runs.stored_table(spark, root, t).collect(), key=str) for t in runs.TABLES}

    for batch, rows in enumerate((one, two)):
        runs.persist(spark.createDataFrame(rows, schema), batch, root)
    before = state()
    for batch, rows in enumerate((one, two)):
        runs.persist(spark.createDataFrame(rows, schema), batch, root)
    assert state() == before
    assert {(r.id, r.title) for r in before["sessions"]} >= {("c", "Second")} and len(before["sessions"]) == 2
    assert [len(before[t]) for t in ("messages", "events", "audit")] == [7, 4, 19]
    assert not any(r.raw_stored for r in before["messages"])


def test_browser_pdf_text(spark, tmp_path):
    page = rb"BT (one (nested (twice)) \(three\) \101) Tj <FEFF00680069> Tj <00680069> Tj <4142> Tj <zz> Tj (open ET"
    packed = zlib.compressobj(wbits=-15)
    (tmp_path / "a.pdf").write_bytes(b"%PDF <</Length 3>>stream\n" + page + b"\nendstream <</Filter /FlateDecode>> stream\r\n" + packed.compress(b"BT (raw deflate) Tj ET") + packed.flush() + b"\nendstream")
    (tmp_path / "b.pdf").write_bytes(b"<< /FlateDecode >> stream\nbroken\nendstream (outside) no block")
    got = {r.path[-5:]: r.text for r in documents.document_text(documents.read_binaries(spark, str(tmp_path)), browser=True).collect()}
    assert got["a.pdf"].startswith("one (nested (twice)) (three) A hi hi AB") and "raw deflate" in got["a.pdf"]
    assert got["b.pdf"] == "outside"


def test_provenance_of_names(spark):
    texts = ["email olga petrova about it", "Contact Maria Lopez for help", "please email Maria Lopez (maria@x.org) about it", "nobody here"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [[(x.value, x.source) for x in r[0]] for r in df.select(names.provenance(F.col("t"))).collect()]
    assert got == [[("olga petrova", "heuristic")], [("Maria Lopez", "local")], [("Maria Lopez", "both")], []]
