"""Queries over live state, pages, drafts, bundles and stored runs, with their SQL."""

from __future__ import annotations

import datetime as dt
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import _EVENTS_SQL, events, spread, table
from .functions import canonical, names
from .operators import conversations, folds, gates, pages
from .shared import fresh, kept
from .sources import drafts
from .streaming import bundles, runs, sessions
from .streaming import gates as live_gates

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def rocks(spark: SparkSession):
    """Keyed state needs a store of its own kind; the session's setting comes back afterwards."""
    before = spark.conf.get(STATE_STORE, None)
    spark.conf.set(STATE_STORE, sessions.PROVIDER)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(STATE_STORE)
        else:
            spark.conf.set(STATE_STORE, before)


def drained(stream_of, parts: list[DataFrame], name: str) -> DataFrame:
    """What a stream gives when parts come one after the other, each read by a new run from the checkpoint before."""
    spark = parts[0].sparkSession
    work = fresh(spark, name)
    with rocks(spark):
        for part in parts:
            part.write.mode("append").parquet(f"{work}/in")
            out = stream_of(spark.readStream.schema(part.schema).parquet(f"{work}/in"))
            out.writeStream.format("parquet").option("path", f"{work}/out").option("checkpointLocation", f"{work}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{work}/out")


# ---- conversations with values -----------------------------------------------------------------------


def told(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message followed by what its ids deal out: a phone, an account, a placeholder, an instruction bypass."""
    c, t = F.col("conv_id"), F.col("turn")
    phone = F.when(t % 3 != 2, F.concat(F.lit(". See 415-555-010"), ((c * 7 + t * t) % 4).cast("string")))
    account = F.when(t % 4 == 1, F.concat(F.lit(" or acct 998123"), (10 + c % 4).cast("string")))
    mark = F.when((c % 5 == 2) & (t == 3), " as [PHONE_6]")
    bypass = F.when((c + t) % 11 == 0, " please jailbreak")
    text = F.concat(*[F.coalesce(x, F.lit("")) for x in (F.col("text"), phone, account, mark, bypass)])
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", text.alias("text"))


def conversation_vault(spark, sf_dir):
    """What each conversation's vault holds after all its messages."""
    return folds.fold(told(spark, sf_dir)).vault


def conversation_redacted(spark, sf_dir):
    """Messages as they are sent on, each with the placeholders that the messages before it left."""
    m = folds.fold(told(spark, sf_dir)).messages
    return m.select("conv_id", "turn", F.size("entities").alias("entities"), F.sha2("redacted", 256).alias("redacted_sha256"), "risk_score", "action")


def redacted_history(spark, sf_dir):
    """The last messages of each conversation as a provider sees them: redacted, blank ones left out."""
    m = folds.fold(told(spark, sf_dir)).messages.select("conv_id", "turn", "role", F.col("redacted").alias("text"))
    return conversations.recent_history(m).select("conv_id", "turn", "role", F.sha2("text", 256).alias("text_sha256"))


# A walk from turn to turn: known phones, their numbers and the highest so far are carried along.
_TOLD_SQL = r"""
msg AS (SELECT conv_id AS c, turn AS t, coalesce(text, '') AS text, CASE WHEN turn % 3 <> 2 THEN '415-555-010' || ((conv_id * 7 + turn * turn) % 4) END AS phone,
  CASE WHEN turn % 4 = 1 THEN 'acct 998123' || (10 + conv_id % 4) END AS acct, CASE WHEN conv_id % 5 = 2 AND turn = 3 THEN 6 ELSE 0 END AS mark, (conv_id + turn) % 11 = 0 AS stop,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations),
walk(c, k, known, numbers, top, acct_known, id, seen, acct_seen) AS (
  SELECT c, CAST(0 AS BIGINT), CAST([] AS VARCHAR[]), CAST([] AS BIGINT[]), CAST(0 AS BIGINT), FALSE, CAST(NULL AS BIGINT), FALSE, FALSE FROM (SELECT DISTINCT c FROM msg)
  UNION ALL
  SELECT w.c, m.k,
    CASE WHEN m.phone IS NOT NULL AND NOT m.stop AND NOT list_contains(w.known, m.phone) THEN list_append(w.known, m.phone) ELSE w.known END,
    CASE WHEN m.phone IS NOT NULL AND NOT m.stop AND NOT list_contains(w.known, m.phone) THEN list_append(w.numbers, greatest(w.top, m.mark) + 1) ELSE w.numbers END,
    CASE WHEN m.phone IS NOT NULL AND NOT m.stop AND NOT list_contains(w.known, m.phone) THEN greatest(w.top, m.mark) + 1 ELSE w.top END,
    w.acct_known OR (m.acct IS NOT NULL AND NOT m.stop),
    CASE WHEN m.phone IS NULL THEN NULL WHEN list_contains(w.known, m.phone) THEN w.numbers[list_position(w.known, m.phone)] ELSE greatest(w.top, m.mark) + 1 END,
    m.phone IS NOT NULL AND list_contains(w.known, m.phone), m.acct IS NOT NULL AND w.acct_known
  FROM walk w JOIN msg m ON m.c = w.c AND m.k = w.k + 1),
last AS (SELECT * FROM walk QUALIFY row_number() OVER (PARTITION BY c ORDER BY k DESC) = 1)"""
VAULT_SQL = f"""WITH RECURSIVE {_TOLD_SQL}, e AS (SELECT c, unnest(known) AS original, unnest(numbers) AS n FROM last)
SELECT c AS conv_id, '[PHONE_' || n || ']' AS placeholder, 'PHONE' AS type, original FROM e
UNION ALL SELECT c, '[ACCOUNT_1]', 'ACCOUNT', 'acct 998123' || (10 + c % 4) FROM last WHERE acct_known"""
REDACTED_SQL = f"""WITH RECURSIVE {_TOLD_SQL}
SELECT m.c AS conv_id, m.t AS turn, CAST((CASE WHEN phone IS NULL THEN 0 ELSE 1 END) + (CASE WHEN acct IS NULL THEN 0 ELSE 1 END) AS INT) AS entities,
  sha256(text || CASE WHEN phone IS NULL THEN '' ELSE '. See [PHONE_' || id || ']' END || CASE WHEN acct IS NULL THEN '' ELSE ' or [ACCOUNT_1]' END || CASE WHEN mark > 0 THEN ' as [PHONE_6]' ELSE '' END
    || CASE WHEN stop THEN ' please jailbreak' ELSE '' END) AS redacted_sha256,
  CAST(least(100, greatest(10 + CASE WHEN phone IS NULL THEN 0 ELSE 18 END + CASE WHEN acct IS NULL THEN 0 ELSE 28 END + CASE WHEN stop THEN 48 ELSE 0 END, CASE WHEN seen OR acct_seen THEN 40 ELSE 0 END)) AS INT) AS risk_score,
  CASE WHEN stop THEN 'block' WHEN phone IS NOT NULL OR acct IS NOT NULL THEN 'redact' ELSE 'allow' END AS action
FROM msg m JOIN walk w ON m.c = w.c AND m.k = w.k"""


# ---- sessions with drafts ----------------------------------------------------------------------------


def session_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as live sessions: users' scans and answers to restore, three minutes a turn. The first two turns are a draft's;
    two of three drafts become the conversation by a move before the third."""
    c, t = F.col("conv_id"), F.col("turn")
    rows = table(spark, sf_dir, "conversations").where("role in ('user', 'assistant') and turn is not null")
    key = F.concat(F.when(t < 2, "draft:").otherwise("conversation:"), c.cast("string"))
    at = lambda minutes: F.timestamp_seconds(1_704_067_200 + 60 * minutes)
    text = F.when(F.col("role") == "user", F.concat(F.lit("See u"), ((c + t) % 3).cast("string"), F.lit("@mail.test"), F.when(t % 2 == 0, F.concat(F.lit(" or 415-555-01"), (10 + c % 4).cast("string"))).otherwise("")))
    said = rows.select(
        F.concat(F.lit("s"), c.cast("string")).alias("session"), at(3 * t).alias("at"), t.alias("seq"), F.when(F.col("role") == "user", "scan").otherwise("rehydrate").alias("kind"), key.alias("conversation"),
        F.lit(None).cast("string").alias("target"), F.lit(True).alias("authoritative"), F.coalesce(text, F.lit("[EMAIL_1] [PHONE_1] [EMAIL_9]")).alias("text"),
    )
    third = table(spark, sf_dir, "conversations").where((t == 2) & (c % 3 != 0))
    moved = third.select(
        F.concat(F.lit("s"), c.cast("string")).alias("session"), at(F.lit(5)).alias("at"), F.lit(-1).cast("long").alias("seq"), F.lit("move").alias("kind"), F.concat(F.lit("draft:"), c.cast("string")).alias("conversation"),
        F.concat(F.lit("conversation:"), c.cast("string")).alias("target"), F.lit(True).alias("authoritative"), F.lit(None).cast("string").alias("text"),
    )
    return said.unionByName(moved)


def session_vaults(spark, sf_dir):
    """The sessions as a stream that comes in three parts and is stopped between them."""
    e = kept(session_events(spark, sf_dir), "session-events")
    minute = (F.unix_timestamp("at") - 1_704_067_200) / 60
    got = drained(sessions.session_vaults, [e.where(minute < 6), e.where((minute >= 6) & (minute < 12)), e.where(minute >= 12)], "sessions")
    return got.where("kind <> 'move'").select("session", "seq", "kind", "text", "replaced", F.size("unresolved").alias("unresolved"))


SESSIONS_SQL = """
WITH m AS (SELECT conv_id AS c, turn AS t, role, 'u' || ((conv_id + turn) % 3) || '@mail.test' AS e FROM conversations WHERE role IN ('user', 'assistant')),
moves AS (SELECT DISTINCT conv_id AS c FROM conversations WHERE turn = 2 AND conv_id % 3 <> 0),
g AS (SELECT m.*, CASE WHEN moves.c IS NOT NULL THEN 'all' WHEN t < 2 THEN 'draft' ELSE 'own' END AS line FROM m LEFT JOIN moves ON m.c = moves.c),
u AS (SELECT * FROM g WHERE role = 'user'),
first AS (SELECT c, line, e, min(t) AS t0 FROM u GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY c, line ORDER BY t0) AS n FROM first),
scans AS (SELECT u.c, u.t, 'See [EMAIL_' || n || ']' || CASE WHEN u.t % 2 = 0 THEN ' or [PHONE_1]' ELSE '' END AS text FROM u JOIN ranked r ON r.c = u.c AND r.line = u.line AND r.e = u.e),
answers AS (SELECT a.c, a.t, a.line, a.line IN ('own') AS may_fall,
    (SELECT min(t) FROM u WHERE u.c = a.c AND u.line = a.line AND u.t < a.t) AS own, (SELECT count(*) FROM u WHERE u.c = a.c AND u.line = a.line AND u.t < a.t AND u.t % 2 = 0) AS phones,
    (SELECT max(t) FROM u WHERE u.c = a.c AND u.line = 'draft') AS last_draft, (SELECT min(t) FROM u WHERE u.c = a.c AND u.line = 'draft') AS first_draft,
    (SELECT count(*) FROM u WHERE u.c = a.c AND u.line = 'draft' AND u.t % 2 = 0) AS draft_phones FROM g a WHERE a.role = 'assistant'),
x AS (SELECT *, own IS NULL AND may_fall AND last_draft IS NOT NULL AND (t - last_draft) * 3 <= 10 AS falls FROM answers),
y AS (SELECT c, t, CASE WHEN own IS NOT NULL THEN own WHEN falls THEN first_draft END AS e, CASE WHEN own IS NOT NULL THEN phones > 0 WHEN falls THEN draft_phones > 0 ELSE FALSE END AS p FROM x)
SELECT 's' || c AS session, t AS seq, 'scan' AS kind, text, 0 AS replaced, 0 AS unresolved FROM scans
UNION ALL SELECT 's' || c, t, 'rehydrate', CASE WHEN e IS NULL THEN '[EMAIL_1]' ELSE 'u' || ((c + e) % 3) || '@mail.test' END || ' ' || CASE WHEN p THEN '415-555-01' || (10 + c % 4) ELSE '[PHONE_1]' END || ' [EMAIL_9]',
  CAST((CASE WHEN e IS NULL THEN 0 ELSE 1 END) + (CASE WHEN p THEN 1 ELSE 0 END) AS INT), CAST(3 - (CASE WHEN e IS NULL THEN 0 ELSE 1 END) - (CASE WHEN p THEN 1 ELSE 0 END) AS INT) FROM y"""


# ---- pauses and gates over events --------------------------------------------------------------------


def edits(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").cast("string").alias("session"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("seq"), F.when(F.col("event_id") % 7 == 0, " \t").otherwise(F.col("event_type")).alias("text"),
        F.element_at(F.array(*map(F.lit, ("select", "allow", "clear", "refuse", "send"))), (F.col("event_id") % 5 + 1).cast("int")).alias("step"),
    )


def edit_pauses(spark, sf_dir):
    """Events of a user that no other follows within six hours, as edits after which a scan runs."""
    return gates.debounced(edits(spark, sf_dir), ["session"], pause="6 hours").select("session", "seq")


def live_pauses(spark, sf_dir):
    """The same as a stream in two parts, by timers; a last event of no user moves the time on."""
    e = edits(spark, sf_dir).select("session", "at", "seq", "text")
    last = e.agg(F.max("at").alias("at")).select(F.lit("end").alias("session"), (F.col("at") + F.expr("interval 10 days")).alias("at"), F.lit(0).cast("long").alias("seq"), F.lit("x").alias("text"))
    half = F.col("at") < F.lit(dt.datetime(2024, 1, 15))
    got = drained(lambda s: live_gates.debounced_live(s, dt.timedelta(hours=6)), [e.where(half), e.where(~half), last], "pauses")
    return got.where("session <> 'end'").select("session", "seq")


def send_gates(spark, sf_dir):
    """The gate of each user's files after each event, and why a message may not go then."""
    e = gates.gate_states(edits(spark, sf_dir), ["session"])
    notice = F.col("seq") % 3 == 0
    return e.select("session", "seq", "step", "state", gates.send_problem(F.col("state"), F.col("seq") % 2 == 0, notice, F.when(F.col("state") == "blocked", "blocked").otherwise("clear"), F.lit("")).alias("problem"))


def live_send_gates(spark, sf_dir):
    """The states of the gates from a stream in two parts."""
    e = edits(spark, sf_dir).select("session", "at", "seq", "step")
    half = F.col("at") < F.lit(dt.datetime(2024, 1, 15))
    return drained(live_gates.gates_live, [e.where(half), e.where(~half)], "gates").select("session", "seq", "step", "state")


_PAUSES_SQL = """SELECT CAST(user_id AS VARCHAR) AS session, event_id AS seq FROM (
  SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS after FROM events) WHERE event_id % 7 <> 0 AND (after IS NULL OR after >= ts + INTERVAL 6 HOUR)"""
_GATES_SQL = """
e AS (SELECT user_id, event_id, ['select', 'allow', 'clear', 'refuse', 'send'][CAST(event_id % 5 AS INT) + 1] AS step, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
walk(user_id, k, event_id, step, state) AS (
  SELECT user_id, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR), 'none' FROM (SELECT DISTINCT user_id FROM e)
  UNION ALL
  SELECT e.user_id, e.k, e.event_id, e.step,
    CASE WHEN e.step = 'select' THEN 'pending' WHEN e.step = 'allow' AND state = 'pending' THEN 'governed' WHEN e.step = 'refuse' AND state = 'pending' THEN 'blocked' WHEN e.step = 'clear' AND state = 'governed' THEN 'none' ELSE state END
  FROM walk w JOIN e ON e.user_id = w.user_id AND e.k = w.k + 1),
s AS (SELECT CAST(user_id AS VARCHAR) AS session, event_id AS seq, step, state FROM walk WHERE k > 0)"""


# ---- pages, canonical JSON, names --------------------------------------------------------------------


def page_text(spark, sf_dir):
    """Pages with an answer's end planted, restored: nodes, placeholders put back, those left, and the text."""
    p = table(spark, sf_dir, "pages")
    tail = F.concat(F.lit("<p>To [EMAIL_1] &amp; [PERSON_3]</p><pre>[EMAIL_1]<b>[EMAIL_1]</b></pre><span role='code'>[EMAIL_1]</span>[EMAIL_"), (F.col("page_id") % 3).cast("string"), F.lit("]"))
    told = p.select("page_id", F.concat(F.coalesce("html", F.lit("")), tail).alias("html"))
    vault = F.transform(F.array(F.lit(1), F.lit(2)), lambda i: F.struct(F.concat(F.lit("[EMAIL_"), i.cast("string"), F.lit("]")).alias("id"), F.concat(F.lit("u"), i.cast("string"), F.lit("@mail.test")).alias("original")))
    done = pages.restored_pages(told, vault)
    return done.select("page_id", F.size("nodes").alias("nodes"), "restored", F.array_join("unresolved", " ").alias("unresolved"), F.sha2("text", 256).alias("text_sha256"))


def event_checksums(spark, sf_dir):
    """Each event's properties with what they come with, as canonical JSON."""
    e = table(spark, sf_dir, "events")
    inner = F.struct(F.col("event_type").alias("type"), F.array(F.struct(F.col("user_id").alias("user"), F.when(F.col("event_id") % 3 == 0, F.lit('a "b"')).alias("note"))).alias("by"), F.col("value").alias("value"))
    whole = e.select("event_id", F.struct(inner.alias("what"), F.from_json("props", "k int").alias("props"), F.when(F.col("event_id") % 4 != 0, F.create_map(F.lit("z"), F.lit(True), F.lit("a"), F.lit(False))).alias("marks")).alias("v"))
    kind = whole.schema["v"].dataType
    out = kept(whole.select("event_id", canonical.canonical_json(F.col("v"), kind).alias("body")), "canonical")
    return out.select("event_id", "body", F.sha2("body", 256).alias("checksum"))


def name_provenance(spark, sf_dir):
    """Names in documents and planted sentences by what found them: the rules, the second detector or both."""
    own = spark.sql("SELECT * FROM VALUES (-1L, 'email olga petrova about it'), (-2L, 'Contact Maria Lopez for help'), (-3L, 'please email Maria Lopez (maria@x.org) about it'), (-4L, 'no one') AS t(doc_id, text)")
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).unionByName(own)
    found = docs.select("doc_id", F.explode_outer(names.provenance(F.coalesce("text", F.lit("")))).alias("x")).where("x is not null")
    return found.groupBy("doc_id", F.col("x.source").alias("source")).agg(F.count(F.lit(1)).alias("names"), F.min("x.value").alias("first_name"))


# ---- drafts, bundles, stored runs --------------------------------------------------------------------


def surface_drafts(spark, sf_dir):
    """Conversations as a surface's JSON files, read by the draft source as a stream and in batch; a row counts if both have it."""
    spark.dataSource.register(drafts.DraftSource)
    work = fresh(spark, "surface")
    m = table(spark, sf_dir, "conversations")
    lines = m.select(
        F.when(F.col("role") == "user", "chat").otherwise("answers").alias("surface"), F.concat(F.lit("conversation:"), F.col("conv_id").cast("string")).alias("conversation"), F.col("turn").alias("seq"), F.col("role").alias("kind"), "text",
        F.date_format(F.timestamp_seconds(1_704_067_200 + 60 * F.col("turn")), "yyyy-MM-dd'T'HH:mm:ss").alias("at"),
    )
    lines.write.json(f"{work}/in")
    stream = spark.readStream.format("drafts").load(f"{work}/in")
    stream.writeStream.format("parquet").option("path", f"{work}/out").option("checkpointLocation", f"{work}/state").trigger(availableNow=True).start().awaitTermination()
    keys = ["surface", "conversation", "seq"]
    streamed = spark.read.schema(stream.schema).parquet(f"{work}/out").select(*keys, F.sha2("text", 256).alias("text_sha256"), F.date_format("at", "HH:mm").alias("at"))
    batch = spark.read.format("drafts").load(f"{work}/in").where("problem is null").select(*keys)
    return streamed.join(batch, keys, "left_semi")


def bundle_refresh(spark, sf_dir):
    """Events decided as a stream in three parts: by the first bundle, by the same while the store is down, by the next one."""
    e = events(spark, sf_dir)
    flags = F.when(F.col("event_id") % 4 == 0, F.array(F.lit("email"))).when(F.col("event_id") % 4 == 1, F.array(F.lit("regulated_legal"))).otherwise(F.array().cast("array<string>"))
    s = e.select(
        F.col("event_id").alias("doc_id"), flags.alias("flags"), F.create_map().cast("map<string,int>").alias("entity_counts"), F.lit(1).alias("redaction_count"), F.lit(True).alias("sanitizable"), F.lit("chatgpt").alias("ai_provider"),
        F.lit("personal").alias("destination_type"), F.lit("all").alias("user_scope"), F.lit("all").alias("department_scope"), (F.col("event_id") % 3).alias("part"),
    )
    rule = lambda version, categories, action: ("shared_rule", version, categories, "any", "any", action, "block", "high", "all", "", "P", "1", "E")
    first, second = [rule(1, ["personal_data"], "transform")], [rule(2, ["personal_data", "regulated_legal_context"], "warn")]
    answers = iter([first, None, second])

    def read():
        found = next(answers)
        if found is None:
            raise OSError("the store is down")
        return spark.createDataFrame(found, bundles.RULE)

    cache, work = bundles.BundleCache(read, fresh=0), fresh(spark, "bundles")
    keep = lambda df, batch_id: df.write.mode("overwrite").parquet(f"{work}/out/batch={batch_id}")
    for part in range(3):
        s.where(F.col("part") == part).write.mode("append").parquet(f"{work}/in")
        stream = spark.readStream.schema(s.schema).parquet(f"{work}/in")
        bundles.decide(stream, cache, keep).option("checkpointLocation", f"{work}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{work}/out").select(F.col("doc_id").alias("event_id"), "triggered", "action", "rule_version")


def stored_runs(spark, sf_dir):
    """Users' messages as answered runs, persisted by a stream in two parts, the second replayed; rows of the tables by session."""
    m, c, t = table(spark, sf_dir, "conversations").where("role = 'user'"), F.col("conv_id"), F.col("turn")
    at = F.timestamp_seconds(1_704_067_200 + 60 * (c * 100 + t))
    r = m.select(
        (c * 1000 + t).alias("run_id"), F.when(c % 4 != 0, F.concat(F.lit("c"), c.cast("string"))).alias("conversation_id"), F.concat(F.lit("company-"), (c % 5).cast("string")).alias("company_slug"), F.concat(F.lit("Turn "), t.cast("string")).alias("title"),
        F.lit("openai").alias("provider"), F.lit("m").alias("model"), F.when(t % 3 == 0, "block").otherwise("allow").alias("action"), F.lit("preview").alias("preview"), F.when(t % 3 != 0, "answer").alias("answer_preview"), (t * 10).cast("int").alias("risk_score"),
        F.array(F.lit("email")).alias("flags"), (t % 3 != 0).alias("provider_called"), at.alias("at"),
    )
    work = fresh(spark, "runs")
    for part in (c % 2 == 0, c % 2 == 1):
        r.where(part).write.mode("append").parquet(f"{work}/in")
        stream = spark.readStream.schema(r.schema).parquet(f"{work}/in")
        runs.persisted(stream, f"{work}/store").option("checkpointLocation", f"{work}/state").trigger(availableNow=True).start().awaitTermination()
    runs.persist(r.where(c % 2 == 1), 1, f"{work}/store")
    sessions_ = runs.stored_table(spark, f"{work}/store", "sessions").select(F.col("id").alias("session_id"), "title", "company_slug")
    for name in runs.TABLES[1:]:
        n = runs.stored_table(spark, f"{work}/store", name).groupBy("session_id").agg(F.count(F.lit(1)).alias(name))
        sessions_ = sessions_.join(n, "session_id", "left")
    return sessions_


QUERIES = {f.__name__: f for f in (
    conversation_vault, conversation_redacted, redacted_history, session_vaults, edit_pauses, live_pauses, send_gates, live_send_gates, page_text, event_checksums, name_provenance, surface_drafts, bundle_refresh, stored_runs,
)}
ORACLES = {
    "conversation_vault": VAULT_SQL,
    "conversation_redacted": REDACTED_SQL,
    "redacted_history": f"""WITH r AS ({REDACTED_SQL.replace("WITH RECURSIVE", "WITH RECURSIVE", 1)})
SELECT r.conv_id, r.turn, c.role, r.redacted_sha256 AS text_sha256 FROM r JOIN conversations c ON c.conv_id = r.conv_id AND c.turn = r.turn WHERE c.role IN ('user', 'assistant') QUALIFY row_number() OVER (PARTITION BY r.conv_id ORDER BY r.turn DESC) <= 8""",
    "session_vaults": SESSIONS_SQL,
    "edit_pauses": _PAUSES_SQL,
    "live_pauses": _PAUSES_SQL,
    "send_gates": f"""WITH RECURSIVE {_GATES_SQL} SELECT *, CASE WHEN state = 'pending' THEN '{gates.WAITING}' WHEN seq % 3 = 0 AND state = 'blocked' THEN '{gates.REFUSED}' WHEN seq % 2 = 0 AND state <> 'governed' THEN '{gates.UNVERIFIED}' END AS problem FROM s""",
    "live_send_gates": f"WITH RECURSIVE {_GATES_SQL} SELECT * FROM s",
    "event_checksums": """WITH b AS (SELECT event_id, '{"marks":' || CASE WHEN event_id % 4 = 0 THEN 'null' ELSE '{"a":false,"z":true}' END || ',"props":{"k":' || json_extract_string(props, '$.k') || '},"what":{"by":[{"note":' || CASE WHEN event_id % 3 = 0 THEN '"a \\"b\\""' ELSE 'null' END
  || ',"user":' || user_id || '}],"type":"' || event_type || '","value":' || CASE WHEN value = floor(value) THEN CAST(CAST(value AS BIGINT) AS VARCHAR) ELSE CAST(value AS VARCHAR) END || '}}' AS body FROM events)
SELECT event_id, body, sha256(body) AS checksum FROM b""",
    "surface_drafts": """SELECT CASE WHEN role = 'user' THEN 'chat' ELSE 'answers' END AS surface, 'conversation:' || conv_id AS conversation, turn AS seq, sha256(text) AS text_sha256, strftime(TIMESTAMP '2024-01-01 00:00:00' + turn * INTERVAL 1 MINUTE, '%H:%M') AS at FROM conversations""",
    "bundle_refresh": f"""WITH {_EVENTS_SQL}, x AS (SELECT event_id, event_id % 3 < 2 AS old, event_id % 4 = 0 OR (event_id % 4 = 1 AND event_id % 3 = 2) AS hit FROM ev)
SELECT event_id, hit AS triggered, CASE WHEN NOT hit THEN 'allow' WHEN old THEN 'redact' ELSE 'warn' END AS action, CAST(CASE WHEN hit THEN CASE WHEN old THEN 1 ELSE 2 END END AS INT) AS rule_version FROM x""",
    "stored_runs": """WITH r AS (SELECT *, conv_id * 1000 + turn AS run, CASE WHEN conv_id % 4 <> 0 THEN 'c' || conv_id ELSE substr(sha256('session:' || (conv_id * 1000 + turn)), 1, 32) END AS session_id FROM conversations WHERE role = 'user')
SELECT session_id, 'Turn ' || max(turn) AS title, 'company-' || (min(conv_id) % 5) AS company_slug, count(*) + count(*) FILTER (WHERE turn % 3 <> 0) AS messages, count(*) AS events, 4 * count(*) + count(*) FILTER (WHERE turn % 3 <> 0) AS audit FROM r GROUP BY session_id""",
}
