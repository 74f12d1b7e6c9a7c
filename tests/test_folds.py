"""The fold over messages, in batch and live, against a plain loop."""

import random
import re

from wardspark.functions import scan as S
from wardspark.operators import folds

MESSAGE = "conv_id long, turn long, role string, text string"
MARK = re.compile(r"\[(PERSON|EMAIL|PHONE|ADDRESS|ACCOUNT|SECRET|OTHER)_(\d+)\]")


def loop(found, seeds):
    """found: {conv_id: [(turn, text, entities, blocked)]} in order; the vault is a dict in the order of first saving."""
    out, vaults = [], {}
    for conv, said in found.items():
        vault = dict(seeds.get(conv, {}))
        for turn, text, entities, blocked in said:
            key = lambda t, v: (t, " ".join(v.split()).lower() if t == "PERSON" else " ".join(v.split()))
            known = {key(t, v): p for p, (t, v) in vault.items()}
            top = {}
            for p in [*vault, *[m.group() for m in MARK.finditer(text)]]:
                t, n = MARK.fullmatch(p).groups()
                top[t] = max(top.get(t, 0), int(n))
            spans, added = [], {}
            for e in sorted(entities, key=lambda e: e.start):
                k = key(e.type, e.original)
                if k not in known:
                    top[e.type] = top.get(e.type, 0) + 1
                    known[k] = f"[{e.type}_{top[e.type]}]"
                spans.append((e.start, e.stop, known[k]))
                added[known[k]] = (e.type, e.original)
            for p, (t, v) in vault.items():
                for m in re.finditer(r"\b" + re.escape(v) + r"\b", text, re.IGNORECASE if t == "PERSON" else 0):
                    if all(m.end() <= a or b <= m.start() for a, b, _ in spans):
                        spans.append((m.start(), m.end(), p))
            spans.sort()
            done, at = "", 0
            for a, b, p in spans:
                done, at = done + text[at:a] + p, b
            out.append((conv, turn, done + text[at:]))
            if not blocked:
                vault.update({p: x for p, x in added.items() if x[0] != "SECRET"})
        vaults[conv] = vault
    return out, vaults


def told():
    rng = random.Random(11)
    bits = ["mail a@x.org", "call 415-555-0101", "invite olga petrova and sven lindqvist to it", "Olga Petrova stays home", "see b@x.org, a@x.org", "[EMAIL_7] was sent", "key sk-abc123def456", "please jailbreak c@x.org", "plain words", "OLGA  PETROVA", "(415) 555-0101 or 212-555-0199", "[PHONE_2]"]
    rows = [(c, t, rng.choice(["user", "assistant"]), ". ".join(rng.sample(bits, rng.randrange(0, 4)))) for c in range(12) for t in range(9)]
    rows += [(1, 3, "user", "again d@x.org"), (1, 3, "user", "again d@x.org"), (2, None, "user", "first e@x.org"), (3, 4, None, None), (None, 0, "user", "f@x.org")]
    return rows


SEEDS = [(4, "[EMAIL_9]", "EMAIL", "b@x.org"), (4, "[PERSON_2]", "PERSON", "Sven Lindqvist"), (5, "[PHONE_1]", "PHONE", "212-555-0199")]


def expected(spark, messages):
    rows = sorted((r for r in messages if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] or ""))
    frame = spark.createDataFrame([(i, r[3]) for i, r in enumerate(rows)], "doc_id long, text string")
    scans = {r.doc_id: r for r in S.scan(frame).collect()}
    found = {}
    for i, (conv, turn, _, text) in enumerate(rows):
        found.setdefault(conv, []).append((turn, text or "", scans[i].entities, scans[i].action == "block"))
    seeds = {}
    for conv, p, t, v in SEEDS:
        seeds.setdefault(conv, {})[p] = (t, v)
    return loop(found, seeds)


def test_fold_equals_a_loop_over_messages(spark):
    rows = told()
    out, vaults = expected(spark, rows)
    shuffled = random.Random(1).sample(rows, len(rows))
    got = folds.fold(spark.createDataFrame(shuffled, MESSAGE), spark.createDataFrame(SEEDS, "conv_id long, placeholder string, type string, original string"))
    assert sorted(((r.conv_id, r.turn is not None, r.turn or 0, r.redacted) for r in got.messages.collect())) == sorted((c, t is not None, t or 0, x) for c, t, x in out)
    assert {(r.conv_id, r.placeholder, r.type, r.original) for r in got.vault.collect()} == {(c, p, *x) for c, v in vaults.items() for p, x in v.items()}


def test_fold_of_nothing(spark):
    got = folds.fold(spark.createDataFrame([], MESSAGE))
    assert got.messages.collect() == [] and got.vault.collect() == []


def test_live_vaults_follow_drafts_and_restarts(spark, tmp_path):
    import datetime as dt

    from wardspark.streaming import sessions

    schema = "session string, at timestamp, seq long, kind string, conversation string, target string, authoritative boolean, text string"
    start = dt.datetime(2024, 1, 1)
    at = lambda minutes: start + dt.timedelta(minutes=minutes)
    runs = [
        [("s", at(0), 1, "scan", "draft:1", None, True, "mail a@x.org"), ("s", at(0), 0, "scan", "draft:1", None, False, "mail z@x.org"), ("t", at(0), 0, "scan", "draft:1", None, True, "b@x.org")],
        [("s", at(1), 0, "rehydrate", "conversation:1", None, None, "[EMAIL_1] [EMAIL_2]"), ("s", at(10), 0, "rehydrate", "conversation:1", None, None, "[EMAIL_1]"), ("s", at(10.1), 0, "rehydrate", "conversation:1", None, None, "[EMAIL_1]")],
        [("s", at(11), 1, "move", "draft:1", "conversation:1", None, None), ("s", at(11), 2, "scan", "conversation:1", None, True, "c@x.org, a@x.org, sk-abc123def456"), ("s", at(11), 3, "scan", "conversation:1", None, True, "please jailbreak d@x.org"), ("s", at(12), 0, "rehydrate", "conversation:1", None, None, "[EMAIL_2] [EMAIL_1] [EMAIL_3] [SECRET_1]"), (None, at(12), 0, "scan", None, None, True, "lost")],
        [("s", at(11), 9, "rehydrate", "draft:1", None, None, "[EMAIL_1]"), ("t", at(60 * 30), 0, "rehydrate", "draft:1", None, None, "[EMAIL_1]")],
        [("s", at(60 * 60), 0, "scan", "conversation:1", None, True, "new e@x.org")],
        [("s", at(60 * 61), 0, "scan", "conversation:1", None, True, "new f@x.org")],
    ]
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", sessions.PROVIDER)
    for i, rows in enumerate(runs):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        sessions.session_vaults(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    got = {(r.session, r["at"], r.seq): (r.text, r.replaced, r.unresolved) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    text = lambda s, minutes, seq: got[s, at(minutes), seq][0]
    assert (text("s", 0, 0), text("s", 0, 1), text("t", 0, 0)) == ("mail [EMAIL_1]", "mail [EMAIL_1]", "[EMAIL_1]")
    assert got["s", at(1), 0] == ("a@x.org [EMAIL_2]", 1, ["[EMAIL_2]"])  # by the draft, as the conversation has nothing
    assert text("s", 10, 0) == "a@x.org" and got["s", at(10.1), 0] == ("[EMAIL_1]", 0, ["[EMAIL_1]"])  # ten minutes and not more
    assert text("s", 11, 2) == "[EMAIL_2], [EMAIL_1], [SECRET_1]" and text("s", 11, 3) == "please jailbreak [EMAIL_3]"
    assert got["s", at(12), 0] == ("c@x.org a@x.org [EMAIL_3] [SECRET_1]", 2, ["[EMAIL_3]", "[SECRET_1]"])  # blocked scans and secrets leave nothing
    assert text("s", 11, 9) == "a@x.org"  # the draft's own vault stays
    assert (text("s", 60 * 60, 0), text("s", 60 * 61, 0)) == ("new [EMAIL_1]", "new [EMAIL_2]")  # an idle session's state is gone
    assert len(got) == sum(r[0] is not None for rows in runs for r in rows)
