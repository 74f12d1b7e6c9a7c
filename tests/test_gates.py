"""Pauses and gates, in batch and live, against plain loops."""

import datetime as dt
import random

from wardspark.operators import gates
from wardspark.streaming import gates as live
from wardspark.streaming import sessions

START = dt.datetime(2024, 1, 1)


def edits():
    rng, out = random.Random(1), []
    for s in range(8):
        at = 0
        for seq in range(20):
            at += rng.choice([0, 100, 299, 300, 301, 900])
            out.append((f"s{s}", START + dt.timedelta(milliseconds=at), seq, rng.choice(["x", "y", "  ", None])))
    return out


def passing(rows):
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    out = set()
    for some in by.values():
        some.sort(key=lambda r: r[1:3])
        for r, after in zip(some, [*some[1:], None], strict=True):
            if (after is None or after[1] - r[1] >= dt.timedelta(milliseconds=300)) and (r[3] or "").strip():
                out.add(r)
    return out


def test_pauses_let_the_last_edit_through(spark, tmp_path):
    rows = edits()
    frame = spark.createDataFrame([*rows, ("s0", None, 99, "x")], live.EDIT)
    assert {tuple(r) for r in gates.debounced(frame, ["session"]).collect()} == passing(rows)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", sessions.PROVIDER)
    later = [("end", START + dt.timedelta(hours=h), 0, "x") for h in (1, 2)]
    some = sorted(rows, key=lambda r: r[1])
    for part in (some[:50], some[50:], later[:1], later[1:]):
        spark.createDataFrame(part, live.EDIT).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(live.EDIT).parquet(str(tmp_path / "in"))
        live.debounced_live(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert {r for r in got if r[0] != "end"} == passing(rows)


def test_gate_states(spark, tmp_path):
    rng = random.Random(2)
    rows = [(f"s{s}", START + dt.timedelta(seconds=rng.randrange(40)), i, rng.choice(["select", "allow", "refuse", "clear", "send", None])) for s in range(10) for i in range(30)]
    want = {}
    for s in {r[0] for r in rows}:
        now = "none"
        for r in sorted((r for r in rows if r[0] == s), key=lambda r: r[1:3]):
            now = gates.STEPS.get((r[3], now), now)
            want[r[:3]] = now
    schema = "session string, at timestamp, seq long, step string"
    frame = spark.createDataFrame(rows, schema)
    assert {(r.session, r["at"], r.seq): r.state for r in gates.gate_states(frame, ["session"]).collect()} == want
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", sessions.PROVIDER)
    some = sorted(rows, key=lambda r: r[1:3])
    for part in (some[:100], some[100:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        live.gates_live(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    assert {(r.session, r["at"], r.seq): r.state for r in spark.read.parquet(str(tmp_path / "out")).collect()} == want


def test_why_messages_may_not_go(spark):
    rows = [("pending", True, False, "clear", None), ("blocked", True, True, "failed", "why"), ("blocked", True, True, "blocked", None), ("blocked", True, False, "clear", None), ("governed", True, True, "clear", None), ("none", False, False, "clear", None)]
    df = spark.createDataFrame(rows, "state string, files boolean, notice boolean, phase string, message string")
    got = [r[0] for r in df.select(gates.send_problem(*[df[c] for c in df.columns])).collect()]
    assert got == [gates.WAITING, "why", gates.REFUSED, gates.UNVERIFIED, None, None]
