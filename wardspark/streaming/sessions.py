"""Placeholder vaults as live state: one per conversation, kept by session, with drafts that become conversations.

A session (a surface of one installation) sends events in order: ``scan`` a text, ``move`` a draft's vault to the
conversation that it became, ``rehydrate`` an answer. All conversations of a session share one state key, so a move
goes from one map to another without leaving its task. Texts are scanned by column expressions before the stateful
step, which only numbers values and puts texts together.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.patterns import PLACEHOLDER
from ..functions.scan import scan

#: Fixed value: for so long the vault of the last draft stands in for a conversation's own.
DRAFT_AGE = dt.timedelta(minutes=10)
#: A session without events for so long is over, and its state goes.
IDLE = dt.timedelta(hours=24)
RESULT = "session string, at timestamp, seq long, kind string, conversation string, text string, replaced int, unresolved array<string>"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

_MARK = re.compile(PLACEHOLDER)
_WORD = "[A-Za-z0-9_]"
_EDGE = f"(?:(?<!{_WORD})(?={_WORD})|(?<={_WORD})(?!{_WORD}))"

Vault = dict[str, tuple[str, str]]


def stable(kind: str, value: str) -> tuple[str, str]:
    value = " ".join(value.split())
    return kind, value.lower() if kind == "PERSON" else value


def redacted(text: str, entities: list[dict], vault: Vault) -> tuple[str, Vault]:
    """The text with placeholders, known ones first, and what the entities add to the vault."""
    known = {stable(t, v): p for p, (t, v) in vault.items()}
    top: dict[str, int] = {}
    for m in (m for p in (*vault, text) for m in _MARK.finditer(p)):
        top[m[1]] = max(top.get(m[1], 0), int(m[2]))
    spans, added = [], {}
    for e in entities:
        key = stable(e["type"], e["original"])
        if key not in known:
            top[e["type"]] = top.get(e["type"], 0) + 1
            known[key] = f"[{e['type']}_{top[e['type']]}]"
        spans.append((e["start"], e["stop"], known[key]))
        added[known[key]] = (e["type"], e["original"])
    for placeholder, (kind, value) in vault.items():
        if value and value.lower() in text.lower():
            for m in re.finditer(_EDGE + re.escape(value) + _EDGE, text, re.IGNORECASE if kind == "PERSON" else 0):
                if all(m.end() <= a or b <= m.start() for a, b, _ in spans):
                    spans.append((m.start(), m.end(), placeholder))
    out, at = [], 0
    for start, stop, placeholder in sorted(spans):
        out += [text[at:start], placeholder]
        at = stop
    return "".join([*out, text[at:]]), added


def restored(text: str, vault: Vault) -> tuple[str, int, list[str]]:
    """The text with known placeholders put back but for secrets, their number, and the others in order."""
    missing: dict[str, None] = {}
    count = 0

    def value(m: re.Match) -> str:
        nonlocal count
        if m[1] != "SECRET" and m[0] in vault:
            count += 1
            return vault[m[0]][1]
        missing[m[0]] = None
        return m[0]

    return _MARK.sub(value, text), count, list(missing)


class SessionVaults(StatefulProcessor):
    """State of a session: its vaults by conversation and placeholder, and which draft was last and when."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entries = handle.getMapState("entries", "conversation string, placeholder string", "nth long, type string, original string")
        self.draft = handle.getValueState("draft", "conversation string, at timestamp")
        self.seen = handle.getValueState("seen", "at timestamp, nth long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        events = sorted((r for part in rows for r in part.to_dict("records")), key=lambda r: (r["at"], r["seq"]))
        stored = list(self.entries.iterator()) if self.entries.exists() else []
        places = {at: nth for at, (nth, _, _) in stored}
        maps: dict[str, Vault] = {}
        for (conversation, placeholder), (_, kind, original) in sorted(stored, key=lambda x: x[1][0]):
            maps.setdefault(conversation, {})[placeholder] = (kind, original)
        last, nth = self.seen.get() if self.seen.exists() else (None, 0)
        draft = self.draft.get() if self.draft.exists() else None
        out = []

        def save(conversation: str, more: Vault) -> None:
            nonlocal nth
            for placeholder, (kind, original) in more.items():
                if (conversation, placeholder) not in places:
                    nth += 1
                    places[conversation, placeholder] = nth
                maps.setdefault(conversation, {})[placeholder] = (kind, original)
                self.entries.updateValue((conversation, placeholder), (places[conversation, placeholder], kind, original))

        for e in events:
            if last is not None and e["at"] - last > IDLE:  # as the timer would, if it has not yet
                self.entries.clear()
                self.draft.clear()
                draft, nth = None, 0
                places.clear()
                maps.clear()
            conversation, text = e["conversation"] or "", e["text"] or ""
            if e["kind"] == "scan":
                text, added = redacted(text, list(e["entities"]), maps.get(conversation, {}))
                safe = {p: x for p, x in added.items() if x[0] != "SECRET"}
                if safe and e["authoritative"] and e["action"] != "block":
                    save(conversation, safe)
                    draft = (conversation, e["at"])
                result = (text, 0, [])
            elif e["kind"] == "move":
                if conversation != e["target"] and maps.get(conversation):
                    save(e["target"], dict(maps[conversation]))
                result = (None, 0, [])
            else:
                result = restored(text, maps.get(conversation, {}))
                young = draft and draft[0].startswith("draft:") and conversation.startswith("conversation:") and e["at"] - draft[1] <= DRAFT_AGE
                if not result[1] and result[2] and young:
                    result = restored(text, maps[draft[0]])
            out.append((key[0], e["at"], e["seq"], e["kind"], conversation, *result))
            last = e["at"] if last is None else max(last, e["at"])
        if draft:
            self.draft.update(draft)
        self.seen.update((last, nth))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        for wait in (IDLE, *([DRAFT_AGE] if draft else [])):
            since = draft[1] if wait is DRAFT_AGE else last
            self.handle.registerTimer(int(pd.Timestamp(since + wait).timestamp() * 1000) + 1)
        yield pd.DataFrame(out, columns=[x.split()[0] for x in RESULT.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        if self.seen.exists() and now > pd.Timestamp(self.seen.get()[0] + IDLE).timestamp() * 1000:
            self.entries.clear()
            self.draft.clear()
            self.seen.clear()
        elif self.draft.exists() and now > pd.Timestamp(self.draft.get()[1] + DRAFT_AGE).timestamp() * 1000:
            self.draft.clear()
        return iter(())

    def close(self) -> None:
        pass


def session_vaults(events: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """RESULT for a stream of events: session, at, seq, kind, conversation, target, authoritative, text.

    A scan's text comes out redacted, a rehydrated one with its values put back. Vaults keep what authoritative
    scans that are not blocked find, secrets aside. Where a conversation's own vault resolves nothing, that of the last draft
    does for ten minutes. Events of a session in one batch are taken by ``at``, then ``seq``; those that come in a later
    batch are taken when they come. Sessions without an id are dropped.
    """
    rows = events.where("session is not null and at is not null")
    whole = F.struct("session", "at", "seq", "kind", "conversation", "target", F.coalesce("authoritative", F.lit(False)).alias("authoritative"), "text").alias("event")
    scanned = scan(rows.select(whole, F.when(F.col("kind") == "scan", F.col("text")).otherwise("").alias("body")), "event", "body")
    spans = F.transform("entities", lambda e: F.struct(e["start"].alias("start"), e["stop"].alias("stop"), e["type"].alias("type"), e["original"].alias("original")))
    told = scanned.select("event.*", spans.alias("entities"), "action")
    return told.withWatermark("at", lateness).groupBy("session").transformWithStateInPandas(SessionVaults(), RESULT, "Append", "EventTime")
