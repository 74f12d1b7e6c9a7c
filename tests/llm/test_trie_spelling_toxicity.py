"""Operators 11 to 13 against brute force and held-out labels."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from wardspark.llm import conversation_trie, spelling, toxicity

CONV = "conv_id long, turn long, role string, text string, seg long, depth long, a string, kind int"


def conversations():
    rng = random.Random(3)
    rows = []
    for c in [*range(0, 260), 5003, 77777, -150, -100, -3]:
        turns = rng.randrange(1, 9) if c % 50 else 30
        for t in range(turns):
            text = rng.choice(["a", "b", "", None]) if t < 4 else rng.choice(["long é", "x"])
            rows.append((c, t, rng.choice(["user", "user", None]), text))
    rows += [(200, None, "system", "first")]  # null turn goes first
    rows += [(300 + i, t, "user", "same") for i in range(60) for t in range(7)]  # copies
    rows += [(8, 1, "user", "tie"), (8, 1, "user", "tie"), (8, 1, "assistant", "tie"), (None, 0, "user", "nobody")]
    return rows


def brute_trie(rows, every=100, most=6):
    by = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            by[c].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [(r, x) for _, r, x in sorted(v)] for c, v in by.items()}
    built = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % most
        base = c - int(np.fmod(c, every))
        built[c] = tuple(own.get(base, [])[:h] + v[h:])
    members = defaultdict(list)
    for c, v in built.items():
        for d in range(len(v) + 1):
            members[v[:d]].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) if kids[p] else 1
        saved[p] = sum(saved[k] for k in kids[p]) + ((len(members[p]) - 1) * len(p[-1][1]) if p else 0)
    out = set()
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(built[c]) == len(p))
        parent = min(members[p[:-1]]) if p else None
        out.add((min(m), len(p), parent, len(m), len(kids[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    assert len(out) == len(members)
    return out


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


@pytest.mark.parametrize("segment", [2, 64])
def test_trie_equals_brute_force(spark, segment, monkeypatch):
    rows = conversations()
    random.Random(1).shuffle(rows)
    frame = spark.createDataFrame([(*r, 1, 2, "x", 3) for r in rows], CONV)
    monkeypatch.setattr(conversation_trie, "STRETCH", 3)
    monkeypatch.setattr(conversation_trie, "FOREST_ROWS", 60)
    monkeypatch.setattr(conversation_trie, "CHUNK", 7)
    found = conversation_trie.conversation_trie(frame, segment=segment).collect()
    assert len(found) == len({tuple(r[c] for c in COLUMNS) for r in found})
    assert {tuple(r[c] for c in COLUMNS) for r in found} == brute_trie(rows)


def test_trie_of_no_conversations_and_of_turnless_ones(spark):
    assert conversation_trie.conversation_trie(spark.createDataFrame([], CONV)).collect() == []
    lost = next(c for c in range(1000, 1100) if zlib.crc32(str(c).encode()) % 6 > 0 and c % 100)
    frame = spark.createDataFrame([(lost, 0, "user", "gone", 1, 1, "", 1)], CONV)
    [row] = conversation_trie.conversation_trie(frame).collect()
    assert (row.conv_id, row.depth, row.n_convs, row.n_children, row.n_leaves, row.ends_sha256) == (lost, 0, 1, 0, 1, hashlib.sha256(str(lost).encode()).hexdigest())


def brute_words(docs):
    n = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_forms(words):
    near = {w: [v for v in words if v != w and abs(len(v) - len(w)) <= 1 and one_apart(w, v)] for w in words}
    form = {}
    for w, some in near.items():
        best = min(some, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 2 * words[w] else None
    out = {}
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None)
    return out


def variant_docs():
    rng = random.Random(5)
    base = ["aaaaa", "aaaaaa", "ababab", "hello", "hallo", "helló", "jello", "shell", "colour", "color", "colours", "überall", "Überall", "strasse", "straße", "gardener"]
    base += ["".join(rng.choice("abcà") for _ in range(rng.randrange(4, 8))) for _ in range(150)]
    docs = []
    for i in range(240):
        some = [rng.choice(base) if rng.random() < 0.7 else rng.choice(base[:16]) for _ in range(60)]
        docs.append((i, rng.choice([" ", ", ", "1", "\n"]).join(w.upper() if rng.random() < 0.1 else w for w in some)))
    docs += [(600 + i, " ".join(["lanterna"] * (i < 5) + ["lanternb"] * (i < 15) + ["lantermb"])) for i in range(50)]  # a chain of forms
    docs += [(None, "hello hello hello"), (900, None), (901, ""), (902, "hello " * 250_000), (903, "×÷×÷× _ hello"), (3, docs[3][1])]
    return docs


@pytest.mark.parametrize("block", [7, 4096])
def test_spelling_groups_equal_brute_force(spark, block):
    docs = variant_docs()
    frame = spark.createDataFrame([(i, t, "x", 1, "s") for i, t in docs], "doc_id long, text string, word string, n int, part string")
    words = brute_words(docs)
    assert len(words) > 100
    found = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.spelling_groups(frame, block=block).collect()}
    assert found == brute_forms(words)
    assert any(x[0] and x[0] != x[1] for x in found.values())  # a chain of forms


def test_spelling_groups_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.spelling_groups(none).collect() == []
    assert spelling.spelling_groups(spark.createDataFrame([(1, None), (2, "a b")], "doc_id long, text string")).collect() == []


def toxic_docs(rng, n):
    """Insults and groups stand in clean texts too, each by itself; together they are toxic."""
    rows, labels = [], []
    for i in range(n):
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        text = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(10, 60))]
        if insult:
            text.insert(rng.randrange(len(text)), rng.choice(["fool", "pest", "rat"]))
        if group:
            text.insert(rng.randrange(len(text)), rng.choice(["northerner", "villager"]))
        rows.append((i, " ".join(text)))
        labels.append((i, int(insult and group)))
    return rows, labels


def test_pairs_of_terms_tell_what_single_ones_do_not(spark):
    rows, labels = toxic_docs(random.Random(2), 3000)
    rows += [(None, "fool villager"), (9001, None), (9002, ""), (9003, "fool villager " * 50_000)]
    docs = spark.createDataFrame([(i, t, 1.0, 2) for i, t in rows], "doc_id long, text string, score double, toxic int")
    marks = spark.createDataFrame([(i, y, 5) for i, y in labels] + [(None, 1, 1), (9001, None, 1)], "doc_id long, toxic int, text int")
    out = toxicity.toxicity(docs, marks).collect()
    assert len(out) == len(rows)
    truth, held = dict(labels), [r for r in out if r.held_out and r.doc_id is not None and r.doc_id < 3000]
    assert {r.doc_id for r in held} == {i for i, _ in labels if zlib.crc32(str(i).encode()) % 5 == 0}
    assert np.mean([truth[r.doc_id] == r.predicted for r in held]) > 0.97
    assert {r.doc_id: r.predicted for r in out if r.doc_id in (9001, 9002, 9003)} == {9001: 0, 9002: 0, 9003: 1}
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)


def test_held_out_labels_are_not_learned(spark):
    rows, labels = toxic_docs(random.Random(4), 400)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    turned = [(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, y in labels]
    one, two = ({r.doc_id: r.score for r in toxicity.toxicity(docs, spark.createDataFrame(x, "doc_id long, toxic int")).collect()} for x in (labels, turned))
    assert one == two


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "some text"), (1, "some text"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [round(r.score, 6) for r in toxicity.toxicity(docs, none).collect()] == [0.1] * 3
    assert toxicity.toxicity(docs.where("false"), none).collect() == []
