"""Brute-force versions, round trips and edge cases of the operators."""

import hashlib
import random
import re
import textwrap
import zlib

import numpy as np
import pytest
from pyspark.sql import Row

from wardspark.llm import chat, decontaminate, embedding_dedup, jaccard_join, kneser_ney, licenses, line_dedup, mixing, rans, sharding, token_ids
from wardspark.llm.queries import tokenizer_path
from wardspark.llm.shingles import shingle_hashes, word_hashes

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names the operators use for their own.
CLASHING = "copies long, rep long, h string, size long, part int, shard int, mixed_id long, mixed_copies int, mixed_copy int, start long, n long"


def words(rng, n, vocabulary=3000):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def sample_texts():
    rng = random.Random(7)
    base = [words(rng, rng.randrange(20, 120)) for _ in range(20)]
    texts = list(base)
    for t in base[:8]:  # near copies of several distances, exact copies
        w = t.split()
        for share in (0.01, 0.03, 0.08):
            texts.append(" ".join(x if rng.random() > share else "changed" for x in w))
        texts.append(t.upper())
        texts.append(t)
    long_text = words(rng, 30_000)
    return [*texts, long_text, long_text + " end", "", "   ", "one", "one two", "one two", "é ü ñ", None, "!!! ??", "a\x00b c d e f g"]


@pytest.fixture(scope="module")
def texts():
    return dict(enumerate(sample_texts()))


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, None if i % 5 == 0 else "en", "a", 1) for i, t in texts.items()]
    rows += [(None, "row without an id", "en", "a", 1), (0, texts[0], "en", "a", 1)]
    df = spark.createDataFrame(rows, DOCS)
    return df.selectExpr("*", *[f"cast(1 as {kind}) as {name}" for name, kind in (c.split() for c in CLASHING.split(", "))])


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def shingles(text, size=5):
    w = [x for x in re.split(r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (text or "").lower()) if x]
    k = min(size, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def smallest_reachable(nodes, links):
    low = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(low[a], low[b])
            changed |= low[a] != m or low[b] != m
            low[a] = low[b] = m
    return low


def test_jaccard_join_equals_brute_force(docs, texts):
    sets = {i: shingles(t) for i, t in texts.items()}
    links = [
        (a, b) for a in sets for b in sets
        if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8
    ]
    low = smallest_reachable(sets, links)
    degree = {i: sum(i in pair for pair in links) for i in sets}
    got = {r.doc_id: r for r in jaccard_join.jaccard_classes(docs).collect()}
    assert set(got) == set(texts)
    assert {i: r.class_id for i, r in got.items()} == low
    copies_of_0 = {i for i in texts if sets[i] == sets[0]}  # id 0 stands twice in the table
    linked_to_0 = {x for pair in links if 0 in pair for x in pair} | copies_of_0
    assert all(got[i].n_links == degree[i] + (i in linked_to_0) for i in texts)
    assert all(r.kept == (r.doc_id == r.class_id) for r in got.values())


def test_jaccard_join_over_many_blocks(spark):
    rng = random.Random(21)
    base = [words(rng, 60) for _ in range(4)]
    texts = {}
    for i in range(60):  # chains: each text is near its neighbours and not near the others
        w = base[i % 4].split()
        for k in range(i // 4):
            w[k * 4 % 60] = f"x{k}"
        texts[i] = " ".join(w)
    # An id whose rows have different sets of the same size
    texts[100], other = words(rng, 40), words(rng, 40)
    df = spark.createDataFrame([*texts.items(), (100, other), (101, other)], "doc_id long, text string")
    sets = {i: shingles(t) for i, t in texts.items()} | {101: shingles(other)}
    links = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8] + [(100, 101)]
    got = {r.doc_id: r for r in jaccard_join.jaccard_classes(df, block=4).collect()}
    assert {i: r.class_id for i, r in got.items()} == smallest_reachable(sets, links)
    assert all(got[i].n_links == sum(i in pair for pair in links) for i in sets)
    assert {i: r.class_id for i, r in got.items()} == {r.doc_id: r.class_id for r in jaccard_join.jaccard_classes(df).collect()}


def test_jaccard_join_drops_all_but_one_of_a_class(docs, none):
    classes = {r.doc_id: r.class_id for r in jaccard_join.jaccard_classes(docs).collect()}
    left = jaccard_join.drop_near_duplicates(docs)
    assert left.columns == docs.columns
    rows = [r.doc_id for r in left.collect()]
    assert {i for i in rows if i is not None} == set(classes.values())
    assert None in rows
    assert jaccard_join.drop_near_duplicates(none).count() == 0


def test_a_chain_of_near_duplicates_costs_its_bucket_pairs():
    """Texts near their neighbours only: pairs to compare grow with the chain's length, and none is compared twice."""
    rng = random.Random(9)
    w, chain = words(rng, 200).split(), []
    for k in range(240):
        w[k * 3 % 200] = f"y{k}"
        chain.append(" ".join(w))
    sigs = np.array([jaccard_join.signature(np.unique(shingle_hashes(t))) for t in chain])
    least, cost = jaccard_join.least_matches(0.8), {}
    for n in (120, 240):
        buckets = {}
        for i, sig in enumerate(sigs[:n]):
            for band, key in enumerate(sig.reshape(jaccard_join.BANDS, jaccard_join.ROWS)):
                buckets.setdefault((band, key.tobytes()), []).append(i)
        several = {at: rows for at, rows in buckets.items() if len(rows) > 1}
        cost[n] = sum(len(r) * (len(r) - 1) // 2 for r in several.values())
        found = []
        for (band, _), rows in several.items():
            i, j = jaccard_join.candidate_pairs(sigs[rows], np.full(len(rows), band), [(len(rows), 0, True)], least)
            found += [(rows[a], rows[b]) for a, b in zip(i, j, strict=True)]
        assert len(found) == len(set(found)) and {(i, i + 1) for i in range(n - 1)} <= set(found)
    assert cost[240] < 2.5 * cost[120] < 240 * 240 * 8


def test_pruning_keeps_whatever_can_reach_the_threshold():
    least = jaccard_join.least_matches(0.8)
    assert all(least[n] <= n and least[n] >= least[n - 1] for n in range(1, len(least)))
    assert least[jaccard_join.HASHES] > jaccard_join.HASHES // 3


def test_decontamination_equals_brute_force(spark, docs, none):
    rng = random.Random(3)
    items = {i: words(rng, n) for i, n in enumerate((40, 12, 7, 5, 3, 1, 90))} | {7: "", 8: None}
    rows = [(100 + i, f"{words(rng, 500)} {t} {words(rng, 300)}", "en", "b", 1) for i, t in items.items()]
    rows.append((200, words(rng, 50) + " " + " ".join(items[0].split()[:20]), "en", "b", 1))
    rows.append((201, words(rng, 50) + " " + " ".join(items[0].split()[:38]) + " " + words(rng, 9), "en", "b", 1))
    table = docs.select("doc_id", "text", "lang", "source", "n_chars").unionByName(spark.createDataFrame(rows, DOCS))
    bench = spark.createDataFrame([(i, t) for i, t in items.items()] + [(0, items[0]), (None, "w1 w2 w3")], "item_id long, text string")
    expected = set()
    for i, t in items.items():
        own = shingles(t)
        size = min(5, len(next(iter(own), ())))
        for d, text in [(r.doc_id, r.text) for r in table.collect()]:
            if own and d is not None and len(own & shingles(text, size)) / len(own) >= 0.8 and len(next(iter(shingles(text, size)), ())) == size:
                expected.add((d, i))
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(table, bench).collect()}
    assert got == expected and (201, 0) in got and (200, 0) not in got
    left = decontaminate.drop_contaminated(table, bench)
    assert left.columns == table.columns
    assert {r.doc_id for r in left.collect()} == {r.doc_id for r in table.collect()} - {d for d, _ in got}
    assert decontaminate.contaminated(none, bench).count() == 0
    assert decontaminate.contaminated(table, bench.where("false")).count() == 0


def test_embeddings_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(60, 24))
    vectors = [v.tolist() for v in np.concatenate([base, base[:20] + 0.1 * rng.normal(size=(20, 24)), base[:10] * 3.0])]
    table = dict(enumerate(vectors))
    odd = {200: None, 201: [0.0] * 24, 202: [float("nan")] * 24, 203: [float("inf")] * 24, 204: [None] * 24, 205: [], 206: [1.0, 2.0], 207: [2.0, 4.0]}
    table |= odd
    df = spark.createDataFrame([(i, v, 1) for i, v in table.items()] + [(None, vectors[0], 1)], "vec_id long, embedding array<double>, label int")
    good = {i: np.array(v) for i, v in table.items() if i not in odd or i >= 206}
    links = [
        (a, b) for a in good for b in good
        if a < b and len(good[a]) == len(good[b]) and good[a] @ good[b] / (np.sqrt(good[a] @ good[a]) * np.sqrt(good[b] @ good[b])) >= 0.9
    ]
    low = smallest_reachable(table, links)
    got = {r.vec_id: r for r in embedding_dedup.cosine_components(df).collect()}
    assert {i: r.component_id for i, r in got.items()} == low
    assert {i: r.n_links for i, r in got.items()} == {i: sum(i in pair for pair in links) for i in table}
    assert embedding_dedup.cosine_components(df.where("false")).count() == 0


def test_embeddings_over_many_blocks(spark):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(90, 6))
    vectors = np.concatenate([base, base[:40] + 0.2 * rng.normal(size=(40, 6)), np.repeat(base[:1], 30, axis=0), -0.0 * base[:1] + base[1:2]])
    rows = [(i, v.tolist(), 0) for i, v in enumerate(vectors)] + [(5, vectors[5].tolist(), 0), (6, vectors[7].tolist(), 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, copies int")
    ids = np.array([r[0] for r in rows])
    m = np.array([r[1] for r in rows])
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    np.fill_diagonal(near, False)
    low = smallest_reachable(set(ids.tolist()), [(int(ids[i]), int(ids[j])) for i, j in zip(*np.nonzero(near), strict=True)])
    degree = {i: max(int(near[k].sum()) for k in np.flatnonzero(ids == i)) for i in set(ids.tolist())}
    for block in (8, 4096):
        got = {r.vec_id: r for r in embedding_dedup.cosine_components(df, block=block).collect()}
        assert {i: r.component_id for i, r in got.items()} == low
        assert {i: r.n_links for i, r in got.items()} == degree


def test_tiles_agree_with_one_product():
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(700, 16)), rng.normal(size=(300, 16))
    b[:100] = a[:100] + 0.2 * rng.normal(size=(100, 16))
    axes = np.linalg.qr(rng.normal(size=(16, 16)))[0]
    i, j = embedding_dedup.linked_pairs(a, b, axes, 0.9, False)
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == set(zip(*np.nonzero(unit(a) @ unit(b).T >= 0.9), strict=True))


@pytest.mark.parametrize("n", [1, 63, 64, 65, rans.BLOCK, rans.BLOCK + 1, 3 * rans.BLOCK - 7])
def test_range_coder_round_trip(n):
    ids = (np.random.default_rng(n).zipf(1.3, n) % 50_000).astype(np.uint32)
    coded = rans.encode_segment(ids)
    assert np.array_equal(rans.decode_segment(n, *coded), ids)
    if n > rans.BLOCK:  # one block by itself
        assert np.array_equal(rans.decode_segment(n, *coded, first=1, stop=2), ids[rans.BLOCK : 2 * rans.BLOCK])


def test_range_coder_finds_damage():
    ids = np.arange(1000, dtype=np.uint32) % 91
    table, checkpoints, payload = rans.encode_segment(ids)
    with pytest.raises(rans.CorruptBlock):
        rans.decode_segment(len(ids), table, checkpoints, bytes([payload[0] ^ 1]) + payload[1:])


def test_token_ids_equal_the_tokenizer(spark, docs, none):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    path = token_ids.write_token_ids(docs, tokenizer_path(), end_id=2, segment_tokens=5000)
    digest = sorted(token_ids.read_token_digest(spark, path).collect(), key=lambda r: r.start)
    source = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r.doc_id for r in digest] == [i for i, _ in source]
    start = 0
    for r, (_, text) in zip(digest, source, strict=True):
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    back = {r.doc_id: r.ids for r in token_ids.read_token_ids(spark, path).collect()}
    assert tokenizer.decode(back[1][:-1]) == dict(source)[1]
    assert token_ids.read_token_digest(spark, token_ids.write_token_ids(none, tokenizer_path(), end_id=2)).count() == 0


def test_words_are_known_by_their_bytes():
    """Two words that every polynomial hash modulo a power of two confuses, and strings of added tokens."""
    from tokenizers import Tokenizer

    word = "a"
    while len(word) < 1024:
        word += word.translate({97: 98, 98: 97})
    other = word.translate({97: 98, 98: 97})
    tokenizer, encoder = Tokenizer.from_file(tokenizer_path()), token_ids.WordEncoder(tokenizer_path(), 2)
    texts = [word, other, f"{other} {word}", word[:64], other[:64], "hello <|endoftext|> x", "two  <|endoftext|>  <|endoftext|>", "hello x", ""]
    for batch in (texts, texts[::-1]):
        flat, n = encoder.encode(batch)
        for text, at, k in zip(batch, (np.cumsum(n) - n).tolist(), n.tolist(), strict=True):
            assert flat[at : at + k].tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 2], text
    a, b = (word_hashes(f"{x} end") for x in (word, other))
    assert a[0] != b[0] and a[1] == b[1]
    # Words that share a key: the second is told from the first by its bytes.
    clash = token_ids.WordEncoder(tokenizer_path(), 2)
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(token_ids, "span_hashes", lambda raw, starts, ends: np.full(len(starts), 7, np.uint64))
        for batch in (["one two three", "two"], ["three one", "onf"]):
            flat, n = clash.encode(batch)
            assert flat.tolist() == [x for t in batch for x in [*tokenizer.encode(t, add_special_tokens=False).ids, 2]]


def test_cut_words_give_the_ids_of_whole_texts():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    rng = random.Random(11)
    alphabet = ["a", "word", " ", "  ", "\n", "\t", "'s", "12", "é", " ", "　", "漢字", "😀", "-", ".", "</s>", " ", "İ"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(800)]
    flat, n = token_ids.WordEncoder(tokenizer_path(), 2).encode(texts)
    at = 0
    for text, k in zip(texts, n.tolist(), strict=True):
        assert flat[at : at + k].tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 2], text
        at += k


def assert_encodes(encoder, tokenizer, texts):
    flat, n = encoder.encode(texts)
    assert len(n) == len(texts) and n.sum() == len(flat)
    for text, at, k in zip(texts, (np.cumsum(n) - n).tolist(), n.tolist(), strict=True):
        assert flat[at : at + k].tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 2], text


def test_cuts_between_letters_and_signs_give_the_ids_of_whole_texts():
    from tokenizers import Tokenizer

    tokenizer, encoder = Tokenizer.from_file(tokenizer_path()), token_ids.WordEncoder(tokenizer_path(), 2)
    rng = random.Random(12)
    alphabet = [*"aZ ~'\n\r\t.,(!1_-\x00\x1c\x7f", "  ", "'s", "'re", *"\u00e9\u00c9\u00d7\u00f7\u00ff\u00aa\u00b5\u0301\u00a0\u0085\u2028\u3000\u0663\u2019\u0416\u6f22\u0130", "<|endoftext|>"]
    for size in (3, 8, 30):
        assert_encodes(encoder, tokenizer, ["".join(rng.choice(alphabet) for _ in range(rng.randrange(size + 1))) for _ in range(1500)])


def learnt_words(encoder, patch):
    """The words that the encoder hands to the tokenizer from now on."""
    seen, learn = [], encoder._learn
    patch.setattr(encoder, "_learn", lambda found: (seen.extend(found), learn(found))[1])
    return seen


def test_a_word_is_learnt_once_whatever_stands_beside_it(monkeypatch):
    from tokenizers import Tokenizer

    tokenizer, encoder = Tokenizer.from_file(tokenizer_path()), token_ids.WordEncoder(tokenizer_path(), 2)
    seen = learnt_words(encoder, monkeypatch)
    signs = [".", ",", "!!", "***", ".\n", ";", ")"]
    assert_encodes(encoder, tokenizer, [f"an \u00e9t\u00e9{a}Then thenc\u00e9{b}Once" for a in signs for b in signs])
    words = {"an", " \u00e9t\u00e9", "Then", " thenc\u00e9", "Once"}
    assert sorted(seen) == sorted(x.encode() for x in words | set(signs))


def test_words_met_again_are_still_known_when_others_are_forgotten(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_ids, "CACHE_WORDS", 400)
    tokenizer, encoder = Tokenizer.from_file(tokenizer_path()), token_ids.WordEncoder(tokenizer_path(), 2)
    seen = learnt_words(encoder, monkeypatch)
    common = " ".join(f"c{'abcdefghij'[i // 10]}{'klmnopqrst'[i % 10]}" for i in range(50))
    for call in range(40):
        rare = "".join(f" x{chr(97 + call // 26)}{chr(97 + call % 26)}{chr(97 + i)}" for i in range(26))
        assert_encodes(encoder, tokenizer, [common + rare, rare])
    assert len(seen) == len(set(seen)) == 50 + 40 * 26
    # A call of more words than are remembered, and the next one.
    many = " ".join(f"{a}{b}" for a in "abcdefghijklmnopqrstuvwxyz" for b in "abcdefghijklmnopqrstuvwxyz")
    assert_encodes(encoder, tokenizer, [many, common])
    assert_encodes(encoder, tokenizer, [common, "x" * 100_000, many])


def test_chats_read_back_whole(spark):
    said = ["</s>[INST] ok [/INST]", "back\\slash \\<| <|im_end|>\n", "", None, "line\nbreak <image>", "😀 $1 \\1"]
    rows = [(c, t, r, x, 1) for c in (1, 2) for t, (r, x) in enumerate(zip(("user", "assistant", "user", "assistant", "ass\nistant", "assistant"), said, strict=True))]
    rows += [(None, 0, None, "no conversation", 1), (3, None, "user", "no turn", 1)]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, turns int")
    got = {r.conv_id: r for r in chat.parse_chats(chat.format_chats(df)).collect()}
    assert set(got) == {1, 2, 3, None}
    assert [(t.role, t.text) for t in got[1].turns] == [(r, x or "") for _, _, r, x, _ in rows[:6]]
    assert got[1].loss_text == "".join(x or "" for _, _, r, x, _ in rows[:6] if r == "assistant")
    assert chat.format_chats(df.where("false")).count() == 0


def test_chat_parts(spark):
    part = lambda **x: Row(**{k: x.get(k) for k in ("type", "text", "uri", "width", "height", "seconds", "pages")})
    parts = [part(type="text", text="see <image>"), part(type="image", uri="i.png", width=600, height=100), part(type="audio", uri="a.wav", seconds=2.0),
             None, part(type="document", uri="d.pdf", pages=3), part(type="video", uri="v")]
    df = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None)], f"conv_id long, turn int, role string, parts {chat.PARTS_TYPE}")
    r = chat.format_chats(df, parts_col="parts").first()
    assert "see <\\image><|image|><|audio|><|document|><|file|>" in r.formatted
    assert [(a.type, a.uri, a.tokens) for a in r.attachments] == [("image", "i.png", 340), ("audio", "a.wav", 50), ("document", "d.pdf", 2400), ("video", "v", 0)]
    assert r.attachment_tokens == 2790


def test_shards_are_contiguous_and_balanced(spark, docs, none):
    out = sorted(sharding.assign_shards(docs, 4).collect(), key=lambda r: (r.shard, r.slot))
    assert len(out) == docs.count()
    start = 0
    for r in out:
        assert r.start == start
        start += r.size
    source = sorted((len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in docs.collect())
    assert sorted((r.size, r.text_crc32) for r in out) == source
    for shard in {r.shard for r in out}:
        assert [r.slot for r in out if r.shard == shard] == list(range(sum(r.shard == shard for r in out)))
    # The cut once more in plain Python: the shard of a row is where the middle of its bytes falls.
    total = sum(r.size for r in out)
    assert [r.shard for r in out] == [min(3, (2 * r.start + r.size) * 4 // (2 * total)) for r in out]
    key = lambda r: (r.doc_id is not None, r.doc_id or 0, r.text_crc32, r.size)
    assert [key(r) for r in out] == sorted(map(key, out))
    many = spark.range(2000).selectExpr("id as doc_id", "repeat('x', cast(id % 50 as int)) as text")
    sizes = [r["sum(size)"] for r in sharding.assign_shards(many, 16).groupBy("shard").sum("size").collect()]
    assert len(sizes) == 16 and max(sizes) - min(sizes) <= 2 * 51
    assert sharding.assign_shards(none).count() == 0


def test_written_shards_hold_all_rows(docs, tmp_path):
    back = sharding.write_shards(docs, str(tmp_path / "shards"), 3)
    assert sorted((str(r.row.doc_id), r.row.text or "") for r in back.collect()) == sorted((str(r.doc_id), r.text or "") for r in docs.collect())


def test_written_shards_of_repeated_rows_and_none(spark, none, tmp_path):
    df = spark.createDataFrame([(None, None)] * 3 + [(1, "x")] * 4 + [(2, "y" * 300_000)], "doc_id long, text string").selectExpr("*", "9 as shard", "9 as slot", "9 as copy")
    back = sharding.write_shards(df, str(tmp_path / "odd"), 2).collect()
    assert sorted((r.row.doc_id or 0, len(r.row.text or "")) for r in back) == [(0, 0)] * 3 + [(1, 1)] * 4 + [(2, 300_000)]
    assert sorted((r.shard, r.slot) for r in back) == [(0, i) for i in range(7)] + [(1, 0)]
    assert sharding.write_shards(none, str(tmp_path / "none"), 2).count() == 0


def test_repeated_lines_of_odd_tables(spark):
    rng = random.Random(5)
    block = [words(rng, 12) for _ in range(5)]
    long_text = "\n".join(words(rng, 9) for _ in range(4000))
    rows = [(1, "\n".join(block)), (1, "\n".join(block)), (2, "\n".join(block + ["own line"])), (2, "\n".join(["another", *block])), (3, long_text), (4, long_text + "\nend of it"), (5, None), (6, "\n\n")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as pos", "1 as h", "1 as copy", "1 as lines", "1 as at")
    got = line_dedup.drop_repeated_lines(df).collect()
    by_id = {i: sorted(r.text for r in got if r.doc_id == i and r.text is not None) for i in range(1, 7)}
    assert by_id[1] == ["\n".join(block)] * 2  # equal rows of one id aren't repeats of each other
    assert by_id[2] == ["another", "own line"]
    assert by_id[3] == [long_text] and by_id[4] == ["end of it"] and by_id[5] == [] and by_id[6] == ["\n\n"]


def test_decontamination_of_ties_and_long_texts(spark):
    rng = random.Random(6)
    item = words(rng, 300)
    docs = [(1, words(rng, 100_000) + " " + item), (2, item), (2, item), (3, " ".join(item.split()[:230])), (4, " ".join(item.split()[:245])), (5, "same " * 50)]
    items = [(1, item), (2, item), (3, "same same same same same same"), (4, "same " * 9)]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as item_id", "1 as h", "1 as q", "1 as length")
    got = {(r.doc_id, r.item_id): (r.shared, r.item_shingles) for r in decontaminate.contaminated(df, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(d, i): (n, 296) for d, n in ((1, 296), (2, 296), (4, 241)) for i in (1, 2)} | {(5, 3): (1, 1), (5, 4): (1, 1)}


def test_licences_of_odd_tables(spark):
    rows = [(1, "Released under the MIT License."), (1, "Released under the MIT License."), (2, words(random.Random(1), 60_000) + "\nLicensed under CC BY 4.0."), (3, "alpha beta gamma")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as license", "1 as tid", "1 as unit", "1 as copy")
    assert {(r.doc_id, r.unit, r.place, r.license) for r in licenses.license_matches(df).collect()} == {(1, "line", 0, "MIT"), (2, "line", 1, "CC-BY-4.0")}
    own = spark.createDataFrame([("B", "alpha beta gamma"), ("A", "alpha beta gamma"), ("C", "")], "license string, text string")
    assert [(r.doc_id, r.license, r.dice) for r in licenses.license_matches(df, own).collect()] == [(3, "A", 1.0)]
    assert licenses.license_matches(df, own.where("false")).count() == 0


def test_repeated_lines_go(spark, none):
    rng = random.Random(2)
    block = [words(rng, 8) for _ in range(6)]
    passage = words(rng, 60)
    own = lambda n: [words(rng, 6) for _ in range(n)]
    a, b, c = own(3) + block + own(2), own(1) + [x.upper() + "  " for x in block] + own(4), own(2) + [passage] + own(1)
    rows = {1: a, 2: b, 3: c, 4: own(1) + [passage], 5: block[:2] + own(2), 6: block, 7: own(3) + block[:5] + own(1) + block[:5]}
    df = spark.createDataFrame([(i, "\n".join(x), "x") for i, x in rows.items()] + [(8, None, "x"), (9, "", "x"), (None, "a\nb", "x")], "doc_id long, text string, deleted string")
    got = {r.doc_id: r for r in line_dedup.drop_repeated_lines(df).collect()}
    assert got[1].text == "\n".join(a) and got[3].text == "\n".join(c) and got[5].text == "\n".join(rows[5])
    assert got[2].text == "\n".join([b[0], *b[7:]])
    assert got[4].text == rows[4][0] and got[6].text == ""
    assert got[7].text == "\n".join([*rows[7][:3], rows[7][8]])
    assert got[8].text is None and got[9].text == "" and got[None].text == "a\nb"
    assert line_dedup.drop_repeated_lines(none).count() == 0


def test_repeated_lines_equal_brute_force(spark):
    rng = random.Random(9)
    kinds = [*"abcdefgh", words(rng, 20), words(rng, 30), words(rng, 55)]  # common lines occur first in other contexts
    docs = {i: [kinds[rng.randrange(len(kinds))] for _ in range(rng.randrange(1, 14))] for i in range(60)}
    docs |= {100: ["a", *"qrs", "b"], 101: [*"xyza", *"uvwb"], 102: ["y", "a", *"uvw", "b", "c"], 103: ["k", "y", "a", *"uvw", "b", "l"]}
    length = {x: len(x.split()) for lines in docs.values() for x in lines}
    gone = {i: set() for i in docs}
    places = [(i, at) for i in sorted(docs) for at in range(len(docs[i]))]
    for k, (i, at) in enumerate(places):
        for j, at0 in places[:k]:
            n = 0
            while at + n < len(docs[i]) and at0 + n < len(docs[j]) and docs[i][at + n] == docs[j][at0 + n]:
                n += 1
            if n >= 4 or sum(length[x] for x in docs[i][at : at + n]) >= 50:
                gone[i] |= set(range(at, at + n))
    df = spark.createDataFrame([(i, "\n".join(x)) for i, x in docs.items()], "doc_id long, text string")
    got = {r.doc_id: set(r.deleted) for r in line_dedup.drop_repeated_lines(df).collect()}
    assert got == gone and {1, 2, 3, 4, 5, 6} & gone[103]


def test_licences(spark, none):
    rows = [(1, "x\nReleased under the MIT license\ny"), (2, "nothing here"), (3, None), (4, ""), (5, licenses.TEMPLATES[4][1]), (None, "Licensed under CC BY 4.0.")]
    got = {(r.doc_id, r.license) for r in licenses.license_matches(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, "MIT"), (5, "Apache-2.0")}
    assert licenses.license_matches(none).count() == 0


def test_notices_among_other_lines(spark):
    def wrapped(text, mark="# ", width=70):
        return "\n".join(mark + x for x in textwrap.wrap(text, width))

    whole = {}
    for name, text in licenses.WHOLE_TEMPLATES:
        whole.setdefault(name, text)
    code = "import os\nprint(os.getcwd())"
    rows = [(i, f"{code}\n{wrapped(text)}\ndef main(): pass\n{code}") for i, text in enumerate(whole.values())]
    bsd = [(50, wrapped(whole["BSD-2-Clause"], "")), (51, wrapped(whole["BSD-3-Clause"], "")), (52, licenses.BSD_HEADING)]
    twice = [(60, f"{wrapped(whole['MIT'])}\n{wrapped(whole['ISC'])}\n{code}\n{wrapped(whole['MIT'])}"), (61, f"{code}\nReleased under\nthe MIT License.\n{code}"), (62, code)]
    got = licenses.license_matches(spark.createDataFrame(rows + bsd + twice, "doc_id long, text string")).collect()
    runs = {i: sorted((r.place, r.license) for r in got if r.doc_id == i and r.unit == "run") for i in {r.doc_id for r in got}}
    assert [runs[i] for i in range(len(whole))] == [[(2, name)] for name in whole]
    assert {r.license for r in got if r.doc_id == 50 and r.unit != "line"} == {"BSD-2-Clause"}
    assert {r.license for r in got if r.doc_id == 51 and r.unit != "line"} == {"BSD-3-Clause"}
    assert {r.license for r in got if r.doc_id == 52} == {"BSD-2-Clause OR BSD-3-Clause"}
    assert [name for _, name in runs[60]] == ["MIT", "ISC", "MIT"] and runs[61] == [(2, "MIT")] and 62 not in runs


def test_mixing_reaches_its_targets(spark):
    rng = random.Random(4)
    kinds = {"a": "red green blue", "b": "cat dog bird", "c": "sun moon star"}
    rows, labels = [], []
    for i in range(300):
        kind = "aabbcb"[i % 6] if i % 3 else "a"
        rows.append((i, " ".join(rng.choice(kinds[kind].split()) for _ in range(rng.randrange(5, 40))), "en", "s", 1))
        if i % 4:
            labels.append((i, kind))
    rows += [(900, None, "en", "s", 1), (901, "", "en", "s", 1), (None, "red", "en", "s", 1), (5, "red", "en", "s", 1)]
    df = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 as copies", "1 as mixed_id", "1 as mixed_copies")
    goal = {"a": 0.4, "b": 0.3, "c": 0.3}
    rates = mixing.mixing_rates(df, spark.createDataFrame(labels, "doc_id long, domain string"), goal)
    got = rates.collect()
    assert len(got) == 302 and all(r.rate >= 0 for r in got)
    whole = sum(r.tokens for r in got)
    for d, share in goal.items():
        assert abs(sum(r.rate * r.tokens * r[f"p_{d}"] for r in got) - share * whole) <= 0.002 * whole
    mixed = mixing.mix(df, rates)
    assert mixed.columns == df.columns
    n = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert all(int(r.rate) <= n.get(r.doc_id, 0) <= int(r.rate) + 1 for r in got if r.doc_id != 5)
    assert mixing.mixing_rates(df.where("false"), spark.createDataFrame(labels, "doc_id long, domain string"), goal).count() == 0


@pytest.mark.parametrize("max_rate, goal", [(4.0, (0.3, 0.3, 0.4)), (1.0, (0.5, 0.1, 0.1)), (1.5, (0.1, 0.1, 2.0)), (4.0, (0.0, 0.0, 1.0)), (0.5, (1.0, 1.0, 1.0))])
def test_rates_equal_a_bounded_least_squares_fit(spark, max_rate, goal):
    rng = np.random.default_rng(3)
    p = rng.dirichlet((0.4, 0.3, 0.2), 300)
    p[:20] = p[0]  # ties
    tokens = rng.integers(0, 200, 300)
    table = spark.createDataFrame([(int(t), *map(float, x)) for t, x in zip(tokens, p, strict=True)], "tokens long, p0 double, p1 double, p2 double")
    m = mixing.fitted(table, list(goal), max_rate)
    start = min(1.0, max_rate)
    rate = np.clip(start - p @ m, 0, max_rate)
    w = tokens / tokens.sum()

    def value(r):
        return ((p.T @ (w * r) - goal) ** 2).sum() / 2 + mixing.RIDGE / 2 * (w * (r - start) ** 2).sum()

    # The same objective by many plain projected-gradient steps in numpy.
    r, last, momentum = np.full(300, start), np.full(300, start), 1.0
    length = 1 / (np.linalg.eigvalsh((p * w[:, None]).T @ p)[-1] + mixing.RIDGE)
    for _ in range(20_000):
        following = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        ahead = r + (momentum - 1) / following * (r - last)
        gradient = p @ (p.T @ (w * ahead) - goal) + mixing.RIDGE * (ahead - start)
        last, r, momentum = r, np.clip(ahead - length * gradient, 0, max_rate), following
    assert value(rate) <= value(r) + 1e-8
    assert np.abs(p.T @ (w * rate) - p.T @ (w * r)).max() < 2e-3


def test_mixing_of_odd_tables(spark):
    rows = [(1, "a b c"), (2, None), (3, ""), (4, "x " * 200_000), (4, "y"), (5, "a b c"), (None, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as tokens", "1 as rate", "1 as held")
    one = spark.createDataFrame([(1, "only"), (99, "only"), (None, "x"), (2, None)], "doc_id long, domain string")
    got = {r.doc_id: r for r in mixing.mixing_rates(df, one, {"only": 1.0}, total_factor=2.0).collect()}
    assert set(got) == {1, 2, 3, 4, 5} and got[4].tokens == 200_001 and got[2].tokens == 0
    assert all(abs(r.rate - 2) < 1e-3 and r.p_only == 1 for r in got.values())
    with pytest.raises(ValueError):
        mixing.mixing_rates(df, one.where("false"), {"only": 1.0})


def test_quality_of_odd_texts(docs, none, spark):
    trusted = spark.createDataFrame([(i,) for i in range(20)] + [(None,), (777,)], "doc_id long")
    got = {r.doc_id: r for r in kneser_ney.classify(docs, trusted).collect()}
    assert set(got) == {r.doc_id for r in docs.collect() if r.doc_id is not None}
    empty = [r.doc_id for r in docs.collect() if not r.text and r.doc_id is not None]
    assert empty and not any(got[i].kept for i in empty)
    assert kneser_ney.classify(none, trusted).count() == 0


def test_pipeline_runs_on_odd_tables(spark, docs, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "never seen before words in this item")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = pipeline.run(spark, str(tmp_path)).collect()
    assert out and {"doc_id", "start", "n_tokens", "ids_crc32"} <= set(out[0].asDict())


def test_sha_of_turns_is_that_of_the_contract(spark):
    df = spark.createDataFrame([(1, 0, "user", "é")], "conv_id long, turn int, role string, text string")
    r = chat.parse_chats(chat.format_chats(df)).first()
    assert hashlib.sha256("".join(f"{t.role}\n{t.text}\n" for t in r.turns).encode()).hexdigest() == hashlib.sha256("user\né\n".encode()).hexdigest()


def test_texts_of_very_many_lines_take_seconds(spark):
    """100,000 lines, all repeated, and a notice among lines that share bigrams with its template; limits leave room for a slow machine."""
    import time

    text = "\n".join(f"line {i} of a long text" for i in range(100_000))
    df = spark.createDataFrame([(1, text), (2, text + "\nnew end of it")], "doc_id long, text string").repartition(2)
    line_dedup.drop_repeated_lines(df.limit(0)).count()
    began = time.time()
    got = {r.doc_id: (r.lines_out, r.text) for r in line_dedup.drop_repeated_lines(df).select("doc_id", "lines_out", "text").collect()}
    assert got == {1: (100_000, text), 2: (1, "new end of it")} and time.time() - began < 90
    lines = [f"subject to the following w{i} conditions w{i + 1} of the work" for i in range(30_000)]
    lines[777:777] = licenses.WHOLE_TEMPLATES[0][1].replace(". ", ".\n").split("\n")
    began = time.time()
    found = licenses.license_matches(spark.createDataFrame([(1, "\n".join(lines))], "doc_id long, text string")).where("unit = 'run'").collect()
    assert [(r.license, r.place) for r in found] == [("MIT", 777)] and time.time() - began < 120


def test_an_item_of_two_lengths_is_one_item(spark):
    items = spark.createDataFrame([(1, "alpha beta gamma"), (1, "one two three four five six seven"), (2, "alpha beta gamma")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x alpha beta gamma one two three four five six seven y"), (2, "alpha beta gamma"), (3, "one two three four five six")], "doc_id long, text string")
    got = {(r.doc_id, r.item_id): (r.shared, r.item_shingles) for r in decontaminate.contaminated(docs, items, threshold=0.7).collect()}
    assert got == {(1, 1): (4, 4), (1, 2): (1, 1), (2, 2): (1, 1)}


def test_scratch_tables_go(spark):
    from pathlib import Path

    from wardspark.llm import common

    folder = Path(common.shared_dir(spark).removeprefix("file:"))
    before = common.stored(spark.range(3), "stays")
    with common.scratch(spark):
        assert common.stored(spark.range(3), "goes").count() == 3 and list(folder.glob("goes-*"))
    assert not list(folder.glob("goes-*")) and before.count() == 3
