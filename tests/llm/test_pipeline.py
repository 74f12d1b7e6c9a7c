"""The stages of the corpus pipeline against what was planted, each on its own input."""

import random
import zlib

import numpy as np
import pytest

from wardspark.llm.queries import tokenizer_path

pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_do_what_was_planted(spark, tmp_path):
    from tokenizers import Tokenizer

    rng = random.Random(12)
    syllables = "ba de fi go lu ma ne pi ro su ta ve".split()
    vocabulary = ["".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    clean = {i: prose(rng.randrange(60, 160)) for i in range(150)}
    toxic = {i: prose(40) + " vilest vilest scum " + prose(40) for i in range(200, 230)}
    junk = {i: "".join(rng.choice("#@%$!zxqjk0123456789") for _ in range(400)) for i in range(300, 310)}
    copies = {400: clean[1], 401: clean[1].upper(), 402: clean[2] + " ba"}
    items = {1: prose(50), 2: prose(20)}
    leaked = {500: f"{prose(80)} {items[1]} {prose(30)}", 501: f"{items[2]} {prose(200)}"}
    texts = clean | toxic | junk | copies | leaked | {600: None, 601: ""}
    rows = [(i, t, "en", "s", 1, "kept") for i, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, rate string").write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, 1, 0) for i in clean] + [(i, 1, 1) for i in list(toxic)[:20]]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(list(items.items()), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    sf, docs, kept = str(tmp_path), spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = {r.doc_id for r in docs.select("doc_id").collect()}
    assert kept["quality"] & {*junk, 600, 601} == set() and len(set(clean) - kept["quality"]) <= 3 and set(leaked) <= kept["quality"]
    assert kept["near_duplicates"] == kept["quality"] - {400, 401, 402}
    assert kept["decontamination"] == kept["near_duplicates"] - {500, 501}
    assert set(clean) & kept["decontamination"] <= kept["mixture"] and len(set(toxic) & kept["mixture"]) < len(toxic) / 2
    digest = sorted(pipeline.STAGES[-1][1](spark, docs, sf).collect(), key=lambda r: r.start)
    tokenizer, start = Tokenizer.from_file(tokenizer_path()), 0
    assert [r.doc_id for r in digest] == sorted(r.doc_id for r in docs.collect())
    for r in digest:
        ids = [*tokenizer.encode(texts[r.doc_id], add_special_tokens=False).ids, 2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
