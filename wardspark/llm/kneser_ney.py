"""Quality classifier: interpolated modified Kneser-Ney perplexity (operator 6).

The model predicts a character from the ORDER - 1 characters before it. Counts come from all
trusted text; discounts, contexts and probabilities are grouped sums and joins over hash-sharded
count tables. Documents are scored against the finished table in shards of bounded size: each
shard is broadcast in turn, adds its part of every document's log-probability, and is released,
so neither the text nor the table has to fit or move as a whole.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sized, stored
from .shingles import mix

ORDER = 5
#: A held-out tenth of the trusted documents sets the thresholds; its text is not counted.
HELD_OUT = 10
QUANTILE, SLACK = 0.95, 1.2
#: Bytes of the model broadcast at once (16 bytes an n-gram), characters counted at once, n-grams held by a task.
SHARD_BYTES, SLICE_CHARS, HELD_GRAMS = 32 << 20, 1 << 20, 2 << 20

CONTEXT_ONLY = np.float32(-1e30)

_keys = mix(np.arange(1, 17, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def code_points(text: str) -> np.ndarray:
    """Code points of a text; the null character becomes U+FFFD, as numpy's strings end at it."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return np.where(c == 0, np.uint32(0xFFFD), c)


def gram_hashes(codes: np.ndarray, order: int) -> np.ndarray:
    """Hash of the ``order`` code points that end at each position from order - 1 on."""
    n = len(codes) - order + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    c = codes.astype(np.uint64)
    h = np.full(n, order, np.uint64)
    for i in range(order):
        h += c[order - 1 - i : order - 1 - i + n] * _keys[i]
    return mix(h)


def _count(order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def merged():
            h, g, c = (np.concatenate(x) for x in zip(*held, strict=True))
            keys, first, inverse = np.unique(h, return_index=True, return_inverse=True)
            return keys, g[first], np.bincount(inverse, c).astype(np.int64)

        def emitted(grams, counts):
            for at in range(0, len(grams), 1 << 17):
                yield pa.RecordBatch.from_arrays([pa.array(grams[at : at + (1 << 17)].tolist(), pa.string()), pa.array(counts[at : at + (1 << 17)])], names=["gram", "n"])

        for texts in _text_slices(batches):
            grams, hashes = [], []
            for text in texts:
                c = code_points(text)
                if len(c) >= order:
                    grams.append(np.lib.stride_tricks.sliding_window_view(c, order))
                    hashes.append(gram_hashes(c, order))
            if not hashes:
                continue
            h = np.concatenate(hashes)
            keys, first, counts = np.unique(h, return_index=True, return_counts=True)
            offsets = np.cumsum([0, *map(len, hashes)])
            owner = np.searchsorted(offsets, first, side="right") - 1
            rows = np.empty((len(keys), order), np.uint32)
            for o in np.unique(owner):
                mine = owner == o
                rows[mine] = grams[o][first[mine] - offsets[o]]
            held.append((keys, rows.view(f"<U{order}").reshape(-1), counts))
            if len(held) >= 16:
                held = [merged()]
                if len(held[0][0]) > HELD_GRAMS:
                    yield from emitted(*held[0][1:])
                    held = []
        if held:
            yield from emitted(*merged()[1:])

    return run


def _text_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[list[str]]:
    """Lists of texts of about SLICE_CHARS characters, across batches; nulls are left out."""
    texts, chars = [], 0
    for batch in batches:
        for text in batch.column(0):
            text = text.as_py()
            if text:
                texts.append(text)
                chars += len(text)
                if chars >= SLICE_CHARS:
                    yield texts
                    texts, chars = [], 0
    if texts:
        yield texts


def discounts(counts: DataFrame) -> tuple[float, float, float]:
    """D1, D2, D3+ of a count table by the closed form; 0.5, 1.0, 1.5 where a needed count of counts is zero."""
    row = counts.agg(*[F.count(F.when(F.col("n") == i, 1)).alias(f"n{i}") for i in range(1, 5)]).first()
    n1, n2, n3, n4 = (row[f"n{i}"] for i in range(1, 5))
    if not (n1 and n2 and n3 and n4):
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    found = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(min(max(d, 0.01), i - 0.01 * (i == 1)) for i, d in enumerate(found, 1))


def train(texts: DataFrame, order: int = ORDER) -> DataFrame:
    """The model as rows (gram, logp, backoff), natural logarithms, for texts with one column ``text``.

    backoff is the interpolation weight of the gram as a context, null if it never was one.
    The row of the empty gram has the log-probability of an unseen character.
    """
    counts = stored(
        texts.select("text").mapInArrow(_count(order), "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n")), f"kn-counts-{order}"
    )
    tables = {order: counts}
    for k in range(order - 1, 0, -1):  # continuation counts: different characters before a gram
        lower = tables[k + 1].groupBy(F.substring("gram", 2, k).alias("gram")).agg(F.count(F.lit(1)).alias("n"))
        tables[k] = stored(lower, f"kn-counts-{k}")
    probs, rows = None, []
    for k in range(1, order + 1):
        d1, d2, d3 = discounts(tables[k])
        grams = tables[k].withColumn("context", F.substring("gram", 1, k - 1))
        cut = F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3)
        contexts = grams.groupBy("context").agg(F.sum("n").alias("total"), F.sum(cut).alias("mass"), F.count(F.lit(1)).alias("kinds"))
        contexts = contexts.withColumn("weight", F.col("mass") / F.col("total"))
        if k == 1:
            # One more kind stands for all unseen characters.
            contexts = contexts.withColumn("unseen", F.col("weight") / (F.col("kinds") + 1))
            probs = grams.join(F.broadcast(contexts), "context").select(  # one row: the empty context
                "gram", ((F.col("n") - cut) / F.col("total") + F.col("unseen")).alias("p")
            )
            rows.append(contexts.select(F.lit("").alias("gram"), F.log("unseen").alias("logp"), F.log("weight").alias("backoff")))
        else:
            joined = grams.join(contexts.select("context", "total", "weight"), "context").withColumn("rest", F.substring("gram", 2, k - 1))
            lower = probs.select(F.col("gram").alias("rest"), F.col("p").alias("below"))
            here = joined.join(lower, "rest").select("gram", ((F.col("n") - cut) / F.col("total") + F.col("weight") * F.col("below")).alias("p"))
            weights = contexts.select(F.col("context").alias("gram"), F.log("weight").alias("backoff"))
            rows.append(probs.join(weights, "gram", "full").select("gram", F.log("p").alias("logp"), "backoff"))
            probs = stored(here, f"kn-probs-{k}")
    rows.append(probs.select("gram", F.log("p").alias("logp"), F.lit(None).cast("double").alias("backoff")))
    return stored(reduce(DataFrame.unionByName, rows), "kn-model")


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        grams = batch.column(0).to_pylist()
        codes = [code_points(g) for g in grams]
        out = np.zeros(len(grams), np.int64)
        lengths = np.array([len(c) for c in codes])
        for k in np.unique(lengths[lengths > 0]):
            at = np.flatnonzero(lengths == k)
            m = np.stack([codes[i] for i in at]).astype(np.uint64)
            h = np.full(len(at), k, np.uint64)
            for i in range(k):
                h += m[:, k - 1 - i] * _keys[i]
            out[at] = mix(h).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(out), batch.column(1), batch.column(2)], names=["key", "logp", "backoff"])


class _Table:
    """Sorted 64-bit keys with an index over their top bits."""

    def __init__(self, keys: np.ndarray, logp: np.ndarray, backoff: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.logp, self.backoff = keys[order], logp[order], backoff[order]
        bits = max(8, int(len(keys)).bit_length() + 1)
        self.shift = np.uint64(64 - bits)
        counts = np.bincount((self.keys >> self.shift).astype(np.int64), minlength=1 << bits)
        self.start = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
        self.deepest = int(counts.max()) if len(keys) else 0
        self.keys = np.append(self.keys, np.uint64(0))

    def find(self, h: np.ndarray) -> np.ndarray:
        """Row of each key, -1 if it isn't there."""
        bucket = (h >> self.shift).astype(np.int64)
        at = self.start[bucket]
        found = np.where(self.keys[at] == h, at, -1)
        open_ = np.flatnonzero((found < 0) & (self.start[bucket + 1] - at > 1))
        for step in range(1, self.deepest):
            if not len(open_):
                break
            place = at[open_] + step
            inside = place < self.start[bucket[open_] + 1]
            open_, place = open_[inside], place[inside]
            hit = self.keys[place] == h[open_]
            found[open_[hit]] = place[hit]
            open_ = open_[~hit]
        found[found == len(self.keys) - 1] = -1
        return found


def _shard_of(codes: np.ndarray, shards: int) -> np.ndarray:
    """Shard of a predicted character: by the two characters before it, so its whole back-off chain is in one shard."""
    return (gram_hashes(codes, 2) % np.uint64(shards)).astype(np.int64)


def log_probabilities(codes: np.ndarray, table: "_Table", order: int, unseen: float, only: np.ndarray | None = None) -> np.ndarray:
    """Of each character from order - 1 on, backing off to shorter contexts where a gram is unknown; of those outside ``only`` 0."""
    n = len(codes) - order + 1
    out = np.zeros(n)
    left = np.arange(n) if only is None else only
    for k in range(order, 0, -1):
        full = gram_hashes(codes, k)[order - k :] if k == order and only is None else _some(codes, left + order - k, k)
        row = table.find(full)
        known = (row >= 0) & (table.logp[row] > CONTEXT_ONLY)
        out[left[known]] += table.logp[row[known]]
        left = left[~known]
        if not len(left):
            return out
        if k > 1:
            context = table.find(_some(codes, left + order - k, k - 1))
            out[left] += np.where(context >= 0, np.nan_to_num(table.backoff[context]), 0.0)
    out[left] += unseen
    return out


def _some(codes: np.ndarray, starts: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k code points from each start."""
    h = np.full(len(starts), k, np.uint64)
    for i in range(k):
        h += codes[starts + (k - 1 - i)].astype(np.uint64) * _keys[i]
    return mix(h)


_tables: dict[str, _Table] = {}


def _score(model, tag: str, order: int, shard: int, shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, logp, backoff, unseen = model.value
        if tag not in _tables:  # a worker keeps the table of its last shard
            _tables.clear()
            _tables[tag] = _Table(keys.view(np.uint64), logp, backoff)
        table = _tables[tag]
        for batch in batches:
            sums, counts = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            held, chars = [], 0

            def settle():
                # Several texts at once; predictions that would reach over a border are left out.
                codes = np.concatenate([c for _, c in held])
                # Each character is looked up in its own shard alone; in the others it costs one hash.
                only = np.flatnonzero(_shard_of(codes, shards)[order - 3 : len(codes) - 2] == shard) if shards > 1 else None
                logp = log_probabilities(codes, table, order, unseen, only)
                at = 0
                for row, c in held:
                    counts[row] += len(c) - order + 1
                    sums[row] += logp[at : at + len(c) - order + 1].sum()
                    at += len(c)

            for row, text in enumerate(batch.column(1)):
                text = text.as_py() or ""
                for at in range(0, max(1, len(text) - order + 1), SLICE_CHARS):  # very long texts in overlapping pieces
                    c = code_points(text[at : at + SLICE_CHARS + order - 1])
                    if len(c) >= order:
                        held.append((row, c))
                        chars += len(c)
                    if chars >= SLICE_CHARS // 4:
                        settle()
                        held, chars = [], 0
            if held:
                settle()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts), pa.array(sums)], names=["row", "predicted", "logp"])

    return run


def score(docs: DataFrame, model: DataFrame, order: int = ORDER, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(doc_id, predicted, logp): characters predicted and their summed log-probability, a row per doc_id.

    docs has doc_id and text; rows that repeat an id, null included, are added up. Null texts and those shorter than the
    order predict nothing. With an empty model every sum is 0.
    """
    spark = docs.sparkSession
    unseen = model.where("gram = ''").first()
    if unseen is None:
        return docs.select("doc_id").distinct().select("doc_id", F.lit(0).cast("long").alias("predicted"), F.lit(0.0).alias("logp"))
    rows = model.where("gram <> ''")
    shards = max(1, -(-rows.count() * 16 // shard_bytes))
    keyed = rows.withColumn("size", F.length("gram"))
    parts = []
    for shard in range(shards):
        mine = rows.select("gram", "logp", "backoff")
        if shards > 1:
            mine = keyed.mapInArrow(_in_shard(shard, shards), "gram string, logp double, backoff double")
        hashed = mine.mapInArrow(_hashed, "key long, logp double, backoff double")
        hashed = hashed.select("key", F.col("logp").cast("float"), F.col("backoff").cast("float")).toArrow()
        values = tuple(hashed.column(c).to_numpy() for c in range(3))
        # A gram that is only a context has no probability of its own.
        values = (values[0], np.nan_to_num(values[1], nan=CONTEXT_ONLY), values[2])
        sent = spark.sparkContext.broadcast((*values, float(unseen["logp"])))
        part = docs.select("doc_id", "text").mapInArrow(_score(sent, uuid.uuid4().hex, order, shard, shards), "doc_id long, predicted long, logp double")
        if shards == 1:
            return part.groupBy("doc_id").agg(F.sum("predicted").alias("predicted"), F.sum("logp").alias("logp"))
        parts.append(stored(part, "kn-part"))
        sent.unpersist()
    every = reduce(DataFrame.unionByName, parts).groupBy("doc_id")
    return every.agg((F.sum("predicted") / shards).cast("long").alias("predicted"), F.sum("logp").alias("logp"))


def _in_shard(shard: int, shards: int):
    """Grams whose shard it is; grams of fewer than three characters and contexts of fewer than two go to all."""

    def run(batches):
        for batch in batches:
            keep = []
            for gram in batch.column(0).to_pylist():
                c = code_points(gram)
                as_gram = len(c) < 3 or _shard_of(c[-3:-1], shards)[0] == shard
                as_context = len(c) < 2 or _shard_of(c[-2:], shards)[0] == shard
                keep.append(as_gram or as_context)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2)], names=["gram", "logp", "backoff"]).filter(pa.array(keep))

    return run


def classify(
    docs: DataFrame,
    trusted: DataFrame,
    order: int = ORDER,
    quantile: float = QUANTILE,
    slack: float = SLACK,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """One row per document: doc_id, lang, predicted, perplexity, threshold, kept.

    ``trusted`` has the ids of trusted documents. A document is kept if its perplexity is at most
    its language's threshold: the ``quantile`` of the perplexities of held-out trusted documents
    of that language, times ``slack``. A language without held-out documents takes the threshold
    of all held-out documents; without any, every document that can be scored is kept. Without
    trusted text none can be scored, and all that are not empty are kept.

    Null and empty texts are not kept. Other texts shorter than the order can't be scored: their
    perplexity is null and they are kept, as nothing speaks against them. A null
    language is the language 'und'. Null ids are dropped; rows that repeat an id come out as one
    row, kept only if each of them is. An empty table gives no rows. Other columns are not read.
    """
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(F.col(lang_col), F.lit("und")).alias("lang")
    ).where("doc_id is not null")
    ids = stored(trusted.select(F.col(id_col).cast("long").alias("trusted_id")).where("trusted_id is not null").distinct(), "trusted")
    ids = ids.withColumn("held_out", F.pmod(F.xxhash64("trusted_id"), F.lit(HELD_OUT)) == 0)
    taught = ids.where("not held_out")
    texts = rows.join(sized(taught, 16), rows["doc_id"] == taught["trusted_id"], "left_semi")
    model = train(texts, order)
    langs = rows.groupBy("doc_id").agg(F.min("lang").alias("lang"), F.min(F.coalesce(F.length("text"), F.lit(0))).alias("chars"))
    scored = score(rows.select("doc_id", "text"), model, order, shard_bytes)
    scored = scored.join(langs, "doc_id").withColumn("perplexity", F.when(F.col("predicted") > 0, F.exp(-F.col("logp") / F.col("predicted"))))
    scored = stored(scored.select("doc_id", "lang", "chars", "predicted", "perplexity"), "kn-scores")
    held = scored.join(ids.where("held_out"), scored["doc_id"] == ids["trusted_id"], "left_semi").where("perplexity is not null")
    cut = F.percentile_approx("perplexity", quantile, 10000) * slack
    by_lang = held.groupBy("lang").agg(cut.alias("own"))
    overall = held.agg(cut.alias("any"))
    return (
        scored.crossJoin(F.broadcast(overall)).join(by_lang, "lang", "left")  # one row; one row a language
        .withColumn("threshold", F.coalesce("own", "any"))
        .select("doc_id", "lang", "predicted", "perplexity", "threshold",
                ((F.col("chars") > 0) & F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True))).alias("kept"))
    )
