"""Token ids of whole documents in a range-coded binary format (operator 3).

The file format is a Parquet folder. A row is a segment: whole documents in ascending id
order, their ids and lengths, one frequency table counted over all of the segment's tokens,
checkpoints and the coded words of its blocks (see rans.py).
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import rans
from .common import partitions_for, shared_dir, small_batches
from .shingles import LONG_SPAN, eights, head, span_hashes

SEGMENT_TOKENS = 1 << 20
SEGMENT_SCHEMA = (
    "part int, segment int, n_tokens long, doc_ids array<long>, doc_tokens array<long>, table binary, checkpoints binary, payload binary"
)
#: Characters of text encoded at once; words that a worker remembers; words joined into one call of the tokenizer.
SLICE_CHARS, CACHE_WORDS, JOINED = 1 << 19, 1 << 19, 256


def _cut_codes(fine: bool) -> np.ndarray:
    """Where to cut at two bytes, by the number first + 256 * second; 0: not there.

    1: before the first, a space. 2: between them. 3: between them if the first ends an accented
    letter, so comes after 0xC3. 4: between a line feed and a letter if a visible ASCII character stands
    before. An apostrophe may open a contraction and is never cut from what follows it.
    """
    byte = np.arange(256)
    # Bytes that a space can be cut off before: not white space, nor the lead byte of any in UTF-8.
    solid = (byte > 32) & ~np.isin(byte, [0xC2, 0xE1, 0xE2, 0xE3])
    letter = ((byte | 32) >= 97) & ((byte | 32) <= 122) & (byte < 128)
    codes = np.zeros((256, 256), np.uint8)  # by second, first
    codes[solid, 32] = 1
    if fine:
        other = (byte < 128) & ~letter & (byte != 32)
        tail = (byte >= 0x80) & (byte < 0xC0) & ~np.isin(byte, [0x97, 0xB7])  # after 0xC3 those two are signs
        codes[np.ix_(other, letter)] = 2
        codes[np.ix_(letter, other & (byte > 32) & (byte < 127) & (byte != 39))] = 2
        codes[np.ix_(other, tail)] = 3
        codes[letter, 10] = 4
    return codes.reshape(-1)


_cuts = {fine: _cut_codes(fine) for fine in (False, True)}


def _cut_places(raw: np.ndarray, fine: bool) -> np.ndarray:
    """Whether to cut before each byte; one place more, for the end."""
    cut = np.zeros(len(raw) + 1, bool)
    if len(raw) < 2:
        return cut
    code = _cuts[fine][np.ndarray((len(raw) - 1,), "<u2", raw, strides=(1,))]
    cut[:-2] = code == 1
    if fine:
        cut[1:-1] |= code == 2
        maybe = np.flatnonzero(code >= 3)
        maybe = maybe[maybe > 0]
        before = raw[maybe - 1]
        sure = np.where(code[maybe] == 3, before == 0xC3, (before > 32) & (before < 127))
        cut[maybe[sure] + 1] = True
    return cut


class _HashTable:
    """64-bit keys to row numbers: open addressing in arrays, looked up and filled as vectors."""

    def __init__(self, rows: int):
        self.mask = np.uint64((1 << (2 * rows - 1).bit_length()) - 1)
        self.keys = np.zeros(int(self.mask) + 1, np.uint64)
        self.rows = np.zeros(int(self.mask) + 1, np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        slot = keys & self.mask
        at = self.keys[slot]
        found = np.where(at == keys, self.rows[slot], -1)
        open_ = np.flatnonzero((at != keys) & (at != 0))
        while len(open_):
            slot[open_] = (slot[open_] + np.uint64(1)) & self.mask
            at = self.keys[slot[open_]]
            hit = at == keys[open_]
            found[open_[hit]] = self.rows[slot[open_[hit]]]
            open_ = open_[~hit & (at != 0)]
        return found

    def add(self, keys: np.ndarray, rows: np.ndarray) -> None:
        """Keys must be different and not there yet."""
        slot = keys & self.mask
        left = np.arange(len(keys))
        while len(left):
            free = left[self.keys[slot[left]] == 0]
            _, first = np.unique(slot[free], return_index=True)
            mine = free[first]
            self.keys[slot[mine]], self.rows[slot[mine]] = keys[mine], rows[mine]
            left = np.setdiff1d(left, mine, assume_unique=True)
            slot[left] = (slot[left] + np.uint64(1)) & self.mask


class _Rising:
    """An array that grows at its end in place."""

    def __init__(self, dtype, spare: int = 0):
        self.n, self.spare = 0, spare
        self.room = np.zeros(1 << 10, dtype)

    @property
    def values(self) -> np.ndarray:
        return self.room[: self.n]

    def add(self, values) -> None:
        n = self.n + len(values)
        if n + self.spare > len(self.room):
            room = np.zeros(max(n + self.spare, len(self.room) * 3 // 2), self.room.dtype)
            room[: self.n] = self.values
            self.room = room
        self.room[self.n : n] = values
        self.n = n

    def cut(self, n: int) -> None:
        """Keeps the first n values, and not much more room than they need."""
        self.n = n
        if len(self.room) > 4 * n + (1 << 16):
            self.room = self.room[: 2 * n + (1 << 15)].copy()


class WordEncoder:
    """Encodes texts with a byte-level BPE tokenizer, looking repeated words up.

    A text is cut before each space that a non-space character follows. The tokenizer's own
    pre-tokenizer always starts a piece there (the space belongs to the piece that it opens, and
    white space before it ends one), so the ids of the cuts joined are the ids of the whole text.
    If its pre-tokenizer is the byte-level one with its own pattern, a text is also cut where a run of
    letters ends and, but for white space and apostrophes, where one begins: it ends a piece there too.
    Texts that hold one of the tokenizer's added tokens, which it takes out beforehand, aren't cut.
    Each different cut of up to LONG_SPAN bytes is encoded by the library once while it is
    remembered. It is found by a hash of its bytes, and then the bytes are compared. When CACHE_WORDS
    are remembered, those that no later call met again are forgotten.
    """

    def __init__(self, path: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.end_id = end_id
        pieces = self.tokenizer.pre_tokenizer
        self.fine = isinstance(pieces, ByteLevel) and pieces.use_regex and self.tokenizer.normalizer is None
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.joined = 1 if any(" " in t for t in added) else JOINED
        vocabulary = self.tokenizer.get_vocab()
        self.opens = np.zeros(max(vocabulary.values()) + 1, bool)  # tokens that begin with a space
        self.opens[[i for t, i in vocabulary.items() if t.startswith("\u0120")]] = True
        self.clear()

    def clear(self, room: int = 0) -> None:
        self.table = None  # the old one goes before the new one comes
        self.table = _HashTable(max(CACHE_WORDS, room))
        self.flat = _Rising(np.uint32)  # ids of all rows; row 0 stands for the end of a document
        self.starts, self.lengths = _Rising(np.int32), _Rising(np.int32)  # of the rows, in flat
        self.bytes = _Rising(np.uint8, spare=8)  # of the remembered words, by row from byte_at on
        self.byte_at, self.byte_n = _Rising(np.int32), _Rising(np.int32)
        self.keys, self.met = _Rising(np.uint64), _Rising(bool)  # met: again in a later call
        for column, value in (
            (self.flat, self.end_id), (self.starts, 0), (self.lengths, 1), (self.byte_at, 0), (self.byte_n, 0), (self.keys, 0), (self.met, False)
        ):
            column.add([value])

    def _forget(self, new: int) -> None:
        """Makes room for new words: those met again stay, the earliest learnt half of CACHE_WORDS at most."""
        old = {name: column for name, column in vars(self).items() if isinstance(column, _Rising)}
        stay = np.flatnonzero(self.met.values)[: CACHE_WORDS // 2]
        if len(stay) + new >= CACHE_WORDS:
            stay = stay[:0]
        self.clear(new + 1)
        for data, starts, lengths in (("flat", "starts", "lengths"), ("bytes", "byte_at", "byte_n")):
            n = old[lengths].values[stay]
            ends = np.cumsum(n, dtype=np.int64)
            at = np.repeat(old[starts].values[stay] - (ends - n), n) + np.arange(n.sum())
            getattr(self, starts).add(getattr(self, data).n + ends - n)
            getattr(self, lengths).add(n)
            getattr(self, data).add(old[data].values[at])
        self.keys.add(old["keys"].values[stay])
        self.met.add(np.zeros(len(stay), bool))
        self.table.add(self.keys.values[1:], np.arange(1, self.keys.n, dtype=np.int32))

    def _learn(self, words: list[bytes]) -> None:
        texts = [w.decode("utf-8", "surrogatepass") for w in words]
        # Words with no space but their first can share a call: each starts at a token that opens with a space.
        plain = np.array([w[:1] == b" " and w.count(b" ") == 1 for w in words], bool)
        lengths = np.zeros(len(words), np.int64)
        parts = []
        for joined in (True, False):
            at = np.flatnonzero(plain == joined)
            size = self.joined if joined else 1
            calls = ["".join([texts[i] for i in at[k : k + size]]) for k in range(0, len(at), size)]
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(calls, add_special_tokens=False)] if calls else []
            flat = np.array([x for i in ids for x in i], np.uint32)
            if joined:
                lengths[at] = np.diff(np.append(np.flatnonzero(self.opens[flat]), len(flat)))
            else:
                lengths[at] = [len(i) for i in ids]
            parts.append((at, flat))
        starts = np.zeros(len(words), np.int64)
        base = self.flat.n
        for at, flat in parts:
            ends = np.cumsum(lengths[at])
            starts[at] = base + ends - lengths[at]
            base += len(flat)
            self.flat.add(flat)
        self.starts.add(starts)
        self.lengths.add(lengths)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, each document closed by the end id, and the number of ids of each document."""
        raws = [t.encode("utf-8", "surrogatepass") for t in texts]
        joined = b"".join(raws)
        raw = np.frombuffer(joined, np.uint8)
        sizes = np.fromiter(map(len, raws), np.int64, len(raws))
        ends = np.cumsum(sizes)
        cut = _cut_places(raw, self.fine)
        last = ends[sizes > 0] - 1
        cut[last[raw[last] == 32]] = False  # nothing comes after a space at the end of a text
        whole = np.zeros(len(raw) + 1, bool)
        if self.added:
            for i, text in enumerate(texts):
                if self.added.search(text):
                    cut[ends[i] - sizes[i] : ends[i]] = False
                    whole[ends[i] - sizes[i]] = True
        cut[(ends - sizes)[sizes > 0]] = True
        starts = np.flatnonzero(cut[:-1])
        up_to = np.append(starts[1:], len(raw))
        rows = self._rows(joined, raw, starts, up_to, whole[starts])
        # Put row 0 after the words of each document.
        words_before = np.searchsorted(starts, ends, side="left")
        rows = np.insert(rows.astype(np.int64), words_before, 0)
        lengths = self.lengths.values[rows]
        stops = np.cumsum(lengths, dtype=np.int64)
        total = int(stops[-1]) if len(stops) else 0
        at = np.repeat(self.starts.values[rows] - (stops - lengths), lengths) + np.arange(total)
        doc_ends = stops[words_before + np.arange(len(texts))]
        ids = self.flat.values[at]
        # Rows after those of the remembered words served this call only.
        self.flat.cut(self.kept)
        self.starts.cut(self.keys.n)
        self.lengths.cut(self.keys.n)
        return ids, np.diff(doc_ends, prepend=0)

    def _rows(self, joined: bytes, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, apart: np.ndarray) -> np.ndarray:
        """The row of each word: a remembered one, or for long words and those set apart one of this call."""
        short = np.flatnonzero((ends - starts <= LONG_SPAN) & ~apart)
        a, b = starts[short], ends[short]
        keys = span_hashes(raw, a, b)
        keys[keys == 0] = 1
        found = self.table.find(keys)
        self.met.room[found[found >= 0]] = True
        new = np.flatnonzero(found < 0)
        if len(new):
            different, first = np.unique(keys[new], return_index=True)
            if self.keys.n + len(different) > CACHE_WORDS:
                self._forget(len(np.unique(keys)))
                found = self.table.find(keys)
                new = np.flatnonzero(found < 0)
                different, first = np.unique(keys[new], return_index=True)
            at = new[first]
            base = self.keys.n
            words = [joined[x:y] for x, y in zip(a[at].tolist(), b[at].tolist(), strict=True)]
            self._learn(words)
            n = b[at] - a[at]
            self.byte_at.add(self.bytes.n + np.cumsum(n) - n)
            self.byte_n.add(n)
            self.bytes.add(np.frombuffer(b"".join(words), np.uint8))
            self.keys.add(different)
            self.met.add(np.zeros(len(different), bool))
            self.table.add(different, np.arange(base, base + len(different), dtype=np.int32))
            found[new] = self.table.find(keys[new])
        rows = np.full(len(starts), -1, np.int64)
        same = self._same(raw, a, b, found)
        rows[short[same]] = found[same]
        others, self.kept = np.flatnonzero(rows < 0), self.flat.n
        if len(others):
            rows[others] = self.starts.n + np.arange(len(others))
            self._learn([joined[x:y] for x, y in zip(starts[others].tolist(), ends[others].tolist(), strict=True)])
        return rows

    def _same(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Whether each word has the bytes that its row was learnt from."""
        same = self.byte_n.values[rows] == ends - starts
        mine, theirs = eights(raw), np.ndarray((self.bytes.n + 1,), "<u8", self.bytes.room, strides=(1,))
        open_ = np.flatnonzero(same)
        at, kept, left = starts[open_], self.byte_at.values[rows[open_]], (ends - starts)[open_]
        while len(open_):
            equal = head(mine, at, left) == head(theirs, kept, left)
            same[open_[~equal]] = False
            go = equal & (left > 8)
            open_, at, kept, left = open_[go], at[go] + 8, kept[go] + 8, left[go] - 8
        return same


_encoders: dict[tuple[str, int], WordEncoder] = {}


def word_encoder(path: str, end_id: int) -> WordEncoder:
    """The encoder of this Python worker; it keeps its words from task to task."""
    if (path, end_id) not in _encoders:
        _encoders.clear()
        _encoders[path, end_id] = WordEncoder(path, end_id)
    return _encoders[path, end_id]


def _segment(part: int, number: int, docs: list, counts: list, ids: list) -> dict:
    flat = np.concatenate(ids)
    table, checkpoints, payload = rans.encode_segment(flat)
    return {
        "part": part, "segment": number, "n_tokens": len(flat), "doc_ids": docs, "doc_tokens": counts,
        "table": table, "checkpoints": checkpoints, "payload": payload,
    }


ARROW = pa.schema([
    ("part", pa.int32()), ("segment", pa.int32()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
    ("doc_tokens", pa.list_(pa.int64())), ("table", pa.binary()), ("checkpoints", pa.binary()), ("payload", pa.binary()),
])


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[list, list[str]]]:
    """(ids, texts) of a batch, a bounded number of characters at once."""
    lengths = pc.fill_null(pc.utf8_length(batch.column(1)), 0).to_numpy()
    cuts = np.searchsorted(np.cumsum(lengths), np.arange(SLICE_CHARS, lengths.sum() + SLICE_CHARS, SLICE_CHARS), side="left") + 1
    start = 0
    for stop in [*np.unique(np.minimum(cuts, batch.num_rows)), batch.num_rows]:
        if stop > start:
            part = batch.slice(start, stop - start)
            yield part.column(0).to_pylist(), ["" if t is None else t for t in part.column(1).to_pylist()]
            start = stop


def _encode(path: str, end_id: int, segment_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(path, end_id)
        part, number, held = TaskContext.get().partitionId(), 0, 0
        docs, counts, ids = [], [], []
        for batch in batches:
            for doc_ids, texts in _slices(batch):
                flat, n = encoder.encode(texts)
                docs += doc_ids
                counts += n.tolist()
                ids.append(flat)
                held += len(flat)
                if held >= segment_tokens:
                    yield pa.RecordBatch.from_pylist([_segment(part, number, docs, counts, ids)], ARROW)
                    number, held, docs, counts, ids = number + 1, 0, [], [], []
        if docs:
            yield pa.RecordBatch.from_pylist([_segment(part, number, docs, counts, ids)], ARROW)

    return run


def write_token_ids(
    docs: DataFrame,
    tokenizer_path: str,
    end_id: int,
    path: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    segment_tokens: int = SEGMENT_TOKENS,
) -> str:
    """Encode whole texts, append end_id to each, write segments in ascending id order; returns the folder.

    Rows are range-partitioned by id (ties by a hash of the text, then by place, so a repeated
    id is dealt over partitions too) and each partition is encoded as a stream: at most a
    segment of ids is held. Null and empty texts are only the end id; null ids come first and
    stay null. A string of an added token in a text is that token, as the library has it. An empty table gives a
    folder without rows. Other columns are not read.
    """
    spark = docs.sparkSession
    path = path or f"{shared_dir(spark)}/token-ids-{uuid.uuid4().hex}"
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    keyed = rows.withColumn("tie", F.xxhash64("text")).withColumn("place", F.monotonically_increasing_id())
    ordered = keyed.repartitionByRange(partitions_for(docs), "doc_id", "tie", "place").sortWithinPartitions("doc_id", "tie", "place")
    with small_batches(spark):
        ordered.select("doc_id", "text").mapInArrow(_encode(tokenizer_path, end_id, segment_tokens), SEGMENT_SCHEMA).write.parquet(path)
    return path


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            part, segment, n, docs, counts, table, checkpoints, payload = (batch.column(c)[row].as_py() for c in range(8))
            data = memoryview(rans.decode_segment(n, table, checkpoints, payload).astype("<u4").tobytes())
            counts = np.array(counts, np.int64)
            ends = np.cumsum(counts)
            sums = [zlib.crc32(data[4 * (e - c) : 4 * e]) for e, c in zip(ends.tolist(), counts.tolist(), strict=True)]
            m = len(docs)
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * m, pa.int32()), pa.array([segment] * m, pa.int32()), pa.array(docs, pa.int64()),
                 pa.array(ends - counts, pa.int64()), pa.array(counts, pa.int64()), pa.array(sums, pa.int64())],
                names=["part", "segment", "doc_id", "offset", "n_tokens", "ids_crc32"],
            )


def segment_starts(segments: DataFrame) -> DataFrame:
    """(part, segment, before): tokens before each segment, from totals of the parts and sums within them."""
    sizes = segments.select("part", "segment", "n_tokens")
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("tokens"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("part_start"))
    within = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    return (
        sizes.withColumn("run", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
        .join(F.broadcast(parts), "part")  # one row per partition of the writer
        .select("part", "segment", (F.col("part_start") + F.col("run")).alias("before"))
    )


def read_token_digest(spark, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, decoded from the files."""
    segments = spark.read.schema(SEGMENT_SCHEMA).parquet(path)
    docs = segments.mapInArrow(
        _decode, "part int, segment int, doc_id long, offset long, n_tokens long, ids_crc32 long"
    )
    return docs.join(segment_starts(segments), ["part", "segment"]).select(
        "doc_id", (F.col("before") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32"
    )


def read_token_ids(spark, path: str) -> DataFrame:
    """(doc_id, ids) of each document, decoded from the files."""

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                n, docs, counts, table, checkpoints, payload = (batch.column(c)[row].as_py() for c in range(6))
                ids = rans.decode_segment(n, table, checkpoints, payload)
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(docs, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(ids.astype(np.int32)))], names=["doc_id", "ids"]
                )

    cols = ["n_tokens", "doc_ids", "doc_tokens", "table", "checkpoints", "payload"]
    return spark.read.schema(SEGMENT_SCHEMA).parquet(path).select(*cols).mapInArrow(run, "doc_id long, ids array<int>")
