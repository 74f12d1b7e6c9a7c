"""Similarity join on word shingles with Bayesian candidate pruning (operator 5).

1. Texts with equal shingle sets form a class; only the smallest id of a class goes on.
2. MinHash bands propose candidates: the unit of work is a bucket (band, key) of several classes. A bucket
   of many is cut into blocks by a hash of the id, and every pair of blocks is a tile of its own, so none is held whole.
3. A pair is compared only in the first band that it shares, which its signatures tell: some MinHash values at
   a time, and dropped when the posterior probability of reaching the threshold falls below a tolerance.
4. Only classes with a pair left fetch their shingle sets, into the tiles where they have one, and are verified exactly.
5. Link counts are summed over tiles and weighted by class sizes; classes of documents are the
   connected components of the verified links.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, sized, stored
from .shingles import mix, shingle_set

BANDS, ROWS = 32, 5
HASHES = BANDS * ROWS
STEP = 32  # MinHash values compared between two prunings
TOLERANCE = 1e-9
BLOCK = 384  # default number of classes in a block, on average
BAND_BYTES = 2 * ROWS

_seeds = mix(np.arange(1, 2 * HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_mul, _add = _seeds[:HASHES] | np.uint64(1), _seeds[HASHES:]


def signature(shingles: np.ndarray) -> np.ndarray:
    """HASHES MinHash values, 16 bits of each; a false agreement has probability 2**-16."""
    low = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 2048):  # bounded memory for very long texts
        part = shingles[at : at + 2048]
        low = np.minimum(low, (part[None, :] * _mul[:, None] + _add[:, None]).min(axis=1))
    return (mix(low) >> np.uint64(48)).astype("<u2")


def least_matches(threshold: float, tolerance: float = TOLERANCE) -> np.ndarray:
    """For n compared values, the least number of matches that keeps a pair.

    With a uniform prior, P(J >= t | m of n match) = P(Binomial(n + 1, t) <= m).
    """
    least = np.zeros(HASHES + 1, np.int64)
    for n in range(1, HASHES + 1):
        tail = 0.0
        for m in range(n + 1):
            tail += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if tail >= tolerance:
                least[n] = m
                break
    return least


SIGNED = "doc_id long, n_shingles int, set_low long, set_high long, sig binary"


def set_hashes(shingles: np.ndarray) -> tuple[int, int]:
    """Two 64-bit hashes of a set of shingles, which with its size are the key of its class."""
    low = np.bitwise_xor.reduce(mix(shingles + np.uint64(1)))
    high = np.add.reduce(mix(shingles ^ np.uint64(0xA5A5A5A5A5A5A5A5)))
    return int(low.astype(np.int64)), int(high.astype(np.int64))


def _sign(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, counts, lows, highs, sigs = [], [], [], [], []
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                s = shingle_set(text.as_py(), size)
                ids.append(doc_id.as_py())
                counts.append(len(s))
                low, high = set_hashes(s)
                lows.append(low)
                highs.append(high)
                sigs.append(signature(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(counts, pa.int32()), pa.array(lows, pa.int64()), pa.array(highs, pa.int64()), pa.array(sigs, pa.binary())],
                names=["doc_id", "n_shingles", "set_low", "set_high", "sig"],
            )

    return run


def _shingled(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py(), size).astype("<u8") for t in batch.column(1)]
            keys = [set_hashes(s) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int32()), *[pa.array([k[i] for k in keys], pa.int64()) for i in (0, 1)],
                 pa.array([s.tobytes() for s in sets], pa.binary())],
                names=["rep", "n_shingles", "set_low", "set_high", "shingles"],
            )

    return run


def _overlaps(sets_a: list[np.ndarray], sets_b: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Shingles that set i of a and set j of b share, for each pair; i is sorted."""
    shared = np.zeros(len(i), np.int64)
    if not len(i):
        return shared
    used = np.unique(j)
    sizes = np.array([len(sets_b[x]) for x in used])
    flat = np.concatenate([sets_b[x] for x in used])
    values, local = np.unique(flat, return_inverse=True)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    place = np.searchsorted(used, j)
    for a, lo, hi in zip(*np.unique(i, return_index=True), np.append(np.unique(i, return_index=True)[1][1:], len(i)), strict=True):
        at = np.searchsorted(values, sets_a[a])
        at[at == len(values)] = 0
        mark = np.zeros(len(values), np.int32)
        mark[at[values[at] == sets_a[a]]] = 1
        p = place[lo:hi]
        lengths = sizes[p]
        ends = np.cumsum(lengths)
        index = np.repeat(offsets[p] - (ends - lengths), lengths) + np.arange(ends[-1])
        shared[lo:hi] = np.add.reduceat(mark[local[index]], ends - lengths)
    return shared


def _pairs(sizes: list[tuple[int, int, bool]]) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of tiles that lie one after the other: (rows of the first block, of the second, whether it is one block)."""
    none, at = np.zeros(0, np.int64), 0
    left, right = [none], [none]
    for first, second, within in sizes:
        if within:
            i, j = np.triu_indices(first, 1)
        else:
            i, j = np.repeat(np.arange(first), second), first + np.tile(np.arange(second), first)
        left.append(i + at)
        right.append(j + at)
        at += first + second
    return np.concatenate(left), np.concatenate(right)


def candidate_pairs(sigs: np.ndarray, band: np.ndarray, sizes: list[tuple[int, int, bool]], least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of tiles whose first shared band is that of the tile and that the Bayesian pruning keeps."""
    every_i, every_j = _pairs(sizes)
    found = []
    for at in range(0, len(every_i), 1 << 15):
        i, j = every_i[at : at + (1 << 15)], every_j[at : at + (1 << 15)]
        same = sigs[i] == sigs[j]
        first = same.reshape(len(i), BANDS, ROWS).all(axis=2).argmax(axis=1) == band[i]
        i, j, same = i[first], j[first], same[first]
        matches = np.zeros(len(i), np.int64)
        for lo in range(0, HASHES, STEP):
            hi = min(HASHES, lo + STEP)
            matches += same[:, lo:hi].sum(axis=1)
            keep = matches >= least[hi]
            i, j, same, matches = i[keep], j[keep], same[keep], matches[keep]
        found.append((i, j))
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *[i for i, _ in found]]), np.concatenate([none, *[j for _, j in found]])


TILE = ["band", "key", "x", "y"]
CLASS = ["rep", "n_shingles", "set_low", "set_high"]
PLACED = "band int, key binary, x int, y int, side int, rep long, n_shingles int, set_low long, set_high long"
PAIRED = "rep long, n_shingles int, set_low long, set_high long, links long, other long"
#: Rows, and bytes of shingle sets, that a task gathers before it compares; tiles are not cut.
HELD_ROWS, HELD_BYTES = 4096, 32 << 20


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, list[tuple[int, int, bool]]]]:
    """Whole tiles of rows sorted by tile and side, some at a time, with their sizes."""
    held: list[pa.Table] = []
    sizes: list[list] = []
    rows = size = 0
    now = None
    for batch in batches:
        keys = list(zip(*[batch.column(c).to_pylist() for c in (*TILE, "side")], strict=True))
        from_ = 0
        for at, (*tile, side) in enumerate(keys):
            if tile != now:
                if rows + at - from_ >= HELD_ROWS or size >= HELD_BYTES:
                    held.append(pa.Table.from_batches([batch.slice(from_, at - from_)]))
                    yield pa.concat_tables(held).combine_chunks(), [(a, b, c) for a, b, c in sizes]
                    held, sizes, rows, size, from_ = [], [], 0, 0, at
                now = tile
                sizes.append([0, 0, tile[2] == tile[3]])
            sizes[-1][0 if sizes[-1][2] else side] += 1
        if from_ < len(keys):
            held.append(pa.Table.from_batches([batch.slice(from_)]))
            rows += len(keys) - from_
            size += held[-1].nbytes
    if sizes:
        yield pa.concat_tables(held).combine_chunks(), [(a, b, c) for a, b, c in sizes]


def _signatures(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    sigs = np.frombuffer(b"".join(group.column("sig").to_pylist()), "<u2").reshape(-1, HASHES)
    return sigs, group.column("band").to_numpy()


def _surviving(threshold: float):
    least = least_matches(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, sizes in _gathered(batches):
            i, j = candidate_pairs(*_signatures(group), sizes, least)
            some = group.select([*TILE, "side", *CLASS]).take(pa.array(np.unique(np.concatenate([i, j]))))
            yield from some.to_batches()

    return run


def _verified(threshold: float):
    least = least_matches(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, sizes in _gathered(batches):
            i, j = candidate_pairs(*_signatures(group), sizes, least)
            order = np.argsort(i, kind="stable")
            i, j = i[order], j[order]
            sets = [np.frombuffer(x, "<u8") for x in group.column("shingles").to_pylist()]
            lengths = np.array([len(x) for x in sets])
            good = [np.zeros(0, bool)]
            for at in range(0, len(i), 1 << 14):
                a, b = i[at : at + (1 << 14)], j[at : at + (1 << 14)]
                shared = _overlaps(sets, sets, a, b)
                # Decided as a brute-force comparison would: shared / union >= threshold in doubles.
                good.append(shared / np.maximum(1, lengths[a] + lengths[b] - shared) >= threshold)
            good = np.concatenate(good)
            yield from _links(group, i[good], j[good]).to_batches()

    return run


def _links(group: pa.Table, i: np.ndarray, j: np.ndarray) -> pa.Table:
    """Links of each row, and a spanning forest of them, which is all that components need."""
    reps, weight = group.column("rep").to_numpy(), group.column("copies").to_numpy()
    links = np.bincount(i, weight[j], len(reps)).astype(np.int64) + np.bincount(j, weight[i], len(reps)).astype(np.int64)
    root = np.arange(len(reps))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for x, y in zip(i.tolist(), j.tolist(), strict=True):
        x, y = find(x), find(y)
        if x != y:
            root[max(x, y)] = min(x, y)
    some = np.flatnonzero(links)
    tops = reps[np.array([find(x) for x in some.tolist()], np.int64)]
    return group.select(CLASS).take(pa.array(some)).append_column("links", pa.array(links[some])).append_column("other", pa.array(tops))


def jaccard_classes(docs: DataFrame, threshold: float = 0.8, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, class_id, n_links, kept.

    n_links counts the other documents whose shingle sets have a Jaccard similarity of at
    least ``threshold``; class_id is the smallest id that links reach; kept marks that
    document. A pair at the threshold shares no band with probability below 1e-5 (3e-6 at 0.8,
    less above); pruning loses less than 1e-8 of them more.

    Null and empty texts and texts without words link with nothing. Texts of fewer words than
    a shingle are one shingle. Rows that repeat an id with the same text count as copies of each
    other but come out as one row; with other texts the id is linked by either. Null ids are
    dropped. An empty table gives no rows. Other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null")
    signed = stored(rows.mapInArrow(_sign(shingle), SIGNED), "signatures")
    by_set = ["n_shingles", "set_low", "set_high"]
    real = signed.where("n_shingles > 0")
    classes = real.groupBy(*by_set).agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("sig").alias("sig"))
    # One representative may stand for two classes if its id repeats with other texts; its sets are told apart by the class key.
    classes = stored(classes, "classes")

    bands = classes.select(
        *CLASS, F.explode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.struct(b.alias("band"), F.substring("sig", b * BAND_BYTES + 1, F.lit(BAND_BYTES)).alias("key")))).alias("x")
    ).select(*CLASS, "x.band", "x.key")
    shared = bands.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / block).cast("int")
    met = bands.join(shared, ["band", "key"]).select(*CLASS, "band", "key", blocks.alias("blocks"), F.pmod(F.xxhash64(*CLASS), blocks).cast("int").alias("mine"))
    tile = lambda w: F.struct(F.least("mine", w).alias("x"), F.greatest("mine", w).alias("y"), F.when(F.col("mine") <= w, 0).otherwise(1).alias("side"))
    placed = met.select(*CLASS, "band", "key", F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), tile)).alias("t")).select("band", "key", "t.*", *CLASS)
    signs = classes.select(*CLASS, "copies", "sig")
    dealt = placed.join(signs, CLASS).repartition(*TILE).sortWithinPartitions(*TILE, "side")
    survived = stored(dealt.mapInArrow(_surviving(threshold), PLACED), "candidates")

    wanted = sized(stored(survived.select("rep").distinct(), "wanted"), 16)
    texts = rows.join(wanted, rows["doc_id"] == wanted["rep"], "left_semi")
    sets = texts.mapInArrow(_shingled(shingle), "rep long, n_shingles int, set_low long, set_high long, shingles binary")
    full = stored(signs.join(sets, CLASS).dropDuplicates(CLASS), "shingle-sets")
    tiles = survived.join(full, CLASS).repartition(*TILE).sortWithinPartitions(*TILE, "side")
    found = stored(tiles.mapInArrow(_verified(threshold), PAIRED), "links")
    key = CLASS
    # Links belong to a class, as an id whose texts differ may stand for several; components belong to ids.
    counts = found.groupBy(*key).agg(F.sum("links").alias("links"))
    final = connected_components(found.select(F.col("rep").alias("a"), F.col("other").alias("b")))
    linked = classes.select(*key, "copies").join(counts, key, "left").join(final.select(F.col("node").alias("rep"), "component"), "rep", "left")
    out = real.select("doc_id", *by_set).join(linked, by_set).select(
        "doc_id",
        F.coalesce("component", "rep").alias("class_id"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"),
    )
    alone = signed.where("n_shingles = 0").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    out = out.unionByName(alone).groupBy("doc_id").agg(F.min("class_id").alias("class_id"), F.max("n_links").alias("n_links"))
    return out.withColumn("kept", F.col("doc_id") == F.col("class_id"))


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """Rows of docs of which one document of each class stays: the one with the smallest id.

    All rows of that id stay. Rows with a null id and rows without words stay. An empty table gives no rows. Columns of docs
    pass through, whatever their names.
    """
    gone = jaccard_classes(docs, **options).where("not kept").select("doc_id")
    gone = stored(gone.select(F.col("doc_id").alias("duplicate_id")), "duplicates")
    return docs.join(sized(gone, 16), docs[options.get("id_col", "doc_id")] == gone["duplicate_id"], "left_anti")
