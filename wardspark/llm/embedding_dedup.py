"""Embedding near-duplicates by PCA-ordered tiled comparison (operator 10).

Equal vectors form a class. Class representatives are rotated onto the principal axes of all
vectors and cut into blocks along the first axis. Pairs of blocks whose first coordinates are
too far apart for the threshold are never formed; each other pair of blocks is one task group of
bounded size. There the leading coordinates are multiplied first; the product of the norms
of the remaining coordinates bounds what they can add, and pairs that cannot reach the threshold
are dropped. The rest are compared exactly, in double precision, on the vectors as given.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, sized, stored

BLOCK = 4096  # default number of vectors in a block, on average
ROWS = 512  # rows of a block multiplied at once
SLACK = 1e-4  # bounds are in single precision
LEADING = 0.25  # share of the coordinates in the first product


def valid_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v): vectors with finite components only that are not all zero, as doubles."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where("vec_id is not null and v is not null").where((F.size("v") > 0) & finite & F.exists("v", lambda x: x != 0))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _unit(m: np.ndarray) -> np.ndarray:
    m = m / np.abs(m).max(axis=1, keepdims=True)  # no overflow or underflow in the squares
    return m / np.sqrt(np.einsum("ij,ij->i", m, m))[:, None]


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds a 128-bit cryptographic digest of each vector, which stands for its value."""
    for batch in batches:
        digests = [blake2b(v.values.to_numpy().tobytes(), digest_size=16).digest() for v in batch.column(1)]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(digests, pa.binary())], names=["vec_id", "v", "digest"])


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        if batch.num_rows:
            u = _unit(_matrix(batch.column(0)))
            total = u.T @ u if total is None else total + u.T @ u
    if total is not None:
        d = len(total)
        i, j = np.divmod(np.arange(d * d), d)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total.reshape(-1))], names=["i", "j", "s"])


def principal_axes(classes: DataFrame, dim: int) -> np.ndarray:
    """Columns: orthogonal axes of the second moments of all unit vectors, largest first. dim x dim sums reach the driver."""
    sums = classes.select("v").mapInArrow(_moments, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).toPandas()
    m = np.zeros((dim, dim))
    m[sums["i"], sums["j"]] = sums["s"]
    values, axes = np.linalg.eigh((m + m.T) / 2)
    return np.ascontiguousarray(axes[:, np.argsort(-values)])


def _first_coordinate(axis: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                first = _unit(_matrix(batch.column(2))) @ axis
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(first)], names=["rep", "copies", "v", "digest", "first"])

    return run


def linked_pairs(a: np.ndarray, b: np.ndarray, axes: np.ndarray, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of rows of a and b (i < j if they are the same block) with cosine >= threshold."""
    ua, ub = _unit(a), _unit(b)
    d = a.shape[1]
    lead = min(d, max(1, math.ceil(d * LEADING)))
    middle = min(d, 2 * lead)
    ra, rb = (ua @ axes).astype(np.float32), (ub @ axes).astype(np.float32)

    def bounding(r, k):
        """Leading k coordinates and the norm of the rest: one product gives sum and bound together."""
        rest = np.sqrt(np.maximum(0, (r[:, k:] ** 2).sum(axis=1, keepdims=True)))
        return np.concatenate([r[:, :k], rest], axis=1)

    la, lb = bounding(ra, lead), bounding(rb, lead)
    ma, mb = bounding(ra, middle), bounding(rb, middle)
    least = threshold - SLACK
    out_i, out_j = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for at in range(0, len(a), ROWS):
        open_ = la[at : at + ROWS] @ lb.T >= least
        if open_.mean() > 0.02:  # many left: the next product for all of them
            open_ &= ma[at : at + ROWS] @ mb.T >= least
            i, j = np.nonzero(open_)
            if len(i) > 0.1 * open_.size:
                i, j = np.nonzero(open_ & (ra[at : at + ROWS] @ rb.T >= least))
            i += at
        else:
            i, j = np.nonzero(open_)
            i += at
            keep = np.einsum("ij,ij->i", ma[i], mb[j]) >= least
            i, j = i[keep], j[keep]
        if same:
            i, j = i[i < j], j[i < j]
        for k in range(0, len(i), 1 << 16):
            p, q = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
            good = np.einsum("ij,ij->i", ua[p], ub[q]) >= threshold - 1e-9
            p, q = p[good], q[good]
            dot = np.einsum("ij,ij->i", a[p], b[q])
            norms = np.sqrt(np.einsum("ij,ij->i", a[p], a[p])) * np.sqrt(np.einsum("ij,ij->i", b[q], b[q]))
            exact = np.where(np.isfinite(dot) & np.isfinite(norms) & (norms > 0), dot / np.where(norms > 0, norms, 1), np.einsum("ij,ij->i", ua[p], ub[q]))
            out_i.append(p[exact >= threshold])
            out_j.append(q[exact >= threshold])
    return np.concatenate(out_i), np.concatenate(out_j)


def _compare(axes: np.ndarray, threshold: float):
    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        side = group.column("side").to_numpy()
        reps = group.column("rep").to_numpy()
        copies = group.column("copies").to_numpy()
        m = _matrix(group.column("v").chunk(0))
        a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        same = not len(b) and group.column("x")[0] == group.column("y")[0]
        digests = group.column("digest")
        empty = pa.table({"rep": pa.array([], pa.int64()), "digest": pa.array([], pa.binary()), "links": pa.array([], pa.int64()), "other": pa.array([], pa.int64())})
        if same:
            b = a
        if not len(a) or not len(b):
            return empty
        i, j = linked_pairs(m[a], m[b], axes, threshold, same)
        i, j = a[i], b[j]
        links = (np.bincount(i, copies[j], len(reps)) + np.bincount(j, copies[i], len(reps))).astype(np.int64)
        root = list(range(len(reps)))  # a spanning forest of the links

        def find(x):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for x, y in zip(i.tolist(), j.tolist(), strict=True):
            x, y = find(x), find(y)
            if x != y:
                root[max(x, y)] = min(x, y)
        some = np.flatnonzero(links > 0)
        top = np.array([find(x) for x in some], np.int64)
        return pa.table({"rep": pa.array(reps[some]), "digest": digests.take(pa.array(some)), "links": pa.array(links[some]), "other": pa.array(reps[top])})

    return run


def cosine_components(vectors: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    n_links counts the other vectors with cosine >= ``threshold`` (positive), component_id is the
    smallest vec_id reachable by links, kept marks that vector.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, and
    vectors of different length don't link; each length is compared by itself. Rows that repeat an
    id with the same vector count as copies of each other and come out as one row; with different
    vectors they come out as one row with the most links. Null ids are dropped. An empty table gives
    no rows. Other columns are not read.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be in (0, 1]")
    ids = vectors.select(F.col(id_col).cast("long").alias("vec_id")).where("vec_id is not null").distinct()
    rows = valid_vectors(vectors, id_col, vector_col)
    # -0.0 and 0.0 are one value. Equal vectors have equal digests.
    rows = rows.select("vec_id", F.transform("v", lambda x: x + F.lit(0.0)).alias("v"))
    keyed = stored(rows.mapInArrow(_digests, "vec_id long, v array<double>, digest binary"), "vectors").withColumn("dim", F.size("v"))
    classes = stored(keyed.groupBy("digest", "dim").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("v").alias("v")), "vector-classes")
    found = []
    for dim, n in [(r.dim, r["n"]) for r in classes.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()]:
        mine = classes.where(F.col("dim") == dim).select("rep", "copies", "v", "digest")
        axes = principal_axes(mine, dim)
        placed = stored(mine.mapInArrow(_first_coordinate(axes[:, 0]), "rep long, copies long, v array<double>, digest binary, first double"), "placed")
        blocks = max(1, math.ceil(n / block))
        cuts = sorted(set(placed.agg(F.percentile_approx("first", [k / blocks for k in range(1, blocks)], 100 * blocks)).first()[0])) if blocks > 1 else []
        # |a - b| of unit vectors at the threshold bounds how far apart first coordinates can be.
        reach = math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-6
        low, high = [-math.inf, *cuts], [*cuts, math.inf]
        near = [(bisect_left(high, low[x] - reach), bisect_right(low, high[x] + reach) - 1) for x in range(len(low))]
        place = F.expr(" + ".join(["0", *[f"int(first > {c!r}D)" for c in cuts]])) if len(cuts) < 50 else F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col("first")))
        spans = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in near])
        tiles = placed.withColumn("block", place.cast("int")).withColumn("span", F.get(spans, F.col("block")))
        # A block that ties make too large is cut further by a hash of the id.
        sizes = stored(tiles.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / (2 * block)).cast("int").alias("subs")), "block-sizes")
        subs = sized(sizes, 16)  # one row a block
        tiles = tiles.join(subs, "block").withColumn("sub", F.pmod(F.xxhash64("rep"), F.col("subs")).cast("int"))
        tiles = tiles.select("*", F.explode(F.sequence("span.a", "span.b")).alias("other"))
        tiles = tiles.join(subs.select(F.col("block").alias("other"), F.col("subs").alias("other_subs")), "other")
        tiles = tiles.select("*", F.explode(F.sequence(F.lit(0), F.col("other_subs") - 1)).alias("other_sub"))
        here, there = F.struct(F.col("block").alias("b"), F.col("sub").alias("s")), F.struct(F.col("other").alias("b"), F.col("other_sub").alias("s"))
        tiles = tiles.select(
            F.least(here, there).alias("x"), F.greatest(here, there).alias("y"), F.when(here <= there, 0).otherwise(1).alias("side"), "rep", "copies", "v", "digest"
        )
        found.append(stored(tiles.groupBy("x", "y").applyInArrow(_compare(axes, threshold), "rep long, digest binary, links long, other long"), "vector-links"))
    if not found:
        return ids.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    links = found[0]
    for more in found[1:]:
        links = links.unionByName(more)
    # Links belong to a class, as an id whose vectors differ may stand for several; components belong to ids.
    counts = links.groupBy("digest", "rep").agg(F.sum("links").alias("links"))
    final = connected_components(links.select(F.col("rep").alias("a"), F.col("other").alias("b")))
    linked = classes.select("digest", "dim", "rep", "copies").join(counts, ["digest", "rep"], "left").join(final.select(F.col("node").alias("rep"), "component"), "rep", "left")
    out = keyed.select("vec_id", "digest", "dim").join(linked, ["digest", "dim"]).groupBy("vec_id").agg(
        F.max(F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.min(F.coalesce("component", "rep")).alias("component_id")
    )
    out = ids.join(out, "vec_id", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept")
    )
