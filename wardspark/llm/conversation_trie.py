"""Prefix trie of conversations by union-find over sorted neighbours (operator 11).

1. Turns are numbered by one global sort and offsets of partitions. A prefix is known by its depth
   and the sums, modulo a prime, of its turns' digests times powers of two bases: sums of stretches
   add up, so prefixes of a conversation are known without walking it from its start.
2. Conversations are cut into segments of ``segment`` turns, which are sorted by the prefix before
   them and then turn by turn. In each partition the edges between neighbours, taken by descending
   length of their common prefix, join components by union-find: a merge makes the branching node,
   and a component on its way up makes the nodes between.
3. Nodes that hold the first or last row of a partition, or a conversation that goes on in a
   further segment, are open: other partitions may know more of them. They carry the totals of
   what hangs below them, so each partition's forest is contracted to its open nodes. Those
   are merged by key, and totals of subtrees follow by pointer doubling, in logarithmic rounds.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b, sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions_for, sized, stored

SEGMENT = 64
PRIME = (1 << 61) - 1
BASES = (0x1F3D5B79A8C6E421 % PRIME, 0x0B4E9D2C7F618A35 % PRIME)
#: Segments of one conversation that one window adds up, before their sums are.
STRETCH = 4096
#: Segments in a partition that builds a forest, on average.
FOREST_ROWS = 20_000
#: Ids in a piece of the text that is hashed for an open node.
CHUNK = 500


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last, idx = object(), 0
    for batch in batches:
        at, a, b, chars = [], [], [], []
        for conv, role, text in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "role", "text")], strict=True):
            idx = idx + 1 if conv == last else 0
            last = conv
            d = blake2b(f"{len(role)}:{role}{text}".encode("utf-8", "surrogatepass"), digest_size=16).digest()
            at.append(idx)
            a.append(int.from_bytes(d[:8], "little") % PRIME)
            b.append(int.from_bytes(d[8:], "little") % PRIME)
            chars.append(len(text))
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *[pa.array(x, pa.int64()) for x in (at, a, b, chars)]], names=["conv_id", "idx", "a", "b", "chars"])


def numbered_turns(rows: DataFrame) -> DataFrame:
    """(conv_id, pos, a, b, chars): turns of (conv_id, turn, role, text) from 0 on, with a digest of role and text.

    Ordered by turn, nulls first; ties by role, then text. Null roles and texts are empty. Rows without
    a conv_id are no conversation and are left out. Rows that repeat another wholly are turns of their own.
    """
    known = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.monotonically_increasing_id().alias("row")
    ).where("conv_id is not null")
    order = ["conv_id", "turn", "role", "text", "row"]  # by the row, repeats of one row go to several partitions
    dealt = known.repartitionByRange(partitions_for(rows), *order).sortWithinPartitions(*order)
    coded = dealt.mapInArrow(_digests, "conv_id long, idx long, a long, b long, chars long")
    coded = stored(coded.select("*", F.spark_partition_id().alias("part")), "turns")
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = coded.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"))
    offsets = stored(counts.select("conv_id", "part", F.sum("n").over(before).alias("offset")).where("offset is not null"), "turn-offsets")
    placed = coded.join(sized(offsets, 32), ["conv_id", "part"], "left")
    return placed.select("conv_id", (F.col("idx") + F.coalesce("offset", F.lit(0))).alias("pos"), "a", "b", "chars")


def with_shared_heads(turns: DataFrame, every: int = 100, most: int = 6) -> DataFrame:
    """(conv_id, depth, a, b, chars) of rebuilt conversations: the first h turns of conversation c - c % every, then c's own after its first h.

    h is the crc32 of the decimal c modulo ``most``. Each conversation has one row of depth 0 without a
    digest, so those without turns are there too. Remainders of negative ids are negative, as in SQL.
    """
    h = F.expr(f"cast(crc32(cast(cast(conv_id as string) as binary)) % {most} as int)")
    base = F.col("conv_id") - F.col("conv_id") % every
    first = turns.where((F.col("conv_id") % every == 0) & (F.col("pos") < most - 1))
    heads = first.groupBy(F.col("conv_id").alias("base")).agg(F.sort_array(F.collect_list(F.struct("pos", "a", "b", "chars"))).alias("head"))
    heads = stored(heads, "heads")
    length = F.least(h, F.coalesce(F.size("head"), F.lit(0)))
    short = heads.select("base", F.size("head").alias("n_head"))
    own = turns.where(F.col("pos") >= h).withColumn("base", base).join(sized(short, 16), "base", "left")
    own = own.select("conv_id", (F.col("pos") - h + F.least(h, F.coalesce("n_head", F.lit(0))) + 1).cast("long").alias("depth"), "a", "b", "chars")
    none = F.struct(F.lit(0).cast("long").alias("depth"), *[F.lit(None).cast("long").alias(c) for c in ("a", "b", "chars")])
    shared = F.transform(F.slice("head", F.lit(1), length), lambda x, i: F.struct((i + 1).cast("long").alias("depth"), x["a"].alias("a"), x["b"].alias("b"), x["chars"].alias("chars")))
    ids = turns.select("conv_id").distinct().withColumn("base", base).join(sized(heads, 256), "base", "left")
    marks = ids.select("conv_id", F.explode(F.concat(F.array(none), F.coalesce(shared, F.array().cast("array<struct<depth:long,a:long,b:long,chars:long>>")))).alias("x"))
    return own.unionByName(marks.select("conv_id", "x.*"))


def _prefixes(segment: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, chars = [], []
            for seg, turns in zip(batch.column("seg").to_pylist(), batch.column("turns").to_pylist(), strict=True):
                powers = [pow(x, seg * segment, PRIME) for x in BASES]
                a = b = 0
                mine = []
                for t in turns:
                    powers = [p * x % PRIME for p, x in zip(powers, BASES, strict=True)]
                    a, b = (a + t["a"] * powers[0]) % PRIME, (b + t["b"] * powers[1]) % PRIME
                    mine.append({"a": a, "b": b})
                keys.append(mine)
                chars.append([t["chars"] for t in turns])
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), batch.column("seg"), pa.array(keys, pa.list_(KEY)), pa.array(chars, pa.list_(pa.int64()))], names=["conv_id", "seg", "keys", "chars"]
            )

    return run


KEY = pa.struct([("a", pa.int64()), ("b", pa.int64())])


def segments(turns: DataFrame, segment: int) -> DataFrame:
    """(seg, start, keys, conv_id, chars, more): conversations in pieces of at most ``segment`` turns, keys of all their prefixes."""
    seg = F.when(F.col("depth") > 0, F.floor((F.col("depth") - 1) / segment)).otherwise(0).cast("long")
    turn = F.when(F.col("depth") > 0, F.struct("depth", "a", "b", "chars"))
    cut = turns.groupBy("conv_id", seg.alias("seg")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    cut = stored(cut.mapInArrow(_prefixes(segment), "conv_id long, seg long, keys array<struct<a:long,b:long>>, chars array<long>"), "segments")
    alone = (F.col("seg") == 0) & (F.size("keys") < segment)
    last = F.element_at("keys", -1)
    long = cut.where(~alone).select("conv_id", "seg", F.floor(F.col("seg") / STRETCH).alias("stretch"), *[last[c].cast("decimal(38,0)").alias(c) for c in "ab"])
    inside = Window.partitionBy("conv_id", "stretch").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy("conv_id").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    sums = long.groupBy("conv_id", "stretch").agg(*[(F.sum(c) % PRIME).cast("decimal(38,0)").alias(c) for c in "ab"], F.max("seg").alias("last"))
    sums = sums.select("conv_id", "stretch", *[F.sum(c).over(across).alias(f"far_{c}") for c in "ab"], F.max("last").over(Window.partitionBy("conv_id")).alias("last"))
    near = long.select("conv_id", "seg", "stretch", *[F.sum(c).over(inside).alias(f"near_{c}") for c in "ab"])
    zero = F.lit(0).cast("decimal(38,0)")
    starts = near.join(sums, ["conv_id", "stretch"]).select(
        "conv_id", "seg", F.struct(*[((F.coalesce(f"near_{c}", zero) + F.coalesce(f"far_{c}", zero)) % PRIME).cast("long").alias(c) for c in "ab"]).alias("start"), (F.col("seg") < F.col("last")).alias("more")
    )
    none = F.struct(*[F.lit(0).cast("long").alias(c) for c in "ab"])
    rows = cut.where(alone).select("*", none.alias("start"), F.lit(False).alias("more"))
    rows = rows.unionByName(cut.where(~alone).join(sized(stored(starts, "segment-starts"), 48), ["conv_id", "seg"]))
    added = F.transform("keys", lambda k: F.struct(*[((k[c] + F.col("start")[c]) % PRIME).alias(c) for c in "ab"]))
    return rows.select("seg", "start", added.alias("keys"), "conv_id", "chars", "more")


NODE, OPEN, ENDS = 0, 1, 2
FOREST = (
    "kind int, depth long, a long, b long, parent_a long, parent_b long, conv_id long, parent_conv_id long, "
    "n_convs long, n_children long, n_leaves long, saved long, chars long, ends string"
)


class _Part:
    """A component of sorted rows lo..hi whose topmost node so far has depth top."""

    __slots__ = ("lo", "top", "n", "low", "kids", "leaves", "saved", "open", "ends")

    def __init__(self, lo: int, top: int, conv: int, open_: bool, ends: bool):
        self.lo, self.top, self.n, self.low, self.open = lo, top, 1, conv, open_
        self.kids = self.leaves = self.saved = 0
        self.ends = [conv] if ends else []


def _grow(rows: list[tuple], segment: int) -> Iterator[tuple]:
    """Rows of FOREST of a partition's sorted (seg, start, keys, conv_id, chars, more)."""
    parts = [_Part(i, len(keys), conv, more or i in (0, len(rows) - 1), not more) for i, (_, _, keys, conv, _, more) in enumerate(rows)]
    up = list(range(len(rows)))

    def find(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    edges = []
    for i in range(len(rows) - 1):
        if rows[i][:2] == rows[i + 1][:2]:
            common = 0
            for x, y in zip(rows[i][2], rows[i + 1][2], strict=False):
                if x != y:
                    break
                common += 1
            edges.append((-common, i))
    done: list[tuple] = []
    closed: dict[tuple, int] = {}

    def rise(p: _Part, to: int) -> None:
        while p.top > to:
            seg, start, keys, _, chars, _ = rows[p.lo]
            t, key = p.top, keys[p.top - 1]
            parent = keys[t - 2] if t > 1 else start
            place = (seg * segment + t, key["a"], key["b"], parent["a"], parent["b"])
            if p.open:
                done.append((OPEN, *place, p.low, None, p.n, p.kids, p.leaves, p.saved, chars[t - 1], None))
                done.extend(_chunks(place, p.ends))
                p.kids = p.leaves = p.saved = 0
            else:
                leaves, saved = p.leaves if p.kids else 1, p.saved + (p.n - 1) * chars[t - 1]
                ends = sha256(",".join(map(str, p.ends)).encode()).hexdigest()
                done.append((NODE, *place, p.low, None, p.n, p.kids, leaves, saved, chars[t - 1], ends))
                closed[place[:3]] = p.low
                p.kids, p.leaves, p.saved = 1, leaves, saved
            p.ends, p.top = [], t - 1

    for minus, i in sorted(edges):
        left, right = find(i), find(i + 1)
        p, q = parts[left], parts[right]
        rise(p, -minus)
        rise(q, -minus)
        p.n += q.n
        p.low = min(p.low, q.low)
        p.kids, p.leaves, p.saved, p.open = p.kids + q.kids, p.leaves + q.leaves, p.saved + q.saved, p.open or q.open
        p.ends.extend(q.ends)
        up[right] = left
    for i, p in enumerate(parts):
        if up[i] != i:
            continue
        rise(p, 0)
        seg, start = rows[p.lo][:2]
        # The end of the segment before knows how many conversations go through it.
        place = (seg * segment, start["a"], start["b"], None, None)
        done.append((OPEN, *place, None if seg else p.low, None, 0 if seg else p.n, p.kids, p.leaves, p.saved, None, None))
        done.extend(_chunks(place, p.ends))
    for kind, depth, a, b, pa_, pb, low, _, *rest in done:
        yield (kind, depth, a, b, pa_, pb, low, closed.get((depth - 1, pa_, pb)), *rest)


def _chunks(place: tuple, ends: list[int]) -> Iterator[tuple]:
    for at in range(0, len(ends), CHUNK):
        some = ends[at : at + CHUNK]
        yield (ENDS, *place, some[0], None, None, None, None, None, None, ",".join(map(str, some)))


def _forest(segment: int):
    names = [x.split()[0] for x in FOREST.split(", ")]
    kinds = [{"int": pa.int32(), "long": pa.int64(), "string": pa.string()}[x.split()[1]] for x in FOREST.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            rows.extend(zip(*[batch.column(c).to_pylist() for c in ("seg", "start", "keys", "conv_id", "chars", "more")], strict=True))
        out = []
        for row in _grow(rows, segment):
            out.append(row)
            if len(out) == 4096:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return run


def _hash_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by node and id, the hash of each node's pieces joined by commas; holds one hash state."""
    now, state = None, None

    def ready(key, digest):
        return pa.RecordBatch.from_arrays([*[pa.array([x], pa.int64()) for x in key], pa.array([digest])], names=["depth", "a", "b", "ends"])

    for batch in batches:
        for *key, ends in zip(*[batch.column(c).to_pylist() for c in ("depth", "a", "b", "ends")], strict=True):
            if key == now:
                state.update(b"," + ends.encode())
            else:
                if now is not None:
                    yield ready(now, state.hexdigest())
                now, state = key, sha256(ends.encode())
    if now is not None:
        yield ready(now, state.hexdigest())


AT = ["depth", "a", "b"]


def _named(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{prefix}{c}") for c in df.columns])


def _same(prefix: str) -> Column:
    return (F.col("parent.depth") == F.col(f"{prefix}depth")) & (F.col("parent.a") == F.col(f"{prefix}a")) & (F.col("parent.b") == F.col(f"{prefix}b"))


def open_nodes(forest: DataFrame) -> DataFrame:
    """Open nodes of all partitions, merged by key, with the totals of their subtrees."""
    some = forest.where(F.col("kind") == OPEN).groupBy(*AT).agg(
        F.max("parent_a").alias("parent_a"), F.max("parent_b").alias("parent_b"), F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"),
        F.sum("n_children").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved"), F.max("chars").alias("chars"),
    )
    parent = F.when(F.col("depth") > 0, F.struct((F.col("depth") - 1).alias("depth"), F.col("parent_a").alias("a"), F.col("parent_b").alias("b")))
    some = stored(some.select("*", parent.alias("parent")).drop("parent_a", "parent_b"), "open-nodes")
    more = some.where("parent is not null").groupBy("parent").agg(F.count(F.lit(1)).alias("more")).select("parent.*", "more")
    kids = F.col("n_children") + F.coalesce("more", F.lit(0))
    nodes = some.join(more, AT, "left").select(
        *AT, "parent", "conv_id", "n_convs", kids.alias("n_children"),
        (F.col("n_leaves") + F.when(kids == 0, 1).otherwise(0)).alias("n_leaves"), (F.col("saved") + (F.col("n_convs") - 1) * F.coalesce("chars", F.lit(0))).alias("saved"),
    )
    nodes = stored(nodes, "open-nodes")
    # Pointer doubling: totals of descendants less than 2^r above are known after r rounds.
    totals = nodes.select(*AT, "parent", "n_leaves", "saved")
    while not totals.where("parent is not null").isEmpty():
        below = totals.where("parent is not null").groupBy("parent").agg(F.sum("n_leaves").alias("l"), F.sum("saved").alias("s")).select("parent.*", "l", "s")
        above = _named(totals.where("parent is not null").select(*AT, F.col("parent").alias("next")), "up_")
        totals = totals.join(below, AT, "left").join(sized(above, 48), _same("up_"), "left").select(
            *AT, F.col("up_next").alias("parent"), (F.col("n_leaves") + F.coalesce("l", F.lit(0))).alias("n_leaves"), (F.col("saved") + F.coalesce("s", F.lit(0))).alias("saved")
        )
        totals = stored(totals, "trie-totals")
    return stored(nodes.drop("n_leaves", "saved").join(totals.drop("parent"), AT), "open-nodes")


def prefix_trie(turns: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """One row per node of the trie of (conv_id, depth, a, b, chars): conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Turns have depths 1, 2, ... without gaps in each conversation; a row of depth 0 stands for a conversation
    that may have none. conv_id is the smallest member; n_convs counts members; n_leaves and saved_tokens sum over the
    subtree, the latter (members - 1) times the code points of each node's text; ends_sha256 hashes the ids that end at
    the node. Without conversations there is no node.
    """
    rows = segments(turns, segment)
    order = ["seg", "start", "keys", "conv_id"]
    n = max(int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // FOREST_ROWS))
    dealt = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    forest = stored(dealt.mapInArrow(_forest(segment), FOREST), "forest")
    opened = open_nodes(forest)
    chunks = forest.where(F.col("kind") == ENDS).select(*AT, "conv_id", "ends")
    hashed = chunks.repartition(*AT).sortWithinPartitions(*AT, "conv_id").mapInArrow(_hash_ends, "depth long, a long, b long, ends string")
    parents = sized(_named(opened.select(*AT, "conv_id"), "up_"), 48)
    top = opened.join(hashed, AT, "left").join(parents, _same("up_"), "left").select(
        "conv_id", "depth", F.col("up_conv_id").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"),
        F.coalesce("ends", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )
    closed = forest.where(F.col("kind") == NODE)
    parent = F.when(F.col("parent_conv_id").isNull(), F.struct((F.col("depth") - 1).alias("depth"), F.col("parent_a").alias("a"), F.col("parent_b").alias("b")))
    closed = closed.select("*", parent.alias("parent")).join(parents, _same("up_"), "left").select(
        "conv_id", "depth", F.coalesce("parent_conv_id", "up_conv_id").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.col("ends").alias("ends_sha256")
    )
    return closed.unionByName(top)


def conversation_trie(conversations: DataFrame, every: int = 100, most: int = 6, segment: int = SEGMENT) -> DataFrame:
    """The trie of all rebuilt conversations; see numbered_turns, with_shared_heads and prefix_trie. Further columns are not read."""
    turns = stored(numbered_turns(conversations), "numbered-turns")
    return prefix_trie(with_shared_heads(turns, every, most), segment)
