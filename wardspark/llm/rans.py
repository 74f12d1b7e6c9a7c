"""Static range asymmetric numeral coding of token ids: independent interleaved blocks.

A segment of ids shares one frequency table. It is cut into blocks of BLOCK ids; a block is
coded by LANES interleaved states whose words go into one stream, so every block can be decoded
alone from its checkpoint (offset of its words, final states) and is guarded by a checksum.
All blocks of a segment advance together as one numpy vector.
"""

from __future__ import annotations

import zlib

import numpy as np

LANES = 64
BLOCK = 1 << 16
SCALE_BITS = 20
LOW = np.uint64(1 << 31)
U32 = np.uint64(32)
WORD = np.uint64(0xFFFFFFFF)


class CorruptBlock(ValueError):
    """A block whose words or ids do not match their checksum."""


def frequency_table(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols that occur and their frequencies, scaled to sum to 2**SCALE_BITS with each at least 1."""
    counts = np.bincount(ids)
    symbols = np.flatnonzero(counts)
    c = counts[symbols]
    total = 1 << SCALE_BITS
    if len(symbols) > total // 2:
        raise ValueError("too many symbols for the table")
    freqs = np.maximum(1, c * total // c.sum())
    over = int(freqs.sum()) - total
    by_size = np.argsort(-freqs, kind="stable")
    if over < 0:
        freqs[by_size[0]] -= over
    while over > 0:  # take from the largest, never below 1
        take = np.minimum(freqs[by_size] - 1, max(1, over // 8))
        taken = np.minimum(take, np.maximum(0, over - (np.cumsum(take) - take)))
        freqs[by_size] -= taken
        over -= int(taken.sum())
    return symbols.astype(np.uint32), freqs.astype(np.uint32)


def _shape(n: int) -> tuple[int, int, int]:
    """Blocks, steps of a full block, steps of the last block, for n > 0 ids."""
    blocks = -(-n // BLOCK)
    last = -(-(n - (blocks - 1) * BLOCK) // LANES)
    return blocks, (BLOCK // LANES if blocks > 1 else last), last


def _grid(x: np.ndarray, blocks: int, steps: int) -> np.ndarray:
    """(blocks * steps * LANES) in order of ids to (steps, blocks * LANES)."""
    return x.reshape(blocks, steps, LANES).transpose(1, 0, 2).reshape(steps, blocks * LANES)


def encode_segment(ids: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """(table, checkpoints, payload) of a non-empty array of ids."""
    n = len(ids)
    symbols, freqs = frequency_table(ids)
    starts = np.cumsum(freqs, dtype=np.uint64) - freqs
    rank = np.zeros(int(symbols[-1]) + 1, np.uint32)
    rank[symbols] = np.arange(len(symbols), dtype=np.uint32)
    blocks, steps, last = _shape(n)
    padded = np.full(blocks * steps * LANES, int(np.argmax(freqs)), np.uint32)
    padded[:n] = rank[ids]
    grid = _grid(padded, blocks, steps)
    f64 = freqs.astype(np.uint64)
    bits, room = np.uint64(SCALE_BITS), np.uint64(63 - SCALE_BITS)
    state = np.full(blocks * LANES, LOW, np.uint64)
    words = np.zeros(grid.shape, np.uint32)
    wrote = np.zeros(grid.shape, bool)
    for t in range(steps - 1, -1, -1):
        k = (blocks if t < last else blocks - 1) * LANES
        s = grid[t, :k]
        f, x = f64[s], state[:k]
        full = x >= (f << room)
        words[t, :k] = (x & WORD).astype(np.uint32)
        wrote[t, :k] = full
        x = np.where(full, x >> U32, x)
        q = x // f
        state[:k] = (q << bits) + (x - q * f) + starts[s]
    streams = []
    for b in range(blocks):
        lanes = slice(b * LANES, (b + 1) * LANES)
        rows = steps if b < blocks - 1 else last
        streams.append(words[:rows, lanes][wrote[:rows, lanes]].astype("<u4").tobytes())
    flat = np.asarray(ids, "<u4")
    sizes = np.array([len(s) // 4 for s in streams], "<u4")
    sums = np.array([[zlib.crc32(s), zlib.crc32(flat[b * BLOCK : (b + 1) * BLOCK].tobytes())] for b, s in enumerate(streams)], "<u4")
    table = zlib.compress(np.diff(symbols, prepend=np.uint32(0)).astype("<u4").tobytes() + freqs.astype("<u4").tobytes(), 6)
    return table, sizes.tobytes() + sums.tobytes() + state.astype("<u8").tobytes(), b"".join(streams)


def decode_segment(n: int, table: bytes, checkpoints: bytes, payload: bytes, first: int = 0, stop: int | None = None) -> np.ndarray:
    """Ids of blocks first to stop of a segment of n ids; a subset of blocks reads only its own words."""
    both = np.frombuffer(zlib.decompress(table), "<u4")
    symbols, freqs = np.cumsum(both[: len(both) // 2], dtype=np.uint32), both[len(both) // 2 :]
    total, _, _ = _shape(n)
    sizes = np.frombuffer(checkpoints, "<u4", total)
    sums = np.frombuffer(checkpoints, "<u4", 2 * total, 4 * total).reshape(total, 2)
    states = np.frombuffer(checkpoints, "<u8", total * LANES, 12 * total).reshape(total, LANES)
    stop = total if stop is None else min(stop, total)
    if first >= stop:
        return np.zeros(0, np.uint32)
    offsets = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    stream = np.frombuffer(payload, "<u4", int(offsets[stop] - offsets[first]), 4 * int(offsets[first]))
    n_part = min(n, stop * BLOCK) - first * BLOCK
    blocks, steps, last = _shape(n_part)
    for b in range(blocks):
        at = offsets[first + b] - offsets[first]
        if zlib.crc32(stream[at : at + sizes[first + b]].tobytes()) != sums[first + b, 0]:
            raise CorruptBlock(f"words of block {first + b}")
    f64 = freqs.astype(np.uint64)
    starts = np.cumsum(f64, dtype=np.uint64) - f64
    slot_rank = np.repeat(np.arange(len(freqs), dtype=np.uint32), freqs)
    x_all = states[first:stop].reshape(-1).astype(np.uint64)
    at = (offsets[first:stop] - offsets[first]).astype(np.int64)
    out = np.zeros((steps, blocks * LANES), np.uint32)
    bits, mask = np.uint64(SCALE_BITS), np.uint64((1 << SCALE_BITS) - 1)
    stream = np.append(stream, np.uint32(0)).astype(np.uint64)  # a place for lanes that read nothing
    for t in range(steps):
        b = blocks if t < last else blocks - 1
        x = x_all[: b * LANES]
        slot = x & mask
        s = slot_rank[slot]
        out[t, : b * LANES] = s
        x = f64[s] * (x >> bits) + slot - starts[s]
        short = (x < LOW).reshape(b, LANES)
        order = np.cumsum(short, axis=1)
        pos = np.where(short, at[:b, None] + order - 1, len(stream) - 1)
        x_all[: b * LANES] = np.where(short.reshape(-1), (x << U32) | stream[pos].reshape(-1), x)
        at[:b] += order[:, -1]
    ranks = out.reshape(steps, blocks, LANES).transpose(1, 0, 2).reshape(-1)[:n_part]
    ids = symbols[ranks]
    for b in range(blocks):
        if zlib.crc32(ids[b * BLOCK : (b + 1) * BLOCK].astype("<u4").tobytes()) != sums[first + b, 1]:
            raise CorruptBlock(f"ids of block {first + b}")
    return ids
