"""Static range asymmetric numeral system (rANS) for token ids, in numpy.

A container holds the ids of consecutive documents. All its blocks share one frequency table. A block is coded
by itself: `lanes` interleaved coders share one stream of words, and every `stride` rounds there is a checkpoint
(place in the stream and the lanes' states) and over the whole a CRC-32 of the block's ids. Checkpoints let a
reader start anywhere, so here the stretches between checkpoints, of all blocks, are decoded side by side as the
rows of one array.

A state lies in [2^28, 2^52) and is renormalised by 24-bit words; frequencies sum to 2^SCALE. States stay below
2^53, so a rounded float64 quotient has the exact integer part. Encoding goes from a block's last id to its first,
decoding from the first to the last.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

SCALE = 20
LOW = 1 << 28
WORD = 24
LANES = 64
BLOCK = 1 << 16
STRIDE = 256
MAGIC = b"SQA1"
_HEAD = struct.Struct("<4sIIIIQ")
_BLOCK = struct.Struct("<IIII")


def frequencies(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(symbols that occur, their frequencies, each at least 1 and together 2^SCALE)."""
    if ids.max() < 1 << 20:
        counts = np.bincount(ids)
        symbols = np.flatnonzero(counts)
        counts = counts[symbols]
    else:
        symbols, counts = np.unique(ids, return_counts=True)
    if len(symbols) > 1 << (SCALE - 1):
        raise ValueError("more distinct ids than the frequency table can hold")
    freq = np.maximum(1, counts * float(1 << SCALE) // counts.sum()).astype(np.int64)
    over = int(freq.sum()) - (1 << SCALE)
    if over < 0:
        freq[np.argmax(freq)] -= over
    while over > 0:  # rare symbols that were rounded up are paid for by frequent ones
        order = np.argsort(-freq, kind="stable")
        take = np.minimum(freq[order] - 1, np.maximum(1, freq[order] // 8))
        take = np.minimum(take, np.maximum(0, over - (np.cumsum(take) - take)))
        freq[order] -= take
        over -= int(take.sum())
    return symbols.astype("<u4"), freq


def encode(ids: np.ndarray) -> bytes:
    """A container with these ids (unsigned, below 2^32); no ids give a container without blocks."""
    ids = np.ascontiguousarray(ids, "<u4")
    n = len(ids)
    if not n:
        return _HEAD.pack(MAGIC, 0, BLOCK, LANES, STRIDE, 0)
    symbols, freq = frequencies(ids)
    if symbols[-1] < 1 << 20:
        table = np.zeros(int(symbols[-1]) + 1, np.int32)
        table[symbols] = np.arange(len(symbols))
        rank = table[ids]
    else:
        rank = np.searchsorted(symbols, ids).astype(np.int32)
    blocks = -(-n // BLOCK)
    rounds = BLOCK // LANES if blocks > 1 else -(-n // LANES)
    size = np.minimum(rounds * LANES, n - np.arange(blocks) * BLOCK)
    padded = np.zeros(blocks * rounds * LANES, np.int32)
    padded[:n] = rank
    at = np.ascontiguousarray(padded.reshape(blocks, rounds, LANES).swapaxes(0, 1)).reshape(rounds, -1)
    fs, ss = freq, np.cumsum(freq) - freq
    ends = np.repeat(size, LANES) - np.tile(np.arange(LANES), blocks)
    full = int(size.min()) // LANES  # from this round on some lane may have ended
    x = np.full(blocks * LANES, LOW, np.int64)
    word = np.empty((rounds, blocks * LANES), np.int32)
    sent = np.empty((rounds, blocks * LANES), bool)
    states = np.zeros((-(-rounds // STRIDE), blocks * LANES), np.int64)
    for t in range(rounds - 1, -1, -1):
        k = at[t]
        f = fs[k]
        out = x >= f << (52 - SCALE)
        if t >= full:
            out &= t * LANES < ends
        sent[t] = out
        word[t] = x & ((1 << WORD) - 1)
        y = x >> (out * WORD)
        q = (y / f).astype(np.int64)
        q = y - q * f + (q << SCALE) + ss[k]
        x = q if t < full else np.where(t * LANES < ends, q, x)
        if t % STRIDE == 0:
            states[t // STRIDE] = x
    word, sent, states = (a.reshape(len(a), blocks, LANES) for a in (word, sent, states))
    counts = sent.sum(2)
    parts = [_HEAD.pack(MAGIC, blocks, BLOCK, LANES, STRIDE, n), struct.pack("<I", len(symbols)), symbols.tobytes(), freq.astype("<u4").tobytes()]
    for b in range(blocks):
        own = ids[b * BLOCK : (b + 1) * BLOCK]
        used = -(-len(own) // LANES)
        stream = word[:used, b][sent[:used, b]].astype("<u4")
        before = np.concatenate(([0], np.cumsum(counts[:used, b])))[:used:STRIDE].astype("<u4")
        parts += [_BLOCK.pack(len(own), len(before), len(stream), zlib.crc32(own.tobytes())), before.tobytes(), states[: len(before), b].astype("<i8").tobytes()]
        parts.append(stream.view(np.uint8).reshape(-1, 4)[:, :3].tobytes())
    return b"".join(parts)


def decode(data: bytes) -> np.ndarray:
    """The ids of a container; raises ValueError where a checksum or the layout does not hold."""
    magic, blocks, _, lanes, stride, n = _HEAD.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a container of token ids")
    if not blocks:
        return np.zeros(0, "<u4")
    at = _HEAD.size
    (m,) = struct.unpack_from("<I", data, at)
    symbols = np.frombuffer(data, "<u4", m, at + 4)
    freq = np.frombuffer(data, "<u4", m, at + 4 + 4 * m).astype(np.int64)
    at += 4 + 8 * m
    start = np.cumsum(freq) - freq
    slot = np.repeat(np.arange(m, dtype=np.int32), freq)
    heads, streams, places, states, left = [], [], [], [], []
    base = 0
    for _ in range(blocks):
        count, stretches, words, crc = _BLOCK.unpack_from(data, at)
        heads.append((count, stretches, crc))
        at += _BLOCK.size
        places.append(np.frombuffer(data, "<u4", stretches, at).astype(np.int64) + base)
        at += 4 * stretches
        states.append(np.frombuffer(data, "<i8", stretches * lanes, at).reshape(stretches, lanes))
        at += 8 * stretches * lanes
        stream = np.zeros((words, 4), np.uint8)
        stream[:, :3] = np.frombuffer(data, np.uint8, 3 * words, at).reshape(-1, 3)
        streams.append(stream.view("<u4").reshape(-1))
        at += 3 * words
        base += words
        left.append(count - np.arange(stretches) * stride * lanes)
    stream = np.append(np.concatenate(streams), np.zeros(1, "<u4")).astype(np.int64)
    pos, x = np.concatenate(places), np.concatenate(states).astype(np.int64)
    left = np.concatenate(left)
    full = int(left.min()) // lanes
    got = np.empty((stride, len(pos), lanes), np.int32)
    edges = np.arange(len(pos)) * lanes
    for t in range(stride):
        low = x & ((1 << SCALE) - 1)
        k = slot[low]
        got[t] = k
        y = freq[k] * (x >> SCALE) + low - start[k]
        need = y < LOW
        if t >= full:
            live = (t * lanes + np.arange(lanes)) < left[:, None]
            need &= live
            y = np.where(live, y, x)
        which = np.flatnonzero(need)  # in the order in which the words were sent
        sums = np.add.reduceat(need.view(np.int8).reshape(-1), edges, dtype=np.int64)
        word = np.arange(len(which)) + np.repeat(pos - (np.cumsum(sums) - sums), sums)
        flat = y.reshape(-1)
        flat[which] = (flat[which] << WORD) | stream[word]
        pos += sums
        x = y
    got = got.swapaxes(0, 1).reshape(-1)
    out = np.empty(n, "<u4")
    done = row = 0
    for count, stretches, crc in heads:
        own = symbols[got[row * stride * lanes :][:count]]
        if zlib.crc32(own.tobytes()) != crc:
            raise ValueError("a block's checksum does not hold")
        out[done : done + count] = own
        done += count
        row += stretches
    if done != n:
        raise ValueError("the blocks do not hold as many ids as the head says")
    return out
