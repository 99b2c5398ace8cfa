"""A byte model of bit predictors in hashed contexts, mixed online by gated weights (numpy, per worker)."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

#: Bytes before the predicted one that the hashed predictors see; the first predictor sees a code's context.
ORDERS = (3, 5)
SLOT_BITS = 22
SLOTS = 1 << SLOT_BITS
#: Pairs of bytes before that have a code of their own; other bytes share the code of the one byte before.
OWN_CODES = 400
#: Closes a text: no UTF-8 text has this byte.
END = 0xFF
#: Stretched probabilities (log odds) are kept in steps of 1 / SCALE, up to 127 of them.
SCALE = 16.0
DOUBT = 0.4
#: Bits after which a text's weights move, and how far.
BLOCK = 256
RATE = 1.0
#: Weights at a text's begin. First predictor while no, the shorter, the longer hashed context is known; the shorter
#: one alone and under the longer; the longer.
BEGIN = np.array([1.0, 0.35, 0.1, 0.75, 0.35, 0.7], np.float32)
#: Bytes that are turned into bits at a time.
CHUNK = 1 << 20


@dataclass(frozen=True)
class Code:
    """``context`` of two bytes before; by (context, byte), where its path begins in ``path`` and its length.

    A path lists ``node * 2 + bit``; nodes are numbered through all contexts.
    """

    context: np.ndarray
    start: np.ndarray
    length: np.ndarray
    path: np.ndarray

    @property
    def nodes(self) -> int:
        return len(self.start)


def _paths(weights: np.ndarray) -> list[list[tuple[int, int]]]:
    """Of each byte: ``(inner node, bit)`` from the root of a Huffman tree. Every byte has a path."""
    heap = [(w + 1e-3, s) for s, w in enumerate(weights.tolist())]
    heapq.heapify(heap)
    parent, side = [0] * 511, [0] * 511
    for new in range(256, 511):
        (wa, a), (wb, b) = heapq.heappop(heap), heapq.heappop(heap)
        parent[a], parent[b], side[b] = new, new, 1
        heapq.heappush(heap, (wa + wb, new))
    found: list[list[tuple[int, int]]] = [[] for _ in range(511)]
    for at in range(509, -1, -1):
        found[at] = [*found[parent[at]], (parent[at] - 256, side[at])]
    return found[:256]


def prefix_code(triples: np.ndarray) -> Code:
    """Huffman codes from counts ``[two bytes before, byte]``, so that likely bytes take few bits to predict."""
    seen = triples.sum(1)
    own = np.sort(np.argsort(-seen, kind="stable")[:OWN_CODES])
    context = np.arange(1 << 16) & 0xFF
    context[own] = 256 + np.arange(len(own))
    tables = np.concatenate([triples.reshape(256, 256, 256).sum(0), triples[own]])
    start, length, path = [], [], []
    for c, weights in enumerate(tables):
        for steps in _paths(weights):
            start.append(len(path))
            length.append(len(steps))
            path.extend((c << 8 | node) << 1 | bit for node, bit in steps)
    return Code(context, np.array(start), np.array(length), np.array(path, np.uint32))


def keys(data: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Of each position: its byte and the five before it, the nearest lowest; zeros before a text's begin."""
    return _packed(data, heads, max(ORDERS))


def _packed(data: np.ndarray, heads: np.ndarray, depth: int, kind=np.uint64) -> np.ndarray:
    """Each position's byte and the ``depth`` before it, the nearest lowest, zeros before a text's begin.

    Bytes are masked while they are bytes, and widened once each.
    """
    out = data.astype(kind)
    for back in range(1, depth + 1):
        if back >= len(data):
            break
        part = data[:-back] * (heads[back:] >= back)
        out[back:] |= part.astype(kind) << kind(8 * back)
    return out


def bit_slots(found: np.ndarray, code: Code) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """``(bits of each key, bit values, slots by predictor)`` of ``keys``, bit after bit."""
    pair = code.context[((found >> np.uint64(8)) & np.uint64(0xFFFF)).astype(np.int64)] << 8
    pair |= (found & np.uint64(0xFF)).astype(np.int64)
    length = code.length[pair]
    ends = np.cumsum(length)
    place = np.repeat(code.start[pair] - (ends - length), length)
    place += np.arange(len(place))
    step = code.path[place]
    node = step >> np.uint32(1)
    slots, spread = [node], node * np.uint32(0x9E3779B1)
    for order in ORDERS:
        before = (found >> np.uint64(8)) & np.uint64((1 << 8 * order) - 1)
        h = ((before * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)
        mixed = np.repeat(h, length)
        mixed ^= spread
        mixed *= np.uint32(0x85EBCA6B)
        mixed ^= mixed >> np.uint32(13)
        mixed *= np.uint32(0xC2B2AE35)
        slots.append(mixed >> np.uint32(32 - SLOT_BITS))
    return length, (step & np.uint32(1)).astype(np.uint8), slots


def laid_out(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of texts with their end bytes, each byte's distance from its text's begin, and the texts' lengths."""
    sizes = np.array([len(t) + 1 for t in texts])
    data = np.frombuffer(b"".join(t + bytes([END]) for t in texts), np.uint8)
    return data, np.arange(len(data)) - np.repeat(np.cumsum(sizes) - sizes, sizes), sizes


def chunks(texts: list[bytes], limit: int = CHUNK) -> Iterator[list[int]]:
    """Numbers of texts, in lists of about ``limit`` bytes."""
    part, size = [], 0
    for i, text in enumerate(texts):
        part.append(i)
        size += len(text) + 1
        if size >= limit:
            yield part
            part, size = [], 0
    if part:
        yield part


def triple_counts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """``(two bytes before * 256 + byte, count)`` of what occurs."""
    data, heads, _ = laid_out(texts)
    found, n = np.unique(_packed(data, heads, 2, np.uint32), return_counts=True)
    return found, n


def count_bits(texts: list[bytes], code: Code, counts: list[np.ndarray]) -> None:
    """Adds the texts' bits to ``counts``, by predictor, at ``slot * 2 + bit``. Equal keys are counted together."""
    data, heads, _ = laid_out(texts)
    found, n = np.unique(keys(data, heads), return_counts=True)
    for at in range(0, len(found), CHUNK):
        part = slice(at, at + CHUNK)
        length, bits, slots = bit_slots(found[part], code)
        weights = np.repeat(n[part].astype(np.int32), length)
        for into, slot in zip(counts, slots, strict=True):
            np.add.at(into, (slot.astype(np.int64) << 1) | bits, weights)


def new_counts(code: Code) -> list[np.ndarray]:
    return [np.zeros(2 * n, np.int32) for n in (code.nodes, *(SLOTS for _ in ORDERS))]


def stretch(counts: np.ndarray) -> np.ndarray:
    """Log odds of a one in each slot, in whole steps; 0 where a slot was never seen."""
    odds = np.log((counts[1::2] + DOUBT) / (counts[::2] + DOUBT))
    return np.clip(np.rint(odds * SCALE), -127, 127).astype(np.int8)


def log_losses(texts: list[bytes], code: Code, tables: list[np.ndarray]) -> np.ndarray:
    """Natural-log loss of each text with its end, by mixing that adapts to each text alone.

    Texts advance side by side, a block of bits at a time. The gate is the longest context that is known; its weights
    mix a bit's predictions, and after a block they move by the error that it left. What is mixed and summed for a
    text does not depend on the texts beside it.
    """
    out = np.zeros(len(texts))
    for part in chunks(texts):
        out[part] = _chunk_losses([texts[i] for i in part], code, tables)
    return out


def _chunk_losses(texts: list[bytes], code: Code, tables: list[np.ndarray]) -> np.ndarray:
    data, heads, sizes = laid_out(texts)
    length, bits, slots = bit_slots(keys(data, heads), code)
    counts = np.add.reduceat(length, np.cumsum(sizes) - sizes)
    blocks = -(-counts // BLOCK)
    first = np.cumsum(blocks) - blocks
    # three predictions and the bit's sign in four bytes, each text from the begin of a block of its own
    packed = np.empty((len(bits), 4), np.int8)
    for i, (table, slot) in enumerate(zip(tables, slots, strict=True)):
        packed[:, i] = table[slot]
    packed[:, 3] = bits * 2
    packed[:, 3] -= 1
    rows = np.zeros(int(blocks.sum()) * BLOCK, np.uint32)
    shift = first * BLOCK - (np.cumsum(counts) - counts)
    rows[np.arange(len(bits)) + np.repeat(shift, counts)] = packed.view(np.uint32)[:, 0]
    rows = rows.reshape(-1, BLOCK)

    order = np.argsort(-blocks, kind="stable")
    left, weights, loss = blocks[order], np.repeat(BEGIN[None] / np.float32(SCALE), len(texts), 0), np.zeros(len(texts))
    for k in range(int(left[0])):
        active = int(np.searchsorted(-left, -k, side="left"))
        x = rows[first[order[:active]] + k].view(np.int8).reshape(active, BLOCK, 4)
        a, b, c = (x[:, :, i].astype(np.float32) for i in range(3))
        sign = x[:, :, 3].astype(np.float32)
        long, short = c != 0, b != 0
        short &= ~long
        features = (a * ~(long | short), a * short, a * long, b * short, b * long, c)
        w = weights[:active]
        z = features[0] * w[:, 0, None]
        for i in range(1, len(features)):
            z += features[i] * w[:, i, None]
        z *= sign
        np.clip(z, -10, 10, out=z)
        p = np.exp(np.negative(z, out=z), out=z)
        p += 1
        np.reciprocal(p, out=p)
        loss[:active] -= (np.log(p) * (sign != 0)).sum(1, dtype=np.float64)
        error = (1 - p) * sign * np.float32(RATE / BLOCK / SCALE / SCALE)
        for i, f in enumerate(features):
            w[:, i] += np.einsum("db,db->d", error, f)
    out = np.empty(len(texts))
    out[order] = loss
    return out
