"""Static range asymmetric numeral systems over arrays: blocks of symbols under one shared frequency table.

A block is LANES interleaved streams with one 64-bit state each, renormalised
by 32-bit words that all lanes share. Symbol ``i`` of a block belongs to lane
``i mod LANES``. Every STRIDE steps the encoder notes all states and the place
in the words, so that a reader may start there; ``decode`` starts at all of
them at once.
"""

from __future__ import annotations

import numpy as np

LANES, STRIDE, STEPS = 32, 256, 1024
BLOCK = LANES * STEPS
AT_ONCE = 64  # blocks that are coded side by side
_LOW, _WORD = np.uint64(1 << 31), np.uint64(32)


class Table:
    """Frequencies of symbols 0..n-1, scaled to a power of two in which each has a share."""

    def __init__(self, counts: np.ndarray):
        counts = np.asarray(counts, np.int64)
        if not len(counts) or counts.min() < 1:
            raise ValueError("each symbol of a table must occur")
        self.bits = min(28, max(16, int(len(counts)).bit_length() + 2))
        size = 1 << self.bits
        exact = counts.astype(np.float64) * ((size - len(counts)) / counts.sum())
        freq = 1 + np.floor(exact).astype(np.int64)
        spare = size - int(freq.sum())
        if spare > 0:
            order = np.lexsort((np.arange(len(counts)), -(exact - np.floor(exact))))
            freq += np.bincount(order[np.arange(spare) % len(order)], minlength=len(counts))
        elif spare < 0:
            freq[np.argmax(freq)] += spare
        self.freq = freq.astype(np.uint64)
        self.cum = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(counts), dtype=np.int32), freq)
        self.common = int(np.argmax(freq))


def encode(table: Table, codes: np.ndarray) -> list[tuple[int, bytes, bytes, bytes]]:
    """Blocks (symbols, states, places, words) of an array of symbols; ``states`` and ``places`` hold the checkpoints."""
    out = []
    whole = len(codes) // BLOCK
    for lo in range(0, whole, AT_ONCE):
        n = min(AT_ONCE, whole - lo)
        out += _encode(table, codes[lo * BLOCK:(lo + n) * BLOCK].reshape(n, STEPS, LANES), [BLOCK] * n)
    if rest := len(codes) - whole * BLOCK:
        steps = -(-rest // LANES)
        last = np.full(steps * LANES, table.common, codes.dtype)
        last[:rest] = codes[whole * BLOCK:]
        out += _encode(table, last.reshape(1, steps, LANES), [rest])
    return out


def _encode(table: Table, codes: np.ndarray, sizes: list[int]) -> list[tuple[int, bytes, bytes, bytes]]:
    n, steps, lanes = codes.shape
    bits, top = np.uint64(table.bits), np.uint64(63 - table.bits)
    x = np.full((n, lanes), _LOW, np.uint64)
    words, used = np.empty((n, steps * lanes), np.uint32), np.zeros(n, np.int64)
    base = (np.arange(n) * steps * lanes)[:, None]
    flat, states, places = words.reshape(-1), [], []
    for t in range(steps - 1, -1, -1):
        c = codes[:, t]
        f = table.freq[c]
        full = x >= (f << top)
        count = np.cumsum(full, axis=1)
        flat[(base + used[:, None] + count - 1)[full]] = x[full].astype(np.uint32)
        used = used + count[:, -1]
        x = np.where(full, x >> _WORD, x)
        whole = x // f
        x = (whole << bits) + (x - whole * f) + table.cum[c]
        if t % STRIDE == 0:
            states.append(x.copy())
            places.append(used.copy())
    states, places = np.stack(states[::-1], 1).astype("<u8"), np.stack(places[::-1], 1).astype("<u4")
    return [(sizes[b], states[b].tobytes(), places[b].tobytes(), words[b, :used[b]].astype("<u4").tobytes())
            for b in range(n)]


def decode(table: Table, blocks: list[tuple[int, bytes, bytes, bytes]]) -> list[np.ndarray]:
    """The symbols of blocks; every checkpoint of every block is read at the same time."""
    x, place, long, base, words = [], [], [], [], []
    before = 0
    for size, states, places, payload in blocks:
        s = np.frombuffer(states, "<u8").reshape(-1, LANES)
        steps = -(-size // LANES)
        x.append(s)
        place.append(np.frombuffer(places, "<u4").astype(np.int64))
        long.append([min(STRIDE, steps - k * STRIDE) for k in range(len(s))])
        base.append(np.full(len(s), before))
        words.append(np.frombuffer(payload, "<u4"))
        before += len(words[-1])
    x, place, base = np.concatenate(x).astype(np.uint64), np.concatenate(place), np.concatenate(base)
    long, words = np.concatenate(long), np.concatenate(words) if before else np.zeros(1, np.uint32)
    out = np.zeros((len(x), STRIDE, LANES), np.int32)
    bits, mask = np.uint64(table.bits), np.uint64((1 << table.bits) - 1)
    order = np.argsort(-long, kind="stable")  # so that those still at work are a prefix
    x, place, base, long = x[order], place[order], base[order], long[order]
    for t in range(int(long[0]) if len(long) else 0):
        live = int(np.searchsorted(-long, -t, "left"))
        y = x[:live]
        slot = y & mask
        s = table.symbol[slot.astype(np.int64)]
        out[:live, t] = s
        y = table.freq[s] * (y >> bits) + slot - table.cum[s]
        low = y < _LOW
        count = np.cumsum(low, axis=1)
        at = (base[:live] + place[:live] - count[:, -1])[:, None] + count - 1
        y[low] = (y[low] << _WORD) | words[at[low]].astype(np.uint64)
        place[:live] -= count[:, -1]
        x[:live] = y
    back = np.empty_like(out)
    back[order] = out
    parts, k = [], 0
    for size, states, _, _ in blocks:
        n = len(states) // (8 * LANES)
        parts.append(back[k:k + n].reshape(-1)[:size])
        k += n
    return parts
