"""Simple-8b: unsigned integers in 64-bit words whose top four bits select how many share a word.

Selector 0 is an escape: the word holds an index into the block's list of raw values (those of
more than 60 bits). Selector 1 is a run: 28 bits of length, 32 bits of value. The others follow
``LAYOUTS``. A block is

    magic "S8B1", number of ids (u64), words, raw values, frames (u32 each),
    frames: ids before each ``FRAME`` words (u32), words (u64), raw values (u64)

all little-endian. The frame offsets let a reader decode any id range without the words before it,
and every step of decoding works on whole arrays.
"""

from __future__ import annotations

import struct

import numpy as np

# Fixed values of the format: ids per word and bits per id, for selectors 2 to 15.
LAYOUTS = [(60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60)]
COUNTS = np.array([1, 0, *(n for n, _ in LAYOUTS)])
FRAME = 128
HEAD = "<4sQIII"
MAGIC = b"S8B1"


def _selectors(bits: np.ndarray) -> np.ndarray:
    """For each place the selector that holds most ids from there on, 0 if none does.

    What fits a layout also fits the wider ones of fewer ids, so the search ends at the first that fits nowhere.
    """
    chosen = np.zeros(len(bits), np.uint8)
    doubled = {1: bits}
    for selector in range(15, 1, -1):
        n, width = LAYOUTS[selector - 2]
        if n > len(bits):
            break
        half = 1 << (n.bit_length() - 1)
        if half not in doubled:
            last = doubled[half // 2]
            doubled[half] = np.maximum(last[: len(last) - half // 2], last[half // 2 :])
        # The most bits among the n values from each place on.
        most = np.maximum(doubled[half][: len(bits) - n + 1], doubled[half][n - half :])
        fits = most <= width
        if not fits.any():
            break
        chosen[: len(fits)][fits] = selector
    return chosen


def encode(ids: np.ndarray) -> bytes:
    """One block. Each word takes as many ids as any selector can hold from there on."""
    ids = np.ascontiguousarray(ids, dtype=np.uint64)
    total = len(ids)
    if total == 0:
        return struct.pack(HEAD, MAGIC, 0, 0, 0, 0)
    bits = np.frexp(ids.astype(np.float64))[1].astype(np.uint8)
    chosen = _selectors(bits)
    count = COUNTS[chosen]
    ends = np.flatnonzero(ids[1:] != ids[:-1]) + 1
    ends = np.append(ends, total)
    run = np.repeat(ends, np.diff(ends, prepend=0)) - np.arange(total)
    runs = (run > count) & (bits <= 32)
    count[runs], chosen[runs] = np.minimum(run[runs], (1 << 28) - 1), 1

    steps, at, starts = count.tolist(), 0, []
    while at < total:
        starts.append(at)
        at += steps[at]
    starts = np.array(starts)
    picked = chosen[starts]
    words = picked.astype(np.uint64) << np.uint64(60)
    raw = ids[starts[picked == 0]]
    words[picked == 0] |= np.arange(len(raw), dtype=np.uint64)
    alike = starts[picked == 1]
    words[picked == 1] |= (count[alike].astype(np.uint64) << np.uint64(32)) | ids[alike]
    for selector, (n, width) in enumerate(LAYOUTS, 2):
        mine = np.flatnonzero(picked == selector)
        if len(mine):
            shifts = np.arange(n, dtype=np.uint64) * np.uint64(width)
            words[mine] |= np.bitwise_or.reduce(ids[starts[mine][:, None] + np.arange(n)] << shifts, axis=1)
    frames = starts[::FRAME].astype("<u4")
    return struct.pack(HEAD, MAGIC, total, len(words), len(raw), len(frames)) + frames.tobytes() + words.astype("<u8").tobytes() + raw.astype("<u8").tobytes()


def decode(block: bytes, start: int = 0, stop: int | None = None) -> np.ndarray:
    """The ids from ``start`` to ``stop`` of a block; only the frames that hold them are unpacked."""
    magic, total, n_words, n_raw, n_frames = struct.unpack_from(HEAD, block)
    if magic != MAGIC:
        raise ValueError("not a block of this format")
    stop = total if stop is None else min(stop, total)
    if start >= stop:
        return np.empty(0, np.uint64)
    at = struct.calcsize(HEAD)
    frames = np.frombuffer(block, "<u4", n_frames, at)
    words = np.frombuffer(block, "<u8", n_words, at + 4 * n_frames)
    raw = np.frombuffer(block, "<u8", n_raw, at + 4 * n_frames + 8 * n_words)
    first = int(np.searchsorted(frames, start, side="right")) - 1
    last = int(np.searchsorted(frames, stop, side="left"))
    words = words[first * FRAME : last * FRAME]
    selector = (words >> np.uint64(60)).astype(np.int64)
    sizes = COUNTS[selector]
    alike = np.flatnonzero(selector == 1)
    sizes[alike] = (words[alike] >> np.uint64(32)) & np.uint64((1 << 28) - 1)
    places = np.cumsum(sizes) - sizes
    out = np.empty(int(sizes.sum()), np.uint64)
    escaped = selector == 0
    out[places[escaped]] = raw[(words[escaped] & np.uint64((1 << 60) - 1)).astype(np.int64)]
    for i in alike.tolist():
        out[places[i] : places[i] + sizes[i]] = words[i] & np.uint64(0xFFFFFFFF)
    for s, (n, width) in enumerate(LAYOUTS, 2):
        mine = np.flatnonzero(selector == s)
        if len(mine):
            shifts = np.arange(n, dtype=np.uint64) * np.uint64(width)
            out[places[mine][:, None] + np.arange(n)] = (words[mine][:, None] >> shifts) & np.uint64((1 << width) - 1)
    base = int(frames[first])
    return out[start - base : stop - base]
