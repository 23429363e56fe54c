"""Simple-8b: a selector in the top four bits of a 64-bit word says how many ids the other 60 bits hold.

Selectors 0 and 1 stand for runs of 240 and 120 zeros, 2 to 14 pack 60 to 2 ids, 15 is an escape: the next word holds
one id of over 30 bits as it is. Encoding finds for each position the longest selector that fits (by ANDs of doubled
windows) and follows the chain of words. Blocks begin at word borders; their offsets let a
block be decoded by itself. Decoding expands all words of a selector at once.
"""

from __future__ import annotations

import numpy as np

#: Ids in a word and bits of each, by selector.
COUNTS = (240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2)
BITS = (0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30)
ESCAPE = 15
_STEPS = np.array([*COUNTS, 1])


def _selectors(ids: np.ndarray) -> np.ndarray:
    """For each position the selector of the word that would begin there (fewer ids are left at the end)."""
    n = len(ids)
    selector = np.full(n, ESCAPE, np.uint8)
    # What fits a selector also fits the wider ones, so each that fits lowers the number by one.
    for count, bits in zip(reversed(COUNTS), reversed(BITS), strict=True):
        fits, have = np.ones(n + count, bool), 1
        np.less(ids, 1 << bits, out=fits[:n])
        while 2 * have <= count:
            fits, have = fits[:-have] & fits[have:], 2 * have
        if count > have:
            fits = fits[: have - count] & fits[count - have :]
        if not fits[:n].any():
            break
        selector -= fits[:n]
    return selector


def _chain(step: np.ndarray) -> np.ndarray:
    """The positions 0, step[0], ... up to the end; sixteen words a turn."""
    n = len(step)
    jump = np.minimum(np.arange(n + 1) + np.append(step, 0), n).astype(np.int32 if n < 1 << 31 else np.int64)
    far = jump
    for _ in range(4):
        far = far[far]
    far, at, turns = far.tolist(), 0, []
    while at < n:
        turns.append(at)
        at = far[at]
    rows = [np.array(turns)]
    for _ in range(15):
        rows.append(jump[rows[-1]])
    starts = np.stack(rows, axis=1).ravel()
    return starts[starts < n].astype(np.int64)


def encode_blocks(ids: np.ndarray, block: int = 1 << 62) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words (uint64) of the ids, and for blocks of at least `block` ids each (the last may be shorter) the ids and the
    words before them, with the totals at the end. The last word may have room left."""
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64), np.zeros(1, np.int64)
    selector = _selectors(ids)
    ids = np.ascontiguousarray(ids, np.uint64)
    starts = _chain(_STEPS[selector])
    chosen = selector[starts]
    escaped = chosen == ESCAPE
    place = np.arange(len(starts)) + np.concatenate(([0], np.cumsum(escaped)[:-1]))
    words = np.zeros(len(starts) + int(escaped.sum()), np.uint64)
    words[place] = chosen.astype(np.uint64) << np.uint64(60)
    padded = np.concatenate((ids, np.zeros(max(COUNTS), np.uint64)))
    for s in np.unique(chosen).tolist():
        at = np.flatnonzero(chosen == s)
        if s == ESCAPE:
            words[place[at] + 1] = ids[starts[at]]
        elif BITS[s]:
            first, packed = starts[at], words[place[at]]
            for k in range(COUNTS[s]):
                packed |= padded[first + k] << np.uint64(k * BITS[s])
            words[place[at]] = packed
    heads = np.unique(np.searchsorted(starts, np.arange(0, n, min(block, n)))) if block < n else np.zeros(1, np.int64)
    heads = heads[heads < len(starts)]
    return words, np.append(starts[heads], n), np.append(place[heads], len(words))


def encode(ids: np.ndarray) -> np.ndarray:
    """Words of the ids; the reader has to know how many there are."""
    return encode_blocks(ids)[0]


def decode(words: np.ndarray, n: int) -> np.ndarray:
    """The n ids (uint64) that the words hold."""
    out = np.zeros(n + max(COUNTS), np.uint64)
    if not n:
        return out[:0]
    words = np.ascontiguousarray(words, np.uint64)
    selector = (words >> np.uint64(60)).astype(np.uint8)
    raw = np.zeros(len(words), bool)
    if (selector == ESCAPE).any():  # a raw word follows each escape and may look like one
        at = 0
        escapes = np.flatnonzero(selector == ESCAPE).tolist()
        for e in escapes:
            if e >= at:
                raw[e + 1], at = True, e + 2
    head = np.flatnonzero(~raw)
    selector = selector[head]
    start = np.concatenate(([0], np.cumsum(_STEPS[selector])[:-1]))
    for s in np.unique(selector).tolist():
        at = np.flatnonzero(selector == s)
        if s == ESCAPE:
            out[start[at]] = words[head[at] + 1]
        elif BITS[s]:
            held, first, mask = words[head[at]], start[at], np.uint64((1 << BITS[s]) - 1)
            for k in range(COUNTS[s]):
                out[first + k] = (held >> np.uint64(k * BITS[s])) & mask
    return out[:n]
