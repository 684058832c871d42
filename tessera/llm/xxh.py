"""XXH64 of many byte ranges of one buffer at once, and the bits that most of a group share."""

from __future__ import annotations

import numpy as np

# fixed values: the primes of XXH64
P1, P2, P3, P4, P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
#: Ranges of at least so many bytes are hashed one by one.
LONG = 256


def turn(x: np.ndarray, n: int) -> np.ndarray:
    return (x << np.uint64(n)) | (x >> np.uint64(64 - n))


def lane(acc: np.ndarray, value: np.ndarray) -> np.ndarray:
    return turn(acc + value * P2, 31) * P1


def hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """XXH64 of buf[start:end] for each range; ranges of one length go together."""
    from xxhash import xxh64_intdigest

    out = np.zeros(len(starts), np.uint64)
    if not len(starts):
        return out
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    words = np.ndarray((len(buf) + 1,), "<u8", padded, strides=(1,))
    halves = np.ndarray((len(buf) + 1,), "<u4", padded, strides=(1,))
    length = ends - starts
    order = np.argsort(length, kind="stable")
    cuts = np.flatnonzero(np.diff(length[order])) + 1
    for index in np.split(order, cuts):
        n = int(length[index[0]])
        if n >= LONG:
            out[index] = [xxh64_intdigest(buf[a : a + n].tobytes(), seed) for a in starts[index].tolist()]
        else:
            out[index] = of_length(padded, words, halves, starts[index], n, np.uint64(seed))
    return out


def of_length(buf: np.ndarray, words: np.ndarray, halves: np.ndarray, at: np.ndarray, n: int, seed: np.uint64) -> np.ndarray:
    end = at + n
    with np.errstate(over="ignore"):
        if n >= 32:
            accs = [np.full(len(at), x) for x in (seed + P1 + P2, seed + P2, seed, seed - P1)]
            for _ in range(n // 32):
                accs = [lane(a, words[at + 8 * i]) for i, a in enumerate(accs)]
                at = at + 32
            h = turn(accs[0], 1) + turn(accs[1], 7) + turn(accs[2], 12) + turn(accs[3], 18)
            for a in accs:
                h = (h ^ lane(np.uint64(0), a)) * P1 + P4
        else:
            h = np.full(len(at), seed + P5)
        h = h + np.uint64(n)
        for _ in range(n % 32 // 8):
            h = turn(h ^ lane(np.uint64(0), words[at]), 27) * P1 + P4
            at = at + 8
        if n % 8 >= 4:
            h = turn(h ^ (halves[at].astype(np.uint64) * P1), 23) * P2 + P3
            at = at + 4
        for i in range(n % 4):
            h = turn(h ^ (buf[end - n % 4 + i].astype(np.uint64) * P5), 11) * P1
        h = (h ^ (h >> np.uint64(33))) * P2
        h = (h ^ (h >> np.uint64(29))) * P3
        return h ^ (h >> np.uint64(32))


BYTES = np.uint64(0x0101010101010101)


def majority(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each group of values (from ``first`` to the next, one value at least): the bits set in over half of them."""
    size = np.diff(np.append(first, len(h)))
    # sums of eight bits at a time, in the bytes of a number: 255 values fit
    chunks = -(-size // 255)
    owner = np.repeat(np.arange(len(first)), chunks)
    inner = np.arange(len(owner)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
    at = first[owner] + 255 * inner
    counts = np.zeros((len(at), 8, 8), np.uint8)
    for j in range(8):
        counts[:, :, j] = np.add.reduceat((h >> np.uint64(j)) & BYTES, at).view(np.uint8).reshape(-1, 8)
    total = np.add.reduceat(counts.reshape(-1, 64), np.cumsum(chunks) - chunks, axis=0, dtype=np.int64)
    return np.packbits(2 * total > size[:, None], axis=1, bitorder="little").view("<u8").ravel()
