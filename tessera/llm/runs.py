"""Front-coded sorted runs of strings and their merge with an LCP loser tree."""

from __future__ import annotations

import struct
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa


def common(x: bytes, y: bytes) -> int:
    """Length of the longest common prefix."""
    n = min(len(x), len(y))
    differ = int.from_bytes(x[:n], "big") ^ int.from_bytes(y[:n], "big")
    return n - (differ.bit_length() + 7) // 8


def front_code(strings: list[bytes], first: int) -> bytes:
    """A sorted run: for each string what it shares with the one before, and the rest. Ids count up from ``first``."""
    shared, rests, before = np.zeros(len(strings), "<u4"), [], b""
    for i, s in enumerate(strings):
        shared[i] = k = common(before, s)
        rests.append(s[k:])
        before = s
    lengths = np.array([len(r) for r in rests], "<u4")
    body = shared.tobytes() + lengths.tobytes() + b"".join(rests)
    return struct.pack("<QII", len(body), len(strings), first) + pa.compress(body, codec="zstd", asbytes=True)


def first_id(data: bytes) -> int:
    return struct.unpack_from("<QII", data)[2]


def decode(data: bytes) -> Iterator[tuple[int, bytes, int]]:
    """(shared with the string before, string, id) of a run, in order."""
    size, n, first = struct.unpack_from("<QII", data)
    body = pa.decompress(memoryview(data)[16:], decompressed_size=size, codec="zstd", asbytes=True)
    shared = np.frombuffer(body, "<u4", n).tolist()
    at, before = 8 * n, b""
    for i, length in enumerate(np.frombuffer(body, "<u4", n, 4 * n).tolist()):
        before = before[: shared[i]] + body[at : at + length]
        at += length
        yield shared[i], before, first + i


def merge(runs: list[Iterator[tuple[int, bytes, int]]]) -> Iterator[tuple[int, bytes, int, int]]:
    """(shared with the string put out before, string, run, id) of all runs, in order.

    Every run holds its current string and what that shares with the last string
    put out. Of two runs the one that shares more comes first, and no byte is
    looked at; only if both share as much are bytes compared, from there on. The
    loser then keeps what it shares with the winner, which is put out before it.
    """
    size = 1
    while size < len(runs):
        size *= 2
    current: list[bytes] = [b""] * size
    ids, shares = [0] * size, [-1] * size  # -1: at its end

    def advance(r: int) -> None:
        nxt = next(runs[r], None) if r < len(runs) else None
        if nxt is None:
            shares[r] = -1
        else:
            shares[r], current[r], ids[r] = nxt

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser."""
        x, y = shares[a], shares[b]
        if x != y:
            return (a, b) if x > y else (b, a)
        if x < 0:
            return a, b
        s, t = current[a][x:], current[b][x:]
        more = common(s, t)
        if s <= t:
            shares[b] = x + more
            return a, b
        shares[a] = x + more
        return b, a

    for r in range(size):
        advance(r)
    losers, level = [0] * size, list(range(size))
    at = size
    while len(level) > 1:
        at //= 2
        winners = []
        for i in range(0, len(level), 2):
            w, losers[at + i // 2] = play(level[i], level[i + 1])
            winners.append(w)
        level = winners
    top = level[0]
    while shares[top] >= 0:
        yield shares[top], current[top], top, ids[top]
        advance(top)
        node = (top + size) // 2
        while node:
            top, losers[node] = play(top, losers[node])
            node //= 2


def repeated(runs: list[bytes], names: Callable[[int, int], Iterable[int]] | None = None, met: Counter | None = None) -> list[list[int]]:
    """Per run, the ids of strings that begin another string of any run, or equal one.

    ``names`` gives the names of a string by run and id; ``met`` then counts, for each
    name, the different strings that go by it.
    """
    found: list[set[int]] = [set() for _ in runs]
    length, owner, name = -1, 0, 0
    here: set[int] = set()
    for share, s, r, i in merge([decode(x) for x in runs]):
        if 0 <= length <= share:
            found[owner].add(name)
        if share >= len(s):
            found[r].add(i)
        if names is not None:
            if not share == len(s) == length:
                met.update(here)
                here = set()
            here.update(names(r, i))
        length, owner, name = len(s), r, i
    if names is not None:
        met.update(here)
    return [sorted(x) for x in found]
