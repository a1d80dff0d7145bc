"""Words and rolling hashes of many texts at once, on the bytes of an Arrow column.

Everything is numpy over one flat byte array. A word is a run of bytes other
than ASCII white space, as UTF-8 never uses those bytes inside a character.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from tidegauge.llm.common import worker_state

#: Odd multiplier of the rolling hash and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: Bytes of text that are worked on at once; the arrays beside them take about 40 times as much.
SLICE_BYTES = 1 << 20


def _is_space() -> np.ndarray:
    out = np.zeros(256, bool)
    out[[0x20, *range(0x09, 0x0E)]] = True
    return out


SPACE = _is_space()


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values evenly."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _tables(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random value per byte, and the powers of BASE and of its inverse."""
    state = worker_state("powers", dict)
    if state.get("n", -1) < n:
        size = max(n, SLICE_BYTES) + 1
        steps = np.full(size, BASE, np.uint64)
        steps[0] = 1
        back = np.full(size, INVERSE, np.uint64)
        back[0] = 1
        byte = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))
        state.update(n=size - 1, byte=byte, up=np.cumprod(steps), down=np.cumprod(back))
    return state["byte"], state["up"], state["down"]


class Texts:
    """Some texts as one byte array; ``at`` holds their borders."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        self.data, self.at = data, at
        self._prefix = None

    def __len__(self) -> int:
        return len(self.at) - 1

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of all words, and the borders of each text among them."""
        space, n = SPACE[self.data], len(self.data)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(self.at), np.int64)
        first = np.ones(n + 1, bool)
        first[1:n] = space[:-1]
        first[self.at] = True
        last = np.ones(n + 1, bool)
        last[: n] = np.append(space[:n], True)[:n]
        last[self.at] = True
        starts = np.flatnonzero(first[:n] & ~space)
        ends = np.flatnonzero(last[1:] & ~space) + 1
        return starts, ends, np.searchsorted(starts, self.at)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of all lines, split at line feeds, and the borders of each text among them."""
        feeds = np.flatnonzero(self.data == 10)
        count = np.searchsorted(feeds, self.at)
        full = np.diff(self.at) > 0
        per_text = np.where(full, np.diff(count) + 1, 0)
        borders = np.concatenate([[0], np.cumsum(per_text)]).astype(np.int64)
        starts, ends = np.empty(borders[-1], np.int64), np.empty(borders[-1], np.int64)
        head, tail = np.zeros(borders[-1], bool), np.zeros(borders[-1], bool)
        head[borders[:-1][full]], tail[borders[1:][full] - 1] = True, True
        starts[head], starts[~head] = self.at[:-1][full], feeds + 1
        ends[tail], ends[~tail] = self.at[1:][full], feeds
        return starts, ends, borders

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each byte range; equal ranges have equal hashes wherever they stand."""
        if not len(starts):
            return np.zeros(0, np.uint64)
        byte, up, down = _tables(len(self.data))
        if self._prefix is None:
            prefix = np.empty(len(self.data) + 1, np.uint64)
            prefix[0] = 0
            np.cumsum(byte[self.data] * up[: len(self.data)], out=prefix[1:])
            self._prefix = prefix
        return mix((self._prefix[ends] - self._prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64))

    def count(self, marked: np.ndarray) -> np.ndarray:
        """How many marked bytes each text has."""
        sums = np.zeros(len(self.data) + 1, np.int64)
        np.cumsum(marked, out=sums[1:])
        return np.diff(sums[self.at])


def slices(column: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, Texts]]:
    """Runs of whole texts of about ``limit`` bytes: first row, row after the last, texts. A null text is empty.

    A text longer than the limit is a run of its own, never cut.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, borders, data = column.buffers()
    at = np.frombuffer(borders, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    begin = 0
    while begin < len(column):
        end = max(begin + 1, int(np.searchsorted(at, at[begin] + limit, "right")) - 1)
        end = min(end, len(column))
        yield begin, end, Texts(data[at[begin] : at[end]], at[begin : end + 1] - at[begin])
        begin = end


def windows(word: np.ndarray, borders: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``n`` words inside a text, and the borders of each text among them.

    A text with fewer words, but at least one, has one run: all its words.
    """
    count = np.diff(borders)
    runs = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    at = np.concatenate([[0], np.cumsum(runs)]).astype(np.int64)
    if not at[-1]:
        return np.zeros(0, np.uint64), at
    first = np.repeat(borders[:-1] - at[:-1], runs) + np.arange(at[-1])
    length = np.repeat(np.minimum(count, n), runs)
    out = np.full(at[-1], 0x1234567, np.uint64)
    short = length < n
    for k in range(n):
        here = word[np.minimum(first + k, len(word) - 1)]
        if short.any():
            here = np.where(k < length, here, np.uint64(0))
        out = out * np.uint64(BASE) + here
    return mix(out + length.astype(np.uint64)), at
