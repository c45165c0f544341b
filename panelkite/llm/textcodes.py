"""Whole batches of texts as numpy arrays: words, their 64-bit codes, and runs of words."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 2_000_000


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column laid end to end, and the offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(batches: Iterator[pa.RecordBatch], column: str, size: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of about ``size`` text bytes; a text is never cut."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = utf8(batch.column(column))[1]
        first = 0
        while first < batch.num_rows:
            last = int(np.searchsorted(ends, ends[first] + size, "right")) - 1
            last = min(max(last, first + 1), batch.num_rows)
            yield batch.slice(first, last - first)
            first = last


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Coder:
    """Codes of short runs of mixed word codes: a polynomial modulo 2**64, made in each task.

    Such sums cancel for long patterned runs, so they name segments of some twenty words, never words or texts.
    """

    STEP = np.uint64(0xA0761D6478BD642F)

    def __init__(self):
        self.power = np.ones(1, np.uint64)
        self.back = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if n > len(self.power):
            inverse = np.uint64(pow(int(self.STEP), -1, 1 << 64))
            for name, factor in (("power", self.STEP), ("back", inverse)):
                steps = np.full(n, factor, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))

    def runs(self, symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """One code for each run of symbols; equal runs have equal codes."""
        if not len(starts):
            return np.zeros(0, np.uint64)
        self._grow(len(symbols))
        total = np.zeros(len(symbols) + 1, np.uint64)
        np.cumsum(symbols * self.power[: len(symbols)], out=total[1:])
        code = (total[ends] - total[starts]) * self.back[starts]
        return mix(code + (ends - starts).astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D))


SEEDS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
LONG_WORD = 1024


def word_codes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = SEEDS[0]) -> np.ndarray:
    """A 64-bit hash of each run of bytes: every eight bytes are mixed into it in turn, so no pattern of bytes cancels.

    Longer runs than ``LONG_WORD`` bytes are hashed one by one. Codes of two seeds are independent.
    """
    lengths = ends - starts
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    lanes = np.ndarray((len(data) + 1,), "<u8", buffer=padded, strides=(1,))
    salt = np.uint64(seed)
    code = mix(lengths.astype(np.uint64) ^ salt)
    is_long = lengths > LONG_WORD
    at = np.flatnonzero(~is_long)
    done = 0
    while len(at):
        left = (8 - np.minimum(lengths[at] - done, 8)).astype(np.uint64)
        lane = lanes[starts[at] + done] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (left * np.uint64(8)))
        code[at] = mix((code[at] ^ mix(lane + salt)) * np.uint64(0xA0761D6478BD642F) + np.uint64(done + 1))
        done += 8
        at = at[lengths[at] > done]
    key = seed.to_bytes(8, "little")
    for i in np.flatnonzero(is_long).tolist():
        digest = hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8, key=key).digest()
        code[i] = np.uint64(int.from_bytes(digest, "little"))
    return code


class Words:
    """The words of a batch: where they start and end in the bytes, their codes, and each text's share of them."""

    def __init__(self, column: pa.Array, coded: bool = True, lower: bool = False):
        data, offsets = utf8(column)
        if lower:
            data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
        word = ~((data == 32) | ((data >= 9) & (data <= 13)))
        first = np.zeros(len(data) + 1, bool)
        first[offsets] = True
        before = np.zeros(len(data), bool)
        before[1:] = word[:-1]
        begins = word & (~before | first[:-1])
        after = np.zeros(len(data), bool)
        after[:-1] = word[1:]
        stops = word & (~after | first[1:])
        self.data, self.offsets = data, offsets
        self.starts = np.flatnonzero(begins)
        self.ends = np.flatnonzero(stops) + 1
        self.bounds = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.bounds)
        if coded:
            self.codes = word_codes(data, self.starts, self.ends)

    def other_codes(self) -> np.ndarray:
        """Codes that are independent of the first ones; the two together identify a word by 128 bits."""
        return word_codes(self.data, self.starts, self.ends, SEEDS[1])

    def texts(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def room(self, length: int) -> np.ndarray:
        """Whether ``length`` words of the same text begin at each word."""
        last = np.repeat(self.bounds[1:], self.counts)
        return np.arange(len(self.starts)) + length <= last

    def grams(self, length: int) -> np.ndarray:
        """Codes of ``length`` words from each word on; defined where ``room`` holds."""
        return gram_codes(self.codes, length)


def gram_codes(codes: np.ndarray, length: int) -> np.ndarray:
    out = np.zeros(len(codes), np.uint64)
    if len(codes) < length:
        return out
    n = len(codes) - length + 1
    acc = codes[:n].copy()
    for j in range(1, length):
        acc *= np.uint64(0x9FB21C651E98DF25)
        acc += codes[j : j + n]
        acc ^= acc >> np.uint64(28)
    out[:n] = mix(acc)
    return out
