"""Words of UTF-8 texts as 64-bit codes, computed on whole Arrow batches with numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: What one step works on, in bytes of text; a longer text is a step of its own.
STEP_BYTES = 1_000_000

U = np.uint64
_RANDOM = np.random.Generator(np.random.PCG64(20240229))
BYTE_CODES = [_RANDOM.integers(1, 2**63, 256, dtype=U) for _ in range(2)]
_BASE = [U(int(x) | 1) for x in _RANDOM.integers(2**62, 2**63, 2, dtype=U)]
_GRAM = [U(int(x) | 1) for x in _RANDOM.integers(2**62, 2**63, 2, dtype=U)]
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _lut(spaces: list[int], lower: bool) -> np.ndarray:
    """The byte a word's byte counts as; 0 where it ends a word."""
    lut = np.arange(256, dtype=np.uint8)
    if lower:
        lut[65:91] += 32
    lut[spaces] = 0
    return lut


#: Words [^\x20\x09-\x0D]+, unchanged. NUL is a word's byte here, so it counts as 32, which is no other word byte.
BLANK_WORDS = _lut([32, *range(9, 14)], lower=False)
BLANK_WORDS[0] = 32
#: Words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ once A-Z are lower-cased.
PLAIN_WORDS = _lut([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)], lower=True)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every bit depends on every bit."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x *= U(0xC4CEB9FE1A85EC53)
    x ^= x >> U(33)
    return x


def powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of a base, and of its inverse modulo 2**64, from 0 to n at least."""
    have = _POWERS.get(which)
    if have is None or len(have[0]) <= n:
        size = max(n + 1, STEP_BYTES + 1)
        base = _BASE[which]
        inverse = U(pow(int(base), -1, 2**64))
        have = tuple(np.concatenate([np.ones(1, U), np.cumprod(np.full(size - 1, b, U), dtype=U)]) for b in (base, inverse))
        if size <= 4 * STEP_BYTES:
            _POWERS[which] = have
    return have


@dataclass
class Words:
    """The words of some texts. ends_at[i]:ends_at[i+1] are the words of text i."""

    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    stops: np.ndarray
    ends_at: np.ndarray
    codes: list[np.ndarray]

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.ends_at)

    def text_of(self) -> np.ndarray:
        """The text that each word is in."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def left(self) -> np.ndarray:
        """The number of words from each word to the end of its text, itself included."""
        return np.repeat(self.ends_at[1:], self.counts) - np.arange(len(self.starts))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null texts are empty."""
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def steps(batch: pa.RecordBatch, text: int, size: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch that hold about that many bytes of text."""
    if not batch.num_rows:
        return
    _, offsets = text_bytes(batch.column(text))
    start = 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + size, "right")) - 1)
        yield batch.slice(start, stop - start)
        start = stop


def words_of(column: pa.Array, lut: np.ndarray, hashes: int = 1) -> Words:
    """Words and their codes: equal words have equal codes; unequal ones differ but for 64-bit chance."""
    data, offsets = text_bytes(column)
    n = len(data)
    seen = lut[data]
    inside = seen != 0
    first, last = inside.copy(), inside.copy()
    if n:
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        at = offsets[:-1][offsets[:-1] < n]
        first[at] |= inside[at]
        at = offsets[1:][offsets[1:] > 0] - 1
        last[at] |= inside[at]
    starts, stops = np.flatnonzero(first), np.flatnonzero(last) + 1
    codes = []
    for k in range(hashes):
        up, down = powers(k, n)
        total = np.zeros(n + 1, U)
        np.cumsum(BYTE_CODES[k][seen] * up[:n], out=total[1:])
        codes.append(mixed((total[stops] - total[starts]) * down[starts]))
    return Words(data, offsets, starts, stops, np.searchsorted(starts, offsets), codes)


def grams(codes: np.ndarray, n: int, which: int = 0) -> np.ndarray:
    """The code of codes[i:i+n] at each i up to len(codes) - n."""
    size = len(codes) - n + 1
    if size <= 0:
        return np.zeros(0, U)
    out = codes[:size].copy()
    for k in range(1, n):
        out *= _GRAM[which]
        out += codes[k : k + size]
    return mixed(out)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of values[i:i+width] at each i."""
    done, out = 1, values
    while done < width:
        step = min(done, width - done)
        out = np.minimum(out[:-step], out[step:])
        done += step
    return out


def pieces(cut: np.ndarray, size: int) -> list[tuple[int, int]]:
    """(start, stop) of the pieces that start at cut, of an array of that size."""
    at = cut.tolist()
    return list(zip(at, [*at[1:], size][: len(at)], strict=True))
