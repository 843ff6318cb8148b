"""Words of whole Arrow columns as numpy arrays: spans, 64-bit hashes, window hashes.

Texts are read as the UTF-8 bytes that Arrow holds, without a Python object per word or
row. A batch is taken apart into chunks of whole texts, so that memory follows
``CHUNK_BYTES`` and the longest text. A null text has no words.
"""

from __future__ import annotations

import hashlib
import secrets
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20

#: Bytes of words between ASCII white space: all but 0x20 and 0x09 to 0x0D.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: Bytes of words of digits, lower-case ASCII letters and everything beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: Lower case for A to Z alone.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

#: Words longer than this are hashed by a digest of their bytes.
LONG_WORD = 256

_BASE = {1: np.uint64(0x9E3779B97F4A7C15), 2: np.uint64(0xD1342543DE82EF95)}
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_TAIL = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of a base modulo 2**64, and those of its inverse."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, CHUNK_BYTES // 4)
        out = []
        for b in (int(_BASE[base]), pow(int(_BASE[base]), -1, 1 << 64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        have = (out[0], out[1])
        if size <= 4 * CHUNK_BYTES:
            _POWERS[base] = have
    return have


def _sums(values: np.ndarray, base: int) -> np.ndarray:
    acc = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _powers(base, len(values))[0][: len(values)], out=acc[1:])
    return acc


@dataclass(frozen=True)
class WordKey:
    """A secret from which word hashes are made; both sides of a match use the same one.

    Pieces of 32 bits are multiplied by odd secret numbers and summed modulo 2**64; the upper half of
    such a sum takes two different words to one value with a chance of 2**-32, whatever the words are,
    since they were chosen without the secret (multilinear hashing). Two sums give 64 bits, which are
    scrambled so that windows of hashes keep nothing of the sums.
    """

    seed: int

    @staticmethod
    def drawn() -> WordKey:
        """A new secret; it goes to the tasks with the job, so that a task run again uses the same."""
        return WordKey(secrets.randbits(128))

    def factors(self, n: int) -> np.ndarray:
        """Two rows of n secret numbers."""
        have = _FACTORS.get(self.seed)
        if have is None:
            if len(_FACTORS) > 16:
                _FACTORS.clear()
            have = np.random.Generator(np.random.PCG64(self.seed)).integers(0, 1 << 64, (2, LONG_WORD // 4 + 4), np.uint64)
            _FACTORS[self.seed] = have
        return have[:, :n]


_FACTORS: dict[int, np.ndarray] = {}

def keyed_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, key: WordKey) -> np.ndarray:
    """A 64-bit hash of each byte span under a key; of spans over ``LONG_WORD`` bytes, the first eight
    bytes of their keyed BLAKE2 digest."""
    size = ends - starts
    short = size <= LONG_WORD
    factors = key.factors(LONG_WORD // 4 + 4)
    low = np.uint64(0xFFFFFFFF)
    sums = [f[0] + f[1] * size.astype(np.uint64) for f in factors]
    eights = np.ndarray((len(buf) + 1,), "<u8", np.append(buf, np.zeros(8, np.uint8)), 0, (1,))
    rows = np.flatnonzero(short & (size > 0))
    for at in range(0, LONG_WORD, 8):
        now = rows[size[rows] > at]
        if not len(now):
            break
        rows = now
        piece = eights[starts[rows] + at] & _TAIL[np.minimum(size[rows] - at, 8)]
        i = at // 4 + 2
        for f, total in zip(factors, sums, strict=True):
            total[rows] += (piece & low) * f[i] + (piece >> np.uint64(32)) * f[i + 1]
    out = mix((sums[0] & ~low) | (sums[1] >> np.uint64(32)))
    for i in np.flatnonzero(~short):
        digest = hashlib.blake2b(buf[starts[i] : ends[i]].tobytes(), digest_size=8, key=key.seed.to_bytes(16, "little")).digest()
        out[i] = np.uint64(int.from_bytes(digest, "little"))
    return out


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For features, whose numbers must be the same in every run: a hash of each byte span without a
    key, to which words can be made that share one. Eight bytes at a time, each step a bijective
    scrambling of all before; spans over ``LONG_WORD`` bytes by eight bytes of their BLAKE2 digest."""
    size = ends - starts
    out = mix(size.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
    eights = np.ndarray((len(buf) + 1,), "<u8", np.append(buf, np.zeros(8, np.uint8)), 0, (1,))
    short = size <= LONG_WORD
    rows = np.flatnonzero(short & (size > 0))
    for at in range(0, LONG_WORD, 8):
        rows = rows[size[rows] > at]
        if not len(rows):
            break
        piece = eights[starts[rows] + at] & _TAIL[np.minimum(size[rows] - at, 8)]
        out[rows] = mix((out[rows] ^ piece) + np.uint64(0x9E3779B97F4A7C15))
    for i in np.flatnonzero(~short):
        digest = hashlib.blake2b(buf[starts[i] : ends[i]].tobytes(), digest_size=8).digest()
        out[i] = np.uint64(int.from_bytes(digest, "little"))
    return out


def window_hashes(words: np.ndarray, k: int, base: int = 2) -> np.ndarray:
    """Hash of the words i to i+k-1 for each i that has so many after it."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.empty(n, np.uint64)
    step = CHUNK_BYTES // 8
    for i in range(0, n, step):
        part = words[i : min(n, i + step) + k - 1]
        acc = _sums(part, base)
        m = len(part) - k + 1
        out[i : i + m] = (acc[k:] - acc[:m]) * _powers(base, m)[1][:m]
    return mix(out)


@dataclass
class Words:
    """The words of rows ``first`` to ``first + len(bounds) - 2`` of a batch."""

    first: int
    buf: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray  # words of row first+i: bounds[i] to bounds[i+1]
    offsets: np.ndarray  # bytes of row first+i in buf, likewise

    @property
    def rows(self) -> int:
        return len(self.bounds) - 1

    def hashes(self, key: WordKey) -> np.ndarray:
        return keyed_hashes(self.buf, self.starts, self.ends, key)

    def owners(self) -> np.ndarray:
        """For each word, its row counted from ``first``."""
        return np.repeat(np.arange(self.rows), np.diff(self.bounds))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and where each row begins; a null is empty."""
    if pa.types.is_null(column.type) or len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def words_of(column: pa.Array, letters: np.ndarray, lower: bool) -> Iterator[Words]:
    """Chunks of a column's words: runs of bytes that ``letters`` marks, never across rows."""
    data, offsets = text_bytes(column)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + CHUNK_BYTES, "right")) - 1)
        buf, offs = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        if lower:
            buf = LOWER[buf]
        inside = letters[buf]
        before = np.empty_like(inside)
        after = np.empty_like(inside)
        if len(buf):
            before[0] = False
            before[1:] = inside[:-1]
            after[-1] = False
            after[:-1] = inside[1:]
            edges = offs[:-1][offs[:-1] < len(buf)]
            before[edges] = False
            after[edges[edges > 0] - 1] = False
        starts = np.flatnonzero(inside & ~before)
        ends = np.flatnonzero(inside & ~after) + 1
        yield Words(i, buf, starts, ends, np.searchsorted(starts, offs), offs)
        i = j


def signed(x: np.ndarray) -> np.ndarray:
    """The same bits as Spark longs."""
    return np.ascontiguousarray(x).view(np.int64)
