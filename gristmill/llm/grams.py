"""Vectorised word hashing: Arrow text columns to 64-bit word and word-n-gram hashes, without a Python loop over words.

Words are maximal runs of bytes above 0x20 of the lower-cased text. A word's hash is a chain of mixing steps over its length and its
blocks of 8 bytes, each step a bijection of the block, so that words of up to 8 bytes never share one with a word of their length;
words of more than ``LONG`` bytes go to xxhash one by one. Hashes find candidates; who must be exact compares the bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

CHUNK_BYTES = 1 << 20
#: Bytes of the longest word that is hashed in numpy.
LONG = 64
U = np.uint64
_KEEP = np.array([(1 << (8 * i)) - 1 for i in range(9)], dtype=U)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift, multiply)."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U(27))
    h = h * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """[from, to) ranges of rows with about ``limit`` bytes of text each; a longer text is a chunk of its own."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield at, to
        at = to


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    t = pc.fill_null(texts.cast(pa.large_string()), "")
    t = pa.concat_arrays([t])  # offsets from 0
    off = np.frombuffer(t.buffers()[1], dtype=np.int64)[t.offset : t.offset + len(t) + 1]
    raw = t.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8)[off[0] : off[-1]] if raw is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return data, off - off[0]


def hashed(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hash of each byte range of ``data``."""
    size = end - start
    raw = np.append(data, np.zeros(8, np.uint8))
    eight = np.ndarray((len(data) + 1,), "<u8", raw, strides=(1,))
    h = mix(size.astype(U) ^ U(seed * 0xD1B54A32D192ED03 % (1 << 64)))
    h = mix(h ^ (eight[start] & _KEEP[np.minimum(size, 8)]))
    at = np.flatnonzero((size > 8) & (size <= LONG))
    for i in range(8, LONG, 8):
        if not len(at):
            break
        # the multiplication keeps equal blocks in succession from undoing each other
        h[at] = mix(h[at] * U(0x9FB21C651E98DF25) ^ (eight[start[at] + i] & _KEEP[np.minimum(size[at] - i, 8)]))
        at = at[size[at] > i + 8]
    for i in np.flatnonzero(size > LONG).tolist():
        h[i] = xxhash.xxh3_64_intdigest(data[start[i] : end[i]].tobytes(), seed)
    return h


def words(texts: pa.Array, lower: bool = True, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, first word of each text, byte start of each word, byte end), start and end within the text."""
    data, off = _bytes(pc.utf8_lower(texts) if lower else texts)
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return np.zeros(0, U), np.zeros(len(off), np.int64), z, z
    is_word = data > 32
    first = np.zeros(n + 1, bool)
    first[off] = True
    prev = np.empty(n, bool)
    prev[0] = False
    prev[1:] = is_word[:-1]
    start = np.flatnonzero(is_word & (~prev | first[:n]))
    nxt = np.empty(n, bool)
    nxt[-1] = False
    nxt[:-1] = is_word[1:]
    end = np.flatnonzero(is_word & (~nxt | first[1:])) + 1
    h = hashed(data, start, end, seed)
    bounds = np.searchsorted(start, off)
    owner = np.repeat(off[:-1], np.diff(bounds))
    return h, bounds, start - owner, end - owner


def ngrams(h: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each n-gram, first n-gram of each text); a text of 1 to n-1 words has one gram of all its words."""
    if n == 1:
        return h, bounds
    sizes = np.diff(bounds)
    counts = np.where(sizes >= n, sizes - n + 1, (sizes > 0).astype(np.int64))
    out_bounds = np.concatenate([[0], np.cumsum(counts)])
    text = np.repeat(np.arange(len(sizes)), counts)
    at = bounds[:-1][text] + (np.arange(out_bounds[-1]) - out_bounds[:-1][text])
    stop = bounds[1:][text]
    g = np.zeros(len(at), U)
    for i in range(n):
        here = at + i
        inside = here < stop
        g = np.where(inside, mix(g * U(0x9FB21C651E98DF25) + h[np.minimum(here, len(h) - 1)] + U(1)), g) if len(h) else g
    return g, out_bounds


def planes(x: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of integers, all first bytes, then all second ones: high bytes that are zero compress away."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def unplanes(b: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(b) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(b, np.uint8).reshape(width, -1).T
    return out.view("<u8").ravel()
