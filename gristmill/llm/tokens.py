"""Byte-level BPE over Arrow text columns, each distinct word encoded once.

A unit is a run of white space with the word behind it. No pre-token of the pattern crosses from a word into the white space
after it, so a text's ids are those of its units, one behind the other. Units are found in numpy and deduplicated by their bytes (Arrow's
dictionary encoding: no hash decides), and only new ones go to the tokenizer. Units and the tokenizer are kept by the worker process
from task to task.
"""

from __future__ import annotations

import base64
import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from gristmill.llm.grams import _bytes, chunks
from gristmill.llm.worker import tidy

PATH = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Units that a worker keeps; beyond it the store starts anew with the next chunk.
UNITS = 1 << 18
#: Units that go to the tokenizer at once.
JOINED = 1 << 14


def _ascii_space(c: np.ndarray) -> np.ndarray:
    return (c == 32) | ((c >= 9) & (c <= 13))


def _wide_space(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Whether bytes a, b, c may end in a white space beyond ASCII: all that do, and some other characters."""
    return ((b == 0xC2) & ((c == 0x85) | (c == 0xA0))) | ((a >= 0xE1) & (a <= 0xE3) & ((b == 0x80) | (b == 0x81) | (b == 0x9A)))


class Encoder:
    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bpe = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.n_vocab = max(ranks.values()) + 1
        self.width = np.zeros(self.n_vocab, np.int64)
        self.width[list(ranks.values())] = [len(k) for k in ranks]
        self.forget()

    def forget(self) -> None:
        """Drop the units: a worker that waits for its next task holds the vocabulary alone."""
        self.known = pa.array([], pa.large_binary())
        self.flat = np.zeros(0, np.int32)
        self.at = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)

    def _learn(self, units: pa.Array) -> None:
        """Ids of units behind the known ones. Units go to the tokenizer joined, many at a call: its ids cover the bytes in order, so that their
        lengths tell each unit's own. One that doesn't begin with an ASCII white space, as a text's first may not, or that ends
        with a white space, would run into its neighbour, and goes alone."""
        data, off = _bytes(units)
        last = off[1:] - 1
        a, b, c = data[np.maximum(last - 2, 0)], data[np.maximum(last - 1, 0)], data[last]
        alone = ~_ascii_space(data[off[:-1]]) | _ascii_space(c) | _wide_space(a, b, c)
        at, size = np.empty((2, len(units)), np.int64)
        ids, used = [self.flat], len(self.flat)
        rest = np.flatnonzero(~alone)
        for i in range(0, len(rest), JOINED):
            part = rest[i : i + JOINED]
            text, ends = _bytes(units.take(pa.array(part)))
            ids.append(np.array(self.bpe.encode_ordinary(text.tobytes().decode()), np.int32))
            bounds = np.searchsorted(np.cumsum(self.width[ids[-1]]), ends, side="right")
            at[part], size[part] = used + bounds[:-1], np.diff(bounds)
            used += len(ids[-1])
        for i in np.flatnonzero(alone).tolist():
            ids.append(np.array(self.bpe.encode_ordinary(units[i].as_py().decode()), np.int32))
            at[i], size[i] = used, len(ids[-1])
            used += len(ids[-1])
        self.flat, self.at, self.size = np.concatenate(ids), np.append(self.at, at), np.append(self.size, size)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, bounds of each text); a NULL text has none."""
        ids, sizes = [], []
        for a, z in chunks(texts):
            i, n = self._chunk(texts.slice(a, z - a))
            ids.append(i)
            sizes.append(n)
        n = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
        return (np.concatenate(ids) if ids else np.zeros(0, np.int32)), np.concatenate([[0], np.cumsum(n)])

    def counts(self, texts: pa.Array) -> np.ndarray:
        """The number of ids of each text; 0 for a NULL one."""
        found = []
        for a, z in chunks(texts):
            start, off, unit = self._units(texts.slice(a, z - a))
            total = np.concatenate([[0], np.cumsum(self.size[unit])])
            found.append(np.diff(total[np.searchsorted(start, off)]))
        return np.concatenate(found) if found else np.zeros(0, np.int64)

    def _units(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(byte at which each unit begins, byte at which each text begins, number of each unit among the known ones)."""
        data, off = _bytes(texts)
        n = len(data)
        if not n:
            return np.zeros(0, np.int64), off, np.zeros(0, np.int64)
        # a unit begins where an ASCII white space follows a word; one that follows any other white space stays in its unit
        space = _ascii_space(data)
        begin = np.zeros(n, bool)
        begin[1:] = space[1:] & ~space[:-1]
        if n > 3 and (data >= 0xC2).any():
            begin[3:] &= ~_wide_space(data[:-3], data[1:-2], data[2:-1])
            begin[2] &= not (data[0] == 0xC2)
        begin[off[:-1][off[:-1] < n]] = True
        start = np.flatnonzero(begin)
        offsets = np.append(start, n)
        units = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
        if len(self.known) > UNITS:
            self.forget()
        # the known ones come first, so that they keep their numbers and new ones follow
        held = len(self.known)
        coded = pa.concat_arrays([self.known, units]).dictionary_encode()
        self._learn(coded.dictionary[held:])
        self.known = coded.dictionary
        unit = coded.indices[held:].to_numpy()
        return start, off, unit

    def _chunk(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        start, off, unit = self._units(texts)
        if not len(unit):
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        size = self.size[unit]
        total = np.cumsum(size)
        out = self.flat[np.repeat(self.at[unit] - (total - size), size) + np.arange(total[-1])]
        bounds = np.concatenate([[0], total])[np.searchsorted(start, off)]
        return out, np.diff(bounds)


def encoder(path: str) -> Encoder:
    """The worker process's encoder for this file."""
    state = sys.modules.setdefault("_gristmill_worker", types.ModuleType("_gristmill_worker"))
    held = state.__dict__.setdefault("encoders", {})
    if path not in held:
        held[path] = Encoder(path)
    return held[path]


def counted(df: DataFrame, text: str, name: str, path: str = PATH) -> DataFrame:
    """``df`` with the column ``name``, the number of the tokenizer's ids (0 for a NULL or empty text), in place of the column ``text``."""
    rest = [c for c in df.columns if c != text]
    schema = T.StructType([df.schema[c] for c in rest]).add(name, T.LongType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        try:
            for b in batches:
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in rest], pa.array(enc.counts(b.column(text)), pa.int64())], [*rest, name])
        finally:
            enc.forget()
            tidy()

    return df.mapInArrow(run, schema)
