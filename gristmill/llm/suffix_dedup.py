"""Operator 7. Suffix-array dedup by distributed prefix doubling.

Every word position is a suffix. The first ranks order positions by their first ``THRESHOLD / 2^DOUBLINGS`` words, a few. At each doubling
the pairs (rank of p, rank of p + h) are sorted and ranked again, which orders positions by 2h words, until a
position is alone in its rank and drops out, or the threshold is reached. What is left there are the starts of
passages of THRESHOLD words that occur at least twice; the union of those passages within a document is its repeated text.

Spark moves position-rank pairs as packed blocks, by ranges of the rank for sorting and back by document for the next pairing; each
task sorts its range. Rank keys order by hash, not by letters: for equality any order common to all tasks does.
Every position of every document takes part. The last doubling overlaps (offset THRESHOLD - h), so any threshold is met exactly.

Defined cases: NULL texts and texts shorter than THRESHOLD words have no passage; words are runs of bytes above 0x20, compared as
they are; a passage that a document repeats within itself counts; repeated rows and copies repeat in whole; rows that
share an id give the union of rows of both; other columns take no part; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import small_batches, text_bytes, with_row_id
from gristmill.llm.grams import U, chunks, mix, planes, unplanes, words
from gristmill.llm.worker import tidied, tidied_stream

THRESHOLD = 50
DOUBLINGS = 3
PARTITION_BYTES = 24 << 20
FLUSH = 1 << 20
#: Bytes of a key that travel beside those that choose the partition: of the first windows, and of pairs of ranks.
FIRST_WIDTH, PAIR_WIDTH = 4, 6
_STEP = 0xC2B2AE3D27D4EB4F
BLOCK = "part int, rids binary, counts binary, gaps binary, keys binary"
NAMES = ["part", "rids", "counts", "gaps", "keys"]


def _pack(part: np.ndarray, rid: np.ndarray, pos: np.ndarray, key: np.ndarray, width: int) -> pa.RecordBatch:
    """Blocks by part of rows that come by rid and position."""
    order = np.argsort(part, kind="stable")
    part, rid, pos, key = part[order], rid[order], pos[order], key[order]
    cut = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.zeros(0, np.int64)
    rows = []
    for a, z in zip(cut, np.append(cut[1:], len(part))):
        r, p = rid[a:z], pos[a:z]
        new = np.concatenate([[True], r[1:] != r[:-1]])
        at = np.flatnonzero(new)
        gap = p.copy()
        gap[1:] = np.where(new[1:], p[1:], p[1:] - p[:-1])
        rows.append((int(part[a]), r[at].tobytes(), np.diff(np.append(at, z - a)).astype(np.int32).tobytes(), planes(gap, 4), planes(key[a:z], width)))
    cols = list(zip(*rows)) if rows else [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *[pa.array(c, pa.binary()) for c in cols[1:]]], NAMES)


def _unpack(t: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rids, positions, keys = [], [], []
    for r, c, g, k in zip(*[t.column(n).to_pylist() for n in NAMES[1:]]):
        count = np.frombuffer(c, np.int32)
        gap = unplanes(g, 4).astype(np.int64)
        total = np.cumsum(gap)
        at = np.cumsum(count) - count
        positions.append(total - np.repeat(total[at] - gap[at], count))
        rids.append(np.repeat(np.frombuffer(r, np.int64), count))
        keys.append(unplanes(k, width))
    return np.concatenate(rids), np.concatenate(positions), np.concatenate(keys)


def _windows(h: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, position, hash of the ``size`` words from there) of every position that has so many."""
    n = np.maximum(np.diff(bounds) - size + 1, 0)
    text = np.repeat(np.arange(len(n)), n)
    pos = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    at = bounds[:-1][text] + pos
    g = np.zeros(len(at), U)
    for i in range(size):
        g = mix(g * U(_STEP) + h[at + i] + U(1))
    return text, pos, g


def _first(start: int, threshold: int, parts: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0

        def flush() -> pa.RecordBatch:
            rid, pos, key = (np.concatenate(x) for x in zip(*held))
            held.clear()
            return _pack(_part(key, parts), rid, pos, key, width)

        for batch in batches:
            texts, rids = batch.column("text"), batch.column("rid").to_numpy(zero_copy_only=False).astype(np.int64)
            for a, z in chunks(texts):
                h, bounds, _, _ = words(texts.slice(a, z - a), lower=False)
                text, pos, key = _windows(h, bounds, start)
                long = np.diff(bounds)[text] >= threshold
                held.append((rids[a:z][text[long]], pos[long], key[long]))
                total += len(held[-1][1])
                if total >= FLUSH:
                    yield flush()
                    total = 0
        if held:
            yield flush()

    return run


def _part(key: np.ndarray, parts: int) -> np.ndarray:
    return (((key >> U(32)) * U(parts)) >> U(32)).astype(np.int64)


def _rank(parts: int, width: int, out_width: int):
    """Sorts the keys of a partition; positions alone in their rank drop out, the others get the rank and go back by document."""

    def run(t: pa.Table) -> pa.Table:
        part = t.column("part")[0].as_py()
        rid, pos, key = _unpack(t, width)
        order = np.argsort(key)
        k = key[order]
        new = np.concatenate([[True], k[1:] != k[:-1]])
        rank = np.cumsum(new) - 1
        shared = np.bincount(rank)[rank] > 1
        order, rank = order[shared], rank[shared].astype(U) | U(part << 32)
        rid, pos = rid[order], pos[order]
        order = np.lexsort((pos, rid))
        rid, pos, rank = rid[order], pos[order], rank[order]
        return pa.Table.from_batches([_pack((mix(rid.astype(U)) % U(parts)).astype(np.int64), rid, pos, rank, out_width)])

    return run


def _pair(offset: int, parts: int):
    """By document: pairs each position's rank with that ``offset`` words on; positions without it drop out."""

    def run(t: pa.Table) -> pa.Table:
        rid, pos, rank = _unpack(t, 8)
        order = np.lexsort((pos, rid))
        rid, pos, rank = rid[order], pos[order], rank[order]
        doc = np.concatenate([[0], np.cumsum(rid[1:] != rid[:-1])])
        place = (doc << 40) | pos
        at = np.searchsorted(place, place + offset)
        ok = at < len(place)
        ok[ok] = place[at[ok]] == place[ok] + offset
        key = mix(mix(rank[ok] + U(1)) * U(_STEP) + rank[at[ok]])
        return pa.Table.from_batches([_pack(_part(key, parts), rid[ok], pos[ok], key, PAIR_WIDTH)])

    return run


def _spans(threshold: int):
    def run(t: pa.Table) -> pa.Table:
        rid, pos, _ = _unpack(t, 1)
        order = np.lexsort((pos, rid))
        rid, pos = rid[order], pos[order]
        new = np.concatenate([[True], (rid[1:] != rid[:-1]) | (pos[1:] > pos[:-1] + threshold)])
        at = np.flatnonzero(new)
        last = np.append(at[1:], len(pos)) - 1
        return pa.table({"rid": rid[at], "start_word": pos[at], "end_word": pos[last] + threshold})

    return run


def repeated_passages(docs: DataFrame, threshold: int = THRESHOLD, doublings: int = DOUBLINGS) -> DataFrame:
    """(doc_id, start_word, end_word): the maximal spans, end exclusive, that passages of ``threshold`` words found at least twice cover."""
    small_batches(docs.sparkSession)
    keyed, kind = with_row_id(docs)
    slim = keyed.select("rid", F.col("row").getField("text").alias("text"))
    size, _ = text_bytes(slim)
    parts = max(1, math.ceil(size * 1.1 / PARTITION_BYTES))
    h = math.ceil(threshold / 2**doublings)
    blocks = slim.filter("text IS NOT NULL").mapInArrow(tidied_stream(_first(h, threshold, parts, FIRST_WIDTH)), BLOCK)
    width = FIRST_WIDTH
    while h < threshold:
        ranked = blocks.groupBy("part").applyInArrow(tidied(_rank(parts, width, 8)), BLOCK)
        offset = min(h, threshold - h)
        blocks = ranked.groupBy("part").applyInArrow(tidied(_pair(offset, parts)), BLOCK)
        h, width = h + offset, PAIR_WIDTH
    ended = blocks.groupBy("part").applyInArrow(tidied(_rank(parts, width, 1)), BLOCK)
    spans = ended.groupBy("part").applyInArrow(tidied(_spans(threshold)), "rid bigint, start_word bigint, end_word bigint")
    if kind == "clean":
        return spans.withColumnRenamed("rid", "doc_id")
    ids = keyed.select("rid", F.col("row").getField("doc_id").alias("doc_id"))
    return spans.join(ids, "rid").select("doc_id", "start_word", "end_word")
