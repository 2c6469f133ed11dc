"""Operator 9. Cost-balanced packing.

A document of n tokens (of the tokenizer, or of a column that holds their number) costs LINEAR * n + n * n: the linear part of a layer against its attention. Documents
longer than the capacity are cut into pieces of the capacity. Shards of about ``SHARD_TOKENS`` tokens, drawn by a hash of the
id, are packed each on its own: pieces in descending order of cost go to the sequence of the lowest cost so far that has room
for them, and a new sequence is opened only when none has. A shard begins with as many sequences as its tokens need
at least. The number of shards grows with the input; only ids and sizes are moved.

Defined cases: NULL and empty texts have no tokens and no piece; ties in cost go by id and piece, ties between sequences to
the first; rows that share an id are packed each on its own; other columns take no part; an empty table gives an
empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import small_batches, with_row_id, written
from gristmill.llm.tokens import PATH, counted
from gristmill.llm.worker import tidied

CAPACITY = 4096
LINEAR = 24_576
SHARD_TOKENS = 1 << 23


def assign(n: np.ndarray, capacity: int, linear: int) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, start in it) of pieces of n tokens that come in descending order."""
    count = max(1, math.ceil(int(n.sum()) / capacity))
    cost, room = np.zeros(2 * count + 8), np.zeros(2 * count + 8, np.int64)
    room[:count] = capacity
    seq, start = np.empty(len(n), np.int64), np.empty(len(n), np.int64)
    for i, k in enumerate(n.tolist()):
        # a sequence without room can't be the lowest
        at = int(np.argmin(np.where(room[:count] >= k, cost[:count], np.inf)))
        if room[at] < k:
            at, count = count, count + 1
            if count > len(cost):
                cost, room = np.append(cost, np.zeros(count)), np.append(room, np.zeros(count, np.int64))
            room[at] = capacity
        seq[i], start[i] = at, capacity - room[at]
        room[at] -= k
        cost[at] += linear * k + k * k
    return seq, start


def pack(docs: DataFrame, capacity: int = CAPACITY, linear: int = LINEAR, shard_tokens: int = SHARD_TOKENS, tokenizer: str = PATH, tokens: str | None = None) -> DataFrame:
    """One row for each piece: (doc_id, piece, doc_start, n_tokens, shard, sequence, start).

    tokens: a column with each document's number of tokens (none where it is NULL or below 1), in place of the tokenizer's.

    doc_start is the piece's first token in its document, start its first in the sequence; (shard, sequence) names a sequence.
    """
    small_batches(docs.sparkSession)
    keyed, _ = with_row_id(docs.select("doc_id", F.col(f"`{tokens}`" if tokens else "text").alias("text")))
    slim = keyed.select("rid", F.col("row.doc_id").cast("bigint").alias("doc_id"), F.col("row.text").alias("text"))
    slim = slim.select("rid", "doc_id", F.col("text").cast("bigint").alias("n")) if tokens else counted(slim, "text", "n", tokenizer)
    # tokens are counted once: the sizes are written, and no filter on them reaches the pass over the ids
    sizes = written(slim, "pack-sizes").filter("n > 0")
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint")).first()[0]
    shards = max(1, math.ceil(total / shard_tokens))
    pieces = sizes.select(
        "rid",
        "doc_id",
        "n",
        F.pmod(F.xxhash64("rid"), F.lit(shards)).alias("shard"),
        F.explode(F.expr(f"sequence(0L, (n - 1) div {capacity})")).alias("piece"),
    )
    pieces = pieces.select("rid", "doc_id", "shard", "piece", F.least(F.lit(capacity).cast("bigint"), F.col("n") - F.col("piece") * capacity).alias("k"))

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("k", "descending"), ("rid", "ascending"), ("piece", "ascending")])
        seq, start = assign(t["k"].to_numpy(), capacity, linear)
        first = np.multiply(t["piece"].to_numpy(), capacity)
        return pa.table({"doc_id": t["doc_id"], "piece": t["piece"], "doc_start": first, "n_tokens": t["k"], "shard": t["shard"], "sequence": seq, "start": start})

    return pieces.groupBy("shard").applyInArrow(tidied(run), "doc_id bigint, piece bigint, doc_start bigint, n_tokens bigint, shard bigint, sequence bigint, start bigint")
