"""Operator 2. Chat formatting in budgeted windows.

A conversation's turns are formatted as ``<|role|>\\n`` text ``<|end|>\\n`` and tokenized. Prefix sums of the turns' tokens choose windows of whole turns:
each window holds the system turn (the conversation's first turn, if its role is system), up to ``HISTORY_TURNS`` turns
repeated from before it, of ``HISTORY_TOKENS`` tokens at most, and as many new turns as the budget allows. Assistant turns are targets: the
loss mask is 1 on the text and end mark of new ones, and 0 on repeated ones, so each target token is trained on once.
Repeated history gives way to the new turn: it keeps the turns nearest to it that fit.

Defined cases: a turn that the budget can't hold beside the system turn has a window of its own, whole, marked over_budget
(a system turn that is itself over the budget is dropped from later windows); turns go by number (NULL first), then role and
text; rows equal in all four columns count once; a NULL text is empty; a NULL or empty role is user (a turn of its own beside one of
the same number and text whose role is user); rows with a NULL conv_id belong to no
conversation and are left out; other columns take no part; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import small_batches
from gristmill.llm.tokens import PATH, encoder
from gristmill.llm.worker import tidied_stream

BUDGET = 1024
HISTORY_TURNS = 4
HISTORY_TOKENS = 256
SCHEMA = "conv_id bigint, window int, first_turn int, last_turn int, history int, system boolean, over_budget boolean, n_tokens int, n_targets int, input_ids array<int>, loss_mask array<tinyint>"


def windows(sizes: list[int], system: bool, budget: int, history_turns: int, history_tokens: int) -> list[tuple[int, int, int, bool, bool]]:
    """(first new turn, end, first history turn, with the system turn, over budget) of each window; indexes into ``sizes``."""
    pre = np.concatenate([[0], np.cumsum(sizes)])
    head = sizes[0] if system else 0
    out, at, low = [], 0, 1 if system else 0
    while at < len(sizes):
        own_head = head if system and at > 0 and head <= budget else 0
        past = at
        if at > low:
            most = min(history_tokens, budget - own_head - sizes[at])
            past = max(low, at - history_turns, int(np.searchsorted(pre, pre[at] - most))) if most > 0 else at
        room = budget - own_head - int(pre[at] - pre[past])
        end = max(at + 1, int(np.searchsorted(pre, pre[at] + room, side="right")) - 1)
        over = own_head + int(pre[end] - pre[past]) > budget
        if over:
            own_head, past = 0, at
        out.append((at, end, past, bool(system and (at == 0 or own_head)), over))
        at = end
    return out


def chat_windows(turns: DataFrame, budget: int = BUDGET, history_turns: int = HISTORY_TURNS, history_tokens: int = HISTORY_TOKENS, tokenizer: str = PATH) -> DataFrame:
    """One row for each window. first_turn and last_turn number the new turns in order from 0; history counts the repeated ones before them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        held: list[tuple] = []
        last: list = [None, None]
        rows: list[tuple] = []

        def close() -> None:
            sizes = [len(t[1]) for t in held]
            for i, (a, z, past, system, over) in enumerate(windows(sizes, held[0][0] == "system", budget, history_turns, history_tokens)):
                first = [held[0]] if system and a > 0 else []
                parts = first + held[past:z]
                ids = np.concatenate([p[1] for p in parts])
                new = len(first) + a - past
                mask = np.concatenate([p[2] if k >= new else np.zeros(len(p[1]), np.int8) for k, p in enumerate(parts)])
                rows.append((last[0], i, a, z - 1, a - past, bool(system), over, len(ids), int(mask.sum()), ids, mask))
            held.clear()

        def table() -> pa.RecordBatch:
            c = list(zip(*rows))
            kinds = [pa.int64(), *[pa.int32()] * 4, pa.bool_(), pa.bool_(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int8())]
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(c, kinds)], [x.split()[0] for x in SCHEMA.split(", ")])

        for b in batches:
            said, text = b.column("role").to_pylist(), b.column("text").to_pylist()
            role = [r or "user" for r in said]
            heads = [f"<|{r}|>\n" for r in role]
            body = pa.array([x or "" for x in text], pa.large_string())
            pieces = [enc.encode(pa.array(x, pa.large_string())) for x in (heads, body, ["<|end|>\n"] * len(role))]
            for i, (conv, turn) in enumerate(zip(b.column("conv_id").to_pylist(), b.column("turn").to_pylist())):
                if held and conv != last[0]:
                    close()
                elif held and (turn, said[i], text[i]) == last[1]:
                    continue
                last[0], last[1] = conv, (turn, said[i], text[i])
                h, t, e = (ids[x[i] : x[i + 1]] for ids, x in pieces)
                target = np.full(len(t) + len(e), role[i] == "assistant", np.int8)
                held.append((role[i], np.concatenate([h, t, e]), np.concatenate([np.zeros(len(h), np.int8), target])))
            if len(rows) >= 500:
                yield table()
        if held:
            close()
        if rows:
            yield table()

    small_batches(turns.sparkSession)
    slim = turns.select(F.col("conv_id").cast("bigint").alias("conv_id"), "turn", "role", "text").filter("conv_id IS NOT NULL")
    ordered = slim.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(tidied_stream(run), SCHEMA)
