"""Operator 1. Token-ID output: Parquet lists of ids with chosen encodings, bounded row groups and pages with a page index.

Token ids are dictionary encoded (bit-packed indexes into the ids that a column chunk uses); doc_id and n_tokens are delta encoded
(DELTA_BINARY_PACKED). Row groups and pages are bounded by bytes, pages of metadata also by rows, and the Parquet writer
adds column and offset indexes, so a reader of a few documents or of metadata alone skips the other pages.
Rows are sorted by doc_id within each file, which makes the page index selective, without an exchange; ``cluster=True`` adds a range exchange of
tokens so that files don't overlap either.

Defined cases: a NULL text has NULL ids and 0 tokens; an empty text has no ids; a NULL doc_id is written as it is; repeated rows
are written each; a column ``n_tokens`` or ``token_ids`` of the input is replaced; other metadata columns are
written only if named; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gristmill.llm.common import small_batches
from gristmill.llm.tokens import PATH, encoder
from gristmill.llm.worker import tidied_stream

ROW_GROUP_BYTES = 32 << 20
PAGE_BYTES = 256 << 10
PAGE_ROWS = 2000
META = ("doc_id", "source", "lang")


def tokenized(docs: DataFrame, meta: Sequence[str] = META, tokenizer: str = PATH) -> DataFrame:
    """(meta columns, n_tokens, token_ids) of every document."""
    small_batches(docs.sparkSession)
    meta = [m for m in meta if m in docs.columns and m not in ("n_tokens", "token_ids")]
    schema = T.StructType([docs.schema[m] for m in meta]).add("n_tokens", T.IntegerType()).add("token_ids", T.ArrayType(T.IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for b in batches:
            for a in range(0, len(b), 1000):
                part = b.slice(a, 1000)
                text = part.column("text")
                ids, bounds = enc.encode(text)
                null = np.array(text.is_null())
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32(), mask=np.append(null, False)) if null.any() else pa.array(bounds, pa.int32()), pa.array(ids))
                yield pa.RecordBatch.from_arrays([*[part.column(m) for m in meta], pa.array(np.diff(bounds).astype(np.int32)), lists], [*meta, "n_tokens", "token_ids"])

    return docs.select(*meta, "text").mapInArrow(tidied_stream(run), schema)


def write_tokens(tokens: DataFrame, path: str, encoding: str = "dictionary", row_group: int = ROW_GROUP_BYTES, page: int = PAGE_BYTES, page_rows: int = PAGE_ROWS, cluster: bool = False) -> None:
    """Write ``tokenized`` rows. encoding: of the ids, "dictionary" or "delta"."""
    if encoding not in ("dictionary", "delta"):
        raise ValueError(f"no such encoding: {encoding}")
    if "doc_id" in tokens.columns:
        tokens = tokens.repartitionByRange("doc_id") if cluster else tokens
        tokens = tokens.sortWithinPartitions("doc_id")
    (
        tokens.write.option("compression", "zstd")
        .option("parquet.writer.version", "v2")
        .option("parquet.block.size", row_group)
        .option("parquet.page.size", page)
        .option("parquet.page.row.count.limit", page_rows)
        .option("parquet.dictionary.page.size", 4 << 20)
        .option("parquet.enable.dictionary", "false")
        .option("parquet.enable.dictionary#source", "true")
        .option("parquet.enable.dictionary#lang", "true")
        .option("parquet.enable.dictionary#token_ids.list.element", str(encoding == "dictionary").lower())
        .parquet(path)
    )


def read_tokens(spark: SparkSession, path: str, doc_ids: Sequence[int] | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """Selective read: ids become a pushed filter that prunes row groups and pages, ``columns`` the read schema (without
    token_ids no page of tokens is read)."""
    df = spark.read.parquet(path)
    if doc_ids is not None:
        df = df.filter(F.col("doc_id").isin(list(doc_ids)))
    return df.select(*columns) if columns else df
