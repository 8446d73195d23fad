"""Tokenized pieces of documents, ready for packing."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsflow.llm.encoding import encoded, library_encoder


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, keeps_space: bool = False, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every document.

    A document's ids are those of its whole text (null: empty), then ``end_id``; only longer ones are cut, into pieces of
    ``capacity``, the last may be shorter. ids_crc32 is over little-endian unsigned 32-bit ids, which ``ids`` holds if
    asked for. One document at least gives one piece, whatever its id holds. Other columns are not read.
    """
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = library_encoder(tokenizer, keeps_space)
        for batch, found in encoded(batches, encoder):
            n = np.diff(found.first) + 1
            number = -(-n // capacity)
            row = np.repeat(np.arange(len(n)), number)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(number) - number, number)
            start = piece * capacity
            length = np.minimum(capacity, n[row] - start)
            flat = found.ids.astype("<u4")
            end = np.array([end_id], "<u4").tobytes()
            raw = []
            for r, s, size in zip(row.tolist(), start.tolist(), length.tolist()):
                a, b = found.first[r] + s, found.first[r + 1]
                raw.append(flat[a:a + size].tobytes() if a + size <= b else flat[a:b].tobytes() + end)
            columns = [batch.column("doc_id").take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length)]
            columns.append(pa.array([zlib.crc32(x) for x in raw], pa.int64()))
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array(raw, pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return docs.select(F.col("doc_id"), "text").mapInArrow(cut, schema)
