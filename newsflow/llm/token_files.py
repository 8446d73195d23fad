"""Token ids of a corpus as shards of wavelet matrices, written in id order and read back.

A shard is one row of a Parquet table, whose files any store that Spark writes to can hold: the documents'
ids and token counts, and the wavelet matrix of all their tokens as one compressed block. Rows (part, shard) in
ascending order hold the documents in ascending order.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsflow.llm.encoding import encoded, library_encoder
from newsflow.llm.wavelet import WaveletMatrix

#: Text bytes that a task sorts, and tokens after which a shard ends (with the document that reaches them).
PART_BYTES, SHARD_TOKENS = 24 << 20, 1 << 20

SHARDS = "part int, shard int, doc_ids array<long>, sizes array<long>, n_tokens long, tokens binary"


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int, path: str, keeps_space: bool = True, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Write the shards of all documents below ``path`` and return them as read from there.

    Ascending doc_id, rows without an id first, rows that share an id by text; each document is its text's ids
    (null: none), then ``end_id``. Documents are dealt by ranges of doc_id, so no task holds more than a range; an empty
    table gives no shard. Other columns are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = docs.repartitionByRange(max(1, -(-total // PART_BYTES), docs.sparkSession.sparkContext.defaultParallelism), "doc_id")
    ordered = parts.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text").select(F.spark_partition_id().alias("part"), "doc_id", "text")

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = library_encoder(tokenizer, keeps_space)
        doc_ids, sizes, ids, held, shard, part = [], [], [], 0, 0, 0

        def row() -> pa.RecordBatch:
            tokens = WaveletMatrix.of(np.concatenate(ids)).to_bytes()
            values = [[part], [shard], [doc_ids], [sizes], [held], [tokens]]
            kinds = [pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, kinds)], [c.split()[0] for c in SHARDS.split(", ")])

        for batch, found in encoded(batches, encoder):
            part = batch.column("part")[0].as_py()
            names = batch.column("doc_id").to_pylist()
            n = np.diff(found.first) + 1
            flat = np.insert(found.ids, found.first[1:], end_id)
            ends = np.cumsum(n)
            done = 0
            for i, name in enumerate(names):
                doc_ids.append(name)
                sizes.append(int(n[i]))
                if held + int(ends[i]) - done >= shard_tokens or i + 1 == len(names):
                    ids.append(flat[done:ends[i]])
                    held, done = held + int(ends[i]) - done, int(ends[i])
                    if held >= shard_tokens:
                        yield row()
                        doc_ids, sizes, ids, held, shard = [], [], [], 0, shard + 1
        if doc_ids:
            yield row()

    ordered.mapInArrow(shards, SHARDS).write.option("compression", "none").parquet(path)
    return docs.sparkSession.read.schema(SHARDS).parquet(path)


def read_tokens(shards: DataFrame, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every document of the shards, tokens taken out of their wavelet matrices.

    start counts the tokens of all documents before it: inside the shard, plus the shards before. Only one row per
    shard, and one per part for the parts before, meet in a window.
    """
    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                get = lambda name: batch.column(name)[i]  # noqa: E731, B023
                sizes = np.array(get("sizes").as_py(), np.int64)
                ids = WaveletMatrix.from_bytes(get("tokens").as_py()).ids().astype("<u4")
                ends = np.cumsum(sizes)
                raw = [ids[a:b].tobytes() for a, b in zip((ends - sizes).tolist(), ends.tolist())]
                n = len(sizes)
                columns = [pa.array([get("part").as_py()] * n, pa.int32()), pa.array([get("shard").as_py()] * n, pa.int32()), get("doc_ids").values,
                           pa.array(ends - sizes), pa.array(sizes), pa.array([zlib.crc32(x) for x in raw], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns + ([pa.array(raw, pa.binary())] if with_ids else []), names)

    schema = "part int, shard int, doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    names = [c.split()[0] for c in schema.split(", ")]
    sizes = shards.select("part", "shard", "n_tokens")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.join(parts, "part").select("part", "shard", (F.col("before") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).alias("first"))
    docs = shards.mapInArrow(unpack, schema).join(first, ["part", "shard"])
    return docs.select("doc_id", (F.col("first") + F.col("start")).alias("start"), *names[4:])
