"""Encoding of whole texts by the streaming transducer, and decoding back, over a table."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from newsflow.llm.encoding import encoded
from newsflow.llm.transducer import Decoder, transducer_encoder

#: Ids that a digest takes at once.
CHUNK = 1 << 16


def coded(docs: DataFrame, tokenizer: str, key: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256[, ids, decoded]) of every text (null: empty).

    ids_sha256 is over the decimal ids joined by one space, decoded_sha256 over the decoded text in UTF-8. Each row is
    coded alone: no shuffle; a long text is encoded and decoded in chunks. One row per input row, whatever the key
    holds; other columns are not read. ``with_ids`` adds the ids and the decoded text themselves.
    """
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, encoder = transducer_encoder(tokenizer)
        decimal = {i: str(i) for i in machine.token}
        for batch, found in encoded(batches, encoder):
            sums, texts, lists, wholes = [], [], [], []
            for a, b in zip(found.first[:-1].tolist(), found.first[1:].tolist()):
                ids_hash, text_hash, decoder, whole = hashlib.sha256(), hashlib.sha256(), Decoder(machine), []
                for at in range(a, b, CHUNK):
                    ids = found.ids[at:min(at + CHUNK, b)].tolist()
                    ids_hash.update(((" " if at > a else "") + " ".join(map(decimal.__getitem__, ids))).encode())
                    text = decoder.feed(ids)
                    text_hash.update(text.encode())
                    if with_ids:
                        whole.append(text)
                last = decoder.end()
                text_hash.update(last.encode())
                sums.append(ids_hash.hexdigest())
                texts.append(text_hash.hexdigest())
                if with_ids:
                    lists.append(found.ids[a:b].tolist())
                    wholes.append("".join(whole) + last)
            columns = [batch.column("key"), pa.array(found.first[1:] - found.first[:-1]), pa.array(sums, pa.string()), pa.array(texts, pa.string())]
            if with_ids:
                columns += [pa.array(lists, pa.list_(pa.int64())), pa.array(wholes, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names)

    told = "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<long>, decoded string" * with_ids
    schema = StructType([StructField("key", docs.schema[key].dataType), *StructType.fromDDL(told).fields])
    names = schema.fieldNames()
    return docs.select(F.col(key).alias("key"), "text").mapInArrow(code, schema).withColumnRenamed("key", key)
