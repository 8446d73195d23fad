"""Removal of word sequences that an earlier document has, found by shared recompression symbols.

1. One pass names the runs and pairs of every text (`recompression`) and keeps, per document, the symbols
   that stand for its windows, and the name of the whole text.
2. Symbols that several documents have are found by an aggregation with partial minima and
   maxima, and joined back: only their windows can be repeats. A text whose whole name an earlier
   document has is a copy; all its windows are repeats, and no other document needs it.
3. The windows of shared symbols get the smallest document that has them, again by aggregation;
   names agree there in symbol and in a second fingerprint over all words of the window, 126 bits.
4. Each document removes the words under its windows that an earlier one has.

No step gathers a symbol's or window's documents: frequent ones are partly aggregated and their joins split.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from newsflow.llm.recompression import window_symbols
from newsflow.llm.store import drop, quoted, written
from newsflow.llm.words import Words, join_prints, members, mix, slices, windows, word_prints, words_of


def _whole(words: Words, prints: np.ndarray) -> np.ndarray:
    """Fingerprints (two rows) of each row's word sequence."""
    n = len(words.first) - 1
    place = (np.arange(len(prints)) - np.repeat(words.first[:-1], words.counts)).astype(np.uint64)
    out = np.zeros((2, n), np.uint64)
    for i, salt in enumerate((0x1B873593CC9E2D51, 0x85EBCA6BC2B2AE35)):
        np.add.at(out[i], words.doc, mix(prints ^ mix(place + np.uint64(salt))))
    return out.view(np.int64)


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32), values)


def symbol_table(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, n_words, w1, w2, symbols) of every text; symbols of its windows, neighbours once."""
    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column("text")
            for start, stop in slices(text):
                n = stop - start
                words = words_of(text.slice(start, n))
                prints = word_prints(words)
                begin = windows(words, width)
                keys, doc = window_symbols(words, prints, width)[begin].view(np.int64), words.doc[begin]
                fresh = np.append(True, (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1]))[:len(keys)]
                whole = _whole(words, prints)
                columns = [batch.column("doc_id").slice(start, n), pa.array(words.counts), pa.array(whole[0]), pa.array(whole[1])]
                columns.append(_lists(keys[fresh], np.bincount(doc[fresh], minlength=n)))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "w1", "w2", "symbols"])

    return docs.mapInArrow(parse, "doc_id long, n_words long, w1 long, w2 long, symbols array<long>")


def window_table(docs: DataFrame, width: int) -> DataFrame:
    """(symbol, print, doc_id) of the windows whose symbol is in the row's ``symbols``."""
    def list_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column("text")
            for start, stop in slices(text):
                n = stop - start
                words = words_of(text.slice(start, n))
                prints = word_prints(words)
                begin = windows(words, width)
                keys, doc = window_symbols(words, prints, width)[begin], words.doc[begin]
                wanted = batch.column("symbols").slice(start, n)
                owner = np.repeat(np.arange(n), wanted.value_lengths().to_numpy())
                tagged = np.sort(mix(wanted.flatten().to_numpy().view(np.uint64) ^ mix(owner.astype(np.uint64))))
                at = np.flatnonzero(members(mix(keys ^ mix(doc.astype(np.uint64))), tagged))
                full = join_prints(prints, width)[begin[at]]
                ids = batch.column("doc_id").slice(start, n).to_numpy()[doc[at]]
                yield pa.RecordBatch.from_arrays([pa.array(keys[at].view(np.int64)), pa.array(full.view(np.int64)), pa.array(ids)], ["symbol", "print", "doc_id"])

    return docs.mapInArrow(list_windows, "symbol long, print long, doc_id long")


SPANS = "n_words long, n_removed long, spans array<struct<start:int,stop:int>>, kept string"


def _cut(docs: DataFrame, width: int) -> DataFrame:
    """Words covered by the windows in ``prints``, or all words where the whole name is in ``copies``, are removed."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column("text")
            for start, stop in slices(text):
                n = stop - start
                words = words_of(text.slice(start, n))
                prints, doc = word_prints(words), words.doc
                begin = windows(words, width)
                full = join_prints(prints, width)[begin]
                tags = []
                for name in ("prints", "copies"):
                    wanted = batch.column(name).slice(start, n).fill_null([])
                    owner = np.repeat(np.arange(n), wanted.value_lengths().to_numpy())
                    tags.append(np.sort(mix(wanted.flatten().to_numpy().view(np.uint64) ^ mix(owner.astype(np.uint64)))))
                hit = begin[members(mix(full ^ mix(doc[begin].astype(np.uint64))), tags[0])]
                covered = np.zeros(len(prints) + 1, np.int64)
                np.add.at(covered, hit, 1)
                np.add.at(covered, hit + width, -1)
                gone = np.cumsum(covered)[:-1] > 0
                whole = _whole(words, prints)[0].view(np.uint64)
                copy = members(mix(whole ^ mix(np.arange(n, dtype=np.uint64))), tags[1])
                gone |= np.repeat(copy, words.counts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("key").slice(start, n), pa.array(words.counts), pa.array(np.bincount(doc[gone], minlength=n)),
                     _spans(gone, words), _kept(words, gone)], ["key", "n_words", "n_removed", "spans", "kept"])

    return docs.mapInArrow(cut, StructType([docs.schema["key"], *StructType.fromDDL(SPANS).fields]))


def _spans(gone: np.ndarray, words: Words) -> pa.ListArray:
    """Stretches of removed words of each row, counted from its first word."""
    inner = words.first[:-1][words.counts > 0]
    first = np.zeros(len(gone), bool)
    first[inner] = True
    last = np.append(first[1:], True)[:len(gone)]
    begins = np.flatnonzero(gone & (first | ~np.append(False, gone[:-1])[:len(gone)]))
    ends = np.flatnonzero(gone & (last | ~np.append(gone[1:], False)[:len(gone)])) + 1
    doc = words.doc[begins]
    base = words.first[doc]
    pairs = pa.StructArray.from_arrays([pa.array((begins - base).astype(np.int32)), pa.array((ends - base).astype(np.int32))], ["start", "stop"])
    return _lists(pairs, np.bincount(doc, minlength=len(words.counts)))


def _kept(words: Words, gone: np.ndarray) -> pa.Array:
    """The other words of each row, joined by one space."""
    stay = np.flatnonzero(~gone)
    start, size, doc = words.start[stay], words.end[stay] - words.start[stay], words.doc[stay]
    last = np.append(doc[1:] != doc[:-1], True)[:len(doc)]
    step = size + ~last  # a space after each word but a row's last
    total = int(step.sum())
    out = np.full(total, 32, np.uint8)
    begin = np.cumsum(step) - step
    place = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    out[np.repeat(begin, size) + place] = words.data[np.repeat(start, size) + place]
    ends = np.concatenate([[0], np.cumsum(np.bincount(doc, step, len(words.counts)))]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_string(), len(words.counts), [None, pa.py_buffer(ends), pa.py_buffer(out)]).cast(pa.string())


def remove_repeats(docs: DataFrame, width: int = 13, key: str = "doc_id", whole_rows: bool = False) -> DataFrame:
    """(key, n_words, n_removed, spans, kept) of every document; with ``whole_rows``, all its columns as a struct named row for the key.

    A window is ``width`` consecutive words of one document; words covered by a window whose words also
    begin in a document with a smaller id are removed; spans holds the removed stretches as word
    numbers, kept the other words joined by one space. Null texts have no words; texts shorter than a
    window keep all. Rows that share an id don't count as earlier than each other, and rows without an id
    are neither searched nor cut. Other columns are not read.
    """
    named = docs.select((F.struct(*map(quoted, docs.columns)) if whole_rows else quoted(key)).alias("key"), quoted(key).cast("long").alias("own"), "text")
    known = named.select(F.col("own").alias("doc_id"), "text").filter("doc_id is not null")
    table = written(symbol_table(known, width), "symbols")
    uses = table.select("doc_id", F.explode("symbols").alias("symbol"))
    shared = uses.groupBy("symbol").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).filter("low < high").select("symbol")
    whole = table.filter(F.col("n_words") >= width).select("doc_id", "n_words", "w1", "w2")
    first = whole.groupBy("n_words", "w1", "w2").agg(F.min("doc_id").alias("low"))
    told = whole.join(first, ["n_words", "w1", "w2"]).groupBy("doc_id").agg(
        F.min(F.col("doc_id") > F.col("low")).alias("copy"), F.collect_set(F.when(F.col("doc_id") > F.col("low"), F.col("w1"))).alias("copies"))
    copies = written(told.filter("size(copies) > 0"), "copies")
    asked = uses.join(shared, "symbol").groupBy("doc_id").agg(F.collect_set("symbol").alias("symbols"))
    asked = written(asked.join(copies.filter("copy").select("doc_id"), "doc_id", "left_anti"), "asked")
    drop(table)
    found = written(window_table(known.join(asked, "doc_id").select("doc_id", "text", "symbols"), width), "windows")
    drop(asked)
    earlier = found.groupBy("symbol", "print").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).filter("low < high")
    hits = found.join(earlier.select("symbol", "print", "low"), ["symbol", "print"]).filter("doc_id > low")
    hits = hits.groupBy("doc_id").agg(F.collect_set("print").alias("prints"))
    marks = hits.join(copies.select("doc_id", "copies"), "doc_id", "full").withColumnRenamed("doc_id", "id")
    cut = _cut(named.join(marks, F.col("own") == F.col("id"), "left").select("key", "text", "prints", "copies"), width)
    return cut.withColumnRenamed("key", "row" if whole_rows else key)
