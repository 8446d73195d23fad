"""Near-duplicate documents: SuperMinHash bands, verification on full shingle sets, components.

1. One pass over the texts gives each document the size and a 128-bit fingerprint of its shingle
   set and its band keys. Documents with the same set are one class, represented by the smallest id.
2. Classes that share a band key are candidates, if their set sizes and signatures allow the similarity at
   all. All pairs of a bucket are not made: first its most popular member, the hub, is compared with
   the others. Verified links join components; buckets that have become one component are done. In the
   others, the members outside of the largest component are compared with all members, in blocks of
   documents that share a hub. So each pair of a bucket is compared, or is connected without it.
3. Components of the links, and each document's class, give the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsflow.llm.components import components
from newsflow.llm.store import written
from newsflow.llm.superminhash import band_keys, fragments, shingle_sets, signatures
from newsflow.llm.words import members, mix, slices, words_of

# Bands and slots per band: a pair at 0.8 shares no band with a chance of (1 - 0.8**4)**27 < 1e-6.
BANDS, ROWS = 27, 4
#: Documents whose sets a task holds at once in the second round, about.
BLOCK = 256


def set_table(docs: DataFrame, width: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, p1, p2, bands, slots) per row; a text without words has n_shingles 0."""
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column("text")
            for start, stop in slices(text):
                n = stop - start
                keys, owner = shingle_sets(words_of(text.slice(start, n), lower=True), width)
                size = np.bincount(owner, minlength=n)
                prints = np.zeros((2, n), np.uint64)
                for i, scrambled in enumerate((mix(keys), mix(keys ^ np.uint64(0x5DEECE66D)))):
                    np.add.at(prints[i], owner, scrambled)
                signed = signatures(keys, owner, n, bands * rows)
                lists = [
                    pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * x.shape[1], x.view(np.int64).ravel())
                    for x in (band_keys(signed, bands, rows), fragments(signed))]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(start, n), pa.array(size), *(pa.array(p.astype(np.int64)) for p in prints), *lists],
                    ["doc_id", "n_shingles", "p1", "p2", "bands", "slots"])

    rows_ = docs.select(F.col("doc_id").cast("long"), "text")
    return rows_.mapInArrow(sets, "doc_id long, n_shingles long, p1 long, p2 long, bands array<long>, slots array<long>")


def verified_links(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets have 100 * intersection >= percent * union."""
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column("text_a"), batch.column("text_b")
            for start, stop in slices(left):
                n = stop - start
                sides = [shingle_sets(words_of(x.slice(start, n), lower=True), width) for x in (left, right)]
                tagged = [mix(keys ^ mix(owner.astype(np.uint64))) for keys, owner in sides]
                common = np.bincount(sides[1][1][members(tagged[1], np.sort(tagged[0]))], minlength=n)
                union = sum(np.bincount(owner, minlength=n) for _, owner in sides) - common
                good = pa.array((100 * common >= percent * union) & (common > 0))
                yield pa.RecordBatch.from_arrays([batch.column(c).slice(start, n).filter(good) for c in ("a", "b")], ["a", "b"])

    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text").filter("id is not null")
    left = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    both = left.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(check, "a long, b long")


def _may_link(slots: int, percent: int):
    """Whether the sizes and signatures of x and y (n, s) allow a link.

    The signature test is six standard deviations below what a pair at the threshold agrees in, a chance
    of 1e-9 per pair, less than that of sharing no band.
    """
    share = percent / 100
    least = int(slots * share - 6 * (slots * share * (1 - share)) ** 0.5)
    def unlike(a, b):
        x = a.bitwiseXOR(b)
        for step in (4, 2, 1):  # each byte's lowest bit: whether any of its bits is set
            x = x.bitwiseOR(F.shiftrightunsigned(x, step))
        return F.bit_count(x.bitwiseAND(F.lit(0x0101010101010101)))

    different = F.aggregate(F.zip_with("x.s", "y.s", unlike), F.lit(0), lambda total, n: total + n)
    sizes = 100 * F.least("x.n", "y.n") >= percent * F.greatest("x.n", "y.n")
    return sizes & (different <= slots - least)


def _links(docs: DataFrame, classes: DataFrame, width: int, percent: int, slots: int) -> DataFrame:
    """(node, root) of the representatives that are linked with a smaller one."""
    keyed = classes.select("rep", "n", "s", F.explode("bands").alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    live = written(keyed.join(sizes, "key").select("key", "rep", "n", "s", "size"), "buckets")
    # The member whose buckets are largest is nearest to the middle of its group.
    liked = live.groupBy("rep").agg(F.sum("size").alias("liked"))
    hubs = written(live.select("key", "rep").join(liked, "rep").groupBy("key").agg(F.max(F.struct("liked", "rep")).alias("top")), "hubs")
    told = hubs.select("key", F.col("top.rep").alias("rep")).join(live.select("key", "rep", "n", "s"), ["key", "rep"])
    pair = [F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b")]
    pairs = live.alias("x").join(told.alias("y"), F.col("x.key") == F.col("y.key")).filter(F.col("x.rep") != F.col("y.rep"))
    roots = components(verified_links(pairs.filter(_may_link(slots, percent)).select(*pair).distinct(), docs, width, percent))
    rooted = live.join(roots, live["rep"] == roots["node"], "left").select("key", "rep", F.coalesce("root", "rep").alias("root"))
    weights = rooted.groupBy("key", "root").agg(F.count("*").alias("weight")).groupBy("key")
    main = weights.agg(F.max(F.struct("weight", "root"))["root"].alias("main"), F.count("*").alias("roots")).filter("roots > 1").select("key", "main")
    # Members that share their most popular hub are dealt to the same few blocks.
    home = live.select("key", "rep").join(hubs, "key").groupBy("rep").agg(F.max("top")["rep"].alias("home"))
    blocks = F.ceil(F.col("size") / BLOCK)
    homes = home.groupBy("home").agg(F.count("*").alias("size"))
    dealt = home.join(homes, "home").select("rep", F.xxhash64("home", F.pmod(F.xxhash64("rep"), blocks)).alias("block"))
    open_ = written(rooted.join(main, "key").join(dealt, "rep"), "open")
    targets = open_.select("key", "block").distinct()
    asked = open_.filter("root <> main").select("key", "rep", "root").join(targets, "key").select("block", F.lit(1).alias("kind"), "rep", "root").distinct()
    resident = open_.select("block", F.lit(0).alias("kind"), "rep", "root").distinct()
    found = block_links(resident.unionByName(asked), docs, width, percent)
    return components(found.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))))


def block_links(rows: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b) between the documents asked about (kind 1) and the residents (kind 0) of each block.

    A task holds the sets of one block, at most about BLOCK documents, and takes the asked ones one by one; of the residents
    of a component that a document is linked with, it names one.
    """
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, index = None, [], None
        for batch in batches:
            blocks, kinds = batch.column("block").to_numpy(), batch.column("kind").to_numpy()
            cuts = np.flatnonzero((blocks[1:] != blocks[:-1]) | (kinds[1:] != kinds[:-1])) + 1
            for begin, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(blocks)]):
                if blocks[begin] != block:
                    block, held, index = blocks[begin], [], None
                part = batch.slice(begin, end - begin)
                for start, stop in slices(part.column("text")):
                    n = stop - start
                    keys, owner = shingle_sets(words_of(part.column("text").slice(start, n), lower=True), width)
                    ids, root = (part.column(c).slice(start, n).to_numpy() for c in ("rep", "root"))
                    if kinds[begin] == 0:
                        held.append((keys, owner, ids, root))
                        continue
                    if index is None:
                        index = _index(held)
                    links = _probe(index, keys, owner, ids, root, percent)
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in links], ["a", "b"])

    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), "text").filter("rep is not null")
    met = rows.join(texts, "rep").repartition("block").sortWithinPartitions("block", "kind")
    return met.select("block", "kind", "rep", "root", "text").mapInArrow(search, "a long, b long")


def _index(held: list[tuple]) -> tuple:
    """Sorted shingles of a block with their owners, and the owners' set sizes, ids and components."""
    first = np.cumsum([0, *(len(h[2]) for h in held)])
    keys = np.concatenate([h[0] for h in held])
    owner = np.concatenate([h[1] + f for h, f in zip(held, first)])
    order = np.argsort(keys, kind="stable")
    ids, roots = (np.concatenate([h[i] for h in held]) for i in (2, 3))
    return keys[order], owner[order], np.bincount(owner, minlength=len(ids)), ids, roots


def _probe(index: tuple, keys: np.ndarray, owner: np.ndarray, ids: np.ndarray, roots: np.ndarray, percent: int) -> tuple[list[int], list[int]]:
    known, whose, sizes, others, components_ = index
    a, b = [], []
    low, high = np.searchsorted(known, keys), np.searchsorted(known, keys, "right")
    first = np.searchsorted(owner, np.arange(len(ids) + 1))
    for i in range(len(ids)):
        s, e = low[first[i]:first[i + 1]], high[first[i]:first[i + 1]]
        count = e - s
        at = np.arange(int(count.sum())) + np.repeat(s - (np.cumsum(count) - count), count)
        common = np.bincount(whose[at], minlength=len(sizes))
        good = (100 * common >= percent * (sizes + len(s) - common)) & (common > 0) & (components_ != roots[i])
        for j in np.unique(components_[good], return_index=True)[1].tolist():
            a.append(int(ids[i]))
            b.append(int(others[np.flatnonzero(good)[j]]))
    return a, b


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every document.

    Words are lower-cased (A-Z); a set holds the distinct ``width``-word shingles, or all words of
    a shorter text as one; null, empty and blank texts have none and are linked with nothing. Documents are
    linked where 100 * intersection >= percent * union; component_id is the smallest id reachable. Rows that
    share an id are one node, linked where any of their texts is. A row without an id stays alone: component_id
    null, kept. Other columns are not read.
    """
    docs = docs.select("doc_id", "text")
    table = written(set_table(docs, width, bands, rows), "sets")
    full = table.filter("n_shingles > 0 and doc_id is not null")
    print_ = ["p1", "p2", "n_shingles"]
    classes = full.groupBy(*print_).agg(F.min("doc_id").alias("rep"))
    banded = full.join(classes, print_).filter("doc_id = rep").select("rep", F.col("n_shingles").alias("n"), F.col("slots").alias("s"), "bands")
    roots = _links(docs, banded.dropDuplicates(["rep", "bands"]), width, percent, bands * rows)
    # Rows that share an id tie the classes of their sets.
    classes = classes.join(roots, classes["rep"] == roots["node"], "left").select(*print_, F.coalesce("root", "rep").alias("root"))
    own = full.select("doc_id", *print_).join(classes, print_).select("doc_id", "n_shingles", F.col("root").alias("component_id"))
    rest = table.filter("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return own.unionByName(rest).select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
