"""Alignment of two tokenizers over whole texts: groups between common token ends, and link statistics of the corpus.

1. Texts are cut where neither tokenizer has a token across (single spaces between other characters); each distinct
   piece of a slice of documents is encoded and aligned once.
2. Documents of more than ``CHUNK`` bytes become byte ranges, cut wherever the range is full, that tasks turn into fragments
   (`fragments`); rounds compose ``FAN`` neighbours each until a document has one.
3. Id pairs are summed by an aggregation. Slices ask for their distinct pairs' sums by parts of the pairs' hash, and
   add them up per document. A pair that every text has is one entry a slice, so no key gathers its links.
"""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsflow.llm.encoding import plain_space_cuts
from newsflow.llm.fragments import Fragment, Closed, Tokens, composed, counted, finished, group_texts, links
from newsflow.llm.store import drop, small_input, written
from newsflow.llm.transducer import byte_letters
from newsflow.llm.words import mix, raw_bytes, slices

#: Bytes of a byte range, fragments composed at once, bytes of a slice of documents, bytes that a piece table may hold, pair entries of a task.
CHUNK, FAN, SLICE, TABLE, HELD = 1 << 16, 8, 1 << 20, 96 << 20, 4_000_000


class Pair:
    """Both tokenizers: ids of pieces, and the bytes that each id stands for."""

    def __init__(self, path_a: str, path_b: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are parallel already
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        byte = {letter: i for i, letter in enumerate(byte_letters())}
        self.a_bytes = {i: bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode() for token, i in self.a.get_vocab().items()}
        self.b_bytes = {}
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            self.b_bytes[i] = bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()
        self.a_size, self.b_size = (np.array([len(t.get(i, b"")) for i in range(max(t) + 1)], np.int64) for t in (self.a_bytes, self.b_bytes))

    def encode(self, pieces: list[str]) -> tuple[list[list[int]], list[list[int]], np.ndarray]:
        """Ids of both sides of pieces that begin with a space, and whether both give the piece's bytes back."""
        a = [x.ids for x in self.a.encode_batch_fast(pieces, add_special_tokens=False)]
        b = self.b.encode([p[1:] for p in pieces], num_threads=1)
        raw = [p.encode() for p in pieces]
        good = [b"".join(map(self.a_bytes.__getitem__, x)) == r == b"".join(map(self.b_bytes.__getitem__, y)) for x, y, r in zip(a, b, raw)]
        return a, b, np.array(good, bool)

    def tokens(self, a: list[list[int]], b: list[list[int]]) -> Tokens:
        """Pieces in text order as one token sequence, offsets counted from the first."""
        one = np.fromiter((i for x in a for i in x), np.int64)
        two = np.fromiter((i for x in b for i in x), np.int64)
        return Tokens(one, np.cumsum(self.a_size[one]), two, np.cumsum(self.b_size[two]))


class PieceTable:
    """Alignments of the pieces seen so far, in bounded memory. Made for one task."""

    def __init__(self, pair: Pair) -> None:
        self.pair = pair
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.text: list[str] = []
        self.numbers = np.zeros((1 << 12, 6), np.int64)  # valid, n_a, n_b, n_groups, first link, links
        self.link, self.used, self.bytes = np.zeros(1 << 14, np.int64), 0, 0

    def learn(self, pieces: list[str]) -> None:
        for begin in range(0, len(pieces), 20_000):
            part = pieces[begin:begin + 20_000]
            a, b, good = self.pair.encode(part)
            at, n = len(self.place), len(part)
            while at + n > len(self.numbers):
                self.numbers = np.concatenate([self.numbers, np.zeros_like(self.numbers)])
            self.place.update(zip(part, range(at, at + n)))
            ok = np.flatnonzero(good)
            t = self.pair.tokens([a[i] for i in ok], [b[i] for i in ok])
            size = np.array([len(part[i].encode()) for i in ok], np.int64)
            stop = np.cumsum(size)
            common, groups = group_texts(t)
            keys, ends = links(t), np.union1d(t.a_end, t.b_end)
            while self.used + len(keys) > len(self.link):
                self.link = np.concatenate([self.link, np.zeros_like(self.link)])
            self.link[self.used:self.used + len(keys)] = keys
            rows = np.zeros((n, 6), np.int64)
            bounds = [np.searchsorted(e, stop, "right") for e in (t.a_end, t.b_end, common, ends)]
            rows[ok, 0] = 1
            for column, bound in enumerate(bounds[:3], 1):
                rows[ok, column] = np.diff(bound, prepend=0)
            rows[ok, 5] = np.diff(bounds[3], prepend=0)
            rows[ok, 4] = self.used + bounds[3] - rows[ok, 5]
            self.numbers[at:at + n] = rows
            self.used += len(keys)
            texts, k = [""] * n, 0
            for i, m in zip(ok.tolist(), bounds[2].tolist()):
                texts[i] = ";".join(groups[k:m])
                k = m
            self.text += texts
            self.bytes += sum(map(len, texts)) + sum(map(len, part)) + 260 * n + 8 * len(keys)

    def places(self, pieces: list[str]) -> np.ndarray:
        if self.bytes > TABLE:
            self.forget()
        missing = [p for p in pieces if p not in self.place]
        if missing:
            self.learn(missing)
        return np.fromiter(map(self.place.__getitem__, pieces), np.int64, len(pieces))


def cut_pieces(data: np.ndarray, rows: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct pieces of texts that begin with a space, which of them follow each other, and how many each row has."""
    cut = np.zeros(len(data), bool)
    cut[rows[:-1][np.diff(rows) > 0]] = True
    cut[plain_space_cuts(data)] = True
    begin = np.flatnonzero(cut)
    parts = pa.Array.from_buffers(pa.large_string(), len(begin), [None, pa.py_buffer(np.append(begin, len(data))), pa.py_buffer(np.ascontiguousarray(data))])
    coded = parts.dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(), np.diff(np.searchsorted(begin, rows))


def spaced(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts with a space before each, and where each begins; nothing where there is no text."""
    data, rows = raw_bytes(column)
    size = np.diff(rows)
    begin = np.concatenate([[0], np.cumsum(size + (size > 0))])
    out = np.full(int(begin[-1]), 32, np.uint8)
    own = np.ones(len(out), bool)
    own[begin[:-1][size > 0]] = False
    out[own] = data
    return out, begin


def _starts(counts: np.ndarray) -> np.ndarray:
    return np.cumsum(counts) - counts


def _per_row(values: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(row, values, n).astype(np.int64)


STATS = ("n_a", "n_b", "n_groups")
SLICES = "slice string, id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, digest array<string>, {}keys binary, totals binary, first binary, pair binary, times binary"


def _schema(with_groups: bool) -> str:
    return SLICES.format("groups array<string>, " if with_groups else "")


def _slice_row(ids: list, stats: np.ndarray, digest: list[str], groups: list[str] | None, keys: np.ndarray, totals: np.ndarray, first: np.ndarray, pair: np.ndarray, times: np.ndarray) -> pa.RecordBatch:
    row = {"slice": [uuid.uuid4().hex], "id": pa.array([ids], pa.list_(pa.int64()))}
    row |= {name: pa.array([stats[:, i].tolist()], pa.list_(pa.int64())) for i, name in enumerate(STATS)}
    row |= {"digest": pa.array([digest], pa.list_(pa.string()))} | ({"groups": pa.array([groups], pa.list_(pa.string()))} if groups is not None else {})
    arrays = {"keys": keys.astype("<i8"), "totals": totals.astype("<i8"), "first": first.astype("<i8"), "pair": pair.astype("<u4"), "times": times.astype("<u4")}
    return pa.RecordBatch.from_pydict(row | {name: pa.array([x.tobytes()], pa.binary()) for name, x in arrays.items()})


def _short_slices(path_a: str, path_b: str, with_groups: bool):
    """Slices of documents that one task aligns whole."""
    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = None
        for batch in batches:
            text = batch.column("text")
            for start, stop in slices(text, SLICE):
                table = table or PieceTable(Pair(path_a, path_b))
                n = stop - start
                distinct, which, counts = cut_pieces(*spaced(text.slice(start, n)))
                place = table.places(distinct)[which] if len(which) else np.zeros(0, np.int64)
                row = np.repeat(np.arange(n), counts)
                told = table.numbers[place]
                valid = (counts > 0) & (_per_row(1 - told[:, 0], row, n) == 0)
                stats = np.column_stack([_per_row(told[:, i], row, n) for i in (1, 2, 3)]) * valid[:, None]
                digest, groups, begins = [], [], _starts(counts)
                for r, (a, size) in enumerate(zip(begins.tolist(), counts.tolist())):
                    whole = ";".join([table.text[i] for i in place[a:a + size].tolist()]) if valid[r] else ""
                    digest.append(hashlib.sha256(whole.encode()).hexdigest() if valid[r] else "")
                    if with_groups:
                        groups.append(whole)
                use = valid[row]
                size, at, owner = told[use, 5], told[use, 4], row[use]
                link = table.link[np.arange(int(size.sum())) + np.repeat(at - _starts(size), size)]
                keys, code = np.unique(link, return_inverse=True)
                both, times = counted(np.repeat(owner, size) * np.int64(max(len(keys), 1)) + code)
                doc, pair = np.divmod(both, max(len(keys), 1))
                totals = np.bincount(pair, times, len(keys)).astype(np.int64)
                yield _slice_row(batch.column("doc_id").slice(start, n).to_pylist(), stats, digest, groups if with_groups else None,
                                 keys, totals, np.searchsorted(doc, np.arange(n + 1)), pair, times)

    return align


CHUNKS = "uid long, doc_id long, part long, low long, high long, base long, text string"


def _chunked(size: int):
    """Byte ranges of each text (with its space), and the text between the safe cuts around them.

    A range that would end in a stretch without safe cut longer than a range ends with the stretch: its pieces can't be encoded apart.
    """
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uid, doc, text in zip(batch.column("uid").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("text")):
                raw = b" " + text.as_buffer().to_pybytes()
                cuts = np.concatenate([[0], plain_space_cuts(np.frombuffer(raw, np.uint8)), [len(raw)]])
                low, part = 0, 0
                while low < len(raw):
                    high = min(low + size, len(raw))
                    after = int(cuts[np.searchsorted(cuts, high)])
                    before = int(cuts[np.searchsorted(cuts, high, "right") - 1])
                    if after - before > size:
                        high = after
                    begin = int(cuts[np.searchsorted(cuts, low, "right") - 1])
                    yield pa.RecordBatch.from_pydict({
                        "uid": [uid], "doc_id": pa.array([doc], pa.int64()), "part": [part], "low": [low], "high": [high], "base": [begin],
                        "text": [raw[begin:after].decode()]})
                    low, part = high, part + 1

    return cut


FRAGMENTS = "uid long, doc_id long, part long, valid boolean, cut boolean, prefix binary, suffix binary, groups string, n_groups long, n_a long, n_b long, keys binary, times binary"


def _fragment_row(uid: int, doc: int | None, part: int, valid: bool, f: Fragment) -> pa.RecordBatch:
    f = f if valid else Fragment()
    return pa.RecordBatch.from_pydict({
        "uid": [uid], "doc_id": pa.array([doc], pa.int64()), "part": [part], "valid": [valid], "cut": [f.cut], "prefix": [f.prefix.dump()], "suffix": [f.suffix.dump()],
        "groups": pa.array([f.closed.groups], pa.string()), "n_groups": [f.closed.n_groups], "n_a": [f.closed.n_a], "n_b": [f.closed.n_b],
        "keys": [f.closed.keys.astype("<i8").tobytes()], "times": [f.closed.times.astype("<i8").tobytes()]})


def _fragment(row: dict) -> Fragment:
    closed = Closed(row["groups"], row["n_groups"], row["n_a"], row["n_b"], np.frombuffer(row["keys"], "<i8"), np.frombuffer(row["times"], "<i8"))
    return Fragment(row["cut"], Tokens.load(row["prefix"]), closed, Tokens.load(row["suffix"]))


def _fragments(path_a: str, path_b: str):
    """The fragment of each byte range."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = None
        for batch in batches:
            for i, row in enumerate(batch.select(["uid", "doc_id", "part", "low", "high", "base"]).to_pylist()):
                pair = pair or Pair(path_a, path_b)
                distinct, which, _ = cut_pieces(*raw_bytes(batch.column("text").slice(i, 1)))
                a, b, good = pair.encode(distinct)
                t = pair.tokens([a[w] for w in which], [b[w] for w in which])
                t = Tokens(t.a, t.a_end + row["base"], t.b, t.b_end + row["base"])
                yield _fragment_row(row["uid"], row["doc_id"], row["part"], bool(good.all()), Fragment.of(t.within(row["low"], row["high"])))

    return read


def _compose(fan: int):
    """Neighbours of one document as one fragment."""
    def join(rows: pa.Table) -> pa.Table:
        told = rows.sort_by("part").to_pylist()
        valid = all(r["valid"] for r in told)
        whole = composed([_fragment(r) for r in told]) if valid else Fragment()
        return pa.Table.from_batches([_fragment_row(told[0]["uid"], told[0]["doc_id"], told[0]["part"] // fan, valid, whole)])

    return join


def _long_slices(with_groups: bool):
    """Finished documents as slices of one document."""
    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                c = finished(_fragment(row)) if row["valid"] else Closed()
                digest = hashlib.sha256(c.groups.encode()).hexdigest() if row["valid"] else ""
                yield _slice_row([row["doc_id"]], np.array([[c.n_a, c.n_b, c.n_groups]]), [digest], [c.groups] if with_groups else None,
                                 c.keys, c.times, np.array([0, len(c.keys)]), np.arange(len(c.keys)), c.times)

    return finish


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A slice's distinct pairs as rows."""
    for batch in batches:
        for keys, totals in zip(batch.column("keys"), batch.column("totals")):
            key = np.frombuffer(keys.as_buffer(), "<i8")
            for i in range(0, len(key), 1 << 16):
                yield pa.RecordBatch.from_pydict({
                    "a": pa.array((key[i:i + (1 << 16)] >> 32).astype(np.int32)), "b": pa.array((key[i:i + (1 << 16)] & 0xFFFFFFFF).astype(np.int32)),
                    "n": np.frombuffer(totals.as_buffer(), "<i8")[i:i + (1 << 16)]})


def _parts(keys: np.ndarray, bits: int) -> np.ndarray:
    return (mix(keys.view(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)


def _asked(bits: int):
    """A slice's pairs, dealt to the parts that know their sums."""
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, raw in zip(batch.column("slice").to_pylist(), batch.column("keys")):
                keys = np.frombuffer(raw.as_buffer(), "<i8")
                part = _parts(keys, bits)
                order = np.argsort(part, kind="stable")
                ends = np.cumsum(np.bincount(part, minlength=1))
                chosen = np.flatnonzero(np.diff(ends, prepend=0))
                yield pa.RecordBatch.from_pydict({
                    "part": pa.array(chosen, pa.int64()), "slice": pa.array([name] * len(chosen), pa.string()),
                    "keys": pa.array([keys[order[(ends[c - 1] if c else 0):ends[c]]].tobytes() for c in chosen], pa.binary())})

    return ask


def _placed(bits: int):
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = (batch.column("a").to_numpy().astype(np.int64) << 32) | batch.column("b").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(_parts(keys, bits)), pa.array(keys), batch.column("n"), batch.column("best")], ["part", "key", "n", "best"])

    return place


def _answered(asked: pa.Table, known: pa.Table) -> pa.Table:
    """Sums of the asked pairs of one part, per asking row; the best of their B id have a negative sign."""
    order = np.argsort(known["key"].to_numpy())
    key = known["key"].to_numpy()[order]
    n = (known["n"].to_numpy() * np.where(known["best"].to_numpy(), -1, 1))[order]
    sums = [n[np.searchsorted(key, np.frombuffer(x.as_buffer(), "<i8"))].astype("<i8").tobytes() for x in asked["keys"]]
    return pa.table({"slice": asked["slice"], "answer": pa.StructArray.from_arrays([asked["keys"].combine_chunks(), pa.array(sums, pa.binary())], ["keys", "sums"])})


def _rows(with_groups: bool):
    """Documents with their link sums."""
    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                first = np.frombuffer(row["first"], "<i8")
                pair, times = np.frombuffer(row["pair"], "<u4"), np.frombuffer(row["times"], "<u4").astype(np.int64)
                answers = row["answers"] or []
                keys = np.frombuffer(b"".join(x["keys"] for x in answers), "<i8")
                sums = np.frombuffer(b"".join(x["sums"] for x in answers), "<i8")[np.argsort(keys)]
                ends = lambda x: np.concatenate([[0], np.cumsum(x)])
                n = sums[pair]
                told = [ends(x)[first[1:]] - ends(x)[first[:-1]] for x in (times, times * (n < 0), times * np.abs(n))]
                out = {"doc_id": pa.array(row["id"], pa.int64())} | {s: row[s] for s in STATS}
                out |= {"n_links": told[0], "n_best": told[1], "count_sum": told[2], "groups_sha256": pa.array(row["digest"], pa.string())}
                yield pa.RecordBatch.from_pydict(out | ({"groups": pa.array(row["groups"], pa.string())} if with_groups else {}))

    return tell


def aligned(docs: DataFrame, path_a: str, path_b: str, with_groups: bool = False, chunk: int = CHUNK, fan: int = FAN) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256[, groups]) of every document.

    ``path_a`` is a byte-level tokenizer file that encodes space + text, ``path_b`` a sentence-piece model that adds the space
    itself; special tokens' strings are plain text. Groups are the tokens between places where both sides end, written ``a1,a2|b1;a3|b2``. Links
    are all pairs of overlapping tokens; an id pair's count is its links in the corpus, n_best the links whose count is the highest of
    their B id, count_sum the counts' sum over links. Texts that are null or empty, or that a side does not give back byte by byte, have
    no tokens: zeros and empty strings. One row per input row, whatever the id; other columns are not read.
    """
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    big = F.octet_length("text") >= chunk
    schema = _schema(with_groups)
    short = small_input(known).filter(F.coalesce(~big, F.lit(True))).mapInArrow(_short_slices(path_a, path_b, with_groups), schema)
    # Numbered on the scan itself, so that a row has the same number however often it is read.
    chunks = written(known.withColumn("uid", F.monotonically_increasing_id()).filter(big).mapInArrow(_chunked(chunk), CHUNKS).repartition("uid", "part"), "chunks")
    parts = (chunks.agg(F.max("part")).first()[0] or 0) + 1
    frags = written(chunks.mapInArrow(_fragments(path_a, path_b), FRAGMENTS), "fragments")
    drop(chunks)
    while parts > 1:
        joined = written(frags.groupBy("uid", F.floor(F.col("part") / fan).alias("next")).applyInArrow(_compose(fan), FRAGMENTS), "fragments")
        drop(frags)
        frags, parts = joined, -(-parts // fan)
    table = written(short.unionByName(frags.mapInArrow(_long_slices(with_groups), schema)), "slices")
    drop(frags)
    sums = table.select("keys", "totals").mapInArrow(_listed, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))
    sums = written(sums, "pairs")
    known_best = sums.groupBy("b").agg(F.max("n").alias("top"))
    told = sums.join(known_best, "b").select("a", "b", "n", (F.col("n") == F.col("top")).alias("best"))
    entries = (table.agg(F.sum(F.length("keys"))).first()[0] or 0) // 8
    bits = max(-(-entries // HELD) - 1, 0).bit_length()
    asked = table.select("slice", "keys").mapInArrow(_asked(bits), "part long, slice string, keys binary")
    placed = told.mapInArrow(_placed(bits), "part long, key long, n long, best boolean")
    answers = asked.groupBy("part").cogroup(placed.groupBy("part")).applyInArrow(_answered, "slice string, answer struct<keys:binary,sums:binary>")
    answers = answers.groupBy("slice").agg(F.collect_list("answer").alias("answers"))
    out = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string" + ", groups string" * with_groups
    return table.drop("keys", "totals").join(answers, "slice", "left").mapInArrow(_rows(with_groups), out)
