"""op1, op2 and op7 against the tokenizers library and brute force."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")

from newsflow.llm.coding import coded  # noqa: E402
from newsflow.llm.encoding import PieceEncoder, space_cuts, word_cuts  # noqa: E402
from newsflow.llm.packing import best_fit, lower_bound, pack, pack_lengths  # noqa: E402
from newsflow.llm.store import new_folder  # noqa: E402
from newsflow.llm.token_files import read_tokens, write_tokens  # noqa: E402
from newsflow.llm.token_pieces import token_pieces  # noqa: E402
from newsflow.llm.transducer import BytePairTokenizer, Transducer, sufficient_lookahead  # noqa: E402
from newsflow.llm.wavelet import WaveletMatrix  # noqa: E402

FILES = ["word_bpe_49k.json", "byte_bpe_50k.json"]
LETTERS = [" ", "\n", "a", "b", "é", " ", ".", "'", "s", "1", "\t", "!", "́", "　", "\x85", "th", "ing", "Σ", "İ", "<|endoftext|>", "\x1c", "½", "日", "\r"]


def texts(n=1500):
    draw = random.Random(9)
    return ["", " ", "\n\n", "a" * 4000, "ab" * 3000] + ["".join(draw.choice(LETTERS) for _ in range(draw.randint(0, 30))) for _ in range(n)]


@pytest.mark.parametrize("name", FILES)
def test_pieces_encode_like_whole_texts(name):
    library = tokenizers.Tokenizer.from_file(public_tokenizers.path(name))
    encoder = PieceEncoder(public_tokenizers.path(name), word_cuts if name.startswith("word") else space_cuts)
    found = encoder(pa.array([None, *texts()], pa.string()))
    for i, text in enumerate(["", *texts()]):
        assert found.ids[found.first[i]:found.first[i + 1]].tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("name", FILES)
def test_transducer_encodes_and_decodes_like_the_library(name):
    library = tokenizers.Tokenizer.from_file(public_tokenizers.path(name))
    machine = BytePairTokenizer(public_tokenizers.path(name))
    for text in texts():
        want = library.encode(text, add_special_tokens=False).ids
        assert list(machine.stream(text)) == want, repr(text)
        decoder = machine.decoder()
        assert "".join(decoder.feed(want[i:i + 3]) for i in range(0, len(want), 3)) + decoder.end() == library.decode(want, skip_special_tokens=False)


def test_lookahead_is_enough_for_small_merge_lists():
    draw = random.Random(4)
    for _ in range(60):
        tokens, merges = ["a", "b", "c"], []
        for _ in range(draw.randint(2, 12)):
            pair = (draw.choice(tokens), draw.choice(tokens))
            if "".join(pair) not in tokens and len("".join(pair)) < 9:
                merges.append(pair)
                tokens.append("".join(pair))
        machine = Transducer(merges)
        assert machine.lookahead == sufficient_lookahead(merges)
        for _ in range(20):
            word = [draw.choice("abc") for _ in range(draw.randint(1, 150))]
            assert list(machine(word)) == machine.merge(word)


def fewest(items, capacity):
    items, best = sorted(items, reverse=True), len(items)

    def place(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(items):
            best = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + items[i] <= capacity and bins[k] not in bins[:k]:
                bins[k] += items[i]
                place(i + 1, bins)
                bins[k] -= items[i]
        place(i + 1, [*bins, items[i]])

    place(0, [])
    return best


def test_bin_completion_finds_the_fewest():
    draw = random.Random(5)
    better = 0
    for trial in range(250):
        capacity = draw.choice([10, 20, 30, 50])
        close = trial % 3 == 0
        items = [draw.randint(capacity // 4, capacity // 2 + 1) if close else draw.randint(1, capacity) for _ in range(11 if close else draw.randint(0, 11))]
        counts = np.bincount(items, minlength=capacity + 1) if items else np.zeros(capacity + 1, int)
        patterns, proven = pack_lengths(counts, capacity)
        held = np.zeros(capacity + 1, int)
        for contents, number in patterns:
            assert sum(n * k for n, k in contents) <= capacity
            for length, copies in contents:
                held[length] += copies * number
        assert (held == counts).all()
        want = fewest(items, capacity)
        assert proven and sum(n for _, n in patterns) == want >= lower_bound(counts, capacity)
        better += sum(n for _, n in best_fit(counts, capacity)) > want
    assert better


def docs(spark, rows):
    return spark.createDataFrame([(i, t, 5, "z") for i, t in rows], "doc_id long, text string, length int, offset string")


ROWS = [(5, "one two three"), (2, None), (9, ""), (4, "word " * 5000), (7, "one two three"), (7, "other text"), (None, "no id")]


def test_packing_of_documents(llm_spark):
    path = public_tokenizers.path(FILES[0])
    library = tokenizers.Tokenizer.from_file(path)
    rows = pack(token_pieces(docs(llm_spark, ROWS), path, 2048, 0, with_ids=True), 2048).collect()
    want = []
    for i, text in ROWS:
        ids = library.encode(text or "", add_special_tokens=False).ids + [0]
        want += [(i, k // 2048, k, len(ids[k:k + 2048]), zlib.crc32(np.array(ids[k:k + 2048], "<u4").tobytes())) for k in range(0, len(ids), 2048)]
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.piece, r.start, r.length, r.ids_crc32)) for r in rows)
    assert all(zlib.crc32(bytes(r.ids)) == r.ids_crc32 for r in rows)
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in sequences.values():
        ends = 0
        for offset, length in sorted(held):
            assert offset == ends
            ends += length
        assert ends <= 2048
    assert len(sequences) == -(-sum(r.length for r in rows) // 2048)
    assert pack(token_pieces(docs(llm_spark, []), path, 2048, 0), 2048).count() == 0


def test_wavelet_matrix_access_rank_select():
    draw = np.random.default_rng(1)
    for n in (0, 1, 7, 2048, 5000):
        ids = draw.integers(0, 300, n).astype(np.uint32) * 167
        matrix = WaveletMatrix.from_bytes(WaveletMatrix.of(ids).to_bytes())
        assert (matrix.ids() == ids).all() and matrix.count(65535) == 0
        for i in draw.integers(0, max(n, 1), 15).tolist() if n else []:
            symbol = int(ids[i])
            assert matrix.access(i) == symbol and matrix.rank(symbol, i) == (ids[:i] == symbol).sum()
            assert matrix.occurrences(symbol) == np.flatnonzero(ids == symbol).tolist()


def test_token_files_round_trip(llm_spark):
    path = public_tokenizers.path(FILES[1])
    library = tokenizers.Tokenizer.from_file(path)
    shards = write_tokens(docs(llm_spark, ROWS), path, 2, new_folder(llm_spark, "t"), shard_tokens=50)
    got = sorted((tuple(r) for r in read_tokens(shards).collect()), key=lambda r: r[1])
    at, want = 0, []
    for i, text in sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == want
    assert read_tokens(write_tokens(docs(llm_spark, []), path, 2, new_folder(llm_spark, "t"))).count() == 0


def test_coding_of_a_table(llm_spark):
    path = public_tokenizers.path(FILES[0])
    library = tokenizers.Tokenizer.from_file(path)
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    want = []
    for i, text in ROWS:
        ids = library.encode(text or "", add_special_tokens=False).ids
        want.append((i, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in coded(docs(llm_spark, ROWS), path).collect())
    assert coded(docs(llm_spark, []), path).count() == 0
