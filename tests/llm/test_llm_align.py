"""op13: the monoid's laws, whole documents against a direct alignment, odd rows."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from newsflow.llm import alignment as module
from newsflow.llm.alignment import Pair, aligned
from newsflow.llm.fragments import EMPTY, Fragment, Tokens, compose, composed, finished

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
NAMES = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def brute(rows):
    a_tok, pair, b_tok = Tokenizer.from_file(A), Pair(A, B), sentencepiece.SentencePieceProcessor(model_file=B)
    a_tok.encode_special_tokens = True
    per_doc, counts = [], Counter()
    for _, text in rows:
        a = a_tok.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_tok.encode(text, num_threads=1) if text else []
        raw = (" " + text).encode() if text else b""
        if b"".join(pair.a_bytes[i] for i in a) != raw or b"".join(pair.b_bytes[i] for i in b) != raw:
            a, b = [], []
        groups, links, x, y = [], [], 0, 0
        spans, at = [], 0
        for i in b:
            spans.append((i, at, at + len(pair.b_bytes[i])))
            at = spans[-1][2]
        at, j, open_a, open_b = 0, 0, [], []
        ends_b = {s[2] for s in spans}
        taken = 0
        for i in a:
            low, at = at, at + len(pair.a_bytes[i])
            links += [(i, t) for t, u, v in spans[j:] if u < at and v > low]
            while j < len(spans) and spans[j][2] <= at:
                j += 1
            open_a.append(i)
            if at in ends_b:
                open_b = [t for t, _, v in spans[taken:] if v <= at]
                taken += len(open_b)
                groups.append(",".join(map(str, open_a)) + "|" + ",".join(map(str, open_b)))
                open_a = []
        counts.update(links)
        per_doc.append((len(a), len(b), groups, links))
    best = {}
    for (_, t), n in counts.items():
        best[t] = max(best.get(t, 0), n)
    return [(key, n_a, n_b, len(g), len(k), sum(counts[x] == best[x[1]] for x in k), sum(counts[x] for x in k),
             hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for (key, _), (n_a, n_b, g, k) in zip(rows, per_doc)]


def test_fragments_compose_in_any_tree():
    draw = random.Random(4)
    for _ in range(300):
        total = draw.randrange(1, 40)
        sides = []
        for _ in range(2):
            ends = sorted({draw.randrange(1, total + 1) for _ in range(draw.randrange(1, 20))} | {total})
            sides += [np.array([draw.randrange(9) for _ in ends]), np.array(ends)]
        whole = Tokens(*sides)
        cuts = sorted({draw.randrange(total + 1) for _ in range(draw.randrange(6))} | {0, total})
        parts = [Fragment.of(whole.within(a, b)) for a, b in zip(cuts, cuts[1:])]
        want = finished(Fragment.of(whole))
        trees = [composed(parts), composed([EMPTY, *parts, EMPTY])]
        for _ in range(3):
            left = list(parts)
            while len(left) > 1:
                i = draw.randrange(len(left) - 1)
                left[i:i + 2] = [compose(left[i], left[i + 1])]
            trees += left
        for tree in trees:
            got = finished(tree)
            assert (got.groups, got.n_a, got.n_b, got.n_groups) == (want.groups, want.n_a, want.n_b, want.n_groups)
            assert got.keys.tolist() == want.keys.tolist() and got.times.tolist() == want.times.tolist()
            assert not len(tree.suffix.a)


ODD = [(1, None), (2, ""), (3, " "), (4, "▁x y"), (5, "<|endoftext|> </s> <s> <unk>"), (5, "a\nb  c\t d e"), (None, "x" * 3000), (6, "é😀 　 ﬁ \x00 !!a's  "), (6, "é😀 　 ﬁ \x00 !!a's  ")]


@pytest.mark.parametrize("chunk,fan", [(1 << 16, 8), (64, 2), (7, 3)])
def test_equals_direct_alignment(llm_spark, small, monkeypatch, chunk, fan):
    monkeypatch.setattr(module, "HELD", 50)
    rows = [(r["doc_id"], r["text"][:3000]) for r in llm_spark.read.parquet(f"{small}/documents.parquet").limit(25).collect()] + ODD
    df = llm_spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, part int, keys int")
    got = sorted((tuple(r[c] for c in NAMES) for r in aligned(df, A, B, chunk=chunk, fan=fan).collect()), key=str)
    assert got == sorted(brute(rows), key=str)


def test_small_table_and_groups(llm_spark, small):
    df = llm_spark.read.parquet(f"{small}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    got = aligned(df, A, B, with_groups=True).collect()
    assert sorted(tuple(r[c] for c in NAMES) for r in got) == sorted(brute(rows))
    assert all(hashlib.sha256(r["groups"].encode()).hexdigest() == r["groups_sha256"] or not r["groups"] for r in got)
    assert aligned(df.limit(0), A, B).count() == 0
