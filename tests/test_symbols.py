"""Merging and learning inside tasks, and training in many passes, against plain restatements."""

import random

import numpy as np
import pytest

from shardwright.functions import symbols as S
from shardwright.functions.codepoints import id_to_cp, tok
from shardwright.operators import bpe


def naive(texts, n, first=256):
    """Merges with counts and the merged strings, by full recounts."""
    strings = [t.encode().decode("latin-1") for t in texts]
    out = []
    for i in range(n):
        counts = {}
        for s in strings:
            for p in map(str.__add__, s, s[1:]):
                counts[p] = counts.get(p, 0) + 1
        if not counts:
            break
        pair = min(counts, key=lambda p: (-counts[p], p))
        out.append((pair[0], pair[1], counts[pair]))
        strings = [s.replace(pair, tok(first + i)) for s in strings]
    return out, strings


def soup(seed, n, alphabet="ab c\n", longest=60):
    draw = random.Random(seed)
    return ["".join(draw.choices(alphabet, k=draw.randint(0, longest))) for _ in range(n)]


@pytest.mark.parametrize("seed", range(12))
def test_heap_and_cuts_equal_the_fold(seed):
    draw = random.Random(seed)
    base = "abcd" if seed % 2 else "ab"
    known, merges = list(base), []
    for i in range(draw.randint(1, 40)):
        a, b = draw.choice(known), draw.choice(known)
        if any(m[:2] == (a, b) for m in merges):
            continue
        x = chr(id_to_cp(0xD7F0 + i))  # some on either side of the surrogates
        merges.append((a, b, x))
        known.append(x)
    merger = S.Merger(merges)
    for s in soup(seed, 60, base + "-", 80) + ["", "a", "aa", "a" * 999, "ab" * 700]:
        want = s
        for a, b, x in merges:
            want = want.replace(a + b, x)
        assert merger.merge(s) == want == S.merge_symbols(s, merger.ranks)


def test_the_memo_is_bounded(monkeypatch):
    monkeypatch.setattr(S, "MEMO_SYMBOLS", 50)
    merger = S.Merger([("a", "b", "X")])
    for n in range(1, 60):
        assert merger.merge("ab" * n) == "X" * n
        assert merger.held < 50 + 3 * n + 3


def test_pieces_are_the_runs():
    joins = np.array(sorted((ord(a) << S.SHIFT) | ord(b) for a, b in ("ab", "ba", "cc")), np.int64)
    assert [("xabaacccab")[a:b] for a, b in S.pieces("xabaacccab", joins)] == ["aba", "ccc", "ab"]
    assert S.pieces("", joins) == S.pieces("x", joins) == []


@pytest.mark.parametrize("seed", range(6))
def test_learning_equals_recounts(seed):
    texts = soup(seed, 30)
    want, _ = naive(texts, 25)
    got = S.learn(list(texts), [1] * len(texts), [tok(256 + i) for i in range(25)], None, 25)
    assert got == want


@pytest.mark.parametrize("most, every, merges", [(1, 1, 8), (40, 3, 30), (300, 1, 30)])
def test_training_in_many_passes_equals_recounts(spark, monkeypatch, most, every, merges):
    monkeypatch.setattr(bpe, "MOST_SYMBOLS", most)
    monkeypatch.setattr(bpe, "TOP_PAIRS", 7)
    texts = soup(most, 25, "abc d", 50) + ["aaaaaaaa", "a" * 31, "é🦊é🦊"] * 2
    want, _ = naive(texts, merges)
    report = bpe.TrainReport()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = bpe.train_bpe(df, 256 + merges, checkpoint_every=every, num_partitions=2, report=report)
    assert [(tok(a), tok(b), n) for (a, b), n in zip(model.merges, model.pair_counts)] == want
    assert report.passes > 1 and sum(report.merges_of_passes) == report.rounds == len(want)


def test_hundreds_of_merges_equal_recounts(spark, sf0001, monkeypatch):
    """400 merges of the sf0.001 conversations in several passes, and their encoding."""
    monkeypatch.setattr(bpe, "MOST_SYMBOLS", 4000)
    df = spark.read.parquet(f"{sf0001}/conversations.parquet").selectExpr("conv_id * 1000 + turn AS doc_id", "text")
    rows = sorted(df.collect(), key=lambda r: r["doc_id"])
    want, strings = naive([r["text"] for r in rows], 400)
    report = bpe.TrainReport()
    model = bpe.train_bpe(df, 256 + 400, num_partitions=2, report=report)
    assert [(tok(a), tok(b), n) for (a, b), n in zip(model.merges, model.pair_counts)] == want
    assert 1 < report.passes < 40
    coded = sorted(bpe.encode_documents(df, model).collect(), key=lambda r: r["doc_id"])
    assert ["".join(map(tok, r["ids"])) for r in coded] == strings


def test_decoding_by_gather(spark):
    model = bpe.BPEModel(("<|eos|>",), ((0xE6, 0x97), (257, 0xA5), (97, 98)))
    rows = [(1, [97, 256, 258, 259]), (2, []), (3, None), (4, [0xE6, 0x97]), (5, [65, 0xFF, 66, 257]), (6, [0xED, 0xA0, 0x80])]
    df = spark.createDataFrame(rows, "k int, ids array<int>")
    vocab = model.vocab_bytes()
    want = {k: b"".join(vocab[i] for i in ids or []).decode("utf-8", "replace") for k, ids in rows}
    assert {r["k"]: r["text"] for r in bpe.decode_documents(df.repartition(2), model).collect()} == want
    for bad in (260, -1, 999999):
        with pytest.raises(Exception, match="no bytes for token id"):
            bpe.decode_documents(spark.createDataFrame([(1, [97, bad])], "k int, ids array<int>"), model).collect()
    wide = bpe.BPEModel((), tuple((97, 98 + i) for i in range(100)))
    plan = lambda m: len(bpe.decode_documents(df, m)._jdf.queryExecution().optimizedPlan().toString())
    assert abs(plan(model) - plan(wide)) < 20
    with pytest.raises(ValueError):
        bpe.decode_documents(df, model, out_col="k")
