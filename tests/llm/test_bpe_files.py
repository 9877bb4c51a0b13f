"""Segment-tree BPE, Simple-8b files and section counts against the public libraries."""

import base64
import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from shardwright.llm import chunks
from shardwright.llm import segtree_bpe as S
from shardwright.llm import simple8b as B
from shardwright.llm import token_counts as T
from shardwright.llm.queries import bpe_digests

RANKS, JSON = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def public():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(JSON)
    t.encode_special_tokens = True
    return t


def odd_texts():
    rng = random.Random(4)
    alphabet = list("ab e'stréüñ東🚚 \n\t\r  \x1c\x85019.,!?<|>") + ["  ", " the", "'ll", "<|endoftext|>"]
    return ["", " ", "\n", "a", " a", "a ", "  a  b  "] + ["".join(rng.choices(alphabet, k=rng.randint(1, 80))) for _ in range(600)]


def test_chunks_encode_like_whole_texts(public, library):
    texts = odd_texts()
    cut = lambda codes: [x.tolist() for x in np.split(codes[0], np.cumsum(codes[1])[:-1])]
    assert cut(S.coder_of(RANKS, P.PATTERN).code(texts)) == [public.encode_ordinary(t) for t in texts]
    assert cut(B.coder_of(JSON).code(texts)) == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_words_with_white_space_at_an_end_are_told_apart(library):
    words = ["a", "", " ", "a b", "a\u00a0", "\u00a0a", "\x1cé", "é\x85", "\u3000", "東", "a\tb", "b\n"]
    assert chunks._tight(words).tolist() == [bool(w) and not w[0].isspace() and not w[-1].isspace() for w in words]
    ids, n = B.coder_of(JSON).encode_many([" a", " é", " 東x", " a\tb"])  # as one text, cut by its tokens' bytes
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [library.encode(w, add_special_tokens=False).ids for w in [" a", " é", " 東x", " a\tb"]]


def test_chunk_memos_are_bounded():
    c = chunks.ChunkCoder(lambda xs: (np.frombuffer("".join(xs).encode(), np.uint8).astype(np.int32), np.array([len(x) for x in xs])), most=10)
    for i in range(50):
        ids, n = c.code([f"a{i} b{i} c{i}", "", " x"])
        assert bytes(ids.tolist()) == f"a{i} b{i} c{i} x".encode() and n.tolist() == [len(ids) - 2, 0, 2]
    assert len(c.inner.names) <= 14


@pytest.mark.parametrize("piece", ["aaaaaaa", "ab" * 50, "x" * 129, "abcdefgh" * 40, "é" * 100])
def test_lockstep_and_long_walk_agree(public, piece):
    r, raw = S.ranks_of(RANKS), piece.encode()
    width = 1 << (len(raw) - 1).bit_length()
    want = public._encode_single_piece(raw)
    assert S.merge_rows([raw], width, r)[0] == S.merge_long(raw, r) == want


def test_digests(hard, none, public):
    got = Counter(tuple(r) for r in bpe_digests(hard.select("doc_id", "text")).collect())
    want = Counter()
    for r in hard.collect():
        ids = public.encode_ordinary(r["text"] or "")
        want[(r["doc_id"], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest())] += 1
    assert got == want
    kept = S.encoded_documents(hard, RANKS, P.PATTERN)
    assert set(kept.columns) == (set(hard.columns) - {"text"}) and dict(kept.dtypes)["ids"] == "array<int>"
    back = S.decoded_documents(kept, RANKS)
    assert Counter(bytes(r["decoded"]) for r in back.collect()) == Counter((r["text"] or "").encode() for r in hard.collect())
    assert bpe_digests(none.select("doc_id", "text")).count() == 0


def test_unknown_id_is_an_error(spark):
    with pytest.raises(Exception, match="no token has"):
        S.decoded_documents(spark.createDataFrame([(1, [999999])], "doc_id long, ids array<int>"), RANKS).collect()


def id_lists():
    rng = np.random.default_rng(2)
    yield np.zeros(0, np.uint64)
    for bits in (0, 1, 2, 5, 8, 16, 20, 31, 45, 60, 61, 64):
        top = (1 << bits) - 1
        for n in (1, 2, 59, 60, 61, 500):
            yield rng.integers(0, top, n, dtype=np.uint64, endpoint=True)
    wide = rng.integers(0, 50_000, 3000, dtype=np.uint64)
    wide[rng.integers(0, 3000, 40)] = np.uint64(2**63 + 5)
    yield wide
    yield np.full(300, 2**64 - 1, np.uint64)


def test_words_round_trip():
    for ids in id_lists():
        w = B.pack(ids)
        assert (B.unpack(w) == ids).all() and len(B.unpack(w)) == len(ids)
        for word, first in B.frames_of(w).tolist():
            assert (B.unpack(w[word:]) == ids[first:]).all()


def test_words_take_the_most_that_fit():
    assert len(B.pack(np.ones(60, np.uint64))) == 1 and len(B.pack(np.full(4, 32_767, np.uint64))) == 1
    assert len(B.pack(np.full(4, 32_768, np.uint64))) == 2  # three of 20 bits, one more word
    with pytest.raises(ValueError):
        B.unpack(np.array([15 << 60], np.uint64))


def test_files(spark, hard, none, library):
    from pyspark.sql import functions as F

    path = B.encoded_files(hard, JSON)
    got = B.read_documents(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("crc")).collect()
    rows = []
    for r in hard.collect():
        ids = np.array(library.encode(r["text"] or "", add_special_tokens=False).ids + [2], "<u4").tobytes()
        rows.append((r["doc_id"] is not None, r["doc_id"] or 0, ids))
    at, want = 0, []
    for some, key, ids in sorted(rows):
        want.append((key if some else None, at, len(ids) // 4, zlib.crc32(ids)))
        at += len(ids) // 4
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    assert B.read_documents(spark, B.encoded_files(none, JSON)).count() == 0


def test_files_of_several_ranges(spark):
    docs = spark.range(0, 500).selectExpr("500 - id as doc_id", "concat('text number ', id) as text").repartition(7)
    edges = B.file_edges(docs, docs_per_file=60)
    assert len(edges) == 8
    from shardwright.llm.common import new_folder

    out = new_folder(spark, "t")
    B.write_files(B.token_ids(docs, JSON, 2, edges), len(edges) + 1, out, "<u2", block_ids=50)
    rows = B.read_documents(spark, out).orderBy("start").collect()
    assert [r["doc_id"] for r in rows] == list(range(1, 501))
    assert [r["start"] for r in rows] == np.cumsum([0, *(r["n_tokens"] for r in rows)])[:-1].tolist()
    assert B.read_blocks(spark, out).count() > 20


def owner(s, e, spans, rule):
    over = [max(0, min(e, r) - max(s, l)) for l, r in spans]
    some = [i for i, x in enumerate(over) if x]
    if not some:
        return -1
    return {"first": some[0], "last": some[-1], "most": over.index(max(over))}[rule]


@pytest.mark.parametrize("rule", T.RULES)
def test_sections_match_the_library_offsets(spark, library, rule):
    texts = ["a\n\nb", "one two\n\n\n  three", "\n", "", "日本語のテキスト\n\n🚚🚚 end", "a  \n  b\n"] + [t for t in odd_texts()[:150] if "\x85" not in t]
    got = T.section_tokens(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), JSON, RANKS, rule).collect()
    have = {}
    for r in got:
        have[r["doc_id"], r["section_no"]] = (r["char_start"], r["char_end"], r["n_tokens"])
    for i, t in enumerate(texts):
        cut = [0, *(k + 1 for k, c in enumerate(t) if c == "\n"), len(t)]
        spans = list(zip(cut, cut[1:]))
        n = Counter(owner(s, e, spans, rule) for s, e in library.encode(t, add_special_tokens=False).offsets)
        assert {k: have[i, k] for k in range(len(spans))} == {k: (*spans[k], n[k]) for k in range(len(spans))}


def test_added_tokens_like_the_unchanged_library(spark, tmp_path):
    from pyspark.sql import functions as F

    from shardwright.llm import queries

    plain = Tokenizer.from_file(JSON)
    texts = odd_texts() + ["x <|endoftext|>", "<|endoftext|> <|endoftext|>x  <|endoftext|>\n<|endoftext|>", "a b <|endo ftext|>", " <|endoftext|> é"]
    want = plain.encode_batch(texts, add_special_tokens=False)
    ids, n = B.coder_of(JSON, True).code(texts)
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [e.ids for e in want] and 50256 in ids
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["n_tokens"], r["ids_crc32"]) for r in queries.op4_simple8b(spark, str(tmp_path)).collect()}
    assert got == {i: (len(e.ids) + 1, zlib.crc32(np.array([*e.ids, 2], "<u4").tobytes())) for i, e in enumerate(want)}
    sums = queries.op8_token_counts(spark, str(tmp_path)).groupBy("doc_id").agg(F.sum("n_tokens").alias("n")).collect()
    assert {r["doc_id"]: r["n"] for r in sums} == {i: len(e.ids) for i, e in enumerate(want)}


def test_given_sections_and_hard_rows(spark, hard, none):
    rows = [(1, "hello wonderful world", [(0, 3), (8, 12)]), (2, "abc", None), (3, "abc", []), (4, None, [(0, 5)]), (5, "abc def", [(0, 0), (0, 7)])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sections array<struct<start int, end int>>")
    got = {(r["doc_id"], r["section_no"]): r["n_tokens"] for r in T.section_tokens(docs, JSON, RANKS, sections="sections").collect()}
    assert got[1, 0] == 1 and got[1, 1] == 1 and got[1, -1] == 1 and got[2, -1] >= 1 and got[3, -1] >= 1
    assert got[4, 0] == 0 and (4, -1) not in got and got[5, 0] == 0 and got[5, 1] == 2
    lines = T.section_tokens(hard, JSON, RANKS)
    assert lines.groupBy().sum("n_tokens").collect()[0][0] > 4000 and T.section_tokens(none, JSON, RANKS).count() == 0
