import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from shardwright.llm import phrases as P

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def brute(rows, least, most, scale=2_000_000, cover=80):
    """The contract in plain Python; rows of (lang, text)."""
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, 5):
                f[lang].update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, counts in f.items():
        cand = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        longer = defaultdict(int)
        for p, a in cand.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    longer[p[i : i + k]] = max(longer[p[i : i + k]], a)
        kept = []
        for p, a in cand.items():
            if 100 * longer[p] >= cover * a:
                continue
            score, _, x, y = min((scale * a // (counts[p[:k]] + counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), x, y))
        for rank, (s, a, p, x, y) in enumerate(sorted(kept)[:most], 1):
            out.append((lang, rank, p.decode(), -a, x, y, n[lang], -s))
    return sorted(out)


def got(docs, **kw):
    return sorted(tuple(r[c] for c in COLUMNS) for r in P.collocations(docs, **kw).collect())


def corpus():
    texts = [
        "The red fox runs; the red fox sleeps. New York City is big, new york city!",
        "new\tyork  city: NEW YORK\x0bnew york\x0ccity a a a a a a",
        "le chat noir, le chat noir? le chat noir dort",
        "Ünï cödé ünï cödé \x00 odd \x85 word odd \x85 word",
        "x y z w x y z w x y z w x y z w",
    ]
    rows = [(i, texts[i % len(texts)], ["en", None, "fr", "und", "zzé"][i % len(texts)]) for i in range(40)]
    return rows + [(50, None, "en"), (51, "", None), (None, "the red fox", "en"), (52, "lonely", "only"), (53, " \t\n", "blank")]


@pytest.mark.parametrize("least, most", [(2, 2000), (8, 3), (9, 2000), (1000, 5)])
def test_matches_brute_force(spark, least, most):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string, lang string")
    assert got(docs, least=least, most=most) == brute([(r[2], r[1]) for r in corpus()], least, most)


def test_small_shards_runs_sections_and_trees(spark, hard, monkeypatch):
    rows = [(r["lang"], r["text"]) for r in hard.collect()] * 3
    docs = hard.union(hard).union(hard).repartition(5)
    for name, value in [("SHARD_BYTES", 900), ("RUN_WORDS", 64), ("SECTION_ENTRIES", 128), ("FAN", 3), ("MOST_BITS", 17)]:
        monkeypatch.setattr(P, name, value)
    want = brute(rows, 3, 2000)
    assert len(want) > 20 and got(docs, least=3) == want


def test_chunks_are_cut_at_breaks(monkeypatch):
    monkeypatch.setattr(P, "CHUNK_WORDS", 4)
    x = np.array([1, 2, 0, 3, 4, 5, 6, 7, 8, 0, 9, 9, 0, 4, 5], np.uint32)
    assert [c.tolist() for c in P._chunks(x)] == [[1, 2, 0, 3, 4, 5, 6, 7, 8, 0], [9, 9, 0, 4, 5, 0]]
    assert list(P._chunks(x[:0])) == []
    s = P.Shard()
    s.add(b"A b c. a b! B")
    word, codes = s.rows(7, "en")
    assert word.column("word").to_pylist() == [b"a", b"b", b"c"] and word.column("n").to_pylist() == [2, 3, 1]
    assert codes.column("n").to_pylist() == [3, 3, 0] and codes.column("local").to_pylist() == [0, 1, 2]
    assert np.frombuffer(b"".join(codes.column("codes").to_pylist()), "<u4").tolist() == [1, 2, 3, 0, 1, 2, 0, 2, 0]


def test_full_bitmap_changes_nothing(spark, hard, monkeypatch):
    rows = [(r["lang"], r["text"]) for r in hard.collect()]
    monkeypatch.setattr(P, "MOST_BITS", 3)
    assert got(hard, least=2, cover=100) == brute(rows, 2, 2000, cover=100)


def test_products_beyond_64_bits(spark):
    """Scores of counts whose product with the scale passes 2^64."""
    a, f1, f2 = 10**14, 3 * 10**14 + 7, 10**14 + 1
    pairs = spark.createDataFrame([(1, 2, 0, 0, a)], "w1 long, w2 long, w3 long, w4 long, a long")
    words = spark.createDataFrame([("en", bytearray(b"x"), f1, 1), ("en", bytearray(b"y"), f2, 2)], "lang string, word binary, f long, id long")
    (r,) = P.scored_phrases(pairs, words, 2_000_000, 80).collect()
    assert (r["lang"], r["l"], r["r"], r["score"]) == ("en", f1, f2, 2_000_000 * a // (f1 + f2))


def test_empty_table(none):
    assert P.collocations(none).columns == COLUMNS and P.collocations(none).collect() == []
