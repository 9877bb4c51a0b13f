from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from brute import words
from pyspark.sql import functions as F

from shardwright.llm import mixing as M


def test_targets_are_shared_until_none_is_above():
    got = M.share_out({"a": 10, "b": 100, None: 100})
    assert got["a"] == 20 and sum(got.values()) == Fraction(3, 2) * 210 and got["b"] == 2 * got[None]
    assert M.share_out({}) == {} and M.share_out({"x": 0}) == {"x": 0}


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 1000])
def test_permutation_and_inverse(n):
    k = M._keys(3, n)
    p = M.permute(np.arange(n), n, k)
    assert sorted(p) == list(range(n)) and (M.permute(p, n, k, inverse=True) == np.arange(n)).all()


def test_shard_counts_add_up():
    quota = np.array([1000, 5, 0, 77])
    n_shards = -(-int(quota.sum()) // 64)
    parts = [M.shard_counts(quota, s, n_shards, 64, 9) for s in range(n_shards)]
    assert (sum(c for _, c in parts) == quota).all()
    run = np.zeros_like(quota)
    for before, c in parts:
        assert (before == run).all() and c.sum() <= 64
        run = run + c


def test_normal_limit_stays_possible():
    have = np.array([10**12, 5 * 10**12, 3])
    got = M._split(np.random.default_rng(1), have, 10**11)
    assert got.sum() == 10**11 and (got >= 0).all() and (got <= have).all() and abs(got[0] / 10**11 - 1 / 6) < 0.01


def test_taken_words(hard, none):
    rows = M.taken_words(hard, block=7).collect()
    size = Counter((r["doc_id"], len(words(r["text"]))) for r in hard.collect())
    assert Counter((r["doc_id"], r["size"]) for r in rows) == size
    source = {(r["doc_id"], len(words(r["text"]))): r["source"] for r in hard.collect()}
    took, want = defaultdict(int), {}
    for r in rows:
        assert 0 <= r["taken"] <= 2 * r["size"]
        s = source[r["doc_id"], r["size"]]
        took[s] += r["taken"]
        want[s] = r["target"]
    assert all(abs(took[s] - want[s]) <= 1 for s in want)
    again = M.taken_words(hard.repartition(5), block=7).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    assert M.taken_words(none).count() == 0


def test_mix_blocks_are_whole_and_unrepeated_in_a_pass(hard):
    spans = M.Mix(hard, block=7).spans().collect()
    slots = defaultdict(list)
    for r in spans:
        slots[r["shard"], r["slot"]].append(r)
    assert all(sum(x["words"] for x in v) <= 7 for v in slots.values())
    seen = Counter((r["source_no"], r["start"], r["from_word"], r["pass_no"]) for r in spans)
    assert max(seen.values()) == 1


def test_documents_of_the_mix(hard, none):
    out = M.mixed_documents(hard, block=7)
    assert out.schema == hard.schema
    taken = defaultdict(int)
    for r in M.taken_words(hard.withColumn("doc_id", F.coalesce("doc_id", F.lit(-1))), block=7).collect():
        taken[r["doc_id"]] += r["taken"]
    got = defaultdict(int)
    for r in out.collect():
        got[-1 if r["doc_id"] is None else r["doc_id"]] += len(words(r["text"]))
        assert r["n_chars"] == len(r["text"]) and r["size"] in ("x", None)
    assert sum(got.values()) == sum(taken.values())
    assert M.mixed_documents(none).count() == 0


def test_cut_text_keeps_whole_texts_and_white_space():
    t = b"  one two\tthree \n four "
    assert M.cut_text(t, [(2, 2), (0, 2)]) == t
    assert M.cut_text(t, [(1, 2)]) == b"two\tthree"
    assert M.cut_text(t, [(0, 1), (3, 1)]) == b"one\nfour"


def test_texts_are_cut_in_runs_of_a_batch(monkeypatch):
    texts = ["a b c", None, "", "word " * 9, *["x y"] * 20]
    batch = pa.RecordBatch.from_pydict({"_doc": pa.array([{"k": i, "text": t} for i, t in enumerate(texts)]), "_cuts": pa.array([[i] for i in range(24)])})
    monkeypatch.setattr(M, "SLICE", 12)
    parts = list(M.runs(batch, 1))
    assert len(parts) > 5 and pa.Table.from_batches(parts).equals(pa.Table.from_batches([batch])) and not list(M.runs(batch.slice(0, 0), 1))
    assert [x for p in parts for x in p.column(0).flatten()[1].to_pylist()] == texts


def test_rows_that_differ_in_where_nulls_stand_all_stay(spark):
    text = " ".join(f"w{i}" for i in range(8))
    rows = [(8, text, None, "en", 3), (8, text, "en", None, 3), (8, text, "en", "en", None), (3, text, "en", "en", 8), (8, text, "en", "en", 3), (8, text, "en", "en", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    digests = docs.select(M.row_digest(docs).alias("d"), "*").collect()
    assert len({bytes(r["d"]) for r in digests}) == 5
    want = Counter()
    for r in M.taken_words(docs).collect():
        want[r["doc_id"]] += r["taken"]
    got, sources = Counter(), set()
    for r in M.mixed_documents(docs).collect():
        got[r["doc_id"]] += len(r["text"].split())
        sources.add(r["source"])
    assert sources == {"en", None} and sum(got.values()) == sum(want.values())
