"""The toxicity machine and the context-mixing scores."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from brute import lower_words
from conftest import prose

from shardwright.llm import context_mixing as M
from shardwright.llm import toxicity as X


def test_factorization_learns_a_pair_that_no_weight_shows():
    rng = np.random.default_rng(1)
    rows = [np.flatnonzero(rng.random(6) < 0.5) for _ in range(1500)]
    y = np.array([float((0 in r) != (1 in r)) for r in rows])  # exclusive or: no single term tells anything
    m = X.fit_machine(rows, y, np.arange(6), epochs=40)
    assert np.mean([(m.score(r) >= 0.5) == t for r, t in zip(rows, y)]) > 0.97


def test_score_is_the_machine_formula():
    rng = np.random.default_rng(2)
    m = X.Machine(np.arange(5), 0.3, rng.normal(size=5), rng.normal(size=(5, X.RANK)))
    at = np.array([0, 2, 3])
    z = 0.3 + m.w[at].sum() + sum(m.v[i] @ m.v[j] for i in at for j in at if i < j)
    assert math.isclose(m.score(at), 1 / (1 + math.exp(-z)), rel_tol=1e-9)


def labelled(spark, n=900):
    rng = random.Random(5)
    docs, labels = [], []
    for i in range(n):
        words, bad = prose(i, 40).split(), i % 6 == 0
        if bad:
            words[rng.randrange(40)] = rng.choice(["Idiot!", "moron", "(scum)"])
        docs.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_held_out_accuracy_and_filter(spark, hard, none):
    docs, labels = labelled(spark)
    m = X.train(docs, labels)
    y = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    held = [(r["score"] >= 0.5) == (y[r["doc_id"]] == 1) for r in X.toxicity_scores(docs, m).collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert len(held) > 100 and np.mean(held) > 0.98
    assert {r["doc_id"] % 6 == 0 for r in X.toxic_filter(docs, m).collect()} == {False}
    got = X.toxicity_scores(hard, m)
    assert got.count() == hard.count() and got.where("score is null or score < 0 or score > 1").count() == 0
    kept = X.toxic_filter(hard, m)
    assert kept.schema == hard.schema and kept.count() == got.where("score < 0.5").count() and X.toxicity_scores(none, m).count() == 0


def test_scores_and_filter_work_on_runs_of_a_batch(monkeypatch, spark):
    rows = [(i, [None, "", "idiot " * 9, "fine words here"][i % 4]) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    m = X.Machine(np.array([X.slot(b"idiot")]), -2.0, np.array([4.0]), np.zeros((1, X.RANK)))
    batch = pa.RecordBatch.from_pydict({"t": pa.array([t and t.encode() for _, t in rows], pa.binary())})
    monkeypatch.setattr(X, "SLICE", 60)
    parts = list(X.runs(batch, 0))
    assert len(parts) > 9 and pa.Table.from_batches(parts).equals(pa.Table.from_batches([batch])) and not list(X.runs(batch.slice(0, 0), 0))
    assert {(r["doc_id"], r["score"] > 0.5) for r in X.toxicity_scores(docs, m).collect()} == {(i, i % 4 == 2) for i in range(40)}
    assert [r["doc_id"] for r in X.toxic_filter(docs, m).orderBy("doc_id").collect()] == [i for i in range(40) if i % 4 != 2]


def test_pair_counts_take_no_more_room_than_their_rows_need(monkeypatch):
    rows = [np.array([i % 9, 9 + i], "<u4").tobytes() for i in range(200)]  # rows that differ
    fit = X.fit_terms_of(rows, [i % 2 for i in range(200)])
    real, kinds = np.zeros, []
    monkeypatch.setattr(X.np, "zeros", lambda shape, dtype=float: kinds.append(np.dtype(dtype)) or real(shape, dtype))
    X.paired_places(fit, 0)
    assert len(fit.slots) == 9 and len(fit.y) == 200 and kinds[0].itemsize == 1


def test_train_learns_terms_that_tell_only_in_pairs(spark):
    rng = random.Random(11)
    docs, labels = [], []
    for i in range(2500):
        words, one, two = prose(i, 30).split(), rng.random() < 0.5, rng.random() < 0.5
        for w, there in (("amber", one), ("Cobalt.", two)):
            if there:
                words[rng.randrange(30)] = w
        there = {x.strip(".") for x in words}
        docs.append((i, " ".join(words)))
        labels.append((i, int(("amber" in there) != ("Cobalt" in there))))
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    m = X.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert {X.slot(b"amber"), X.slot(b"cobalt")} <= set(m.features.tolist())
    y = dict(labels)
    held = [(r["score"] >= 0.5) == (y[r["doc_id"]] == 1) for r in X.toxicity_scores(docs, m).collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert len(held) > 300 and np.mean(held) > 0.95


def test_pairs_match_a_count_of_every_pair(monkeypatch):
    monkeypatch.setattr(X, "PAIR_BLOCK", 5)
    rng = np.random.default_rng(4)
    rows = [np.flatnonzero(rng.random(23) < rng.random(23)) for _ in range(700)]
    y = [int((3 in r and 17 in r) or rng.random() < 0.2) for r in rows]
    rows = [r.astype("<u4").tobytes() for r in rows] * 2  # repeated rows count once
    fit = X.fit_terms_of(rows, y * 2)
    once = {(tuple(np.frombuffer(r, "<u4").tolist()), t) for r, t in zip(rows, y * 2)}
    share = np.mean([t for _, t in once])
    bar = 2 * math.log(23 * 22 / 2)
    support = math.ceil(bar / (-2 * math.log(min(share, 1 - share))))

    def g2(k, n, p):
        return 2 * ((k * math.log(k / (n * p)) if k else 0) + ((n - k) * math.log((n - k) / (n * (1 - p))) if n > k else 0))

    def seen(*slots):
        has = [t for r, t in once if set(slots) <= set(r)]
        return sum(has), len(has)

    want = set()
    for a in range(23):
        for b in range(a):
            k, n = seen(a, b)
            if n >= support and min(g2(k, n, seen(x)[0] / seen(x)[1]) for x in (a, b)) > bar:
                want |= {a, b}
    got = np.concatenate([X.paired_places(fit, i) for i in range(-(-len(fit.slots) // 5))])
    assert set(fit.slots[got].tolist()) == want and {3, 17} <= want
    assert X.fit_terms_of(rows, [1] * len(rows)) is None and X.fit_terms_of([], []) is None


def test_every_slot_with_evidence_is_a_feature(spark):
    counts = spark.range(9000).selectExpr("cast(id as int) slot", "100L n", "if(id < 6000, 90L, 50L) pos")
    got = X.evidence(counts, 10_000, 5_000, np.arange(0, 9000, 2))
    assert got.tolist() == list(range(0, 6000, 2))


def test_a_bound_on_terms_draws_fewer_rows(spark, monkeypatch):
    docs, labels = labelled(spark)
    real, sizes = X.fit_machine, []
    monkeypatch.setattr(X, "fit_machine", lambda rows, *a: sizes.append(len(rows)) or real(rows, *a))
    X.train(docs, labels)
    X.train(docs, labels, fit_terms=6_000)
    assert 650 < sizes[0] < 800 and 100 < sizes[1] < 400


def test_labels_of_one_kind_or_none(spark, hard):
    odd = spark.createDataFrame([(1, None), (None, 1), (2, 9)], "doc_id long, toxic int")
    assert X.train(hard, odd).score(np.zeros(0, int)) < 0.01
    one = spark.createDataFrame([(i, 1) for i in range(1, 14)], "doc_id long, toxic int")
    assert X.train(hard, one).score(np.zeros(0, int)) > 0.99


@pytest.mark.parametrize("table", ["hard", "prose", "none"])
def test_base_score_matches_brute_force(spark, request, table):
    docs = spark.createDataFrame([(i, prose(i, 50)) for i in range(60)], "doc_id long, text string") if table == "prose" else request.getfixturevalue(table)
    rows = docs.select("doc_id", "text").collect()
    got = M.scores(docs.repartition(3) if table == "prose" else docs, bucket_words=16).collect()
    assert len(got) == len(rows)
    held = lambda k: k is not None and zlib.crc32(str(k).encode()) % 7 == 2
    c = Counter(t for r in rows if not held(r["doc_id"]) for t in [*lower_words(r["text"]), None])
    n, v = sum(c.values()), len(c)
    want = Counter()
    for r in rows:
        t = [*lower_words(r["text"]), None]
        want[(r["doc_id"], held(r["doc_id"]), len(t), sum(c[x] > 0 for x in t), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in t), 6))] += 1
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)


def test_a_second_call_scores_with_its_own_model(spark, monkeypatch):
    corpora = [spark.createDataFrame([(i, " ".join([w, prose(i, 20)])) for i in range(40)], "doc_id long, text string").repartition(2).cache() for w in ("first", "other words")]
    get = lambda docs: {r["doc_id"]: (r["score"], r["base_score"], r["n_known"]) for r in M.scores(docs).collect()}
    apart = [get(d) for d in corpora]
    real, place = M._model_bytes, {}

    def same_place(learned):  # what the allocator may do once the first call's dict is freed
        got = real(learned)
        place.clear()
        place.update(got)
        return place

    monkeypatch.setattr(M, "_model_bytes", same_place)
    for docs, want in zip(corpora, apart):
        got = get(docs)
        assert all(np.allclose(got[k], want[k], rtol=1e-9) for k in want)


def learnt(texts):
    learner = M.Learner()
    for t in texts:
        learner.add(toks([t]))
    learner.flush()
    return M.Model(learner.mixer)


def toks(texts):
    import pyarrow as pa

    return M.tokens_of(pa.array(texts, pa.binary()))


def test_tokens():
    t = toks([b" A b\t\nc ", b"", b"x\x0b\x0cy \x1c z\x85", b"  ", b"\xff\xfe q", b"a"])
    assert t.n.tolist() == [3, 0, 4, 0, 2, 1] and [t.words[i] for i in t.at] == b"a b c x y \x1c z\x85 \xff\xfe q a".split(b" ")


def test_bits_are_a_distribution():
    """The probabilities of all continuations of a context add up to one."""
    m = learnt([prose(i, 200).encode() for i in range(20)])
    values = np.arange(256, dtype=np.uint8)
    ctx = np.tile(np.array([[97, 97, 97, 12345]], np.uint64), (256, 1))
    assert math.isclose(np.exp(m.mixer.code(ctx, values, 0, np.ones(256, np.int64))).sum(), 1, rel_tol=1e-4)
    assert math.isclose(np.exp(m.mixer.code(ctx[:, :3], values, 1, np.zeros(256, np.int64))).sum(), 1, rel_tol=1e-4)


def test_learning_beats_no_learning():
    train, test = [prose(i, 300).encode() for i in range(30)], prose(99, 200).encode().split()
    score = lambda m: m.word_scores(test).sum() + m.start_scores(toks([b" ".join(test)])).sum()
    some, none = score(learnt(train)), score(M.Model(M.Mixer()))
    assert some > 0.5 * none  # less than half of the bits


def test_every_counted_bit_teaches():
    texts = [prose(i, 300).encode() for i in range(8)]
    learner = M.Learner()
    for t in texts:
        learner.add(toks([t]))
    learner.flush()
    assert learner.mixer.bits == 8 * sum(sum(len(w) + 1 for w in t.split()) + 1 for t in texts)


def test_bytes_of_a_shared_prefix_are_worked_on_once(monkeypatch):
    words = sorted({f"prefix{i:03}".encode() for i in range(300)} | {b"p", b"pre", b"q" * 70_000})
    values, ctx, place, which = M.inner_contexts(words)
    first, kind = M.merged(ctx, values, place, None)
    bits = [*zip(map(tuple, ctx.tolist()), values.tolist(), np.minimum(place, 4).tolist())]
    assert [bits[i] for i in first[kind]] == bits and (np.diff(first) > 0).all() and len(first) < 71_000 < len(values)
    apart, kind = M.merged(ctx, values, place, 100)
    assert (apart[kind] // 100 == np.arange(len(values)) // 100).all()
    worked, real = [], M.slots
    monkeypatch.setattr(M, "slots", lambda ctx, values, kind: worked.append(len(values)) or real(ctx, values, kind))
    few = [w for w in words if len(w) < 70_000]
    values, ctx, place, which = M.inner_contexts(few)
    got, alone, times = M.Mixer(), M.Mixer(), np.arange(len(few))[which] + 1
    got.code(ctx, values, 0, place, times)
    assert sum(worked) < len(values) / 2  # coded and counted
    bit = M._BITS[values].ravel().astype(np.int64)
    for at in real(ctx, values, 0):
        np.add.at(alone.n, at * 2 + bit, np.repeat(times, 8).astype(np.uint32))
    assert (got.n == alone.n).all() and got.bits == 8 * times.sum()
    m = M.Model(got)
    assert np.allclose(m.mixer.code(ctx, values, 0, place), [m.mixer.code(ctx[i : i + 1], values[i : i + 1], 0, place[i : i + 1])[0] for i in range(len(values))])


def test_slots_that_are_not_kept_are_counted_too(monkeypatch):
    texts = [prose(i, 300).encode() for i in range(8)]
    want = learnt(texts).mixer
    monkeypatch.setattr(M, "KEPT", 0)
    got = learnt(texts).mixer
    assert (got.frozen[0] == want.frozen[0]).all() and (got.frozen[1] == want.frozen[1]).all()


def test_word_scores_do_not_depend_on_company():
    m = learnt([prose(i, 100).encode() for i in range(10)])
    words = prose(50, 40).encode().split()
    assert np.allclose(m.word_scores(words), [m.word_scores([w])[0] for w in words])
    some = b" ".join(words[:5])
    assert np.allclose(m.start_scores(toks([b" ".join(words), some, b""]))[1:], [m.start_scores(toks([some]))[0], m.start_scores(toks([b""]))[0]])
