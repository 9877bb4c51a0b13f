"""Embedding and shingle near-duplicates against brute force."""

from collections import Counter

import numpy as np
import pytest
from brute import classes, shingle_set, similar
from conftest import prose

from shardwright.llm import embed_dedup as E
from shardwright.llm import parity_join as J
from shardwright.llm.components import components


def test_components_of_paths_stars_and_rings(spark):
    rng = np.random.default_rng(1)
    links = [(i, i + 1) for i in range(100, 160)] + [(200, i) for i in range(201, 280)] + [(300 + i, 300 + (i + 1) % 30) for i in range(30)]
    links += [tuple(map(int, x)) for x in rng.integers(1000, 1200, (150, 2))] + [(5, 5)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    want = classes({x for e in links for x in e}, links)
    assert all(got.get(k, k) == v for k, v in want.items())
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def vectors(seed, n, dim, near):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    for i in range(1, n):
        if rng.random() < near:
            x[i] = x[rng.integers(0, i)] + rng.normal(size=dim) * rng.choice([0.05, 0.3, 0.46, 0.5])
    return x.astype(np.float32)


def brute_vectors(rows, threshold=0.9):
    ok = [(i, np.array(v, float)) for i, (k, v) in enumerate(rows) if k is not None and v and all(a is not None and np.isfinite(a) for a in v) and any(v)]
    pairs = [(i, j) for a, (i, x) in enumerate(ok) for j, y in ok[a + 1 :] if len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold]
    n = np.bincount([i for p in pairs for i in p], minlength=len(rows))
    return n, classes({k for k, _ in rows if k is not None}, [(rows[i][0], rows[j][0]) for i, j in pairs])


def test_embeddings_match_brute_force_with_hot_blocks(spark):
    x = vectors(3, 400, 16, 0.5)
    hot = (x[0] + np.random.default_rng(4).normal(size=(120, 16)) * 0.02).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate([*x, *hot, *[x[7]] * 5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    got = {r["vec_id"]: r for r in E.near_duplicates(df, block=32, per_task=200).collect()}
    n, comp = brute_vectors(rows)
    found, all_ = sum(got[i]["n_links"] for i, _ in rows), int(n.sum())
    assert all(got[i]["n_links"] <= n[i] for i, _ in rows) and found >= 0.99 * all_
    assert sum(got[i]["component_id"] != comp[i] for i, _ in rows) <= 2
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())


def test_blocks_are_dealt_by_the_rows_they_hold(spark):
    """A large group is dealt over as many tasks as its rows need, and each pair of members meets once."""
    m, block = 300, 10
    rows = spark.range(m).selectExpr("id as rep", "1L as component").join(spark.createDataFrame([(1, m)], "component long, n long"), "component")
    total = E.dealt_rows(spark.createDataFrame([(1, m)], "component long, n long"), "n", block)
    assert total == m * 30 and E.dealt_rows(spark.createDataFrame([], "n long"), "n", block) == 0
    dealt = E.in_blocks(rows, ["component"], "n", block, 50, total).toPandas()
    assert len(dealt) == total and dealt["g"].nunique() > 100 and dealt.groupby("g").size().max() < 10 * dealt.groupby("g").size().median()
    met = Counter()
    for _, at in dealt.groupby("blk"):
        low, high = (set(at.loc[at["side"] == k, "rep"]) for k in (0, 1))
        met.update((min(x, y), max(x, y)) for x in low for y in high) if high else met.update((x, y) for x in low for y in low if x < y)
    assert len(met) == m * (m - 1) // 2 and set(met.values()) == {1}


def test_recall_at_the_threshold():
    t = E.plan_tables(50_000, 0.9)
    rng = np.random.default_rng(6)
    a = rng.normal(size=(3000, 32))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.normal(size=(3000, 32))
    b -= (b * a).sum(1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    b = 0.9 * a + np.sqrt(1 - 0.81) * b
    assert (t.keys(a) == t.keys(b)).any(1).mean() > 0.99


def test_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]), (8, [None, 1.0]), (None, [1.0, 0.0]), (9, [1.0, 0.0, 0.0]), (10, [1.0, 0.0]), (10, [1.0, 0.0])]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, rep int, label int")
    got = sorted(E.near_duplicates(df).collect(), key=lambda r: (r["vec_id"] is None, r["vec_id"]))
    assert [(r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got] == [
        (1, 3, 1, True), (2, 3, 1, False), *((i, 0, i, True) for i in (3, 4, 5, 6, 7, 8, 9)), (10, 3, 1, False), (10, 3, 1, False), (None, 0, None, True),
    ]
    assert E.near_duplicates(df.limit(0)).count() == 0


def near_texts():
    rng = np.random.default_rng(8)
    rows = []
    for i in range(90):
        base = prose(i, int(rng.integers(3, 160))).split()
        rows.append(" ".join(base))
        for _ in range(int(rng.integers(0, 4))):
            w = list(base)
            for _ in range(int(rng.integers(0, 3))):
                w[int(rng.integers(0, len(w)))] = "other"
            w += ["tail"] * int(rng.integers(0, 2))
            rows.append(" ".join(w).upper() if rng.random() < 0.2 else " ".join(w))
    shared = prose(777, 60)
    rows += [shared + " " + prose(1000 + i, 60) for i in range(40)]  # a long passage in common, yet not similar
    hot = prose(555, 100).split()
    rows += [" ".join(hot[:k] + ["x%d" % k] + hot[k + 1 :]) for k in range(80)]  # one large group of near copies
    rows += ["a b c d e f g h " + "z " * k for k in range(1, 6)] + ["tiny", "tiny", "one two", ""]
    return list(enumerate(rows, 1))


@pytest.mark.parametrize("parts", [1, 6])
def test_documents_match_brute_force(spark, parts):
    rows = near_texts()
    sets = {i: shingle_set(t) for i, t in rows}
    want = classes(sets, similar(sets))
    got = J.similar_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts), entries_per_bucket=500).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == {i: (len(sets[i]), want[i]) for i in sets}


def test_every_linking_pair_shares_a_signature():
    rng = np.random.default_rng(0)
    seen = 0
    for turn in range(1500):
        n = int(rng.integers(4, 30 if turn % 2 else 500))
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        d = 2 * len(a) // 9
        gone = int(rng.integers(0, d + 1))
        b = np.unique(np.concatenate([rng.permutation(a)[gone:], rng.integers(0, 2**63, d - gone, dtype=np.uint64)]))
        if J.links(a, b):
            seen += 1
            assert len(np.intersect1d(J.signatures(a), J.signatures(b)))
            far = J.hamming(J.parity_sketch(a).tobytes(), J.parity_sketch(b).tobytes())
            assert far <= len(np.setxor1d(a, b)) <= (len(a) + len(b)) / 9
            small = np.bincount(((a >> np.uint64(7)) % J.BITS).astype(int), minlength=J.BITS) & 1
            assert np.array_equal(J.folded(J.parity_sketch(a), J.BITS // 8), np.packbits(small.astype(np.uint8)))
    assert seen > 700


def test_documents_without_a_short_round(spark, monkeypatch):
    """Sets whose segments are too often empty in all rounds meet on the scheme alone."""
    monkeypatch.setattr(J, "ROUNDS", 0)
    a, b = np.arange(1, 40, dtype=np.uint64), np.arange(2, 41, dtype=np.uint64)
    assert J.links(a, b) and set(J.signatures(a)) & set(J.signatures(b))


def test_groups_across_components(spark):
    """Group members that no star joined are compared across components."""
    rows = [(i, shingle_set(prose(3, 60) + f" w{i % 2}" * 3 + f" u{i}")) for i in range(6)]
    sets = [(i, np.sort(np.array([hash(x) & (2**62 - 1) for x in s], "<u8")).tobytes()) for i, s in rows]
    df = spark.createDataFrame(sets, "doc_id long, h binary")
    sk = spark.createDataFrame([(i, len(h) // 8, J.parity_sketch(np.frombuffer(h, "<u8")).tobytes()) for i, h in sets], "id long, size long, sketch binary")
    groups = spark.createDataFrame([(1, i) for i in range(6)], "g long, id long")
    cc = spark.createDataFrame([(0, 0), (2, 0)], "node long, component long")
    pairs = {(r["a"], r["b"]) for r in J.across(groups, cc, sk, block=2).collect()}
    true = {p for p in similar(dict(rows))}
    assert true - {(0, 2)} <= pairs and (0, 2) not in pairs
    assert {(r["a"], r["b"]) for r in J.verified(J.across(groups, cc, sk), df).collect()} == true - {(0, 2)}
    # many groups of one least id are dealt over several tasks: each pair still comes once
    many = spark.createDataFrame([(g, i) for g in range(40) for i in range(6) if i == 0 or (g >> (i - 1)) & 1], "g long, id long")
    for most in (3, 200_000):
        got = [(r["a"], r["b"]) for r in J.verified(J.across(many, cc, sk, block=2, per_task=5, most=most), df).collect()]
        assert len(got) == len(set(got)) and set(got) == {p for p in true - {(0, 2)} if sum(1 << (i - 1) for i in p if i) < 40}


def test_hard_documents(spark, hard, none):
    sets = {r["doc_id"]: shingle_set(r["text"]) for r in hard.collect() if r["doc_id"] is not None}
    want = classes(sets, similar(sets))
    got = J.similar_documents(hard).collect()
    assert len(got) == hard.count()
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None
        else:
            assert (r["n_shingles"], r["component_id"]) == (len(sets[r["doc_id"]]), want[r["doc_id"]])
    kept = J.one_of_each(hard)
    assert kept.schema == hard.schema
    ids = sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in kept.collect())
    assert ids == sorted([-1, *(i for i in sets if want[i] == i)])
    assert J.similar_documents(none).count() == 0 and J.one_of_each(none).count() == 0
