"""Packing, shards, manifest and examples."""

import json

import pytest
from pyspark.sql import functions as F

from shardwright.operators import examples, packing
from shardwright.sources import shards as shard_io


def docs_frame(spark, id_lists, split="train"):
    return spark.createDataFrame([(i, split, ids) for i, ids in enumerate(id_lists)], "doc_key bigint, split string, ids array<int>")


def shard_sizes(df):
    return [(r["filename"], r["num_tokens"]) for r in df.orderBy("split", "shard_idx").collect()]


def test_dtype_for_vocab():
    assert [packing.dtype_for_vocab(v) for v in (256, 4096, 65536, 65537)] == ["uint16", "uint16", "uint16", "uint32"]
    with pytest.raises(ValueError):
        packing.dtype_for_vocab(0)


def test_sharding_stream(spark):
    sh = packing.pack_documents(docs_frame(spark, [list(range(10))]), 4)
    assert shard_sizes(sh) == [("train_00000.bin", 4), ("train_00001.bin", 4), ("train_00002.bin", 2)]
    toks = [list(r["tokens"]) for r in sh.orderBy("shard_idx").collect()]
    assert toks == [[0, 1, 2, 3], [4, 5, 6, 7], [8, 9]]
    with pytest.raises(ValueError):
        packing.pack_documents(docs_frame(spark, [[1]]), 0)


def test_empty_stream_has_no_shards(spark):
    assert packing.pack_documents(docs_frame(spark, [[], []]), 4).count() == 0


def test_documents_straddle_shards(spark):
    sh = packing.pack_documents(docs_frame(spark, [[0, 1, 2], [3, 4, 5, 6, 7]]), 4)
    assert [list(r["tokens"]) for r in sh.orderBy("shard_idx").collect()] == [[0, 1, 2, 3], [4, 5, 6, 7]]


def test_boundaries_and_offsets_with_empty_doc(spark):
    d = docs_frame(spark, [[5, 6], [], [7]])
    marked = d.select("doc_key", "split", packing.add_boundaries(F.col("ids"), 256, 257).alias("ids"))
    off = packing.token_offsets(marked).orderBy("doc_key").collect()
    assert [(r["start"], r["n"]) for r in off] == [(0, 4), (4, 2), (6, 3)]
    sh = packing.pack_documents(d, 100, eos_id=257)
    assert list(sh.collect()[0]["tokens"]) == [5, 6, 257, 257, 7, 257]


def test_offsets_many_buckets(spark):
    # many slices of sparse keys
    rows = [(i * 3_000_000_007, "train" if i % 3 else "val", 1 + i % 5) for i in range(500)]
    df = spark.createDataFrame(rows, "k bigint, split string, n bigint")
    got = packing.prefix_offsets(df, ["split"], "k", "n", "start", rows_per_slice=7).collect()
    exp, run = {}, {}
    for k, s, n in rows:
        exp[k] = run.get(s, 0)
        run[s] = run.get(s, 0) + n
    assert {r["k"]: r["start"] for r in got} == exp


def test_offsets_of_path_keys(spark, tmp_path):
    """Keys of a file corpus: the window over slices has a row per slice, not per file."""
    from shardwright.sources.corpus import read_corpus

    for i in range(60):
        (tmp_path / f"f{i:02d}.txt").write_text("x" * (i % 5))
    corpus = read_corpus(spark, str(tmp_path)).select("doc_key", F.lit("train").alias("split"), F.length("text").cast("long").alias("n"))
    sliced = packing.range_slices(corpus, "doc_key", 20)
    assert sliced.select("_slice").distinct().count() <= 3
    rows = packing.prefix_offsets(corpus, ["split"], "doc_key", "n", "start", rows_per_slice=20).orderBy("doc_key").collect()
    run = 0
    for r in rows:
        assert r["start"] == run
        run += r["n"]
    assert len(rows) == 60


def test_partition_count_invariance(spark):
    ids = [list(range(i, i + (i % 7))) for i in range(60)]
    d = docs_frame(spark, ids)
    a = shard_sizes(packing.pack_documents(d.repartition(1), 16, eos_id=1))
    b = shard_sizes(packing.pack_documents(d.repartition(7), 16, eos_id=1))
    assert a == b


def test_shard_roundtrip_uint16_and_uint32(spark, tmp_path):
    sh = spark.createDataFrame(
        [("train", 0, "train_00000.bin", [0, 1, 255, 256, 4095])], "split string, shard_idx int, filename string, tokens array<int>"
    )
    info = shard_io.write_shards(sh, str(tmp_path / "a"), "uint16").collect()
    assert [(r["filename"], r["num_tokens"]) for r in info] == [("train_00000.bin", 5)]
    assert (tmp_path / "a" / "train_00000.bin").stat().st_size == 10
    back = shard_io.read_shards(spark, str(tmp_path / "a"), "uint16").collect()
    assert list(back[0]["tokens"]) == [0, 1, 255, 256, 4095] and back[0]["shard_idx"] == 0
    wide = spark.createDataFrame([("train", 0, "train_00000.bin", [0, 70000, 1, 131071])], sh.schema)
    shard_io.write_shards(wide, str(tmp_path / "b"), "uint32").collect()
    back = shard_io.read_shards(spark, str(tmp_path / "b"), "uint32")
    ex = examples.cut_examples(back, 2).orderBy("example_idx").collect()
    assert [(list(r["x"]), list(r["y"])) for r in ex] == [([0, 70000], [70000, 1])]
    with pytest.raises(Exception):
        shard_io.write_shards(wide, str(tmp_path / "c"), "uint16").collect()


def test_manifest_table_and_file(spark, tmp_path):
    d = spark.createDataFrame(
        [(0, "train", [1, 2, 3, 4]), (1, "val", [5, 6])], "doc_key bigint, split string, ids array<int>"
    )
    sh = packing.pack_documents(d, 4)
    man = packing.manifest(sh, 4096, 4)
    rows = {r["split"]: r for r in man.collect()}
    assert rows["train"]["num_tokens"] == 4 and rows["val"]["num_tokens"] == 2 and rows["train"]["dtype"] == "uint16"
    uri = (tmp_path / "out dir").as_uri()
    path = shard_io.write_manifest(man, uri)
    assert path == str(tmp_path / "out dir" / "manifest.json")
    m = json.loads(open(path).read())
    assert m["dtype"] == "uint16" and m["vocab_size"] == 4096 and m["shard_size"] == 4
    assert m["splits"]["train"] == {"shards": ["train_00000.bin"], "num_tokens": 4}
    assert m["splits"]["val"] == {"shards": ["val_00000.bin"], "num_tokens": 2}
    assert shard_io.load_manifest(uri) == m
    assert shard_io.manifest_shards(spark, uri).count() == 2


def one_shard(spark, tokens, split="train", idx=0):
    return spark.createDataFrame([(split, idx, f"{split}_{idx:05d}.bin", tokens)], "split string, shard_idx int, filename string, tokens array<int>")


def test_examples_blocks_and_shift(spark):
    ex = examples.cut_examples(one_shard(spark, list(range(10))), 4).orderBy("example_idx").collect()
    assert [(list(r["x"]), list(r["y"])) for r in ex] == [([0, 1, 2, 3], [1, 2, 3, 4]), ([4, 5, 6, 7], [5, 6, 7, 8])]


def test_example_index_rules(spark):
    sh = one_shard(spark, list(range(10)))
    assert list(examples.example_at(sh, "train", 0, -1, 4).collect()[0]["x"]) == [4, 5, 6, 7]
    assert list(examples.example_at(sh, "train", 0, 0, 4).collect()[0]["y"]) == [1, 2, 3, 4]
    with pytest.raises(Exception, match="no example"):
        examples.example_at(sh, "train", 0, 2, 4).collect()
    with pytest.raises(Exception, match="no example"):
        examples.example_at(sh, "train", 0, -3, 4).collect()


def test_small_shard_and_bad_context(spark):
    with pytest.raises(Exception, match="too few"):
        examples.cut_examples(one_shard(spark, [1, 2, 3]), 4).collect()
    assert examples.cut_examples(one_shard(spark, [1, 2, 3]), 4, on_small="drop").count() == 0
    with pytest.raises(ValueError):
        examples.cut_examples(one_shard(spark, [1, 2, 3]), 0)


def test_train_shard_and_batch(spark):
    sh = one_shard(spark, [i % 64 for i in range(128)])
    first = examples.first_train_shard(sh)
    ex = examples.cut_examples(first, 16)
    assert ex.count() == 7
    b = examples.batches(ex, 2).collect()[0]
    assert len(b["x"]) == 2 and list(b["x"][1]) == list(range(16, 32))
    with pytest.raises(Exception, match="more than the"):
        examples.batches(ex, 8).collect()
    full = examples.batches(ex, 2, first_only=False).collect()
    assert len(full) == 3  # 7 examples -> 3 complete batches of 2
    with pytest.raises(ValueError, match="no first one"):
        examples.first_train_shard(one_shard(spark, [1, 2], split="val"))


def test_token_audits(spark):
    df = spark.createDataFrame([([0, 64],), ([1, 2, 3, 4, 5, 6, 7, 8, 9],)], "x array<int>")
    a = examples.token_id_audit(df, ["x"], 64).collect()[0]
    assert (a["min_id"], a["max_id"], a["n_bad"]) == (0, 64, 1)
    with pytest.raises(Exception, match="ids outside"):
        examples.strict(examples.token_id_audit(df, ["x"], 64), 64).collect()
    both = examples.example_audit(df.withColumn("g", F.lit(1)), ["x"], 64, 8, "g").collect()[0]
    assert (both["n_bad"], both["n_too_long"]) == (1, 1)
    with pytest.raises(TypeError, match="integer dtype"):
        examples.token_id_audit(df.select(F.col("x").cast("array<double>").alias("x")), ["x"], 64)
    assert examples.context_audit(df, "x", 8).collect()[0]["n_too_long"] == 1
    with pytest.raises(Exception, match="exceeds"):
        examples.strict(examples.context_audit(df, "x", 8)).collect()


@pytest.mark.parametrize("slices, shard_size", [(1, 7), (6, 7), (6, 1000), (6, 1)])
def test_slices_make_the_shards_of_one_stream(spark, monkeypatch, slices, shard_size):
    """Shards that cross slices, tasks and long documents equal cuts of the concatenated documents."""
    monkeypatch.setattr(packing, "MOST_SLICES", slices)
    monkeypatch.setattr(packing, "TOKENS_PER_SLICE", 20)
    rows, streams = [], {}
    for i in range(120):
        ids = [(i * 37 + k) % 300 for k in range([0, 3, 1, 12, 90][i % 5])]
        rows.append((f"k{i:03d}", ["train", "val", None][i % 7 % 3], ids))
        streams.setdefault(rows[-1][1], []).extend([7, *ids])
    docs = spark.createDataFrame(rows, "name string, part string, toks array<int>").repartition(5)
    got = packing.pack_documents(docs, shard_size, key="name", split="part", ids="toks", bos_id=7).collect()
    want = {(s, i): t[i * shard_size : (i + 1) * shard_size] for s, t in streams.items() for i in range(-(-len(t) // shard_size))}
    assert len(got) == len(want) and {(r["part"], r["shard_idx"]): list(r["tokens"]) for r in got} == want
    assert all(r["num_tokens"] == len(r["tokens"]) for r in got)


def test_tokens_cross_one_exchange(spark):
    """Behind the written slices only the pieces at the tasks' ends are grouped."""
    docs = spark.range(50).selectExpr("id AS k", "'train' AS split", "transform(sequence(1, 40), x -> CAST(x AS INT)) AS ids")
    plan = packing.pack_documents(docs, 64, key="k")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1 and plan.count("MapInArrow") == 2 and "Join" not in plan
