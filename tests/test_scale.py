"""What a task holds at once is bounded, whatever the size of its input."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from shardwright import session
from shardwright.functions import arrow_encode, symbols
from shardwright.operators import bpe, packing
from shardwright.plans import file_job
from shardwright.sources import corpus, listing, shards


def row_groups(df):
    files = [pq.ParquetFile(f.removeprefix("file://")) for f in df.inputFiles()]
    return [f.metadata.row_group(i).num_rows for f in files for i in range(f.metadata.num_row_groups)]


def test_stored_shards_are_read_in_small_row_groups(spark):
    n, size = 300, 65536
    tokens = F.sequence(F.lit(0), F.lit(size - 1))
    shards = spark.range(0, n, 1, 1).select(F.lit("train").alias("split"), F.col("id").cast("int").alias("shard_idx"), tokens.alias("tokens"))
    stored = packing.store_shards(shards, size)
    assert max(row_groups(stored)) * size <= packing.TOKENS_PER_GROUP
    assert sum(row_groups(stored)) == n == stored.where(F.size("tokens") == size).count()


def test_encoding_hands_ids_on_in_slices():
    model = bpe.BPEModel(("<|eos|>",), ((97, 98), (257, 99)))
    texts = ["abc" * 100_000, None, "", "x<|eos|>abcab"] * 20
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["k", "text"])
    out = list(arrow_encode.encode_partitions(model, 1, "ids")([batch]))
    assert len(out) > 4 and all(sum(len(t or "") for t in b.column(1).to_pylist()) <= 2 * arrow_encode.CHARS_PER_SLICE for b in out)
    rows = [r for b in out for r in b.to_pylist()]
    assert [r["k"] for r in rows] == list(range(len(texts)))
    want = {texts[0]: [258] * 100_000, None: None, "": [], texts[3]: [120, 256, 258, 257]}
    assert all(r["ids"] == want[r["text"]] for r in rows)


def test_pairs_counted_by_table_and_by_sort():
    strings = ["abcab", "b", "", "ca", "āab", "\U00010001a\U00010001"]
    for some in (strings[:4], strings[:5], strings):
        for weights in ([1] * len(some), range(2, 2 + len(some))):
            want, got = Counter(), Counter()
            for s, w in zip(some, weights):
                for a, b in zip(s, s[1:]):
                    want[(ord(a) << symbols.SHIFT) | ord(b)] += w
            for k, n in symbols.pair_sums(some, weights, 6):
                got.update(dict(zip(k.tolist(), n.tolist())))
            assert got == want
    joins = symbols.Joins(np.array(sorted((ord(a) << symbols.SHIFT) | ord(b) for a, b in ("ab", "bc")), np.int64))
    assert joins.dim and [("xabc\U00010001ab")[a:b] for a, b in symbols.pieces("xabc\U00010001ab", joins)] == ["abc", "ab"]


def test_pieces_are_given_on_before_a_batch_ends(spark, monkeypatch):
    monkeypatch.setattr(bpe, "HELD_SYMBOLS", 8)
    state = spark.range(0, 40, 1, 1).selectExpr("concat('ab', char(100 + id % 3), 'ab', char(100 + id % 5)) AS s", "id + 1 AS w")
    kept, _ = bpe._pieces(state, [(9, "ab"), (8, "bd"), (7, "be")])
    want = Counter()
    for r in state.collect():
        for a, b in symbols.pieces(r["s"], np.array(sorted((ord(p[0]) << symbols.SHIFT) | ord(p[1]) for p in ("ab", "bd", "be")), np.int64)):
            want[r["s"][a:b]] += r["w"]
    assert {r["s"]: r["w"] for r in kept.collect()} == want


def test_decoding_hands_texts_on_in_slices():
    model = bpe.BPEModel((), ((97, 98),))
    ids = [[256] * 600_000, None, [], [120]] * 4
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(ids))), pa.array(ids, pa.list_(pa.int32()))], names=["k", "ids"])
    out = list(arrow_encode.decode_partitions(model, 1, "text")([batch]))
    assert len(out) > 1 and [t for b in out for t in b.column(2).to_pylist()] == ["ab" * 600_000, "", "", "x"] * 4
    assert [k for b in out for k in b.column(0).to_pylist()] == list(range(len(ids)))


def test_listing_many_folders_takes_few_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(listing, "FOLDERS_PER_TASK", 1)
    for i in range(200):
        (tmp_path / f"f{i:03d}").mkdir()
        (tmp_path / f"f{i:03d}" / "a.txt").write_text("x")
    files = listing.list_files(spark, f"file:{tmp_path}", (".txt",))
    assert files.count() == 200
    assert len(files.inputFiles()) <= spark.sparkContext.defaultParallelism * 4 + 2


def test_parquet_files_are_read_by_name(spark, tmp_path):
    rows = spark.createDataFrame([("x",), ("y",)], "text string")
    for name in ("a b/p%41.parquet", "c/d/q.parquet"):
        rows.coalesce(1).write.parquet(f"file:{tmp_path}/{name}")
    files = listing.list_files(spark, f"file:{tmp_path}", (".parquet",))
    assert len(corpus._named(files)) == 2
    read = corpus.read_corpus(spark, f"file:{tmp_path}")
    assert sorted(r["text"] for r in read.collect()) == ["x", "x", "y", "y"]
    assert all(k.count("\x00") in (3, 4) for k in [r["doc_key"] for r in read.collect()])
    rows.coalesce(1).write.parquet(f"file:{tmp_path}/e{{f}}.parquet")
    files = listing.list_files(spark, f"file:{tmp_path}", (".parquet",))
    assert corpus._named(files) == []
    assert corpus.read_corpus(spark, f"file:{tmp_path}").count() == 6


def test_tokens_move_as_bytes_and_give_the_same_shards(spark, monkeypatch):
    monkeypatch.setattr(packing, "TOKENS_PER_PART", 50)
    rows = [(i, "val" if i % 7 == 0 else "train", [(i * j) % 300 + (70_000 if i % 5 == 0 else 0) for j in range(i % 40)]) for i in range(200)]
    docs = spark.createDataFrame(rows, "k bigint, split string, ids array<int>").repartition(3)
    stored = []
    for name in ("store", "store_at"):
        monkeypatch.setattr(packing, name, lambda df, *a, real=getattr(packing, name): stored.append(real(df, *a)) or stored[-1])
    got = packing.pack_documents(docs, 64, key="k", eos_id=1).collect()
    assert [dict(df.dtypes)["ids"] for df in stored] == ["binary", "binary"]
    for split in ("train", "val"):
        stream = [t for _, s, ids in rows if s == split for t in [*ids, 1]]
        shards = sorted((r for r in got if r["split"] == split), key=lambda r: r["shard_idx"])
        assert [r["tokens"] for r in shards] == [stream[i : i + 64] for i in range(0, len(stream), 64)]


def test_shard_files_are_read_in_small_batches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(shards, "TOKENS_PER_PART", 10)
    table = spark.createDataFrame([("train", i, f"train_{i:05d}.bin", list(range(i))) for i in range(1, 9)], "split string, shard_idx int, filename string, tokens array<int>").coalesce(1)
    info = shards.write_shards(table, f"file:{tmp_path}", "uint16").collect()
    assert sorted((r["filename"], r["num_tokens"]) for r in info) == [(f"train_{i:05d}.bin", i) for i in range(1, 9)]
    read = shards.read_shards(spark, f"file:{tmp_path}", "uint16")
    assert {r["shard_idx"]: r["tokens"] for r in read.collect()} == {i: list(range(i)) for i in range(1, 9)}


def test_joins_of_shard_files_hold_no_tokens(spark, tmp_path):
    docs = spark.createDataFrame([("aab " * 50,), ("abc" * 40,)], "text string")
    docs.coalesce(1).write.parquet(f"file:{tmp_path}/in")
    file_job.pack_folder(spark, f"file:{tmp_path}/in", f"file:{tmp_path}/out", 4, ("<e>",), 32, eos="<e>")
    plan = file_job.packed_shards(spark, f"file:{tmp_path}/out")._jdf.queryExecution().optimizedPlan().toString()
    join = plan.index("Join")
    assert "array_join" in plan[join:] and "array_join" not in plan[:join]


def test_arrow_batches_are_small_while_tokens_are_packed(spark, monkeypatch):
    monkeypatch.setattr(session, "BATCH_BYTES", 10_000)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], names=["rows"])

    docs = spark.range(0, 400, 1, 1).select(F.sequence(F.lit(1), F.lit(200)).alias("ids")).mapInArrow(sizes, "rows long")
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    with session.small_batches(spark):
        few = [r["rows"] for r in docs.collect()]
    assert spark.conf.get(key) == before and sum(few) == 400 and max(few) < 40
    assert [r["rows"] for r in docs.select("rows").collect()] == [400]
