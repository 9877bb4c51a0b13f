"""Examples from byte ranges of shard files."""

import pytest

from shardwright.operators import examples
from shardwright.sources import ranges
from shardwright.sources import shards as shard_io

SIZES = {("train", 0): 1000, ("train", 1): 37, ("val", 0): 11, ("val", 12): 12}


@pytest.fixture(scope="module", params=["uint16", "uint32"])
def written(spark, tmp_path_factory, request):
    folder = str(tmp_path_factory.mktemp("a folder of 100%") / "shards")
    high = 60_000 if request.param == "uint16" else 2_000_000
    rows = [(s, i, f"{s}_{i:05d}.bin", [high + 3 * j + i for j in range(n)]) for (s, i), n in SIZES.items()]
    shards = spark.createDataFrame(rows, "split string, shard_idx int, filename string, tokens array<int>")
    shard_io.write_shards(shards, folder, request.param).collect()
    return shards, folder, request.param


def rows(df):
    return sorted((r["split"], r["shard_idx"], r["example_idx"], tuple(r["x"]), tuple(r["y"])) for r in df.collect())


@pytest.mark.parametrize("context, per_read", [(1, 7), (5, 5), (5, 64), (10, 3), (10, 1 << 20)])
def test_ranges_give_the_examples_of_whole_shards(spark, written, context, per_read):
    shards, folder, dtype = written
    got = ranges.read_examples(spark, folder, dtype, context, tokens_per_read=per_read)
    assert rows(got) == rows(examples.cut_examples(shards, context))


def test_small_shards(spark, written):
    shards, folder, dtype = written
    with pytest.raises(Exception, match="too few"):
        ranges.read_examples(spark, folder, dtype, 11).collect()
    got = ranges.read_examples(spark, folder, dtype, 11, on_small="drop")
    assert rows(got) == rows(examples.cut_examples(shards, 11, on_small="drop")) and got.where("split = 'val'").count() == 1
    for bad in ({"context_length": 0}, {"context_length": 4, "on_small": "skip"}):
        with pytest.raises(ValueError):
            ranges.read_examples(spark, folder, dtype, **bad)
    with pytest.raises(ValueError):
        ranges.read_examples(spark, folder, "uint8", 4)


def test_examples_asked_for(spark, written):
    shards, folder, dtype = written
    every = {r[:3]: r[3:] for r in rows(examples.cut_examples(shards, 5))}
    asked = [("train", 0, 0), ("train", 0, 198), ("train", 0, -1), ("train", 0, -199), ("train", 1, 3), ("val", 12, -2), ("train", 0, 0)]
    requests = spark.createDataFrame(asked, "split string, shard_idx int, index int").repartition(3)
    count = {("train", 0): 199, ("train", 1): 7, ("val", 12): 2}
    want = sorted((s, i, at, *every[(s, i, at)]) for s, i, at in ((s, i, at + count[s, i] if at < 0 else at) for s, i, at in asked))
    assert rows(ranges.examples_at(requests, folder, dtype, 5)) == want
    assert ranges.examples_at(requests.limit(0), folder, dtype, 5).collect() == []
    for wrong in (("train", 0, 199), ("train", 0, -200), ("val", 0, 2), ("test", 0, 0)):
        with pytest.raises(Exception):
            ranges.examples_at(spark.createDataFrame([wrong], requests.schema), folder, dtype, 5).collect()


def test_torn_file_is_an_error(spark, tmp_path):
    (tmp_path / "train_00000.bin").write_bytes(b"\0" * 21)
    with pytest.raises(Exception, match="whole number"):
        ranges.read_examples(spark, str(tmp_path), "uint16", 2).collect()
    with pytest.raises(Exception, match="whole number"):
        ranges.examples_at(spark.createDataFrame([("train", 0, 0)], "split string, shard_idx int, index int"), str(tmp_path), "uint16", 2).collect()


def test_an_example_reads_its_own_bytes_only():
    asked = []

    class File:
        def seek(self, at):
            asked.append(at)

        def read(self, n):
            asked.append(n)
            return b"\0" * n

    assert len(ranges._tokens(File(), 640, 129, 2)) == 129 and asked == [1280, 258]


def test_no_shards(spark, tmp_path):
    assert ranges.read_examples(spark, str(tmp_path), "uint16", 4).collect() == []
