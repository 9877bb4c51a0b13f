"""From a folder to shard files and back."""

import pytest

from shardwright.operators import bpe
from shardwright.plans.file_job import pack_folder, packed_shards
from shardwright.sources import shards as shard_files
from shardwright.sources.artifacts import load_tokenizer


def test_folder_to_manifest_and_back(spark, tmp_path):
    root, out = tmp_path / "in", (tmp_path / "out").as_uri()
    (root / "a").mkdir(parents=True)
    texts = {"a/2.txt": "river banks and rivers", "a/1.txt": "the bank by\r\nthe river", "b.txt": "", "a.txt": "banking <|eos|> on the bank"}
    for name, text in texts.items():
        (root / name).write_bytes(text.encode())
    spark.createDataFrame([("riverrun",), (None,), ("rivers é",)], "text string").coalesce(1).write.parquet(str(root / "c"))
    path = pack_folder(spark, str(root), out, 12, ["<|bos|>", "<|eos|>"], 16, bos="<|bos|>", eos="<|eos|>")
    model = load_tokenizer(spark, f"{out}/tokenizer")
    order = ["the bank by\nthe river", "river banks and rivers", "banking <|eos|> on the bank", "", "riverrun", "rivers é"]
    df = spark.createDataFrame(list(enumerate(order)), "doc_id long, text string")
    coded = sorted(bpe.encode_documents(df, model).collect(), key=lambda r: r["doc_id"])
    stream = [i for r in coded for i in (256, *r["ids"], 257)]
    manifest = shard_files.load_manifest(path)
    assert manifest["splits"]["train"]["num_tokens"] == len(stream) and len(model.merges) == 12
    read = sorted(shard_files.read_shards(spark, f"{out}/shards", manifest["dtype"]).collect(), key=lambda r: r["shard_idx"])
    assert [i for r in read for i in r["tokens"]] == stream
    assert [r["num_tokens"] for r in packed_shards(spark, out).orderBy("shard_idx").collect()] == [16] * (len(stream) // 16) + [len(stream) % 16] * (len(stream) % 16 > 0)
    with pytest.raises(ValueError):
        pack_folder(spark, str(root), out, 12, ["<|eos|>"], 16, bos="<|bos|>")
