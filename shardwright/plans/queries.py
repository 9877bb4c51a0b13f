"""Registered queries: one per operator group, each ``(spark, sf_dir) -> DataFrame``.

Every query reads the driver's tables (``documents``, ``conversations``) whole, or
data Spark derives from them.  Parameters are fixed here and restated in the
matching DuckDB SQL (``plans.oracle``).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardwright.functions.codepoints import digest
from shardwright.operators import audit, bpe, evaluation, examples, packing, prep
from shardwright.operators.specials import split_special
from shardwright.plans.file_job import pack_folder, packed_shards
from shardwright.session import checkpoint_dir
from shardwright.sources import ranges
from shardwright.sources import shards as shard_files
from shardwright.sources.corpus import balance, hadoop_path, ranked, read_corpus, read_parquet_text

# fixed query parameters (restated in plans/oracle.py)
SEED = 1337
VAL_FRACTION = 0.1
SPECIALS = ("<|bos|>", "<|eos|>")
EOS_ID = 257
SPLIT_SPECIALS = ("<|b", "<|bos|>", "<|eos|>")  # "<|b" checks longest-at-leftmost
TRAIN_MERGES = 8
LONG_MERGES = 1024  # learned from the conversations
SHARD_SIZE = 65536
CONTEXT = 128
READ_TOKENS = 1 << 14  # of one read of a shard file: several reads a shard
BATCH = 4
ALPHA = 1.0
AUDIT_VOCAB = 200  # below the ids of the specials: some rows break it
AUDIT_CONTEXT = 110
SPACE_ID = 32
TEXT_LANG = "es"  # the language that corpus_order writes as text files
COMMIT_BY_TASKS = ("mapreduce.fileoutputcommitter.algorithm.version", "2")  # a file a document: else the driver moves each
BYTE_MODEL = bpe.BPEModel(SPECIALS)  # 256 bytes + 2 specials, no merges
BYTE_VOCAB = BYTE_MODEL.vocab_size


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balance(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"), "doc_id")


_MODELS: dict[tuple, bpe.BPEModel] = {}
_LONG_MODELS: dict[tuple, bpe.BPEModel] = {}


def trained_model(spark: SparkSession, sf_dir: str, merges: int = TRAIN_MERGES) -> bpe.BPEModel:
    """The small BPE model learned from the whole ``documents`` table (memoised: the
    model is vocabulary-sized metadata, deterministic for a given table)."""
    key = (*state_of(spark, sf_dir), merges)
    if key not in _MODELS:
        _MODELS.clear()
        docs = documents(spark, sf_dir)
        _MODELS[key] = bpe.train_bpe(docs, 256 + len(SPECIALS) + merges, SPECIALS)
    return _MODELS[key]


def long_model(spark: SparkSession, sf_dir: str) -> bpe.BPEModel:
    """A model of LONG_MERGES merges, learned from the whole ``conversations`` table (memoised)."""
    key = (*state_of(spark, sf_dir, "conversations"), LONG_MERGES)
    if key not in _LONG_MODELS:
        _LONG_MODELS.clear()
        _LONG_MODELS[key] = bpe.train_bpe(table(spark, sf_dir, "conversations"), 256 + len(SPECIALS) + LONG_MERGES, SPECIALS)
    return _LONG_MODELS[key]


def byte_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents encoded with the byte-level tokenizer, split assigned."""
    docs = prep.assign_split(documents(spark, sf_dir), VAL_FRACTION, SEED, key="doc_id")
    return bpe.encode_documents(docs.select("doc_id", "split", "text"), BYTE_MODEL, method="arrow").drop("text")


_SHARDS: dict[tuple, DataFrame] = {}


def state_of(spark: SparkSession, sf_dir: str, name: str = "documents") -> tuple:
    """A table as it is now: application, path, size and time of change."""
    fs, path = hadoop_path(spark, f"{sf_dir}/{name}.parquet")
    s = fs.getContentSummary(path)
    return spark.sparkContext.applicationId, sf_dir, s.getLength(), fs.getFileStatus(path).getModificationTime()


def shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed shard table, built once per application and state of the corpus (the last one
    is kept): later stages read it the way training reads written shard files, instead
    of re-tokenizing the corpus."""
    key = state_of(spark, sf_dir)
    if key not in _SHARDS:
        packed = packing.pack_documents(byte_tokens(spark, sf_dir), SHARD_SIZE, key="doc_id", eos_id=EOS_ID)
        _SHARDS.clear()
        _SHARDS[key] = packing.store_shards(packed, SHARD_SIZE)
    return _SHARDS[key]


def example_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return examples.cut_examples(shards(spark, sf_dir), CONTEXT, on_small="error")


# ------------------------------------------------------------------ queries


def q_corpus_scan(spark, sf_dir):
    docs = balance(read_parquet_text(spark, f"{sf_dir}/documents.parquet", extra_cols=["doc_id"]), "doc_id")
    return docs.select("doc_id", F.octet_length("text").cast("bigint").alias("n_bytes"))


def q_normalize_v0(spark, sf_dir):
    docs = documents(spark, sf_dir)
    crlf = F.replace(F.replace(F.col("text"), F.lit("\n"), F.lit("\r\n")), F.lit(". "), F.lit(".\r"))
    norm = prep.normalize_v0(crlf)
    return docs.select("doc_id", F.md5(norm).alias("digest"), F.octet_length(norm).cast("bigint").alias("n_bytes"))


def q_dedup_exact(spark, sf_dir):
    return prep.dedup_exact(documents(spark, sf_dir), key="doc_id").select("doc_id", "n_copies")


def q_dedup_lines(spark, sf_dir):
    lines = prep.line_table(documents(spark, sf_dir), key="doc_id")
    return prep.first_lines(lines, key="doc_id").select("doc_id", "line_no", "digest", "n_copies")


def q_dedup_lines_docs(spark, sf_dir):
    docs = prep.dedup_lines(documents(spark, sf_dir).select("doc_id", "text"), key="doc_id")
    return docs.select("doc_id", F.octet_length("text").cast("bigint").alias("n_bytes"), F.md5("text").alias("digest"))


def q_file_corpus(spark, sf_dir):
    """The corpus as a tree of files: written by source, read back in corpus order."""
    root = f"{checkpoint_dir(spark)}/file-corpus-{uuid.uuid4().hex}"
    out = documents(spark, sf_dir).select("doc_id", "text", F.concat(F.lit("from "), "source").alias("src"))
    out.repartition("src").write.partitionBy("src").parquet(root)
    docs = prep.assign_split(read_parquet_text(spark, root, extra_cols=["doc_id"]), VAL_FRACTION, SEED)
    folder = F.substring_index(F.split_part("doc_key", F.lit("\x00"), F.lit(1)), "=", -1)
    named = docs.select("doc_id", F.url_decode(folder).alias("folder"), "text", F.col("split").isin("train", "val").alias("has_split"))
    return named.select("doc_id", "folder", F.md5("text").alias("digest"), "has_split")


def q_corpus_order(spark, sf_dir):
    """A tree of folders, one language as text files (one each), all others in Parquet, read back
    and numbered in corpus order.  Folder names differ in marks that sort before ``/``, so an
    order of plain strings gives other ranks."""
    root = f"{checkpoint_dir(spark)}/corpus-order-{uuid.uuid4().hex}"
    nth = F.col("doc_id") % 3
    folder = F.concat("lang", F.when(nth > 0, F.concat(F.lit("-"), nth)).otherwise(""))
    docs = documents(spark, sf_dir).where("text IS NOT NULL").select("doc_id", "text", "lang", folder.alias("src"))
    name = F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("doc")
    docs.where(F.col("lang") == TEXT_LANG).select("src", name, "text").write.partitionBy("src", "doc").mode("append").option(*COMMIT_BY_TASKS).text(root)
    rows = docs.where(F.col("lang") != TEXT_LANG).select("src", "doc_id", "text")
    rows.repartition("src").sortWithinPartitions("src", "doc_id").write.partitionBy("src").mode("append").parquet(root)
    read = read_corpus(spark, root).select("doc_key", F.md5("text").alias("digest"), F.octet_length("text").cast("bigint").alias("n_bytes"))
    return ranked(read).select("rank", "digest", "n_bytes")


def q_split_assign(spark, sf_dir):
    docs = prep.assign_split(documents(spark, sf_dir), VAL_FRACTION, SEED, key="doc_id")
    return docs.groupBy("split").agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum(F.octet_length("text")).cast("bigint").alias("n_bytes")
    )


def q_special_split(spark, sf_dir):
    conv = balance(table(spark, sf_dir, "conversations"), "conv_id", "turn")
    src = F.concat(F.lit("<|bos|>"), F.replace(F.col("text"), F.lit("\n"), F.lit("<|eos|><|bos|>")), F.lit("<|eos|>"))
    segs = conv.select("conv_id", "turn", F.posexplode(split_special(src, SPLIT_SPECIALS)).alias("seg_idx", "seg"))
    return segs.select("conv_id", "turn", "seg_idx", F.col("seg.is_special").alias("is_special"), F.col("seg.chunk").alias("chunk"))


def q_pair_counts(spark, sf_dir):
    state = bpe.chunk_table(documents(spark, sf_dir))
    counts = bpe.pair_counts(state)
    left, right = bpe.unpack_pair(F.col("k"))
    return counts.select(left.alias("left_id"), right.alias("right_id"), F.col("n").cast("bigint").alias("n"))


def q_bpe_train(spark, sf_dir):
    model = trained_model(spark, sf_dir)
    return model.merges_df(spark).select("rank", "left_id", "right_id", "new_id", F.col("pair_count").alias("n"))


def q_bpe_train_long(spark, sf_dir):
    model = long_model(spark, sf_dir)
    return model.merges_df(spark).select("rank", "left_id", "right_id", "new_id", F.col("pair_count").alias("n"))


def q_bpe_encode_long(spark, sf_dir):
    coded = bpe.encode_documents(documents(spark, sf_dir).select("doc_id", "text"), long_model(spark, sf_dir))
    return coded.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), digest(F.col("ids")).alias("digest"))


def q_bpe_decode_long(spark, sf_dir):
    model = long_model(spark, sf_dir)
    coded = bpe.encode_documents(documents(spark, sf_dir).select("doc_id", "text"), model).select("doc_id", "ids")
    back = bpe.decode_documents(coded, model)
    return back.select("doc_id", F.octet_length("text").cast("bigint").alias("n_bytes"), F.md5("text").alias("digest"))


def q_bpe_vocab(spark, sf_dir):
    model = trained_model(spark, sf_dir)
    return model.vocab_df(spark).select("token_id", "kind", F.hex("bytes").alias("bytes_hex"))


def q_bpe_encode(spark, sf_dir):
    model = trained_model(spark, sf_dir)
    ids = bpe.encode(F.col("text"), model)
    return documents(spark, sf_dir).select(
        "doc_id", F.size(ids).cast("bigint").alias("n_tokens"), digest(ids).alias("digest")
    )


def q_bpe_roundtrip(spark, sf_dir):
    return audit.roundtrip_audit(documents(spark, sf_dir), trained_model(spark, sf_dir), "lang")


def q_compression(spark, sf_dir):
    return audit.compression(documents(spark, sf_dir), trained_model(spark, sf_dir), "lang")


def q_token_offsets(spark, sf_dir):
    marked = byte_tokens(spark, sf_dir).select(
        "doc_id", "split", packing.add_boundaries(F.col("ids"), None, EOS_ID).alias("ids")
    )
    return packing.token_offsets(marked, key="doc_id").select("split", "doc_id", "start", "n")


def q_pack_shards(spark, sf_dir):
    return shards(spark, sf_dir).select("split", "shard_idx", "filename", "num_tokens", digest(F.col("tokens")).alias("digest"))


def q_manifest(spark, sf_dir):
    return packing.manifest(shards(spark, sf_dir), BYTE_VOCAB, SHARD_SIZE)


def q_examples(spark, sf_dir):
    ex = example_rows(spark, sf_dir)
    return ex.select("split", "shard_idx", "example_idx", digest(F.col("x")).alias("x_digest"), digest(F.col("y")).alias("y_digest"))


def q_first_batch(spark, sf_dir):
    first = examples.first_train_shard(shards(spark, sf_dir))
    ex = examples.cut_examples(first, CONTEXT)
    b = examples.batches(ex, BATCH)
    return b.select(
        "split",
        "shard_idx",
        "batch_id",
        F.size("x").alias("n_rows"),
        digest(F.flatten("x")).alias("x_digest"),
        digest(F.flatten("y")).alias("y_digest"),
    )


def q_token_id_audit(spark, sf_dir):
    # bounds that the data do break: ids from AUDIT_VOCAB on, and shards' last examples padded by none
    short = example_rows(spark, sf_dir).withColumn("x", F.expr(f"filter(x, i -> i <> {SPACE_ID})"))
    return examples.example_audit(short, ["x", "y"], AUDIT_VOCAB, AUDIT_CONTEXT, "split")


def q_example_at(spark, sf_dir):
    """X3 by a negative index: the last example of the first train shard."""
    one = examples.example_at(shards(spark, sf_dir), "train", 0, -1, CONTEXT)
    return one.select("split", "shard_idx", "example_idx", digest(F.col("x")).alias("x_digest"), digest(F.col("y")).alias("y_digest"))


def q_shard_files(spark, sf_dir):
    """Shards written as binary files with a manifest, read back by the manifest's width."""
    out = f"{checkpoint_dir(spark)}/shard-files-{uuid.uuid4().hex}"
    packed = shards(spark, sf_dir)
    info = shard_files.write_shards(packed, out, packing.dtype_for_vocab(BYTE_VOCAB))
    info.write.format("noop").mode("overwrite").save()
    shard_files.write_manifest(packing.manifest(packed, BYTE_VOCAB, SHARD_SIZE), out)
    named = shard_files.manifest_shards(spark, out).select("split", "shard_idx", "filename")
    read = shard_files.read_shards(spark, out, shard_files.load_manifest(out)["dtype"])
    short = read.select("split", "shard_idx", "filename", F.size("tokens").cast("bigint").alias("num_tokens"), digest(F.col("tokens")).alias("digest"))
    return named.join(short, ["split", "shard_idx", "filename"]).select("split", "shard_idx", "filename", "num_tokens", "digest")


def packed_files(spark: SparkSession, sf_dir: str) -> str:
    """A folder of the packed corpus's shard files, written anew."""
    out = f"{checkpoint_dir(spark)}/example-files-{uuid.uuid4().hex}"
    shard_files.write_shards(shards(spark, sf_dir), out, packing.dtype_for_vocab(BYTE_VOCAB)).write.format("noop").mode("overwrite").save()
    return out


def q_file_examples(spark, sf_dir):
    """X1 over shard files by byte ranges: every example of every file."""
    ex = ranges.read_examples(spark, packed_files(spark, sf_dir), packing.dtype_for_vocab(BYTE_VOCAB), CONTEXT, tokens_per_read=READ_TOKENS)
    return ex.select("split", "shard_idx", "example_idx", digest(F.col("x")).alias("x_digest"), digest(F.col("y")).alias("y_digest"))


def q_file_example_at(spark, sf_dir):
    """X3 over shard files: the first and the last example of every shard, each by its own bytes."""
    ends = F.explode(F.array(F.lit(0), F.lit(-1))).alias("index")
    asked = shards(spark, sf_dir).select("split", "shard_idx", ends)
    one = ranges.examples_at(asked, packed_files(spark, sf_dir), packing.dtype_for_vocab(BYTE_VOCAB), CONTEXT)
    return one.select("split", "shard_idx", "example_idx", digest(F.col("x")).alias("x_digest"), digest(F.col("y")).alias("y_digest"))


def q_file_job(spark, sf_dir):
    """A folder of Parquet files -> tokenizer, shard files and manifest -> the shards that the manifest names."""
    home = f"{checkpoint_dir(spark)}/file-job-{uuid.uuid4().hex}"
    docs = documents(spark, sf_dir).where("text IS NOT NULL").select("doc_id", "text", F.col("lang").alias("src"))
    docs.repartition("src").sortWithinPartitions("src", "doc_id").write.partitionBy("src").parquet(f"{home}/in")
    pack_folder(spark, f"{home}/in", f"{home}/out", TRAIN_MERGES, SPECIALS, SHARD_SIZE, eos=SPECIALS[1])
    return packed_shards(spark, f"{home}/out")


def q_perplexity(spark, sf_dir):
    """E3 over all splits together."""
    sums = evaluation.bigram_nll(example_rows(spark, sf_dir), BYTE_VOCAB, ALPHA).withColumn("corpus", F.lit("all"))
    return evaluation.perplexity(sums, "corpus").select("corpus", "n_tokens", F.round("ppl", 6).alias("ppl"))


def q_bigram_table(spark, sf_dir):
    return evaluation.bigram_table(example_rows(spark, sf_dir), group=None)


def q_bigram_xent(spark, sf_dir):
    res = evaluation.bigram_xent(example_rows(spark, sf_dir), BYTE_VOCAB, ALPHA)
    return res.select("split", "n_tokens", F.round("nll", 6).alias("nll"), F.round("ppl", 6).alias("ppl"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "corpus_scan": q_corpus_scan,
    "normalize_v0": q_normalize_v0,
    "dedup_exact": q_dedup_exact,
    "dedup_lines": q_dedup_lines,
    "dedup_lines_docs": q_dedup_lines_docs,
    "file_corpus": q_file_corpus,
    "corpus_order": q_corpus_order,
    "split_assign": q_split_assign,
    "special_split": q_special_split,
    "pair_counts": q_pair_counts,
    "bpe_train": q_bpe_train,
    "bpe_train_long": q_bpe_train_long,
    "bpe_encode_long": q_bpe_encode_long,
    "bpe_decode_long": q_bpe_decode_long,
    "bpe_vocab": q_bpe_vocab,
    "bpe_encode": q_bpe_encode,
    "bpe_roundtrip": q_bpe_roundtrip,
    "compression": q_compression,
    "token_offsets": q_token_offsets,
    "pack_shards": q_pack_shards,
    "manifest": q_manifest,
    "shard_files": q_shard_files,
    "file_job": q_file_job,
    "examples": q_examples,
    "example_at": q_example_at,
    "file_examples": q_file_examples,
    "file_example_at": q_file_example_at,
    "first_batch": q_first_batch,
    "token_id_audit": q_token_id_audit,
    "bigram_table": q_bigram_table,
    "bigram_xent": q_bigram_xent,
    "perplexity": q_perplexity,
}
