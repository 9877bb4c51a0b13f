"""Operator 4: token ids in word-aligned Simple-8b files.

A 64-bit word is a selector (top 4 bits) and 60 bits of ids, the first id lowest:

    selector  0 (escape)  1   2   3   4   5   6   7  8  9  10 11 12 13 14
    ids       1           60  30  20  15  12  10  8  7  6  5  4  3  2  1
    bits      64          1   2   3   4   5   6   7  8  10 12 15 20 30 60

(selector 0: the id is the whole next word).  A word takes the most ids that fit.  A file is a
folder of Parquet rows, one per block of whole documents (about ``block_ids`` ids); Spark's own
writer commits them, so any store works and a lost task leaves nothing behind.  Each block has

    file_no, block_no, ids_before   its place, and the ids of this file that precede it
    doc_ids, doc_tokens             little-endian int64 / uint32, one per document
    frames                          little-endian uint32 pairs (word, id) every ``FRAME`` words
    words                           the little-endian uint64 words

Files hold ranges of doc_id in ascending order, blocks of a file too.  Decoding is vectorised by
selector; a frame's offsets let a reader decode any part of a block without the words before it.

Defined cases: a null or empty text is one end id; null doc_ids come first; rows of one doc_id
follow each other in the order of their ids' bytes; an empty table writes no block and gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shardwright.llm.chunks import ChunkCoder, Codes, text_slices
from shardwright.llm.common import new_folder, spread, text_bytes

#: Fixed values of the format: (ids in a word, bits of each) of selectors 1..14.
LAYOUT = ((60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
COUNT = np.array([1] + [c for c, _ in LAYOUT] + [0])
FRAME = 128
BLOCK = "file_no int, block_no int, ids_before long, n_ids long, doc_ids binary, doc_tokens binary, frames binary, words binary"


def pack(ids: np.ndarray) -> np.ndarray:
    """Simple-8b words (uint64) of non-negative ids."""
    v = np.asarray(ids)
    v = v if v.dtype.kind == "u" else v.astype(np.uint64)
    n = len(v)
    if not n:
        return np.zeros(0, np.uint64)
    pick = np.zeros(n, np.int8)  # the selector of a word that begins here
    top, start = int(v.max()), None
    for s in range(len(LAYOUT), 0, -1):  # wider first: of the places that one fits, those that the next fits too
        c, bits = LAYOUT[s - 1]
        if c > n:
            break
        if top >> bits == 0:
            pick[: n - c + 1] = s
            continue
        over = np.zeros(n + 1, np.int32)
        np.cumsum(v >= v.dtype.type(1 << bits), out=over[1:])
        if start is None:
            start = np.flatnonzero(over[c:] == over[: n - c + 1])
        else:
            start = start[: np.searchsorted(start, n - c, "right")]
            start = start[over[start + c] == over[start]]
        if not len(start):
            break
        pick[start] = s
    v = v.astype(np.uint64)
    step, i, at = COUNT[pick].tolist(), 0, []
    put = at.append
    while i < n:
        put(i)
        i += step[i]
    at = np.array(at)
    chosen = pick[at]
    wide = chosen == 0
    place = np.arange(len(at)) + np.cumsum(wide) - wide  # an escape takes two words
    out = np.zeros(len(at) + int(wide.sum()), np.uint64)
    for s in np.unique(chosen).tolist():
        which = chosen == s
        if s == 0:
            out[place[which] + 1] = v[at[which]]
            continue
        c, bits = LAYOUT[s - 1]
        word = np.full(int(which.sum()), s << 60, np.uint64)
        for j in range(c):
            word |= v[at[which] + j] << np.uint64(j * bits)
        out[place[which]] = word
    return out


def unpack(words: np.ndarray) -> np.ndarray:
    """Ids (uint64) of Simple-8b words."""
    w = np.ascontiguousarray(words, np.uint64)
    sel = (w >> np.uint64(60)).astype(np.int8)
    if (sel == 0).any():  # the word after an escape is an id: walk over them, they are few
        raw, skip = np.zeros(len(w), bool), -1
        for i in np.flatnonzero(sel == 0).tolist():
            if i != skip:
                skip = i + 1
                if skip >= len(w):
                    raise ValueError("an escape without its id")
                raw[skip] = True
        sel = np.where(raw, -1, sel)
    if (sel == 15).any():
        raise ValueError("unknown selector 15")
    counts = np.where(sel < 0, 0, COUNT[sel])
    first = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), np.uint64)
    for s in np.unique(sel).tolist():
        which = np.flatnonzero(sel == s)
        if s == 0:
            out[first[which]] = w[which + 1]
        elif s > 0:
            c, bits = LAYOUT[s - 1]
            mask = np.uint64((1 << bits) - 1)
            for j in range(c):
                out[first[which] + j] = (w[which] >> np.uint64(j * bits)) & mask
    return out


def frames_of(words: np.ndarray) -> np.ndarray:
    """(word, id) offsets where a decoder may start: every FRAME words, never inside an escape."""
    sel = (words >> np.uint64(60)).astype(np.int8)
    raw = np.zeros(len(words), bool)
    if (sel == 0).any():
        skip = -1
        for i in np.flatnonzero(sel == 0).tolist():
            if i != skip:
                skip = i + 1
                raw[skip] = True
    counts = np.where(raw, 0, COUNT[sel])
    first = np.cumsum(counts) - counts
    at = np.arange(0, len(words), FRAME)
    at = at + raw[at]
    at = at[at < len(words)]
    return np.stack([at, first[at]], 1).astype("<u4")


# ---------------------------------------------------------------- documents to ids


def added_tokens(path: str) -> dict[int, bytes]:
    """Added tokens of a tokenizer file: bytes by id."""
    from tokenizers import Tokenizer

    added = Tokenizer.from_file(path).get_added_tokens_decoder()
    # texts are cut at spaces: an added token that takes white space in could reach across a cut
    if any(a.lstrip or a.rstrip or a.single_word or a.normalized or any(map(str.isspace, a.content)) for a in added.values()):
        raise ValueError("added tokens that depend on what stands around them")
    return {i: a.content.encode() for i, a in added.items()}


@lru_cache(4)
def coder_of(path: str, specials: bool = False) -> ChunkCoder:
    """``specials``: added tokens' strings in a text get their ids, as the library does by default."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = not specials  # True: their strings in a text are ordinary text

    size = np.zeros(t.get_vocab_size(), np.int64)  # bytes of each token: a character stands for a byte
    for token, i in t.get_vocab().items():
        size[i] = len(token)
    if specials:
        for i, token in added_tokens(path).items():
            size[i] = len(token)

    def apart(chunks: list[str]) -> Codes:
        out = [np.array(e.ids, np.int32) for i in range(0, len(chunks), 2048) for e in t.encode_batch_fast(chunks[i : i + 2048], add_special_tokens=False)]
        return np.concatenate(out) if out else np.zeros(0, np.int32), np.fromiter(map(len, out), np.int64, len(out))

    def together(chunks: list[str]) -> Codes:
        """Chunks that begin with their space, as one text a few hundred; cut where their bytes end."""
        ids, n = [], []
        for i in range(0, len(chunks), 256):
            part = chunks[i : i + 256]
            text = "".join(part)
            got = np.array(t.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int32)
            ends = np.cumsum(size[got])
            want = np.cumsum(list(map(len, part if text.isascii() else map(str.encode, part))))
            at = np.searchsorted(ends, want)
            if at[-1] >= len(ends) or (ends[at] != want).any():  # a token across two chunks: never, by the pattern
                got, m = apart(part)
            else:
                m = np.diff(at + 1, prepend=0)
            ids.append(got)
            n.append(m)
        return np.concatenate(ids) if ids else np.zeros(0, np.int32), np.concatenate(n) if n else np.zeros(0, np.int64)

    def encode_many(chunks: list[str]) -> Codes:
        bare = list(map(str.strip, chunks))
        if all(bare) and chunks == list(map(" ".__add__, bare)):  # a space, and a word without white space at its ends
            return together(chunks)
        return apart(chunks)

    return ChunkCoder(encode_many)


def id_width(path: str, end_id: int) -> str:
    """Type of an id on the way to the files, by the largest id there is."""
    from tokenizers import Tokenizer

    return "<u2" if max(Tokenizer.from_file(path).get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"


def _with_end(ids: np.ndarray, n: np.ndarray, end_id: int, width: str) -> pa.Array:
    """One binary per document: its ids and the end id."""
    ends = np.cumsum(n + 1)
    out = np.full(int(ends[-1]), end_id, width)
    keep = np.ones(len(out), bool)
    keep[ends - 1] = False
    out[keep] = ids
    offsets = np.concatenate([[0], ends * out.itemsize]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offsets), pa.py_buffer(out)])


def token_ids(docs: DataFrame, path: str, end_id: int, edges: np.ndarray | None = None, specials: bool = False) -> DataFrame:
    """doc_id, file_no, ids (binary: little-endian, the end id last; two bytes each if all ids of the vocabulary fit).  ``edges``: the last doc_id of
    every file but the last; a null doc_id belongs to file 0."""
    edges, width = np.zeros(0, np.int64) if edges is None else edges, id_width(path, end_id)
    rows = spread(docs.select(F.col("doc_id").cast("bigint"), text_bytes().alias("text")), "doc_id")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_of(path, specials)
        for b in batches:
            for part, texts in text_slices(b, 1):
                keys = part.column(0).fill_null(-(2**63)).to_numpy(zero_copy_only=False)
                file_no = pa.array(np.searchsorted(edges, keys, "left").astype(np.int32))
                ids, n = coder.code(texts)
                yield pa.RecordBatch.from_arrays([part.column(0), file_no, _with_end(ids, n, end_id, width)], names=["doc_id", "file_no", "ids"])

    return rows.mapInArrow(work, "doc_id long, file_no int, ids binary")


# ---------------------------------------------------------------- files


def _block(file_no: int, block_no: int, before: int, keys: list, parts: list[np.ndarray]) -> dict:
    words = pack(np.concatenate(parts))
    return {
        "file_no": file_no, "block_no": block_no, "ids_before": before, "n_ids": sum(map(len, parts)),
        "doc_ids": np.array([-(2**63) if k is None else k for k in keys], "<i8").tobytes(),
        "doc_tokens": np.array(list(map(len, parts)), "<u4").tobytes(),
        "frames": frames_of(words).tobytes(), "words": words.astype("<u8").tobytes(),
    }


def file_edges(docs: DataFrame, docs_per_file: int = 8192) -> np.ndarray:
    """Quantiles of doc_id that bound the files, from a scan of that one column."""
    n_files = max(1, -(-docs.count() // docs_per_file))
    q = [i / n_files for i in range(1, n_files)]
    got = docs.agg(F.percentile_approx(F.col("doc_id").cast("bigint"), q, max(10_000, 20 * n_files)).alias("q")).collect()[0]["q"] if q else []
    return np.array(sorted(set(got or [])), np.int64)


def write_files(ids: DataFrame, n_files: int, out: str, width: str, block_ids: int = 1 << 16) -> None:
    """ids(doc_id, file_no, ids of type ``width``) as Simple-8b files below ``out``, in ascending order of doc_id."""
    ordered = ids.repartition(n_files, "file_no").sortWithinPartitions("file_no", F.col("doc_id").asc_nulls_first(), "ids")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("file_no", pa.int32()), ("block_no", pa.int32()), ("ids_before", pa.int64()), ("n_ids", pa.int64()), *[(x, pa.binary()) for x in ("doc_ids", "doc_tokens", "frames", "words")]])
        now, block, before, held = None, 0, 0, 0
        keys: list = []
        parts: list[np.ndarray] = []

        def flush():
            nonlocal block, before, held, keys, parts
            row = _block(now, block, before, keys, parts)
            block, before, held, keys, parts = block + 1, before + held, 0, [], []
            return pa.RecordBatch.from_pylist([row], schema=schema)

        for b in batches:
            for key, raw, f in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(1).to_pylist()):
                if keys and (f != now or held >= block_ids):
                    yield flush()
                if f != now:
                    now, block, before = f, 0, 0
                keys.append(key)
                parts.append(np.frombuffer(raw, width))
                held += len(parts[-1])
        if keys:
            yield flush()

    ordered.mapInArrow(encode, BLOCK).write.option("compression", "zstd").parquet(out)


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BLOCK).parquet(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (binary, little-endian uint32),
    decoded from the files alone.  Only a sum per file is made first, from two small columns."""
    blocks = read_blocks(spark, path)
    files = blocks.groupBy("file_no").agg(F.sum("n_ids").alias("n"))
    over = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    starts = files.select("file_no", F.coalesce(F.sum("n").over(over), F.lit(0)).alias("file_start"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                ids = unpack(np.frombuffer(row["words"], "<u8")).astype("<u4")
                keys, n = np.frombuffer(row["doc_ids"], "<i8"), np.frombuffer(row["doc_tokens"], "<u4").astype(np.int64)
                ends = np.cumsum(n)
                if ends[-1] != len(ids):
                    raise ValueError(f"block {row['block_no']} of file {row['file_no']} is damaged")
                first = ends - n
                offsets = np.concatenate([[0], ends * 4]).astype(np.int32)
                each = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offsets), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, mask=keys == -(2**63)), pa.array(np.full(len(n), row["file_no"], np.int32)), pa.array(first + row["ids_before"]), pa.array(n), each],
                    names=["doc_id", "file_no", "in_file", "n_tokens", "ids"],
                )

    rows = blocks.mapInArrow(decode, "doc_id long, file_no int, in_file long, n_tokens long, ids binary")
    # one row a file: its size is bounded by the number of files
    return rows.join(F.broadcast(starts), "file_no").select("doc_id", (F.col("file_start") + F.col("in_file")).alias("start"), "n_tokens", "ids")


def encoded_files(docs: DataFrame, path: str, end_id: int = 2, specials: bool = False) -> str:
    """Encode docs(doc_id, text) and write the files in the shared folder; returns their place."""
    out = new_folder(docs.sparkSession, "simple8b")
    edges = file_edges(docs)
    write_files(token_ids(docs, path, end_id, edges, specials), len(edges) + 1, out, id_width(path, end_id))
    return out
