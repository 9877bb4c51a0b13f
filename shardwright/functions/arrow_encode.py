"""T8 and T9, Arrow paths: merges applied in slices of Arrow batches, ids decoded by a gather.

For merge lists too long for one JVM expression.  The merge list (bounded by the vocabulary) is
captured once per task.  A chunk is cut where no merge can join two neighbours, and each distinct
piece is merged once, lowest rank first, with a linked list and a heap (``functions.symbols``): the
work per chunk does not grow with the model.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from shardwright.functions.codepoints import SURROGATE_SHIFT, tok
from shardwright.functions.symbols import Merger, codes_of

IDS_PER_SLICE = 1 << 20  # that are decoded before their texts are given on
CHARS_PER_SLICE = 1 << 20  # of texts that are encoded before their ids are given on


def encode_partitions(model, text_at: int, out_col: str, allow_specials: bool = True):
    merges = [(tok(a), tok(b), tok(model.first_merge_id + r)) for r, (a, b) in enumerate(model.merges)]
    specials = list(model.specials) if allow_specials else []
    ids = model.special_ids
    pattern = re.compile("|".join(re.escape(s) for s in sorted(specials, key=len, reverse=True))) if specials else None

    def run(batches):
        merger = Merger(merges)

        def chunk_ids(chunk: str) -> np.ndarray:
            if not merges:
                return np.frombuffer(chunk.encode("utf-8"), np.uint8).astype(np.int32)
            cps = codes_of(merger.merge(chunk.encode("utf-8").decode("latin-1")))
            cps[cps > 0xDFFF] -= SURROGATE_SHIFT
            return cps.astype(np.int32)

        def encode_one(text):
            if text is None:
                return None
            if pattern is None:
                return chunk_ids(text) if text else np.zeros(0, np.int32)
            out, pos = [], 0
            for m in pattern.finditer(text):
                if m.start() > pos:
                    out.append(chunk_ids(text[pos : m.start()]))
                out.append(np.array([ids[m.group(0)]], np.int32))
                pos = m.end()
            if pos < len(text):
                out.append(chunk_ids(text[pos:]))
            return np.concatenate(out) if out else np.zeros(0, np.int32)

        for b in batches:
            for part in slices_of(b, text_at):
                coded = [encode_one(t) for t in part.column(text_at).to_pylist()]
                edges = np.concatenate([[0], np.cumsum([0 if c is None else len(c) for c in coded])]).astype(np.int32)
                values = np.concatenate([np.zeros(0, np.int32), *(c for c in coded if c is not None)])
                nulls = pa.array([c is None for c in coded])
                lists = pa.ListArray.from_arrays(pa.array(edges), pa.array(values), mask=nulls)
                yield pa.RecordBatch.from_arrays([*part.columns, lists], names=[*part.schema.names, out_col])

    return run


def slices_of(batch: pa.RecordBatch, text_at: int):
    """The batch in runs of rows whose texts hold about CHARS_PER_SLICE bytes, one row at least: what Python
    makes of a run is then bounded, whatever the batch."""
    size = pc.fill_null(pc.binary_length(batch.column(text_at)), 0).to_numpy(zero_copy_only=False)
    run = np.cumsum(size, dtype=np.int64) // CHARS_PER_SLICE
    cuts = np.flatnonzero(np.diff(run)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
        if b > a:
            yield batch.slice(a, b - a)


def decode_partitions(model, ids_at: int, out_col: str):
    """Each row's bytes are gathered from one flat table of the vocabulary's bytes."""
    vocab = model.vocab_bytes()

    def run(batches):
        flat = np.frombuffer(b"".join(vocab), np.uint8)
        size = np.array([len(v) for v in vocab], np.int64)
        start = np.cumsum(size) - size

        def text(ids: np.ndarray) -> str:
            bad = (ids < 0) | (ids >= len(size))
            if bad.any():
                raise ValueError(f"no bytes for token id {ids[bad][0]}")
            n = size[ids]
            ends = np.cumsum(n)
            at = np.repeat(start[ids] - (ends - n), n) + np.arange(int(n.sum()))
            return flat[at].tobytes().decode("utf-8", "replace")

        for b in batches:
            lists = b.column(ids_at)
            values, edges = lists.values, lists.offsets.to_numpy()
            if values.null_count:
                raise ValueError("no bytes for token id null")
            values = values.to_numpy()
            cuts = (np.flatnonzero(np.diff((edges[1:] - edges[0]) // IDS_PER_SLICE)) + 1).tolist()
            for x, y in zip([0, *cuts], [*cuts, b.num_rows]):
                if y > x:
                    texts = [text(values[edges[i] : edges[i + 1]]) for i in range(x, y)]
                    part = b.slice(x, y - x)
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*b.schema.names, out_col])

    return run
