"""Operator 8: token counts of sections, attributed by offsets.

Every document is encoded once, whole.  A token's bytes are known from the vocabulary, so the
running sum of their lengths gives its span; the spans, as code points, are joined with the
sections' spans by binary search.  A token inside one section counts there.  One that crosses
boundaries is allocated by ``rule``:

    most    the section that holds most of its characters, the earliest of equals
    first   the section in which it begins (or the first it reaches)
    last    the section in which it ends (or the last it reaches)

A token of which a character is only a part (byte-level tokens may split one) covers that
character.  Tokens outside all sections count for section -1.  The sections' counts of a
document add up to its tokens.

Sections are sorted spans that don't overlap: the lines of the text with their ``\\n`` (default), or
a column ``sections`` array<struct<start int, end int>> of code point offsets.

Defined cases: a null or empty text has one empty line without tokens; null or empty ``sections``:
all tokens in -1; ids may be null or repeat (rows are attributed one by one); an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardwright.llm.chunks import text_slices
from shardwright.llm.common import spread, text_bytes
from shardwright.llm.simple8b import added_tokens, coder_of

RULES = ("most", "first", "last")


@lru_cache(2)
def token_bytes(path: str) -> np.ndarray:
    """Bytes of each token id of a byte-level vocabulary in tiktoken form (same ids)."""
    with open(path, "rb") as f:
        rank = {int(b): len(base64.b64decode(a)) for a, b in map(bytes.split, f)}
    out = np.zeros(max(rank) + 1, np.int64)
    out[list(rank)] = list(rank.values())
    return out


def token_spans(text: bytes, ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code point spans (start, end) of the tokens of a text."""
    end = np.cumsum(lengths[ids])
    if (end[-1] if len(end) else 0) != len(text):
        raise ValueError("tokens and text differ in length")
    char = np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80) - 1  # the code point that each byte belongs to
    start = end - lengths[ids]
    return char[start], char[end - 1] + 1


def allocate(start: np.ndarray, end: np.ndarray, left: np.ndarray, right: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Section of each token (-1: none) and whether it crosses a section's boundary.
    left, right: the sections' sorted spans; empty ones get no token."""
    some = np.flatnonzero(right > left)
    if not len(some) or not len(start):
        return np.full(len(start), -1), np.zeros(len(start), bool)
    l, r = left[some], right[some]
    first = np.searchsorted(r, start, "right")  # the first section that ends after the token's start
    last = np.searchsorted(l, end, "left") - 1  # the last that begins before its end
    none = first > last
    f, t = np.minimum(first, len(some) - 1), np.maximum(last, 0)
    crosses = ~none & ((first != last) | (start < l[f]) | (end > r[t]))
    if rule == "first":
        at = first.copy()
    elif rule == "last":
        at = last.copy()
    else:
        at = first.copy()
        for i in np.flatnonzero(first < last).tolist():
            k = np.arange(first[i], last[i] + 1)
            at[i] = first[i] + int(np.argmax(np.minimum(r[k], end[i]) - np.maximum(l[k], start[i])))
    return np.where(none, -1, some[np.clip(at, 0, len(some) - 1)]), crosses


def line_spans(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(text, np.uint8)
    starts_char = (raw & 0xC0) != 0x80
    cut = np.cumsum(starts_char)[raw == 10]
    n = int(starts_char.sum())
    return np.concatenate([[0], cut]).astype(np.int64), np.concatenate([cut, [n]]).astype(np.int64)


def section_tokens(docs: DataFrame, tokenizer: str, vocabulary: str, rule: str = "most", key: str = "doc_id", sections: str | None = None, specials: bool = False) -> DataFrame:
    """key, section_no, char_start, char_end, n_tokens, n_crossing (of them, tokens that cross a
    boundary), a row per section of every row of docs; -1 only where it has tokens.  ``specials``: see ``coder_of``."""
    if rule not in RULES:
        raise ValueError(f"rule: one of {RULES}")
    cols = [F.col(key), text_bytes().alias("text")] + ([F.col(sections).alias("sections")] if sections else [])
    rows = spread(docs.select(*cols), key)
    kind = dict(rows.dtypes)[key]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, lengths = coder_of(tokenizer, specials), token_bytes(vocabulary)
        if specials:
            added = added_tokens(tokenizer)
            lengths = np.concatenate([lengths, np.zeros(max([len(lengths), *(i + 1 for i in added)]) - len(lengths), np.int64)])
            for i, token in added.items():
                lengths[i] = len(token)
        for b in batches:
            for part, texts in text_slices(b, 1):
                given = part.column(2).to_pylist() if sections else [None] * len(texts)
                row, out = [], [[], [], [], [], []]
                ids, counts = coder.code(texts)
                for i, (raw, code, spans) in enumerate(zip(texts.cast(pa.binary()).to_pylist(), np.split(ids, np.cumsum(counts)[:-1]), given)):
                    start, end = token_spans(raw, code, lengths)
                    if sections:
                        spans = [s for s in spans or [] if s and s["start"] is not None and s["end"] is not None]
                        left, right = (np.array([s[x] for s in spans], np.int64) for x in ("start", "end"))
                    else:
                        left, right = line_spans(raw)
                    at, crosses = allocate(start, end, left, right, rule)
                    n = np.bincount(at + 1, minlength=len(left) + 1)
                    c = np.bincount(at[crosses] + 1, minlength=len(left) + 1)
                    skip = 0 if n[0] else 1
                    no = np.arange(-1, len(left))[skip:]
                    lo, hi = np.concatenate([[-1], left])[skip:], np.concatenate([[-1], right])[skip:]
                    row.append(np.full(len(no), i))
                    for have, x in zip(out, (no, lo, hi, n[skip:], c[skip:])):
                        have.append(x)
                if row:
                    which = pa.array(np.concatenate(row))
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(which), *(pa.array(np.concatenate(x).astype(np.int64)) for x in out)],
                        names=[key, "section_no", "char_start", "char_end", "n_tokens", "n_crossing"],
                    )

    return rows.mapInArrow(work, f"`{key}` {kind}, section_no long, char_start long, char_end long, n_tokens long, n_crossing long")
