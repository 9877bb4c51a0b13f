"""Operator 12: fill-in-middle transformation by one repeated-capture match.

A text is a run of units (a run of ASCII letters, or one other character).  One ``fullmatch`` of
``(unit)*`` by the ``regex`` library, which keeps every repetition of a group, covers the whole
text; ``match.ends(1)`` holds the end of each unit, so its length is the number n of units and two of
its entries are the cut offsets: nothing loops over units.  The hash of the document's id draws both
cuts and the form:

    plain   the text (drawn, or the text is empty or holds one of the marks)
    psm     <P> prefix <S> suffix <M> middle
    spm     <S> suffix <P> prefix <M> middle

A mark cannot arise at a seam: each starts with ``<``, ends with ``>`` and holds neither inside, so
cutting the output at its marks gives the three parts back (``restored``).

The work is row by row: no shuffle, and a lost task is simply run again.  A task holds a few MB of
text at a time and, for the text in hand, about 50 bytes a unit.

Defined cases: a null text is an empty one; a null id draws as an empty id; repeated rows
and ids each get their own row, equal ids the same draw; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shardwright.llm.chunks import text_slices
from shardwright.llm.common import spread, text_bytes

UNITS = regex.compile(r"([A-Za-z]++|[^A-Za-z])*+")
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SCHEMA = "n long, form string, prefix_chars long, middle_chars long, output string"


def draws(doc_id: object, salt: str = "1:") -> tuple[int, int, int, int]:
    """Four 32-bit numbers from the id: the first groups of eight digits of a hex sha256."""
    h = hashlib.sha256(f"{salt}{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return int(h[:8], 16), int(h[8:16], 16), int(h[16:24], 16), int(h[24:32], 16)


def transform(text: str, numbers: tuple[int, int, int, int], cut_percent: int = 90, spm_percent: int = 20) -> tuple[int, str, int | None, int | None, str]:
    """n, form, prefix_chars, middle_chars, output of one text."""
    ends = UNITS.fullmatch(text).ends(1)
    n = len(ends)
    h1, h2, h3, h4 = numbers
    if not text or h3 % 100 >= cut_percent or PREFIX in text or SUFFIX in text or MIDDLE in text:
        return n, "plain", None, None, text
    x, y = h1 % (n + 1), h2 % (n + 1)
    if x > y:
        x, y = y, x
    a, b = ends[x - 1] if x else 0, ends[y - 1] if y else 0
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm_percent:
        return n, "spm", a, b - a, "".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle))
    return n, "psm", a, b - a, "".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle))


def fill_in_middle(docs: DataFrame, salt: str = "1:", cut_percent: int = 90, spm_percent: int = 20) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output of every document."""
    rows = spread(docs.select("doc_id", text_bytes().alias("text")))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_slices(batch, 1):
                ids = part.column(0)
                out = [transform(t, draws(i, salt), cut_percent, spm_percent) for i, t in zip(ids.to_pylist(), texts.to_pylist())]
                n, form, prefix, middle, output = zip(*out)
                columns = [pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.string())]
                yield pa.RecordBatch.from_arrays([ids, *columns], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return rows.mapInArrow(work, f"doc_id {kind}, {SCHEMA}")


def restored(output: Column, form: Column) -> Column:
    """The text, rebuilt from a transformed one and its form."""
    part = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    psm = F.concat(F.get(part, 1), F.get(part, 3), F.get(part, 2))
    spm = F.concat(F.get(part, 2), F.get(part, 3), F.get(part, 1))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
