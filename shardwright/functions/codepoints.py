"""Token sequences as strings: one code point per token.

Fixed mapping (must stay stable, it is part of every intermediate):
  code point = id            for id <  0xD800
  code point = id + 0x800    for id >= 0xD800   (skips the UTF-16 surrogate block)

The mapping is monotonic, so comparing two-token strings under Spark's (and
DuckDB's) binary collation orders pairs by (left id, right id).  Spark's
``replace`` is then exactly a greedy, left-to-right, non-overlapping merge.

Every helper returns a ``Column`` built from Spark SQL functions, so the work stays
inside the JVM (no Python per row).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SURROGATE_LO = 0xD800
SURROGATE_SHIFT = 0x800
MAX_VOCAB = 0x110000 - SURROGATE_SHIFT  # 1,112,064 ids fit in the mapping


def id_to_cp(token_id: int) -> int:
    if token_id < 0 or token_id >= MAX_VOCAB:
        raise ValueError(f"token id {token_id} does not fit the code-point mapping")
    return token_id if token_id < SURROGATE_LO else token_id + SURROGATE_SHIFT


def cp_to_id(cp: int) -> int:
    return cp - SURROGATE_SHIFT if cp > 0xDFFF else cp


def tok(token_id: int) -> str:
    """The one-character string of a token id (driver-side literal builder)."""
    return chr(id_to_cp(token_id))


def untok(s: str) -> list[int]:
    return [cp_to_id(ord(c)) for c in s]


def hexq(s: str) -> str:
    """Java-regex literal for ``s``: ``\\x{HEX}`` per code point.

    Safe for any content (``\\E``, metacharacters, supplementary code points),
    unlike ``\\Q..\\E`` quoting.
    """
    return "".join(f"\\x{{{ord(c):X}}}" for c in s)


def byte_string(text: Column) -> Column:
    """UTF-8 bytes of ``text`` as a string whose code point i = byte value (ids 0..255)."""
    return F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")


def ids_of(s: Column) -> Column:
    """ARRAY<INT> of token ids from a token string (``''`` -> empty array)."""
    return F.transform(
        F.filter(F.split(s, ""), lambda c: c != F.lit("")),  # split('', '') is ['']
        lambda c: F.when(F.ascii(c) > F.lit(0xDFFF), F.ascii(c) - F.lit(SURROGATE_SHIFT)).otherwise(F.ascii(c)),
    )


def digest(ids: Column) -> Column:
    """md5 of the comma-joined ids: a short, engine-independent fingerprint of an array."""
    return F.md5(F.array_join(ids, ","))
