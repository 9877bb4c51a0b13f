"""Special tokens.

A special token is a literal string with a reserved id: ``256 + position`` in the
declared list.  Splitting takes the leftmost occurrence; when several specials
start there, the longest wins.  Java regex alternation tries alternatives left to
right, so ordering the alternation longest-first gives exactly that rule.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from shardwright.functions.codepoints import hexq

SEGMENT_TYPE = "array<struct<is_special:boolean,chunk:string>>"


def special_ids(specials: Sequence[str]) -> dict[str, int]:
    """Reserved ids in declaration order; names must be unique and non-empty."""
    specials = list(specials)
    if len(set(specials)) != len(specials):
        raise ValueError("a special token is declared twice")
    if any(s == "" for s in specials):
        raise ValueError("an empty special token would match everywhere")
    return {s: 256 + i for i, s in enumerate(specials)}


def special_id(specials: Sequence[str], name: str) -> int:
    """Id of one special token by name (boundary markers); unknown name -> error."""
    ids = special_ids(specials)
    if name not in ids:
        raise ValueError(f"no special token {name!r} among {sorted(ids)}")
    return ids[name]


def special_pattern(specials: Sequence[str]) -> str:
    """Regex alternation of the specials, longest first (stable for equal lengths)."""
    ordered = sorted(specials, key=len, reverse=True)
    return "|".join(hexq(s) for s in ordered)


def split_special(text: Column, specials: Sequence[str]) -> Column:
    """``text`` -> ordered segments ``array<struct<is_special, chunk>>``.

    Plain chunks are non-empty; with no specials configured the whole text is one
    plain segment, even when empty.
    """
    special_ids(specials)  # validation
    if not specials:
        return F.array(F.struct(F.lit(False).alias("is_special"), text.alias("chunk")))
    pat = special_pattern(specials)
    pieces = F.split(text, pat, -1)
    hits = F.regexp_extract_all(text, F.lit(pat), F.lit(0))
    segs = F.flatten(
        F.transform(
            pieces,
            lambda p, i: F.when(
                i < F.size(hits),
                F.array(
                    F.struct(F.lit(False).alias("is_special"), p.alias("chunk")),
                    F.struct(F.lit(True).alias("is_special"), F.element_at(hits, i + 1).alias("chunk")),
                ),
            ).otherwise(F.array(F.struct(F.lit(False).alias("is_special"), p.alias("chunk")))),
        )
    )
    segmented = F.filter(segs, lambda s: s["is_special"] | (s["chunk"] != F.lit("")))
    # one regex scan decides; texts without any special skip the split + extract
    plain = F.when(text == F.lit(""), F.array().cast(SEGMENT_TYPE)).otherwise(
        F.array(F.struct(F.lit(False).alias("is_special"), text.alias("chunk")))
    )
    return F.when(text.rlike(pat), segmented).otherwise(plain)


def special_id_of(name: Column, specials: Sequence[str]) -> Column:
    """Column lookup of a special name -> id; unknown names raise at run time."""
    ids = special_ids(specials)
    if not ids:
        return F.raise_error(F.concat(F.lit("no such special token: "), name)).cast("int")
    m = F.create_map(*[x for k, v in ids.items() for x in (F.lit(k), F.lit(v))])
    looked = F.try_element_at(m, name)
    return F.when(looked.isNull(), F.raise_error(F.concat(F.lit("no such special token: "), name))).otherwise(looked)
