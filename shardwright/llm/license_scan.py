"""Operator 13: licence scans by template-markup matching.

A template is licence wording with marked regions:

    <<beginOptional>> ... <<endOptional>>     words that may be left out (regions nest)
    <<var;name=holder;min=0;max=12>>          min to max words of any kind
    <<var;name=verb;match=licensed|released>> one of these wordings

Everything outside of a region is mandatory wording.  Templates and texts are cut into the same words
(A-Z lower-cased; ASCII letters, digits and all characters beyond ASCII belong to words), so
punctuation, case and line breaks do not matter and all else must match exactly.  All templates are
compiled into one automaton over words: optional regions are skips, replaceable ones are counted steps
over any word or alternatives.  Sets of its states are made deterministic as texts ask for them;
there is no loop in a template, so these sets are few and a run ends after the longest template.
A text's places are looked at once; a run starts only at words that begin a template.  Of one template's
matches at a place the longest counts.

Plain phrases (``BASE``) are templates without regions; all their places count.  A text's score is
m / (m + 8), m being the most mandatory words of a template found in it: 0 without a match, 0.2
for a phrase of two words, 0.9 for a whole permission notice.

The work is row by row: no shuffle, and a task holds a few MB of text at a time.

Defined cases: a null or empty text has no words, no labels and score 0; null and repeated ids and
repeated rows each get their own row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shardwright.llm.common import slices, spread, text_bytes

#: Bytes that belong to words stand for themselves (A-Z lower-cased), all others become spaces.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
ANY = None  # an edge that every word takes
EVIDENCE = 8  # a template of so many mandatory words scores 1/2


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


@dataclass(frozen=True)
class Template:
    label: str
    markup: str
    base: bool = False


#: Phrases that count wherever they stand.
BASE = (
    Template("mit", "mit license", base=True),
    Template("apache", "apache license", base=True),
    Template("gpl", "general public license", base=True),
)

#: Notices of common licences, as templates.
NOTICES = (
    Template("mit", "<<var;name=verb;match=licensed|released|distributed|available>> under <<beginOptional>>the terms of<<endOptional>> <<beginOptional>>the<<endOptional>> MIT <<var;name=noun;match=license|licence>>"),
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software <<beginOptional>>and associated documentation files <<beginOptional>>(the \"Software\")<<endOptional>><<endOptional>>, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    Template("apache-2.0", "<<var;name=verb;match=licensed|released|distributed|available>> under <<beginOptional>>the terms of<<endOptional>> the Apache License <<var;name=number;match=version 2 0|version 2|2 0|v2>>"),
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License"),
    Template("gpl-2.0", "licensed under <<beginOptional>>the terms of<<endOptional>> the GNU General Public License <<beginOptional>>as published by the Free Software Foundation<<endOptional>> version 2"),
    Template("gpl-3.0", "licensed under <<beginOptional>>the terms of<<endOptional>> the GNU General Public License <<beginOptional>>as published by the Free Software Foundation<<endOptional>> version 3"),
    Template("gpl-or-later", "<<var;name=program;match=this program|this library|this file|it>> is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation <<beginOptional>>, either version <<var;name=number;match=2|3>> of the License, or (at your option) any later version<<endOptional>>"),
    Template("lgpl", "GNU Lesser General Public License <<beginOptional>><<beginOptional>>as published by the Free Software Foundation<<endOptional>> version <<var;name=number;match=2 1|3>><<endOptional>>"),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    Template("bsd", "<<var;name=verb;match=licensed|released|distributed>> under <<beginOptional>>the terms of<<endOptional>> the <<beginOptional>><<var;name=clauses;match=2|3|two|three|new|modified|simplified>><<endOptional>> <<beginOptional>>clause<<endOptional>> BSD License"),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    Template("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    Template("cc-by-4.0", "licensed under <<beginOptional>>a<<endOptional>> <<var;name=name;match=cc by|creative commons attribution>> 4.0"),
    Template("cc-by-sa-4.0", "licensed under <<beginOptional>>a<<endOptional>> <<var;name=name;match=cc by sa|creative commons attribution sharealike|creative commons attribution share alike>> 4.0"),
    Template("cc-by-nc-4.0", "licensed under <<beginOptional>>a<<endOptional>> <<var;name=name;match=cc by nc|creative commons attribution noncommercial|creative commons attribution non commercial>> 4.0"),
    Template("unlicense", "This is free and unencumbered software released into the public domain"),
    Template("all-rights-reserved", "Copyright <<beginOptional>>c<<endOptional>> <<beginOptional>>by<<endOptional>> <<var;name=holder;min=0;max=12>> all rights reserved"),
)

_MARKS = re.compile(r"<<([^>]*)>>")


def parts_of(markup: str) -> Iterator[tuple[str, object]]:
    """("words", [..]), ("begin", None), ("end", None), ("any", (min, max)), ("match", [[..], ..])."""
    at = 0
    for m in _MARKS.finditer(markup):
        if plain := words_of(markup[at : m.start()].encode()):
            yield "words", plain
        at = m.end()
        kind, *fields = m.group(1).split(";")
        known = dict(f.split("=", 1) for f in fields)
        if kind in ("beginOptional", "endOptional"):
            yield kind.removesuffix("Optional"), None
        elif kind == "var" and "match" in known:
            yield "match", [words_of(w.encode()) for w in known["match"].split("|")]
        elif kind == "var" and "max" in known:
            yield "any", (int(known.get("min", 0)), int(known["max"]))
        else:
            raise ValueError(f"unknown mark <<{m.group(1)}>>")
    if plain := words_of(markup[at:].encode()):
        yield "words", plain


def mandatory_words(markup: str) -> int:
    """Words that every text of the template must have as they are."""
    depth = total = 0
    for kind, value in parts_of(markup):
        depth += (kind == "begin") - (kind == "end")
        total += len(value) if kind == "words" and not depth else 0
    return total


class Automaton:
    """All templates as one automaton; ``find`` runs it over a text's words."""

    def __init__(self, templates: Iterable[Template]):
        self.templates = tuple(templates)
        self.edges: list[list[tuple[bytes | None, int]]] = []  # of a state: (word or ANY, next state)
        self.skips: list[list[int]] = []
        self.accepting: dict[int, int] = {}
        starts = [self._compile(i, t.markup) for i, t in enumerate(self.templates)]
        self.vocabulary = {w for e in self.edges for w, _ in e if w is not ANY}
        self.sets: dict[frozenset[int], int] = {}
        self.members: list[frozenset[int]] = []
        self.found: list[tuple[int, ...]] = []  # templates accepted in a set of states
        self.steps: list[dict[bytes | None, int]] = []
        self.dead = self._number(frozenset())
        self.start = self._number(self._closed(starts))
        if self.found[self.start] or any(w is ANY for s in self.members[self.start] for w, _ in self.edges[s]):
            raise ValueError("a template must begin with words of its own")
        self.first = {w for w in self.vocabulary if self.step(self.start, w) != self.dead}

    def _state(self) -> int:
        self.edges.append([])
        self.skips.append([])
        return len(self.edges) - 1

    def _chain(self, at: int, words: Iterable[bytes | None]) -> int:
        for w in words:
            new = self._state()
            self.edges[at].append((w, new))
            at = new
        return at

    def _compile(self, number: int, markup: str) -> int:
        start = at = self._state()
        opened: list[int] = []
        for kind, value in parts_of(markup):
            if kind == "words":
                at = self._chain(at, value)
            elif kind == "begin":
                opened.append(at)
            elif kind == "end":
                if not opened:
                    raise ValueError("<<endOptional>> without its beginning")
                before, at, end = opened.pop(), at, self._state()
                self.skips[before].append(end)
                self.skips[at].append(end)
                at = end
            else:
                end = self._state()
                least, most = value if kind == "any" else (0, 0)
                ends = [self._chain(at, w) for w in value] if kind == "match" else [self._chain(at, [ANY] * least)]
                for _ in range(most - least):
                    ends.append(self._chain(ends[-1], [ANY]))
                for e in ends:
                    self.skips[e].append(end)
                at = end
        if opened:
            raise ValueError("<<beginOptional>> without its end")
        self.accepting[at] = number
        return start

    def _closed(self, states: Iterable[int]) -> frozenset[int]:
        out, todo = set(), list(states)
        while todo:
            s = todo.pop()
            if s not in out:
                out.add(s)
                todo.extend(self.skips[s])
        return frozenset(out)

    def _number(self, states: frozenset[int]) -> int:
        if states not in self.sets:
            self.sets[states] = len(self.members)
            self.members.append(states)
            self.found.append(tuple(sorted(self.accepting[s] for s in states if s in self.accepting)))
            self.steps.append({})
        return self.sets[states]

    def step(self, at: int, word: bytes | None) -> int:
        """The set of states after a word (``ANY``: one that no template names)."""
        nxt = self.steps[at].get(word)
        if nxt is None:
            nxt = self._number(self._closed(to for s in self.members[at] for w, to in self.edges[s] if w is ANY or w == word))
            self.steps[at][word] = nxt
        return nxt

    def find(self, words: list[bytes]) -> list[tuple[int, int, int]]:
        """(template, first word, words) of every match: the longest of a template at a place."""
        out: list[tuple[int, int, int]] = []
        first = self.first
        if first.isdisjoint(words):
            return out
        known = self.vocabulary
        for i in [i for i, w in enumerate(words) if w in first]:
            at, j, ends = self.start, i, {}
            while j < len(words):
                w = words[j]
                at = self.step(at, w if w in known else ANY)
                if at == self.dead:
                    break
                j += 1
                for t in self.found[at]:
                    ends[t] = j
            out.extend((t, i, e - i) for t, e in sorted(ends.items()))
        return out


HIT = "struct<template int, label string, base boolean, first_word long, n_words long>"
SCHEMA = f"n_words long, hits array<{HIT}>, score double"


def scan_licenses(docs: DataFrame, templates: Iterable[Template] = BASE + NOTICES) -> DataFrame:
    """doc_id, n_words, hits (template number, label, base, first word from 0, words), score of every document."""
    rows = spread(docs.select("doc_id", text_bytes().alias("text")))
    kind = rows.schema["doc_id"].dataType.simpleString()
    templates = tuple(templates)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Automaton(templates)
        weight = [mandatory_words(t.markup) for t in templates]
        hit = pa.struct([("template", pa.int32()), ("label", pa.string()), ("base", pa.bool_()), ("first_word", pa.int64()), ("n_words", pa.int64())])
        for batch in batches:
            raw = batch.column(1).fill_null(b"")
            for a, b in slices(pc.binary_length(raw).to_pylist(), 16 << 20):
                n, hits, score = [], [], []
                for text in raw.slice(a, b - a).to_pylist():
                    words = words_of(text)
                    got = machine.find(words)
                    m = max((weight[t] for t, _, _ in got), default=0)
                    n.append(len(words))
                    hits.append([(t, templates[t].label, templates[t].base, i, k) for t, i, k in got])
                    score.append(m / (m + EVIDENCE))
                columns = [batch.column(0).slice(a, b - a), pa.array(n, pa.int64()), pa.array(hits, pa.list_(hit)), pa.array(score, pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "hits", "score"])

    return rows.mapInArrow(work, f"doc_id {kind}, {SCHEMA}")


def labels_of(hits: Column) -> Column:
    """Distinct labels of hits, sorted, comma-joined."""
    return F.array_join(F.array_sort(F.array_distinct(F.transform(hits, lambda h: h["label"]))), ",")
