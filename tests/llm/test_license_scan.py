import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from shardwright.llm import license_scan as L
from shardwright.llm.oracle import template_regex


def brute_words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute_hits(text, templates):
    """Every place tried with every template by Python's backtracking expressions, longest match."""
    w = brute_words(text)
    out = []
    for i in range(len(w)):
        rest = "".join(" " + x for x in w[i:])
        for t, template in enumerate(templates):
            pattern = template_regex(template.markup)
            ends = [k for k in range(1, len(w) - i + 1) if re.fullmatch(pattern, "".join(" " + x for x in w[i : i + k]))] if re.match(pattern, rest) else []
            if ends:
                out.append((t, i, max(ends)))
    return sorted(out, key=lambda x: (x[1], x[0]))


SMALL = (
    L.Template("a", "red blue", base=True),
    L.Template("b", "red <<beginOptional>>green <<beginOptional>>blue<<endOptional>><<endOptional>> blue"),
    L.Template("c", "<<beginOptional>>blue<<endOptional>> red <<var;name=x;min=1;max=3>> blue"),
    L.Template("d", "<<var;name=y;match=green|green green|blue red>> <<var;name=z;min=0;max=2>> red"),
)


def test_automaton_matches_backtracking():
    machine, draw = L.Automaton(SMALL), random.Random(5)
    for _ in range(400):
        words = [draw.choice(["red", "blue", "green", "grey"]) for _ in range(draw.randrange(14))]
        text = " ".join(words)
        assert machine.find([w.encode() for w in words]) == brute_hits(text, SMALL)


def test_notices_are_found():
    machine = L.Automaton(L.BASE + L.NOTICES)
    label = lambda text: {(L.BASE + L.NOTICES)[t].label for t, _, _ in machine.find(L.words_of(text.encode()))}
    assert label("Released under the MIT License.") == {"mit"}
    assert label("// Licensed under the Apache\n// License, Version 2.0.") == {"apache", "apache-2.0"}
    assert label("This work is licensed under the GNU General Public License, version 3.") == {"gpl", "gpl-3.0"}
    assert label("Licensed under CC BY-NC 4.0.") == {"cc-by-nc-4.0"}
    assert label("Licensed under CC BY 4.0.") == {"cc-by-4.0"}
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software {}, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"
    assert label(mit.format('and associated documentation files (the "Software")')) == label(mit.format("")) == {"mit"}
    assert label(mit.format("and its documentation")) == set()
    assert label(mit.format("").replace("merge", "fold")) == set()
    assert label("Copyright (c) 2001-2003 A. N. Other and friends. All rights reserved.") == {"all-rights-reserved"}
    assert label("the license is not from MIT") == set()


def test_rows_match_brute_force(spark, hard):
    texts = ["MIT License mit license MIT", "Apache License\nGeneral  Public-License", "permission to use", "Lïcense MIT licenseé", "x " * 3000 + "mit license"]
    more = spark.createDataFrame([(100 + i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    docs = hard.select("doc_id", "text").unionByName(more)
    templates = L.BASE + L.NOTICES[:4]
    got = Counter()
    for r in L.scan_licenses(docs, templates).collect():
        got[(r["doc_id"], r["n_words"], tuple((h["template"], h["first_word"], h["n_words"]) for h in r["hits"]), r["score"])] += 1
    want = Counter()
    for r in docs.collect():
        w = brute_words(r["text"])
        hits = tuple(brute_hits(r["text"], templates)) if {"mit", "apache", "general", "permission", "licensed"} & set(w) else ()
        m = max((L.mandatory_words(templates[t].markup) for t, _, _ in hits), default=0)
        want[(r["doc_id"], len(w), hits, m / (m + 8))] += 1
    assert got == want


def test_hits_name_their_template(spark):
    docs = spark.createDataFrame([(1, "under the MIT License; released under the MIT licence")], "doc_id long, text string")
    (r,) = L.scan_licenses(docs).select(F.col("hits.label").alias("label"), F.col("hits.base").alias("base"), L.labels_of(F.col("hits")).alias("labels")).collect()
    assert r["label"] == ["mit", "mit"] and r["base"] == [True, False] and r["labels"] == "mit"


@pytest.mark.parametrize("markup", ["<<beginOptional>>a", "a<<endOptional>>", "a <<what>> b", "<<var;name=x;min=0;max=3>> a", "<<beginOptional>>a<<endOptional>>"])
def test_bad_templates(markup):
    with pytest.raises(ValueError):
        L.Automaton([L.Template("x", markup)])


def test_empty_table(none):
    assert L.scan_licenses(none).collect() == []
