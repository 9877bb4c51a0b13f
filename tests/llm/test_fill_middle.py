import hashlib
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from shardwright.llm import fill_middle as M


def brute(doc_id, text):
    """The contract, unit by unit."""
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(("1:" + ("" if doc_id is None else str(doc_id))).encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_matches_brute_force(spark, hard):
    texts = ["<P> marks <M>", "a<S", "P>", "<<P", "<\n>", "\x00\x85  a1b22c", "ÀézZ", "🚚🚚 ab", "no marks < P >", "x"]
    more = spark.createDataFrame([(i, texts[i % len(texts)]) for i in range(100, 400)], "doc_id long, text string")
    docs = hard.select("doc_id", "text").unionByName(more)
    out = M.fill_in_middle(docs).withColumn("back", M.restored(F.col("output"), F.col("form")))
    got = Counter(tuple(r) for r in out.collect())
    want = Counter()
    for r in docs.collect():
        want[(r["doc_id"], *brute(r["doc_id"], r["text"]), r["text"] or "")] += 1
    assert got == want
    assert {k[2] for k in got} == {"plain", "psm", "spm"}


def test_long_text_and_string_ids(spark):
    text = "word, " * 200_000 + "end"
    rows = spark.createDataFrame([(f"d{i}", text) for i in range(6)], "doc_id string, text string")
    for r in M.fill_in_middle(rows).collect():
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == brute(r["doc_id"], text)


@pytest.mark.parametrize("percent, forms", [((0, 20), {"plain"}), ((100, 0), {"psm"}), ((100, 100), {"spm"})])
def test_shares_are_parameters(spark, percent, forms):
    rows = spark.range(60).selectExpr("id AS doc_id", "'some words here' AS text")
    assert {r["form"] for r in M.fill_in_middle(rows, cut_percent=percent[0], spm_percent=percent[1]).collect()} == forms


def test_empty_table(none):
    assert M.fill_in_middle(none).collect() == []
