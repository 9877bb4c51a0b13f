"""Byte-level BPE: literal values, and a DuckDB chain of full recounts as the independent rule."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from shardwright.functions.codepoints import cp_to_id, id_to_cp, ids_of, tok
from shardwright.operators import audit, bpe
from shardwright.operators.specials import special_id, special_id_of, special_ids, split_special
from shardwright.plans import oracle
from shardwright.plans.queries import SPECIALS
from shardwright.sources.artifacts import load_tokenizer, save_tokenizer

RIVER = ["river banks and rivers", "the bank by the river", "banking on the bank", "riverrun riverrun"]
ODD = ["crème brûlée", "Жук над рекой", "🦊🦊 fox", "漢字かな", "\ttab\r\nline  ", ""]


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def recount(texts, n):
    """(merges with counts, token strings) by DuckDB, from full recounts."""
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    rows = con.execute(f"WITH {oracle.merge_chain(n)} SELECT rank, left_id, right_id, n FROM ({oracle.merges_union(n)}) WHERE left_id IS NOT NULL ORDER BY rank").fetchall()
    m = len(rows)
    coded = con.execute(f"WITH {oracle.merge_chain(m)} SELECT {oracle.encode_fold(oracle.byte_str('text'), m)} FROM documents ORDER BY doc_id").fetchall()
    return rows, [[ord(c) for c in s or ""] for (s,) in coded]


def encoded(df, model, method="auto"):
    rows = bpe.encode_documents(df, model, method=method).select("doc_id", "ids").collect()
    return [list(r["ids"]) for r in sorted(rows, key=lambda r: r["doc_id"])]


def decoded(spark, model, lists):
    df = spark.createDataFrame(list(enumerate(lists)), "k int, ids array<int>")
    return [r["t"] for r in df.select("k", bpe.decode(F.col("ids"), model).alias("t")).orderBy("k").collect()]


def soup(seed, n=20):
    rng = random.Random(seed)
    return ["".join(rng.choices("xy zé🦊\n", k=rng.randint(0, 35))) for _ in range(n)]


@pytest.mark.parametrize("texts", [RIVER, ["xxx", "xxxxx", "yxxy", "xxxx"], soup(11), soup(12)], ids=["river", "overlaps", "soup", "soup2"])
def test_training_and_encoding_match_the_recount_chain(spark, texts):
    rows, coded = recount(texts, 14)
    model = bpe.train_bpe(docs(spark, texts), 258 + 14, SPECIALS, checkpoint_every=3)
    assert [(r, a, b, n) for r, ((a, b), n) in enumerate(zip(model.merges, model.pair_counts))] == [tuple(map(int, x)) for x in rows]
    for method in ("fold", "aggregate", "arrow"):
        assert encoded(docs(spark, texts), model, method) == coded
    assert decoded(spark, model, coded) == texts


def test_order_and_speculation_change_nothing(spark):
    one, two, three = bpe.TrainReport(), bpe.TrainReport(), bpe.TrainReport()
    a = bpe.train_bpe(docs(spark, RIVER), 300, SPECIALS, report=one)
    b = bpe.train_bpe(docs(spark, RIVER[::-1]), 300, SPECIALS, report=two)
    c = bpe.train_bpe(docs(spark, RIVER), 300, SPECIALS, report=three, speculate=False)
    assert a.merges == b.merges == c.merges and a.pair_counts == c.pair_counts
    assert one.passes < three.passes == len(c.merges)


def test_sf0001_documents(spark, sf0001):
    table = spark.read.parquet(f"{sf0001}/documents.parquet")
    rows, _ = recount([r["text"] for r in table.select("text").collect()], 9)
    model = bpe.train_bpe(table, 258 + 9, SPECIALS, num_partitions=3)
    assert [m for m in model.merges] == [(a, b) for _, a, b, _ in rows]


def test_fixed_values(spark):
    m = bpe.train_bpe(docs(spark, ["ababab"]), 257)
    assert m.merges == ((97, 98),) and encoded(docs(spark, ["abab"]), m) == [[256, 256]]
    assert special_ids(list(SPECIALS)) == {"<|bos|>": 256, "<|eos|>": 257}
    twenty = bpe.train_bpe(docs(spark, RIVER), 278, SPECIALS)
    assert (len(twenty.merges), twenty.vocab_size, twenty.first_merge_id) == (20, 278, 258)
    best = bpe.best_pair(bpe.pair_counts(bpe.chunk_table(docs(spark, ["ababab", "ba"])))).collect()[0]
    assert (best["left_id"], best["right_id"], best["n"]) == (97, 98, 3)


def test_training_ends_when_no_pair_is_left(spark):
    m = bpe.train_bpe(docs(spark, ["ab", "cd"]), 300)
    assert m.merges == ((97, 98), (99, 100)) and m.vocab_size == 300
    assert bpe.train_bpe(docs(spark, ["", "z"]), 270).merges == ()


def test_texts_of_all_kinds_round_trip(spark):
    plain, trained = bpe.BPEModel(), bpe.train_bpe(docs(spark, RIVER + ODD), 330)
    for model in (plain, trained):
        assert decoded(spark, model, encoded(docs(spark, ODD + RIVER), model)) == ODD + RIVER
    assert len(encoded(docs(spark, RIVER), trained)[0]) < len(RIVER[0].encode())


def test_round_trip_audit_counts_what_differs(spark):
    df = docs(spark, RIVER).withColumn("g", F.col("doc_id") % 2)
    got = {r["g"]: (r["n_docs"], r["n_mismatch"]) for r in audit.roundtrip_audit(df, bpe.train_bpe(df, 262), "g").collect()}
    assert got == {0: (2, 0), 1: (2, 0)}
    null = spark.createDataFrame([(0, None), (0, "x")], "g int, text string")
    assert audit.roundtrip_audit(null, bpe.BPEModel(), "g").collect()[0]["n_docs"] == 2


def test_malformed_bytes(spark):
    raw = ["E697", "FF", "41E69742", "F09F9A", "EDA080", "C080", "F4908080"]
    lists = [list(bytes.fromhex(h)) for h in raw]
    assert decoded(spark, bpe.BPEModel(), lists) == [bytes.fromhex(h).decode("utf-8", errors="replace") for h in raw]


def test_errors(spark):
    with pytest.raises(ValueError):
        bpe.train_bpe(docs(spark, RIVER), 256, SPECIALS)
    with pytest.raises(ValueError):
        special_ids(["<s>", "<s>"])
    with pytest.raises(ValueError):
        special_id(SPECIALS, "<|none|>")
    m = bpe.train_bpe(docs(spark, ["ab"]), 300)
    for unknown in (999999, m.known_ids, -1):
        with pytest.raises(Exception, match="no bytes for token id"):
            decoded(spark, m, [[65, unknown]])


def test_specials_are_kept_whole(spark):
    m = bpe.train_bpe(docs(spark, [f"<|bos|>{t}<|eos|>" for t in RIVER]), 290, SPECIALS)
    text = "<|bos|>river<|eos|><|eos|>x"
    ids = encoded(docs(spark, [text]), m)[0]
    assert ids[0] == 256 and ids.count(257) == 2 and decoded(spark, m, [ids]) == [text]
    names = spark.createDataFrame([("<|eos|>",), ("<|bos|>",)], "name string")
    assert [r["i"] for r in names.select(special_id_of(F.col("name"), SPECIALS).alias("i")).collect()] == [257, 256]
    with pytest.raises(Exception, match="no such special token"):
        names.select(special_id_of(F.lit("<|none|>"), SPECIALS).alias("i")).collect()


def test_longest_special_at_the_leftmost_place(spark):
    cases = {
        "a<|bos|>b": [(False, "a"), (True, "<|bos|>"), (False, "b")],
        "<|b<|bos|>": [(True, "<|b"), (True, "<|bos|>")],
        "<|bo<|eos|>": [(True, "<|b"), (False, "o"), (True, "<|eos|>")],
        "<|eos|><|eos|>": [(True, "<|eos|>"), (True, "<|eos|>")],
        "|> <|": [(False, "|> <|")],
        "": [],
    }
    df = docs(spark, list(cases)).select("text", split_special(F.col("text"), ["<|b", "<|bos|>", "<|eos|>"]).alias("s"))
    assert {r["text"]: [(x["is_special"], x["chunk"]) for x in r["s"]] for r in df.collect()} == cases
    none = docs(spark, [""]).select(split_special(F.col("text"), []).alias("s")).collect()[0]["s"]
    assert [(x["is_special"], x["chunk"]) for x in none] == [(False, "")]


def test_artifact_through_a_uri(spark, tmp_path):
    m = bpe.train_bpe(docs(spark, RIVER), 300, SPECIALS)
    back = load_tokenizer(spark, save_tokenizer(spark, m, (tmp_path / "tok one").as_uri().replace("%20", " ")))
    assert (back.merges, back.specials, back.vocab_size) == (m.merges, m.specials, 300)


def test_code_points(spark):
    for i in [0, 255, 0xD7FF, 0xD800, 0xFFFF, 65536, 0x10FFFF - 0x800]:
        assert cp_to_id(id_to_cp(i)) == i
    wide = [5, 0xD7FF, 0xD800, 65535, 65536, 70000, 70000, 70000]
    df = spark.createDataFrame([("".join(map(tok, wide)), 2), ("", 1)], "s string, w long")
    assert [list(r["ids"]) for r in df.select(ids_of(F.col("s")).alias("ids")).collect()] == [wide, []]
    left, right = bpe.unpack_pair(F.col("k"))
    got = {(r["a"], r["b"]): r["n"] for r in bpe.pair_counts(df).select(left.alias("a"), right.alias("b"), "n").collect()}
    assert got == {(5, 0xD7FF): 2, (0xD7FF, 0xD800): 2, (0xD800, 65535): 2, (65535, 65536): 2, (65536, 70000): 2, (70000, 70000): 4}


def test_one_training_state_is_kept(spark):
    from pathlib import Path

    from shardwright.session import checkpoint_dir

    states = lambda: {p.name for p in Path(checkpoint_dir(spark).removeprefix("file:")).glob("bpe-state-*")}
    before = states()
    bpe.train_bpe(docs(spark, RIVER), 256 + 40, checkpoint_every=2)
    assert states() == before
