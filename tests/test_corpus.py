"""Sources and corpus preparation."""

import pytest
from pyspark.sql import functions as F

from shardwright.operators import prep
from shardwright.sources import corpus

NOTE = "first line\nsecond, longer line\nthird\n\nfirst line\n\n   indented\nlast: done?\n"


def test_text_scan_newlines_bom_and_order(spark, tmp_path):
    root = tmp_path / "in"
    (root / "a").mkdir(parents=True)
    (root / "a.txt").write_bytes("﻿hi\r\nthere\rx".encode("utf-8"))
    (root / "a" / "b.txt").write_text("inner", encoding="utf-8")
    (root / "c.TXT").write_text("wrong suffix", encoding="utf-8")
    (root / ".h.txt").write_text("hidden", encoding="utf-8")
    df = corpus.read_corpus(spark, str(root)).orderBy("doc_key").collect()
    assert [r["text"] for r in df] == ["inner", "﻿hi\nthere\nx"]  # a/b.txt sorts before a.txt


def test_text_and_parquet_interleaved(spark, tmp_path):
    root = tmp_path / "mix"
    root.mkdir()
    (root / "b.txt").write_text("middle", encoding="utf-8")
    spark.createDataFrame([("p1",), (None,), ("",)], "text string").coalesce(1).write.parquet(str(root / "a_pq"))
    spark.createDataFrame([("z1",)], "text string").coalesce(1).write.parquet(str(root / "c_pq"))
    got = [r["text"] for r in corpus.read_corpus(spark, str(root)).orderBy("doc_key").collect()]
    assert got == ["p1", "", "middle", "z1"]  # nulls dropped, empty strings kept, path order


def test_scan_errors(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        corpus.read_corpus(spark, str(tmp_path / "missing"))
    (tmp_path / "empty").mkdir()
    (tmp_path / "empty" / "x.md").write_text("no", encoding="utf-8")
    with pytest.raises(FileNotFoundError):
        corpus.read_corpus(spark, str(tmp_path / "empty"))


def test_malformed_utf8_fails(spark, tmp_path):
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.txt").write_bytes(b"ok\xff")
    with pytest.raises(Exception):
        corpus.read_corpus(spark, str(tmp_path / "bad")).collect()


def test_read_sources(spark, tmp_path):
    fx = tmp_path / "note.txt"
    fx.write_text(NOTE, encoding="utf-8")
    raw = tmp_path / "raw"
    df = corpus.read_sources(spark, [{"type": "fixture", "path": str(fx), "id": "note"}], str(raw))
    rows = df.collect()
    assert rows[0]["text"] == NOTE and rows[0]["source_id"] == "note"
    back = spark.read.parquet(str(raw)).collect()
    assert back[0]["text"] == NOTE and back[0]["source_id"] == "note"
    with pytest.raises(FileNotFoundError):
        corpus.read_sources(spark, [{"type": "fixture", "path": str(tmp_path / "nope.txt"), "id": "x"}])
    with pytest.raises(ValueError):
        corpus.read_sources(spark, [{"type": "fixture", "path": str(fx)}])
    with pytest.raises(ValueError):
        corpus.read_sources(spark, [])
    with pytest.raises(ValueError):
        corpus.read_sources(spark, [{"type": "http", "path": str(fx), "id": "x"}])
    with pytest.raises(ValueError):
        corpus.read_sources(spark, [{"type": "fixture", "path": str(fx), "id": "x"}] * 2)


def test_normalize_and_dedup(spark):
    df = spark.createDataFrame([(0, "a\r\nb"), (1, "a\nb"), (2, "c\rd"), (3, "a\nb")], "doc_key bigint, text string")
    norm = df.withColumn("text", prep.normalize_v0(F.col("text")))
    kept = {r["doc_key"]: r["n_copies"] for r in prep.dedup_exact(norm).collect()}
    assert kept == {0: 3, 2: 1}


def test_dedup_lines(spark):
    lines = NOTE.split("\n")
    df = spark.createDataFrame([(0, NOTE), (1, "third\nnew")], "doc_key bigint, text string")
    out = {r["doc_key"]: r["text"] for r in prep.dedup_lines(df).collect()}
    assert out[0] == "\n".join(lines[:4] + lines[5:])  # second copy of line 1 dropped, empty lines kept
    assert out[1] == "new"


def test_split_assignment(spark):
    df = spark.range(2000).withColumnRenamed("id", "doc_key")
    a = prep.assign_split(df, 0.1, 1337).groupBy("split").count().collect()
    counts = {r["split"]: r["count"] for r in a}
    assert 120 < counts["val"] < 280
    b = prep.assign_split(df.repartition(5), 0.1, 1337)
    assert sorted(r["doc_key"] for r in b.where("split = 'val'").collect()) == sorted(
        r["doc_key"] for r in prep.assign_split(df, 0.1, 1337).where("split = 'val'").collect()
    )
    assert prep.assign_split(df, 0.0, 1).where("split = 'val'").count() == 0
    for bad in (-0.1, 1.0):
        with pytest.raises(ValueError):
            prep.assign_split(df, bad, 1)


def test_parquet_text_must_be_string(spark, tmp_path):
    spark.createDataFrame([(1.5,)], "text double").write.parquet(str(tmp_path / "num"))
    with pytest.raises(ValueError, match="expected a string"):
        corpus.read_parquet_text(spark, str(tmp_path / "num"))


def test_no_file_is_lost(spark, tmp_path):
    """Spaces, percent signs and other marks in names, empty files, a Parquet folder with a space."""
    root = tmp_path / "odd names"
    (root / "sub").mkdir(parents=True)
    files = {"a b.txt": "A", "pct%41.txt": "P", "plus+.txt": "+", "q?#.txt": "Q", "c.txt": "C", "z.txt": "", "sub/e.txt": "", "ü.txt": "U"}
    for name, text in files.items():
        (root / name).write_text(text, encoding="utf-8")
    spark.createDataFrame([("row",)], "text string").write.parquet(str(root / "d e.parquet"))
    rows = corpus.read_corpus(spark, str(root)).orderBy("doc_key").collect()
    want = sorted([*files.items(), ("d e.parquet", "row")], key=lambda x: x[0].split("/"))
    assert [r["text"] for r in rows] == [t for _, t in want]
    assert [r["doc_key"].split("\x00")[0] for r in rows] == [n.split("/")[0] for n, _ in want]


def test_parquet_files_that_disagree(spark, tmp_path):
    for other in ("n int", "text int"):
        root = tmp_path / other.replace(" ", "-")
        spark.createDataFrame([("ok",)], "text string").write.parquet(str(root / "a"))
        spark.createDataFrame([(1,)], other).write.parquet(str(root / "b"))
        with pytest.raises(ValueError, match="column 'text'"):
            corpus.read_parquet_text(spark, str(root))


def test_added_file_moves_no_document(spark, tmp_path):
    root = tmp_path / "grow"
    root.mkdir()
    for i in range(40):
        (root / f"n{i:02d}.txt").write_text(f"text {i}", encoding="utf-8")
    split = lambda: {r["text"]: r["split"] for r in prep.assign_split(corpus.read_corpus(spark, str(root)), 0.3).collect()}
    before = split()
    (root / "a-first.txt").write_text("new", encoding="utf-8")
    after = split()
    assert len(set(before.values())) == 2 and {k: after[k] for k in before} == before


def test_empty_source_is_a_document(spark, tmp_path):
    (tmp_path / "none.txt").write_text("")
    (tmp_path / "some%20.txt").write_text("x\r\ny")
    src = [{"type": "fixture", "path": str(tmp_path / n), "id": i} for n, i in (("some%20.txt", "b"), ("none.txt", "a"))]
    rows = corpus.read_sources(spark, src).orderBy("source_no").collect()
    assert [(r["source_id"], r["text"]) for r in rows] == [("b", "x\ny"), ("a", "")]


def test_dedup_keeps_every_document(spark):
    rows = [(1, "a\nb"), (2, "b\na"), (3, None), (4, ""), (5, "a\nc"), (6, None)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_key bigint, text string, lang string")
    got = {r["doc_key"]: r["text"] for r in prep.dedup_lines(df).collect()}
    assert got == {1: "a\nb", 2: "", 3: None, 4: "", 5: "c", 6: None}
    assert {r["doc_key"]: r["n_copies"] for r in prep.dedup_exact(df).collect()} == dict.fromkeys(range(1, 7), 1)


def test_files_are_listed_by_tasks(spark, tmp_path):
    """Deep and wide trees, hidden names on demand, and ranks that follow path components."""
    root = tmp_path / "tree"
    want = []
    for d in ("a", "a-1", "a b", "a/x", "b"):
        (root / d).mkdir(parents=True, exist_ok=True)
        for i in range(30):
            (root / d / f"{i:02d}.txt").write_text(f"{d} {i}", encoding="utf-8")
            want.append(f"{d}/{i:02d}.txt")
    (root / ".hid").mkdir()
    (root / ".hid" / "h.txt").write_text("hidden", encoding="utf-8")
    (root / "_u.txt").write_text("under", encoding="utf-8")
    shown = corpus.read_corpus(spark, str(root))
    got = [(r["rank"], r["text"]) for r in corpus.ranked(shown.select("doc_key", "text")).orderBy("rank").collect()]
    order = sorted(want, key=lambda n: n.split("/"))
    assert got == [(i, f"{n.rsplit('/', 1)[0]} {int(n[-6:-4])}") for i, n in enumerate(order)]
    assert order != sorted(want)
    every = {r["text"] for r in corpus.read_corpus(spark, str(root), hidden=True).collect()}
    assert every == {t for _, t in got} | {"hidden", "under"}


def test_listing_has_lengths_and_no_paths_on_the_driver(spark, tmp_path, monkeypatch):
    from shardwright.sources import listing

    for i in range(200):
        (tmp_path / f"{i}.txt").write_text("x" * (i % 3))
    made = []
    create = type(spark).createDataFrame
    monkeypatch.setattr(type(spark), "createDataFrame", lambda self, data, *a, **k: made.append(len(data)) or create(self, data, *a, **k))
    files = listing.list_files(spark, f"file:{tmp_path}", (".txt",))
    assert sorted(r["length"] for r in files.collect()) == sorted(i % 3 for i in range(200))
    assert corpus.read_text_files(spark, str(tmp_path)).where("text = ''").count() == 67
    assert set(made) == {1}


def test_stores_only_spark_knows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(corpus, "known_store", lambda uri: False)
    (tmp_path / "a.txt").write_text("one\r\n")
    (tmp_path / "b.txt").write_text("")
    spark.createDataFrame([("p",)], "text string").write.parquet(str(tmp_path / "c"))
    assert [r["text"] for r in corpus.read_corpus(spark, str(tmp_path)).orderBy("doc_key").collect()] == ["one\n", "", "p"]


def test_no_line_text_is_shuffled(spark):
    rows = [(i, "\n".join([f"line {i % 7}", "", "shared", f"own {i}", "shared", ""])) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_key bigint, text string")
    seen, want = set(), {}
    for k, t in rows:
        want[k] = "\n".join(x for x in t.split("\n") if x == "" or not (x in seen or seen.add(x)))
    out = prep.dedup_lines(df.repartition(3))
    assert {r["doc_key"]: r["text"] for r in out.collect()} == want
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and plan.count("Aggregate") == 2
    for line in plan.splitlines():
        if "Aggregate" in line:
            assert "text" not in line and "_lines" not in line
