"""run() against brute force, stage by stage."""

import base64
import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import tiktoken
from brute import classes, shingle_set, similar, words
from conftest import prose

import corpus_pipeline as C
from shardwright import session
from shardwright.llm import mixing, quality, toxicity


def write_tables(spark, folder):
    rows, labels = [], []
    for i in range(120):
        text = prose(i % 100, 30 + i % 40)
        if i % 9 == 0:
            text = text.replace(" ", " idiot ", 1)
            labels.append((i, 1, 1))
        elif i % 2:
            labels.append((i, 1, 0))
        rows.append((i, text + (" extra" if i >= 100 else ""), "en", "abc"[i % 3] if i % 7 else None, len(text)))
    rows += [(200, None, "en", "a", None), (201, "", None, "b", 0), (202, "short one", "en", "a", 9), (203, "same " * 50, "en", "a", 250), (None, prose(300, 40), "en", "c", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return rows


def test_run_matches_brute_force(spark, tmp_path):
    folder = (tmp_path / "sf").as_uri()
    rows = write_tables(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    # toxicity: the fitted machine, scored in plain Python
    m = toxicity.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    place = {s: i for i, s in enumerate(m.features.tolist())}

    def toxic(text):
        at = {place.get(toxicity.slot(w.lower()), -1) for w in words(text)} - {-1}
        return m.score(np.array(sorted(at), int)) >= 0.5

    left = [r for r in rows if not toxic(r[1])]
    assert {r[0] for r in rows if r[1] and "idiot" in r[1]}.isdisjoint(r[0] for r in left) and len(left) > 90

    def good(text):
        raw = (text or "").encode()
        base = quality.base_features(raw)
        return not quality.base_failed(base[0], base[4]) and not any(x.rejects(quality.Features(raw)) for x in quality.RULES)

    left = [r for r in left if good(r[1])]
    sets = {r[0]: shingle_set(r[1]) for r in left if r[0] is not None}
    keep = {k for k, v in classes(sets, similar(sets)).items() if k == v}
    left = [r for r in left if r[0] is None or r[0] in keep]

    stages = docs
    for name, stage in C.STAGES[:3]:
        stages = stage(spark, stages, folder)
        assert stages.columns == docs.columns, name
    assert Counter(map(tuple, stages.collect())) == Counter(left)

    mix = C.STAGES[3][1](spark, stages, folder).collect()
    size, took, want = defaultdict(int), defaultdict(int), {}
    for r in left:
        size[r[3]] += len(words(r[1]))
    for r in mix:
        took[r["source"]] += len(words(r["text"]))
        whole = next(x for x in left if x[0] == r["doc_id"])
        it = iter(words(whole[1]))
        assert all(w in it for w in words(r["text"]))  # the document's words, in their order
    want = mixing.share_out(dict(size))
    assert {s: round(want[s]) for s in size} == dict(took)
    assert max(Counter(r["doc_id"] for r in mix).values()) <= 2

    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    digests = Counter()
    for r in mix:
        ids = enc.encode_ordinary(r["text"])
        digests[(r["doc_id"], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(r["text"].encode()).hexdigest())] += 1
    assert Counter(map(tuple, C.run(spark, folder).collect())) == digests


def test_stages_run_on_small_batches(spark, monkeypatch):
    def rows_at_once(spark, docs, sf_dir):
        return docs.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": pa.array([b.num_rows], pa.int64())}) for b in batches), "n long")

    docs = spark.range(0, 400, 1, 1).selectExpr("id", "repeat('word ', 20) text")
    monkeypatch.setattr(session, "BATCH_BYTES", 2_000)
    saved = spark.conf.get(session.BATCH_KEY, None)
    try:
        spark.conf.unset(session.BATCH_KEY)
        got = [r["n"] for r in C.lean(rows_at_once)(spark, docs, "").collect()]
        assert sum(got) == 400 and max(got) < 60
        spark.conf.set(session.BATCH_KEY, "1m")  # a size of the session's own stays
        assert [r["n"] for r in C.lean(rows_at_once)(spark, docs, "").collect()] == [400]
    finally:
        spark.conf.unset(session.BATCH_KEY) if saved is None else spark.conf.set(session.BATCH_KEY, saved)
    assert {stage.__qualname__.split(".")[0] for _, stage in C.STAGES} == {"lean"}


def test_empty_documents(spark, tmp_path):
    folder = (tmp_path / "none").as_uri()
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    assert C.run(spark, folder).count() == 0
