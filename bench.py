"""Benchmark: run every registered query at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is executed completely (``noop`` sink, no collect) and timed.  Prints one
JSON line: {"metric", "value" (total seconds), "unit", "queries": {name: sec}, "sf", ...}.
"""

from __future__ import annotations

import json
import os
import re
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from shardwright.operators import bpe  # noqa: E402
from shardwright.plans import queries as Q  # noqa: E402
from shardwright.session import local_session  # noqa: E402


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
    spark = local_session(cores=cpus, shuffle_partitions=int(cpus) * 2, app="shardwright-bench")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="shardwright-bench-ckpt-"))

    times: dict[str, float] = {}
    extra: dict[str, float] = {}
    # training is timed on its own, then the memoised model serves the other queries
    t0 = time.time()
    rep = bpe.TrainReport()
    Q._MODELS[(*Q.state_of(spark, sf_dir), Q.TRAIN_MERGES)] = bpe.train_bpe(
        Q.documents(spark, sf_dir), 256 + len(Q.SPECIALS) + Q.TRAIN_MERGES, Q.SPECIALS, report=rep
    )
    times["bpe_train"] = round(time.time() - t0, 3)
    extra["bpe_round0_sec"] = round(rep.seconds_round0, 3)
    extra["bpe_sec_per_merge"] = round(rep.seconds_rounds / max(rep.rounds, 1), 3)
    extra["bpe_merges"] = rep.rounds
    extra["bpe_passes"] = rep.passes

    for name, fn in Q.QUERIES.items():
        if name == "bpe_train" or (only and name not in only):
            continue
        t = time.time()
        fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t, 3)

    n_bytes = Q.documents(spark, sf_dir).selectExpr("sum(octet_length(text)) AS b").collect()[0]["b"]
    if "bpe_encode" in times:
        extra["encode_mb_per_sec"] = round(n_bytes / 1e6 / times["bpe_encode"], 3)
    if "pack_shards" in times:
        extra["pack_mtokens_per_sec"] = round((n_bytes / 1e6) / times["pack_shards"], 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {
        "metric": "total_query_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(m.group(1)) if m else sf_dir,
        "cpus": int(cpus),
        "corpus_bytes": int(n_bytes),
        **extra,
    }
    spark.stop()
    print(json.dumps(out))


if __name__ == "__main__":
    main()
