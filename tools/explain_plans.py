"""Summarise the physical plan of every registered query into PLANS.md.

Usage: python tools/explain_plans.py [sf_dir] [out.md]
For each query: shuffles (Exchange), broadcast joins, sort-merge joins, windows,
Python (Arrow) nodes and what each Parquet scan reads and pushes down.
"""

from __future__ import annotations

import contextlib
import io
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from shardwright.plans.queries import QUERIES  # noqa: E402
from shardwright.session import local_session  # noqa: E402


def plan_text(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def summarise(text: str) -> dict:
    head = text.split("\n\n")[0]
    exchanges = re.findall(r"Arguments: (hashpartitioning|rangepartitioning|RoundRobinPartitioning|SinglePartition)[^\n]*", text)
    return {
        "exchanges": len(re.findall(r"Exchange \(", head)) - len(re.findall(r"BroadcastExchange \(", head)),
        "broadcasts": len(re.findall(r"BroadcastExchange \(", head)),
        "bhj": len(re.findall(r"BroadcastHashJoin", head)),
        "smj": len(re.findall(r"SortMergeJoin", head)),
        "windows": len(re.findall(r"\bWindow \(", head)),
        "python": len(re.findall(r"MapInPandas|ArrowEvalPython|FlatMapGroupsInPandas", head)),
        "scans": sorted(set(re.findall(r"ReadSchema: ([^\n]*)", text))),
        "pushed": sorted(set(re.findall(r"PushedFilters: ([^\n]*)", text))),
        "partitioning": sorted(set(exchanges)),
    }


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    out = sys.argv[2] if len(sys.argv) > 2 else "PLANS.md"
    spark = local_session()
    lines = [
        "# Physical plans of the registered queries",
        "",
        f"Generated by `tools/explain_plans.py` on `{sf}` (local session, AQE on; the final",
        "plan may change at run time, e.g. a shuffle join becoming a broadcast when the measured",
        "side is small).  Queries whose input is a materialised table (trained model, checkpointed",
        "shards) show the plan that reads it.",
        "",
        "| query | shuffles | broadcast joins | sort-merge joins | windows | Arrow/Python nodes | scan reads | pushed filters |",
        "|---|---|---|---|---|---|---|---|",
    ]
    for name, fn in QUERIES.items():
        s = summarise(plan_text(fn(spark, sf)))
        lines.append(
            f"| {name} | {s['exchanges']} | {s['bhj']} | {s['smj']} | {s['windows']} | {s['python']} | "
            f"{'<br>'.join(s['scans']) or '(materialised)'} | {'<br>'.join(s['pushed']) or '-'} |"
        )
    with open(out, "w", encoding="utf-8") as f:
        f.write("\n".join(lines) + "\n")
    print("\n".join(lines))


if __name__ == "__main__":
    main()
