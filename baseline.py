"""Single-threaded plain-Python renditions of a few headline queries, as a yardstick for bench.py: one JSON line of seconds.

They read the same parquet files into lists of dicts and loop; reading is included, as it is in the bench.
"""

from __future__ import annotations

import datetime as dt
import json
import os
import re
import time
from collections import Counter, defaultdict

import pyarrow.parquet as pq

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")


def rows(name: str, columns: list[str]) -> list[dict]:
    return pq.read_table(f"{FOLDER}/{name}.parquet", columns=columns).to_pylist()


def key(text: str | None) -> int | None:
    m = re.match(r"\s*(\d+)(\.0*)?\s*$", text or "")
    return int(m.group(1)) if m else None


def monthly_counts() -> int:
    counts: dict = defaultdict(Counter)
    for r in rows("orders", ["o_orderdate", "o_orderpriority"]):
        counts[r["o_orderdate"].year, r["o_orderdate"].month][r["o_orderpriority"]] += 1
    return len([(m, c["1-URGENT"] - c["5-LOW"]) for m, c in counts.items()])


def risk_panel_quarter() -> int:
    starts: dict = {}
    counts: Counter = Counter()
    for r in rows("orders", ["o_custkey", "o_orderdate"]):
        d = r["o_orderdate"].date()
        starts[r["o_custkey"]] = min(d, starts.get(r["o_custkey"], d))
        counts[r["o_custkey"], d.year, (d.month - 1) // 3] += 1
    end = max([(1998, 3), *((y, q) for _, y, q in counts)])
    quarters = [(y, q) for y in range(min([1992, *(d.year for d in starts.values())]), end[0] + 1) for q in range(4) if (y, q) <= end]
    out = []
    for c, start in starts.items():
        for y, q in quarters:
            first = dt.date(y, 3 * q + 1, 1)
            last = dt.date(y + (q == 3), (3 * q + 3) % 12 + 1, 1) - dt.timedelta(days=1)
            if last >= start:
                out.append((c, first, last, (last - max(first, start)).days + 1, start > first, counts[c, y, q]))
    return len(out)


def bridge_events() -> int:
    apps = {key(r["app_id"]) for r in rows("stage2_master_projects", ["app_id", "deleted_at"]) if r["deleted_at"] is None}
    pubs = {key(r["pub_id"]) for r in rows("schema19_publications", ["pub_id", "deleted_at"]) if r["deleted_at"] is None}
    pairs = Counter((key(r["app_id"]), key(r["pub_id"])) for r in rows("schema24_pub_app_links", ["app_id", "pub_id"]))
    return len([p for p in pairs if p[0] in apps and p[1] in pubs])


def rule_match() -> int:
    near = re.compile("cohort.{0,140}platform|platform.{0,140}cohort")
    out = []
    for r in rows("documents", ["doc_id", "text"]):
        if r["text"] is not None:
            low = r["text"].lower()
            m = re.search("([0-9]+) participants", r["text"])
            out.append((r["doc_id"], m and m.group(1), low.count("cohort"), bool(near.search(low))))
    return len(out)


def fractional_attribution() -> int:
    suppliers = defaultdict(set)
    for r in rows("lineitem", ["l_partkey", "l_suppkey"]):
        suppliers[r["l_partkey"]].add(r["l_suppkey"])
    total: Counter = Counter()
    for s in suppliers.values():
        for x in s:
            total[x] += 1 / len(s)
    return len(total)


if __name__ == "__main__":
    seconds = {}
    for f in (monthly_counts, risk_panel_quarter, bridge_events, rule_match, fractional_attribution):
        began = time.perf_counter()
        f()
        seconds[f.__name__] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "plain_python_seconds", "queries": seconds}))
