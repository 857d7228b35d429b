"""Headline benchmark: runs the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]
and prints one JSON line {"metric", "value", "unit", "queries", "sf"}.

Each query is planned and fully executed (a no-op sink consumes every row), so the
time covers the whole job including materialised intermediate tables.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "f19_pretraining_records",   # pretraining build (F19)
    "g10_classification_features",  # classification features (G10)
    "e2_assign_ids",             # word counts and vocabulary (E1a + E2)
    "i14_classification_report",  # classification report (I14)
    "e4_tokens_to_ids",          # corpus cleaning, documents and ids (C, D, E4)
    "a10_extract_pages",         # page text extraction (A10)
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from lexiforge.plans.catalog import load_all
    from lexiforge.session import local_session

    spark = local_session(cpus, partitions=max(8, int(cpus) if cpus.isdigit() else 8))
    queries, _ = load_all()
    names = sys.argv[1:] or HEADLINE
    times: dict[str, float] = {}
    for name in names:
        t0 = time.time()
        df = queries[name](spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
        print(f"# {name}: {times[name]}s", file=sys.stderr, flush=True)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {
        "metric": "headline_total_wall",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(m.group(1)) if m else sf_dir,
    }
    print(json.dumps(out))


if __name__ == "__main__":
    main()
