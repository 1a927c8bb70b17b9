"""Headline queries over whole tables, timed to the last row. Prints one JSON line.

BENCH_SF_DIR   folder with the driver tables (default /root/testdata/sf0.1)
BENCH_CPUS     local cores (default 8)
BENCH_QUERIES  comma-separated names, to time a few
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks.queries import QUERIES  # noqa: E402
from mailrisk.session import local_session  # noqa: E402

HEADLINE = (
    "risk_levels assessments evidence_table rescore layer_budgets signal_metrics auc ablation "
    "normalize_messages header_rows attachments url_observations registrable_domains "
    "ttl_lookup resolve_redirects base64_email_signals url_ioc_signals hosting_matches "
    "zero_width_signals text_shape sentence_scores assess_mail urgency_signals fusion_signals"
).split()
# Run once before the clock starts, so that the first query does not carry the engine's start.
WARM_UP = ("risk_levels", "normalize_messages")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = local_session(cores=os.environ.get("BENCH_CPUS", "8"), memory="16g", app="mailrisk-bench")
    for name in WARM_UP:
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        started = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    scale = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": float(scale.group(1)) if scale else sf_dir,
    }))


if __name__ == "__main__":
    main()
