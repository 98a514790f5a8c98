"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import contextlib
import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "profile_numeric", "profile_missing", "profile_categorical", "dataset_fingerprint", "infer_datetime",
    "src_csv", "ks_drift", "scorecard", "retrain_decision", "tenant_route", "invoice_flat",
    "vendor_vs_market", "negotiation_opps", "price_change", "forecast", "unify_features", "insight_report",
    "root_cause", "kpi_history", "onb_dashboard", "benefits_summary", "chunk_sentences", "embed_hash",
    "vector_topk", "kb_answer", "escalate", "st_usage", "iforest",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = os.environ.get("BENCH_QUERIES")
    from beaconry.plans import load_all
    from beaconry.session import build_session

    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    registry = load_all()
    names = only.split(",") if only else HEADLINE
    warm = os.environ.get("BENCH_WARM_DIR", "/root/testdata/sf0.001")
    if os.path.isdir(warm):  # class loading and code generation are not part of any query
        for name in names:
            registry[name](spark, warm).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in names:
        begin = time.perf_counter()
        registry[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - begin, 3)
        print(f"{name}: {times[name]}", file=sys.stderr, flush=True)
    with contextlib.suppress(Exception):
        spark.stop()
    print(json.dumps({
        "metric": "headline queries, total time", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
