"""Time the headline queries: prints one JSON line.

``BENCH_SF_DIR`` names the table folder, ``BENCH_CPUS`` the local cores, ``BENCH_RUNS`` how often
each query runs (the median counts). Every query's whole result is computed and thrown away.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from feedloom.plans import catalog  # noqa: E402
from feedloom.session import local_session  # noqa: E402

HEADLINE = (
    "ratings_prepare", "eval_candidates", "hr_ndcg_at_k", "train_epoch", "negatives_anti",
    "shuffle_seeded", "batch_rows", "sort_multi", "interleave_round_robin", "bucket_by_length",
    "sweep_summary", "worker_step_series", "zero_index", "pearson_spearman", "tagging_span_f1",
    "basic_tokenize", "token_counts", "vocab_encode", "wordpiece", "masked_lm", "segment_stream",
    "doc_stride_windows", "em_f1_no_answer", "bleu", "pairwise_iou_join", "box_matching", "nms",
    "gap", "cache_put", "cache_get",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, "feedloom-bench")
    queries = catalog.all_queries()
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_returnflag").count().collect()  # warm up
    times = {}
    for name in names:
        spent = []
        for _ in range(runs):
            start = time.time()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            spent.append(time.time() - start)
        times[name] = round(statistics.median(spent), 3)
        print(f"{name}: {times[name]}", file=sys.stderr, flush=True)
    out = {
        "metric": "total seconds of the headline queries", "value": round(sum(times.values()), 3),
        "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(out))


if __name__ == "__main__":
    main()
