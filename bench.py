"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import time

from twinline.plans import queries as _  # noqa: F401  registers the queries
from twinline.plans.registry import QUERIES
from twinline.session import get_session

HEADLINE = [
    "shard_manifest",
    "scan_parallel_text",
    "zip_drop_batch",
    "strip_text",
    "drop_empty",
    "cap_pairs",
    "token_ids",
    "pad_fixed",
    "pad_longest",
    "decode_ids",
    "roundtrip_audit",
    "micro_batches",
    "length_sort",
    "length_batches",
    "pack_sequences",
    "random_split",
    "shard_by_rows",
    "shard_by_tokens",
    "length_stats",
    "bleu_sacre",
    "bleu_plain",
    "peak_trace",
    "map_batches",
    "write_shards",
    "publish",
    "raw_corpus",
    "token_corpus",
    "train_batches",
    "running_id",
    "score_from_ids",
    "score_sft",
    "sft_rows",
    "sft_blocks",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = get_session("bench", f"local[{cpus}]", cpus, "12g")
    spark.sparkContext.setLogLevel("ERROR")
    run = lambda name: QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    run("shard_manifest")  # starts the session's code paths once, untimed
    seconds, jobs = {}, {}
    for name in HEADLINE:
        spark.sparkContext.setJobGroup(name, name)
        start = time.perf_counter()
        run(name)
        seconds[name] = round(time.perf_counter() - start, 3)
        jobs[name] = len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
    total = round(sum(seconds.values()), 3)
    sf = os.path.basename(sf_dir).removeprefix("sf")
    result = {"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": seconds, "jobs": jobs, "sf": sf}
    print(json.dumps(result))


if __name__ == "__main__":
    main()
