"""Headline queries, timed cold and warm. Prints one JSON line; its value is the cold total."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from kolanut.plans.registry import QUERIES  # noqa: E402
from kolanut.session import local_session  # noqa: E402

HEADLINE = (
    "block_parse", "first_json", "compact_json", "record_seed_join", "join_counters", "first_wins_dedupe",
    "reject_histogram", "kept_records", "apply_patch", "patch_minimal_preserved", "render_report", "history_prompt",
    "summary_by_model", "report_pivot", "language_id", "language_switches", "video_brief_score", "mine_grammar",
    "mine_topk", "menu_synthesis", "weighted_draw_wide", "video_sequences", "holdout_split", "holdout_guard",
    "cap_per_group", "exhibit", "shuffle_positions", "mixture", "build_vocab", "encode_mask", "pack_shards", "corpus_stats",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, int(cores) if cores.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("event_type").count().collect()  # starts the engine
    times, warm = {}, {}
    for name in names:
        for into in (times, warm):  # the first run also builds plans and compiles
            spark.catalog.clearCache()
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            into[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "warm": warm, "warm_total": round(sum(warm.values()), 3), "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1], "cpus": cores}))


if __name__ == "__main__":
    main()
