"""Times the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from duoscope.queries import REGISTRY  # noqa: E402
from duoscope.session import get_session  # noqa: E402

HEADLINE = [
    "tree_best_split", "tree_thresholds", "tree_expand_deep", "tree_prune", "tree_sweep", "win_rank_items",
    "enc_user_tri", "enc_user_predicted", "enc_item", "job_export_dyads", "vec_project", "ml_score", "agg_gradient",
    "ml_sgd", "ml_grid", "ml_assign", "ml_label_users", "job_gradient_bench", "src_tree_text", "agg_hit_rate",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session("bench", f"local[{cpus}]", spark_sql_shuffle_partitions=cpus, spark_driver_memory="12g",
                        spark_ui_enabled="false")
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()  # start-up is not part of any query
    only = sys.argv[1:] or HEADLINE
    seconds = {}
    for name in only:
        start = time.time()
        REGISTRY[name][0](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
