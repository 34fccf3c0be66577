"""Times the headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line.

Each query runs once to warm up and then three times to a sink that keeps
nothing; the median counts.
"""

import json
import os
import statistics
import time

from axonspark.session import session

HEADLINE = ("orn_inputs_by_side", "orn_inputs", "neurons_tagged", "edges_by_neuropil", "edges_total", "membership", "partners_view", "inputs", "outputs", "conn_topk", "agg_sum_mean", "query_exact", "ln_search", "connections_by_ids", "hist_bins", "heatmap_cells")


def main() -> None:
    d, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = session("bench", spark__master=f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__driver__memory="8g", spark__ui__enabled="false", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    from axonspark.plans.registered import QUERIES

    took = {}
    for name in HEADLINE:
        runs = []
        for _ in range(4):
            t = time.perf_counter()
            QUERIES[name](spark, d).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - t)
        took[name] = round(statistics.median(runs[1:]), 3)
    sf = os.path.basename(d.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))


if __name__ == "__main__":
    main()
