"""Time the headline queries and print one JSON line.

Settings by environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS
(default 8), BENCH_RUNS (default 1 timed run after one warm-up of the session).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from functools import partial

from check import local_session
from workload import queries as q

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", "8"))
RUNS = int(os.environ.get("BENCH_RUNS", "1"))

SEARCH = q.po.Search(population=40, elite=4, tournament=6, generations=10, seed=3)


def index_long(spark, sf_dir):
    """Three series with 100,000 rows and more each at sf0.1, by sample sort."""
    return q.se.index_series(q.observations(spark, sf_dir, q.FLAG_KEY), q.SeriesLayout(block_rows=20_000))


QUERIES = {
    "index_series": q.QUERIES["index_series"],
    "index_series_long": index_long,
    "change_rate": q.QUERIES["change_rate"],
    "mine_all_rules": q.QUERIES["mine_all_rules"],
    "forecast_multiorder": q.QUERIES["forecast_multiorder"],
    "score_models": q.score_models,
    "evaluate_population_relational": partial(q.evaluate, "relational"),
    "evaluate_population_batch": partial(q.evaluate, "batch"),
    "next_generation": q.next_generation,
}
#: A whole search is timed on the smaller scale beside SF_DIR, if there is one.
SEARCH_DIR = os.path.join(os.path.dirname(SF_DIR.rstrip("/")), "sf0.01")


def timed(spark, query, sf_dir: str) -> float:
    start = time.perf_counter()
    query(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    spark = local_session(CPUS)
    small = SEARCH_DIR if os.path.isdir(SEARCH_DIR) else SF_DIR
    timed(spark, q.score_models, small)  # start the JVM's compilers
    seconds = {}
    for name, query in QUERIES.items():
        seconds[name] = statistics.median(timed(spark, query, SF_DIR) for _ in range(RUNS))
        print(f"{name}: {seconds[name]:.2f}s", file=sys.stderr, flush=True)
    name = f"fit_cuts_pop40_gen10_{os.path.basename(small)}"
    seconds[name] = timed(spark, partial(q.fit_cuts, search=SEARCH), small)
    print(f"{name}: {seconds[name]:.2f}s", file=sys.stderr, flush=True)
    rounded = {k: round(v, 3) for k, v in seconds.items()}
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(rounded.values()), 3), "unit": "sec",
        "queries": rounded, "sf": os.path.basename(SF_DIR.rstrip("/")), "cpus": CPUS,
    }))


if __name__ == "__main__":
    main()
