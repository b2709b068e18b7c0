"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from corpusloom.plans import catalog
from corpusloom.session import local_session

# co-occurrence, gram candidates, exact neighbours, PageRank, and two plain scans
HEADLINE = ["c01_cooccurrence", "c06_gram_candidates", "v03_knn", "g02_pagerank", "a02_key_frequency", "v06_query_top"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), memory="20g")
    spark.range(1000).selectExpr("sum(id)").collect()  # start-up is not measured
    seconds = {}
    for name in HEADLINE:
        start = time.time()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": sf_dir}))


if __name__ == "__main__":
    main()
