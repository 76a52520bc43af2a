"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from citespark import queries as registry
from citespark.plans.flagship import coupled_output
from citespark.session import build_session

HEADLINE = [
    "read_scopus", "first_wins_dedupe", "min_citation_pruning", "assemble_publications", "author_countries",
    "bib_coupling", "co_citation", "coupling_jaccard", "node_percent_rank_cut", "internal_degree", "modularity",
    "direct_citation_network", "main_info", "pub_summary_general", "community_year_panel", "two_mode_period",
    "diversity_internal", "term_counts", "ngrams", "term_saliency", "topic_distance", "louvain", "doc_topics",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = os.environ.get("BENCH_QUERIES")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"),
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    registry.load()
    todo = {"flagship": coupled_output, **{name: registry.QUERIES[name] for name in HEADLINE}}
    if only:
        todo = {k: v for k, v in todo.items() if k in only.split(",")}
    spark.range(1000).selectExpr("sum(id)").collect()  # start the executor threads
    seconds: dict[str, float] = {}
    for name, run in todo.items():
        begin = time.perf_counter()
        run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - begin, 3)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
