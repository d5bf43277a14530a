"""Times the headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

import json
import os
import time

from ledgerloom.plans import catalog
from ledgerloom.session import session

HEADLINE = [
    "convert_bulk",
    "txn_dedupe_first",
    "category_lookup",
    "parse_date",
    "financial_rows",
    "clean_lines",
    "strip_header_footer",
    "words_outside_tables",
    "paragraph_merge",
    "column_detect",
    "html_text",
    "html_markdown",
    "merge_consolidated",
    "job_queue_position",
    "job_eta",
    "events_session",
]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = session(f"local[{cpus}]", {"spark.sql.shuffle.partitions": cpus})
    queries, took = catalog.queries(), {}
    for name in HEADLINE:
        seconds = []
        for _ in range(2):  # the second run is without compilation
            began = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds.append(time.perf_counter() - began)
        took[name] = round(min(seconds), 3)
    print(json.dumps({"metric": "total_sec", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
