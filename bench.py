"""Times the headline queries and prints one JSON line.

    BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8)

Each query is built, planned and run to the end into a sink that discards the rows:
once to warm up, then once for the time. ``pages_per_sec`` is the end-to-end rate of
the plain page extraction. The given page table is one row group, which one task would
have to read; it is written again in as many files as there are cores, before the clock starts.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from contactlake.operators import extract  # noqa: E402
from contactlake.plans import queries  # noqa: E402
from contactlake.session import build_session  # noqa: E402

HEADLINE = [
    "page_contacts",
    "document_contacts",
    "html_text",
    "page_links",
    "normalize_url",
    "valid_phones",
    "valid_emails",
    "validation_funnel",
    "contact_dedup",
    "link_edges",
    "dedup_pages",
    "set_operations",
    "page_budget",
    "crawl_progress",
    "reachable_pages",
    "site_contacts",
    "batch_contacts",
]


def run(frame) -> None:
    frame.write.format("noop").mode("overwrite").save()


def timed(make) -> float:
    run(make())
    start = time.perf_counter()
    run(make())
    return round(time.perf_counter() - start, 3)


def spread_pages(spark, sf_dir: str, n: int) -> str:
    """A scratch folder with the given tables, pages in ``n`` files."""
    folder = tempfile.mkdtemp(prefix="bench-")
    for path in Path(sf_dir).glob("*.parquet"):
        if path.name != "pages.parquet":
            os.symlink(path.resolve(), f"{folder}/{path.name}")
    spark.read.parquet(f"{sf_dir}/pages.parquet").repartition(n).write.parquet(f"{folder}/pages.parquet")
    return folder


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__driver__memory="12g",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__log__level="ERROR",
    )
    name, sf_dir = Path(sf_dir).name, spread_pages(spark, sf_dir, int(cpus))
    pages = queries.web_pages(spark, sf_dir)
    rows = pages.count()
    times = {"given_pages": timed(lambda: extract.page_contacts(queries.web_pages(spark, sf_dir)))}
    for name in HEADLINE:
        times[name] = timed(lambda: queries.QUERIES[name](spark, sf_dir))
    result = {
        "metric": "headline queries, total time",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": name.removeprefix("sf"),
        "pages_per_sec": round(rows / times["given_pages"]),
        "cores": int(cpus),
        "partitions": pages.rdd.getNumPartitions(),
    }
    spark.stop()
    print(json.dumps(result))


if __name__ == "__main__":
    main()
