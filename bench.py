"""Times the headline queries once each and prints one JSON line.

The fixtures that several queries share are made before the clock starts; ``fixtures`` is their
time.
"""

import json
import os
import time

from pyspark.sql import SparkSession

from heedline import catalog, configure
from heedline.catalog import nested, selection, views

HEADLINE = [
    "h2_content_hash",
    "h6_mail_date",
    "s2_upsert_messages",
    "s3_upsert_cache",
    "p4_search_literal",
    "p6_lookup_by_prefix",
    "j2_gists_with_message",
    "j3_unclassified_messages",
    "j5_failed_messages",
    "j9_missing_attachments",
    "a6_short_ids",
    "a7_one_task_per_content",
    "a8_attachment_statuses",
    "l2_top_k",
    "n2_body_parts",
    "n7_flatten_messages",
    "n8_gist_validation",
    "n9_invoice_totals",
    "c1_cached_inference",
    "t1_stream_ingest",
    "b2_analyze",
    "b3_gists",
    "b4_list",
    "b10_reply_drafts",
]


def prepare(spark: SparkSession, sf_dir: str) -> None:
    v = views.Views.of(configure(spark), sf_dir)
    for table in (v.messages, v.cache, v.all_cache, v.attachments, nested.payloads(v), selection.unique_cache(v)):
        table.count()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("heedline-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.queries()
    only = os.environ.get("BENCH_QUERIES")
    names = only.split(",") if only else HEADLINE
    spark.range(1).count()
    start = time.perf_counter()
    prepare(spark, sf_dir)
    fixtures = round(time.perf_counter() - start, 3)

    seconds = {}
    for name in names:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "fixtures": fixtures,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
