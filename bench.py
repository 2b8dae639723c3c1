"""Headline timings as one JSON line.

Data: $BENCH_SF_DIR (default /root/testdata/sf0.1), cores: $BENCH_CPUS
(default 8). Queries run on the stored event table after one warm-up, median of
three. ``ingest`` parses the whole journal, rendered as log files beforehand,
into the event table: 3600 small hour files, so mostly the cost of files.
``ingest_large`` parses five copies of it in one file per directory and day,
``ingest_2kb`` events of some 2 KB in such files, for the rate by bytes.
``value`` is the sum of the medians and the time to store the event table.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))

from pyspark.sql import DataFrame  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from tidelog.checks.queries import QUERIES, rendered  # noqa: E402
from tidelog.plans.ingest import ingest  # noqa: E402
from tidelog.session import build_session, scratch_path  # noqa: E402
from tidelog.sources.journal_view import LOADED_AT, stored_journal, stored_journal_path  # noqa: E402
from tidelog.sources.render import record_text, write_files  # noqa: E402
from tidelog.sources.files import Layout, list_files  # noqa: E402
from tidelog.sources.store import EventStore, footprint  # noqa: E402

HEADLINE = [
    "slow_top20",
    "latest_db_errors",
    "search_page",
    "search_page_after",
    "search_count",
    "nth_event",
    "analysis_events_page",
    "event_types",
    "users",
    "error_facet",
    "analysis_summary",
    "filter_ratio",
    "types_top20",
    "severity_dist",
    "timeline_second",
    "report_summary",
    "duration_stats",
    "top_users",
    "session_reports",
    "session_durations",
    "session_tops",
    "session_overlap",
    "slow_sql",
    "top_errors",
    "problem_tables",
    "export_rows",
]


def run(frame) -> None:
    frame.write.format("noop").mode("overwrite").save()


def timed(action, repeat: int = 3) -> float:
    action()
    times = []
    for _ in range(repeat):
        started = time.perf_counter()
        action()
        times.append(time.perf_counter() - started)
    return round(statistics.median(times), 4)


def copies(events: DataFrame, n: int = 5) -> DataFrame:
    """Each event n times, in one file per directory and day."""
    day_file = F.concat(F.substring("source_file", 1, 6), F.lit("00.log"))
    hour, line = F.hour("timestamp").cast("bigint"), F.col("line_number")
    return (
        events.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
        .withColumn("line_number", (hour * 100_000_000 + line) * n + F.col("copy"))
        .withColumn("source_file", day_file)
    )


def wide_events(events: DataFrame) -> DataFrame:
    """The events with a statement and a context of several lines, some 2 KB together."""
    statement = F.repeat(F.lit("SELECT T1._IDRRef, T1._Description FROM _Reference42 T1 WHERE T1._Code = 'x'\n"), 12)
    stack = F.repeat(F.lit("CommonModule.Exchange : 1042 : Result = Query.Execute().Unload();\n"), 14)
    return events.withColumns({"sql": F.concat("sql", statement), "context": F.concat("context", stack)})


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = build_session(
        app="tidelog-bench",
        master=f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": str(cpus),
            "spark.driver.memory": "16g",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    started = time.perf_counter()
    events = stored_journal(spark, sf_dir).count()
    store_seconds = time.perf_counter() - started
    queries = {name: timed(lambda n=name: run(QUERIES[n](spark, sf_dir))) for name in HEADLINE}

    layout = rendered(spark, sf_dir, "plain")
    store = EventStore(spark, scratch_path(spark, "bench-store"))
    queries["ingest"] = timed(lambda: ingest(spark, store, layout, "bench", LOADED_AT).count(), repeat=1)

    wide = scratch_path(spark, "logs-large")
    write_files(copies(stored_journal(spark, sf_dir)), record_text(), wide).write.format("noop").mode("overwrite").save()
    large = EventStore(spark, scratch_path(spark, "bench-large"))
    started = time.perf_counter()
    loaded = ingest(spark, large, Layout(wide, parts=True), "bench", LOADED_AT).agg(F.sum("events")).first()[0]
    queries["ingest_large"] = round(time.perf_counter() - started, 4)

    long_text = scratch_path(spark, "logs-2kb")
    write_files(wide_events(copies(stored_journal(spark, sf_dir), 1)), record_text(), long_text).write.format("noop").mode("overwrite").save()
    layout_2kb = Layout(long_text, parts=True)
    mb = list_files(spark, layout_2kb).agg(F.sum("file_size")).first()[0] / 1e6
    started = time.perf_counter()
    ingest(spark, EventStore(spark, scratch_path(spark, "bench-2kb")), layout_2kb, "bench", LOADED_AT).count()
    queries["ingest_2kb"] = round(time.perf_counter() - started, 4)

    sizes = footprint(spark, stored_journal_path(spark, sf_dir)).groupBy().sum("n_bytes").first()[0]
    print(
        json.dumps(
            {
                "metric": "journal_queries_and_ingest",
                "value": round(sum(queries.values()) + store_seconds, 3),
                "unit": "sec",
                "queries": queries,
                "sf": Path(sf_dir).name,
                "cores": cpus,
                "events": events,
                "journal_store_sec": round(store_seconds, 3),
                "ingest_events_per_sec": round(events / queries["ingest"], 1),
                "ingest_events_per_sec_per_core": round(events / queries["ingest"] / cpus, 1),
                "ingest_large_events": loaded,
                "ingest_large_events_per_sec": round(loaded / queries["ingest_large"], 1),
                "ingest_large_events_per_sec_per_core": round(loaded / queries["ingest_large"] / cpus, 1),
                "ingest_2kb_mb": round(mb, 1),
                "ingest_2kb_mb_per_sec_per_core": round(mb / queries["ingest_2kb"] / cpus, 2),
                "ingest_2kb_events_per_sec_per_core": round(events / queries["ingest_2kb"] / cpus, 1),
                "bytes_per_event_stored": round(sizes / events, 1),
            }
        )
    )


if __name__ == "__main__":
    main()
