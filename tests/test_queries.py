"""Every registered query against its SQL counterpart, and the plans of some."""

from datetime import datetime
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as contract
from check import normal
from tidelog.checks.oracle import ORACLE
from tidelog.checks.queries import PAGE_FILTER, QUERIES, RATIO_FILTER, cascade, journal, session_rows
from tidelog.operators.paging import take_slice
from tidelog.plans import analysis, report, search
from tidelog.plans.sessions import filtered_sessions

SF, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def oracle():
    def run(folder, name):
        con = duckdb.connect()
        for path in Path(folder).glob("*.parquet"):
            con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
        return con.execute(ORACLE[name]).df()

    return run


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, oracle, name):
    # The deep pages start beyond the rows of the smallest tables.
    folder = LARGER if name.startswith("deep_page") else SF
    got, want = QUERIES[name](spark, folder).toPandas(), oracle(folder, name)
    assert sorted(got.columns) == sorted(want.columns)
    assert len(want) and normal(got) == normal(want)


def test_cascade_leaves_all_other_sessions_of_the_whole_journal(spark):
    rows = journal(spark, LARGER)
    gone = {f"s_2024010{day}" for day in range(1, 5)}
    files, events = {}, {}
    for r in rows.select("session_id", "directory_name", "source_file").collect():
        files.setdefault(r[0], set()).add((r[1], r[2]))
        events[r[0]] = events.get(r[0], 0) + 1
    assert gone < set(events) and len(events) > 20
    want = {(s, len(files[s]), len(files[s]), events[s]) for s in events if s not in gone}
    got = cascade(spark, rows).select("session_id", "total_files", "files", "events").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_every_query_is_registered(spark):
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(contract.queries()) and set(ORACLE) <= set(contract.oracle_sql())


def test_plans_of_the_top_lists(spark):
    j = journal(spark, SF)
    errors = physical(analysis.top_errors(j))
    assert "SortAggregate" not in errors and "WindowGroupLimit" in errors
    exchanges = [line for line in physical(analysis.slow_queries(j)).splitlines() if "Exchange hashpartitioning(" in line]
    assert exchanges and not any("hashpartitioning(sql" in line for line in exchanges)
    deep = physical(take_slice(journal(spark, LARGER), 6000, 40, "duration_ms", "asc", shallow_rows=100))
    assert "GreaterThanOrEqual(duration_ms" in deep and "LessThan(duration_ms" in deep


def test_entry(spark):
    assert contract.entry(spark).count() == 20
    assert set(contract.oracle_sql()) <= set(contract.queries())


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["slow_top20", "latest_db_errors", "search_page", "analysis_events_page", "nth_event", "export_rows"])
def test_top_k_never_sorts_everything(spark, name):
    plan = physical(contract.queries()[name](spark, SF))
    assert "TakeOrderedAndProject" in plan
    assert "Exchange rangepartitioning" not in plan


def test_filters_reach_the_scan(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    plan = physical(search.count_events(journal(spark, SF), PAGE_FILTER))
    assert "GreaterThanOrEqual(duration_ms,100.0)" in plan
    assert "GreaterThanOrEqual(timestamp,2024-01-03T00:00" in plan
    scan = next(line for line in plan.splitlines() if "FileScan" in line)
    assert "exception" not in scan.split("ReadSchema")[1]


def test_analysis_parts_agree(spark):
    j = journal(spark, SF)
    parts = analysis.analysis(j, RATIO_FILTER)
    kept = j.where(RATIO_FILTER.predicate())
    total = parts["summary"].first()["total"]
    assert total == kept.count() == analysis.summary(kept).first()["total"]
    assert parts["summary"].collect() == analysis.summary(kept).collect()
    for part, column in (("event_types", "event_name"), ("severity_distribution", "severity")):
        assert sum(r["cnt"] for r in parts[part].collect()) == total
        assert parts[part].columns == [column, "cnt"]
    assert parts["directories"].collect() == analysis.directories(kept).collect()
    assert parts["timeline"].count() <= 300
    parts["base"].unpersist()


def test_report_parts_and_approximation(spark):
    j = journal(spark, SF)
    parts = report.report(j)
    exact, rough = parts["summary"].first(), report.report_summary(j, approx=True).first()
    assert exact.total_events == rough.total_events == j.count()
    assert abs(exact.unique_users - rough.unique_users) <= 0.1 * exact.unique_users
    near, close = parts["duration_stats"].first(), report.duration_stats(j, approx=True).first()
    assert close.median == pytest.approx(near.median, rel=0.05)
    assert close.p95 == pytest.approx(near.p95, rel=0.05)
    assert analysis.summary(j, approx=True).first()["dir_count"] == 5


def test_empty_set_gives_empty_answers(spark):
    none = journal(spark, SF).where("event_name = 'no such event'")
    row = analysis.summary(none).first()
    assert (row.total, row.min_ts, row.max_ts, row.dir_count) == (0, None, None, 0)
    row = report.report_summary(none).first()
    assert (row.total_events, row.unique_users, row.events_per_second) == (0, 0, None)
    assert report.duration_stats(none).first()["median"] is None
    assert search.count_events(none, PAGE_FILTER).first().total_pages == 0


def test_unreadable_session_dates_are_no_filter(spark):
    rows = session_rows(spark, SF)
    every = rows.count()
    assert filtered_sessions(rows, "all", "yesterday", None).count() == every
    assert filtered_sessions(rows, "failed").count() == 0
    assert filtered_sessions(rows, None, datetime(2024, 1, 11), "2024-01-20T00:00:00").count() == 9
