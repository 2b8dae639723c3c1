"""Pages, quantiles, numbering and interval lookup against brute force."""

import random
from datetime import datetime, timedelta
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tidelog.operators.filters import EventFilter, check_interval
from tidelog.operators.intervals import first_overlap
from tidelog.operators.numbering import number_within
from tidelog.operators.paging import after_row, check_page, page_totals, take_slice
from tidelog.operators.quantiles import exact_quantiles

START = datetime(2026, 3, 10, 5)
KEYS = ["timestamp", "directory_name", "source_file", "line_number", "session_id"]


@pytest.fixture(scope="module")
def events(spark):
    """Few distinct times and levels, so that ties and hot values are common."""
    rng = random.Random(5)
    rows = []
    for i in range(700):
        hot = i % 3 == 0
        ts = START if hot else START + timedelta(seconds=rng.randrange(0, 90_000, 700), microseconds=rng.choice([0, 5]))
        rows.append(
            (
                ts,
                "ib0" if hot else f"ib{rng.randrange(3)}",
                "26031005.log",
                i,
                "s1",
                rng.choice(["CALL", "SDBL"]),
                rng.randrange(3),
                float(rng.choice([1, 2, 2.5, 1500, 2_000_000.125])),
            )
        )
    schema = (
        "timestamp timestamp_ntz, directory_name string, source_file string, line_number bigint, "
        "session_id string, event_name string, level int, duration_ms double"
    )
    return spark.createDataFrame(rows, schema).coalesce(1).cache()


def in_order(rows, sort_by, sort_order):
    """Python's stable sorts, least significant key first."""
    up = sort_order == "asc"
    out = sorted(rows, key=lambda r: [r[k] for k in KEYS[1:]])
    out.sort(key=lambda r: r["timestamp"], reverse=not up)
    out.sort(key=lambda r: r[sort_by], reverse=not up)
    return out


@pytest.mark.parametrize(
    "sort_by, sort_order", [("timestamp", "desc"), ("duration_ms", "asc"), ("event_name", "desc"), ("level", "asc")]
)
def test_deep_slices_match_a_full_sort(events, sort_by, sort_order):
    want = in_order(events.collect(), sort_by, sort_order)
    for offset, limit in ((233, 40), (690, 40)):
        deep = take_slice(events, offset, limit, sort_by, sort_order, shallow_rows=60).collect()
        assert deep == want[offset : offset + limit], (offset, limit)
    assert take_slice(events, 233, 40, sort_by, sort_order).collect() == want[233:273]


def test_a_slice_beyond_the_last_row_is_empty(events):
    assert take_slice(events, 900, 5, "level", "asc", shallow_rows=60).collect() == []


def test_pages_by_offset_and_by_last_row_cover_everything(events):
    want = in_order(events.collect(), "level", "desc")
    pages, last = [], None
    while True:
        if last is None:
            page = take_slice(events, 0, 90, "level", "desc").collect()
        else:
            page = after_row(events, last.asDict(), 90, "level", "desc").collect()
        if not page:
            break
        pages += page
        last = page[-1]
    assert pages == want
    totals = page_totals(events, 90).first()
    assert (totals.total, totals.total_pages) == (700, 8)


def test_page_limits():
    assert check_page(3, 50) == (100, 50)
    for bad in ((0, 10), (1, 0), (1, 1001)):
        with pytest.raises(ValueError):
            check_page(*bad)
    with pytest.raises(ValueError):
        check_interval(START, START)


def test_filters_narrow_down(events):
    every = events.count()
    assert events.where(EventFilter().predicate()).count() == every
    assert events.where(EventFilter(event_name="", user="").predicate()).count() == every
    one = events.where(EventFilter(event_name="CALL").predicate()).count()
    two = events.where(EventFilter(event_name="CALL", level_min=1, max_duration_ms=100).predicate()).count()
    assert every > one > two > 0
    bounds = EventFilter().within(START.replace(microsecond=1500), START + timedelta(days=1))
    assert bounds.time_from == START.replace(microsecond=1000)
    assert EventFilter(time_from="2026-01-01").within(START, START).time_from == "2026-01-01"


def test_search_text_is_literal_unless_asked(spark):
    df = spark.createDataFrame([("a%b_c", "", ""), ("axbyc", "", ""), ("A%B_C", "", "")], "context string, sql string, sdbl string")
    assert df.where(EventFilter(search="a%b_c").predicate()).count() == 1
    assert df.where(EventFilter(search="a%b_c", search_mode="like").predicate()).count() == 2
    assert df.where(EventFilter(search="' OR 1=1 --").predicate()).count() == 0


def test_quantiles_match_brute_force(spark):
    rng = random.Random(3)
    groups = {
        "hot": [rng.choice([5, 7, 7, 123_456, rng.randrange(10**9)]) for _ in range(2000)],
        "one": [42],
        "two": [10, 11],
        "same": [9] * 50,
        "edge": [9_999, 10_000, 19_999, 20_000, 0],
    }
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("none", None)]
    df = spark.createDataFrame(rows, "g string, v bigint")
    wanted = {"med": Fraction(1, 2), "p95": Fraction(19, 20), "low": Fraction(0), "top": Fraction(1)}

    def brute(values, f):
        ordered = sorted(values)
        at = f * (len(ordered) - 1)
        low = int(at)
        high = min(low + 1, len(ordered) - 1)
        return float(ordered[low] + (at - low) * (ordered[high] - ordered[low]))

    got = {r.g: r for r in exact_quantiles(df, "v", wanted, ["g"]).collect()}
    assert set(got) == set(groups)
    for g, values in groups.items():
        for name, f in wanted.items():
            assert got[g][name] == pytest.approx(brute(values, f), rel=1e-12), (g, name)
    whole = exact_quantiles(df, "v", wanted).first()
    everything = [v for vs in groups.values() for v in vs]
    assert whole["p95"] == pytest.approx(brute(everything, Fraction(19, 20)))


def test_numbering_by_cells_equals_row_number(spark):
    rng = random.Random(1)
    rows = [("hot" if i % 3 else f"g{i % 7}", rng.randrange(500), i) for i in range(900)]
    df = spark.createDataFrame(rows, "g string, t int, i int")
    got = number_within(df, ["g"], F.floor(F.col("t") / 10), ["t", "i"], "n").collect()
    want, seen = {}, {}
    for g, t, i in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        seen[g] = seen.get(g, 0) + 1
        want[i] = seen[g]
    assert {r.i: r.n for r in got} == want


def test_first_overlap_matches_brute_force(spark):
    rng = random.Random(9)

    def interval():
        start = START + timedelta(minutes=rng.randrange(0, 3000, 5))
        return start, start + timedelta(minutes=rng.randrange(0, 200, 5))

    busy = [(f"s{i}", *interval()) for i in range(60)] + [("same", START, START), ("same0", START, START)]
    asked = [(i, *interval()) for i in range(150)] + [(999, START, START)]
    intervals = spark.createDataFrame(busy, "id string, start_date timestamp_ntz, end_date timestamp_ntz")
    requests = spark.createDataFrame(asked, "request int, start_date timestamp_ntz, end_date timestamp_ntz")
    got = {r.request: (r.overlap_id, r.overlap_start) for r in first_overlap(requests, intervals).collect()}
    for request, start, end in asked:
        hits = [(s, i) for i, s, e in busy if s <= end and e >= start]
        best = min(hits) if hits else (None, None)
        assert got[request] == (best[1], best[0])
    assert len(got) == len(asked)
    free = first_overlap(requests, intervals.limit(0)).where("overlap_id is not null")
    assert free.count() == 0
