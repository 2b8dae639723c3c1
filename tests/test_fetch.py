"""Rows fetched by address, and the list of slow statements that uses it."""

import pytest
from pyspark.sql import functions as F

from tidelog.checks.queries import journal
from tidelog.operators.fetch import address, at_addresses, has_addresses
from tidelog.plans import analysis

SF = "/root/testdata/sf0.001"


def test_addresses_find_their_rows_and_files(spark):
    events = journal(spark, SF)
    rows = events.select(address().alias("at"), "timestamp", "sql", "line_number", "source_file").orderBy("at").collect()
    assert len({r["at"] for r in rows}) == len(rows) == events.count()
    wanted = rows[5::97]
    found = at_addresses(events, [r["at"] for r in wanted])
    assert sorted(map(tuple, found.select("timestamp", "sql", "line_number", "source_file").collect())) == sorted(tuple(r)[1:] for r in wanted)
    one = at_addresses(events, [rows[0]["at"]])
    assert one.select(F.col("_metadata.file_path")).distinct().count() == 1
    assert not has_addresses(spark.createDataFrame(events.limit(3).collect(), events.schema))


@pytest.mark.parametrize("fetched", [1000, 3, 1])
def test_slow_statements_from_a_store_and_from_rows(spark, monkeypatch, fetched):
    stored = journal(spark, SF)
    # Many statements that tie at the end of the list.
    tied = stored.withColumn("sql", F.concat("sql", F.lit(" "), F.col("line_number") % 7)).withColumn("duration_ms", F.floor(F.col("duration_ms") / 500) * 500.0)
    monkeypatch.setattr(analysis, "FETCHED", fetched)
    for events in (stored, tied):
        for n in (1, 5, 20):
            got = [tuple(r) for r in analysis.slow_queries(events, n).collect()]
            with monkeypatch.context() as patch:
                patch.setattr(analysis, "has_addresses", lambda _: False)
                assert got == [tuple(r) for r in analysis.slow_queries(events, n).collect()]
    assert analysis.slow_queries(stored.where("sql = 'none'")).count() == 0
