"""Header, property, error-code and reject rules on hand-written records."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidelog.functions.codes import describe_error, error_code
from tidelog.functions.text import property_arrays, property_values
from tidelog.schema import EVENT_COLUMNS, PROPERTY_COLUMNS

US = lambda *t: datetime(2026, 3, 10, *t)


def rows_by_line(frame):
    return {row.line_number: row for row in frame.collect()}


def test_header_and_time(logs, load):
    logs(
        "ib/26031005.log",
        "05:59.123-1500,DBMSSQL,3,Usr=x\n"
        "05:59.1234567-10, CALL , 2, Usr=y\n"
        "05:61.1-1,EXCP,1,\n"
        "05:60.1-1,EXCP,1,a=b\n"
        "05:59.1-10,CALL,1,Descr=z\n"
        "5:59.1-1,EXCP,1,\n"
        "05:59.1-10,CALL,2\n"
        "60:00.0-1,CALL,1,\n"
        "06:00.0-99999999999999999999,CALL,1,\n"
        "06:00.0-1,CALL,256,\n"
        "06:00.0-1,CALL,255,Context='native=4294967296'\n"
        "06:00.0-1,CALL,255,Context='native=4294967295'",
    )
    result = load(logs)
    events, rejects = rows_by_line(result.events), rows_by_line(result.rejects)
    assert sorted(events) == [1, 2, 5, 10]
    assert result.events.columns == EVENT_COLUMNS
    first = events[1]
    assert first.timestamp == US(5, 5, 59, 123000)
    assert (first.duration_us, first.duration_ms, first.event_name, first.level) == (1500, 1.5, "DBMSSQL", 3)
    assert events[2].timestamp == US(5, 5, 59, 123456)
    assert (events[2].event_name, events[2].level, events[2].usr) == ("CALL ", 2, "y")
    # Two lines that only look like headers belong to the record before them.
    assert rejects == {k: v for k, v in rejects.items() if k in (3, 4, 6, 7, 8, 9)}
    assert {k: v.reason for k, v in rejects.items()} == {
        3: "bad_time",
        4: "bad_time",
        6: "bad_time",
        7: "bad_duration",
        8: "level_out_of_range",
        9: "error_code_out_of_range",
    }
    assert events[10].mssql_error_code == 4294967295
    assert first.loaded_at == datetime(2026, 3, 11)
    assert str(first.event_date) == "2026-03-10" and first.session_id == "s1"


PROPERTIES = [
    # a quoted part is a piece of its value wherever it stands, and nothing after it is lost
    ("Sql='q'tail,Usr=u", {"Sql": "'q'tail", "Usr": "u"}),
    ("Sql='q, Usr=a'tail,Ctx=1", {"Sql": "'q, Usr=a'tail", "Usr": None, "Ctx": "1"}),
    ("Description=x 'a, Usr=c' y,Txt=2", {"Description": "x 'a, Usr=c' y", "Usr": None, "Txt": "2"}),
    ("Txt=don't,Usr=u", {"Txt": "don't", "Usr": "u"}),
    ("Txt='a' and 'b',Usr=u", {"Txt": "'a' and 'b'", "Usr": "u"}),
    ("Txt=\"it's, \"\"so\"\"\",Usr=u", {"Txt": "it's, \"so\"", "Usr": "u"}),
    ("Usr=Ann,Rows=3", {"Usr": "Ann", "Rows": "3"}),
    ("Sql='SELECT a, b'", {"Sql": "SELECT a, b"}),
    ("Sql='it''s'", {"Sql": "it's"}),
    ("""Context="a ""q"" 'z'\"""", {"Context": "a \"q\" 'z'"}),
    ("Usr=,Rows=5,Func=", {"Usr": "", "Rows": "5", "Func": ""}),
    ("Rows=1,Rows=2", {"Rows": "2"}),
    ("abc,Usr=x", {"Usr": "x"}),
    ("Descr=a=b", {"Descr": "a=b"}),
    ("Context='l1\nl2',Usr=x", {"Context": "l1\nl2", "Usr": "x"}),
    ("Descr=don't,Usr=x", {"Descr": "don't", "Usr": "x"}),
    ("Sql='abc, Rows=1", {"Sql": "'abc", "Rows": "1"}),
    (" p:processName=main , Usr=x", {"p:processName": "main", "Usr": "x"}),
    ("Usr= 'a, b' ,Rows=1", {"Usr": "a, b", "Rows": "1"}),
    ("Usr='',Func=\"\"", {"Usr": "", "Func": ""}),
    ("Usr=x,", {"Usr": "x"}),
    ("", {"Usr": None}),
]


def test_properties(spark):
    keys = sorted({k for _, want in PROPERTIES for k in want})
    df = spark.createDataFrame([(i, text) for i, (text, _) in enumerate(PROPERTIES)], "i int, props string")
    k, v = property_arrays(F.col("props"))
    got = df.select("i", property_values(k, v, keys).alias("found")).orderBy("i").collect()
    for row, (text, want) in zip(got, PROPERTIES):
        assert dict(zip(keys, row.found)) == {key: want.get(key) for key in keys}, text


def test_properties_of_a_megabyte(spark):
    big = "x'" * 500_000
    texts = ["Sql='" + big.replace("'", "''") + "',Usr=u", "no equals sign " * 70_000 + ",Usr=u", "Sql='" + "a" * 1_000_000]
    df = spark.createDataFrame([(t,) for t in texts], "props string")
    k, v = property_arrays(F.col("props"))
    found = df.select(property_values(k, v, ["Sql", "Usr"]).alias("f"))
    rows = found.select(F.col("f")[0].alias("s"), F.col("f")[1].alias("u")).collect()
    assert rows[0].s == big and rows[0].u == "u"
    assert rows[1].s is None and rows[1].u == "u"
    assert len(rows[2].s) == 1_000_001


def test_fallback_key_and_cut(logs, load):
    long = "s" * 120_000
    logs(
        "ib/26031005.log",
        f"00:01.0-1,A,1,SQL='one'\n00:02.0-1,A,1,SQL='two',Sql=''\n00:03.0-1,A,1,Context='{long} native=7'\n"
        "00:04.0-1,A,1,Unknown=1,Rows=12,RowsAffected=x",
    )
    events = rows_by_line(load(logs).events)
    assert [events[i].sql for i in (1, 2)] == ["one", ""]
    assert len(events[3].context) == 100_000
    assert events[3].mssql_error_code == 7  # found beyond the stored part
    assert (events[4].rows, events[4].rows_num, events[4].rows_affected_num) == ("12", 12, None)
    for name in PROPERTY_COLUMNS.values():
        assert getattr(events[4], name) is not None


CODES = [
    (("native=1205", "", ""), 1205),
    (("Error: 2627", "", ""), 2627),
    (("SQLState=40001", "", ""), 40001),
    (("error 99 native=7", "", ""), 7),
    (("SQLSTATE:40001", "", ""), 40001),
    (("SqlState40001x", "", ""), 40001),
    (("HRESULT=1", "", ""), None),
    (("Error: 0", "", ""), None),
    (("Error: 5", "native=9", ""), 5),
    (("Error: 0", "native=9", ""), 9),
    (("native=0 Error: 3", "", ""), None),
    (("", "", "NATIVE=12"), 12),
    (("", "", ""), None),
]


def test_error_codes(spark):
    df = spark.createDataFrame([(i, *t) for i, (t, _) in enumerate(CODES)], "i int, a string, b string, c string")
    got = df.select("i", error_code(F.col("a"), F.col("b"), F.col("c")).alias("code")).orderBy("i").collect()
    assert [r.code for r in got] == [want for _, want in CODES]


def test_exception_is_searched_only_on_request(logs, load):
    logs("ib/26031005.log", "00:01.0-1,EXCP,1,Exception='native=1205'")
    assert load(logs).events.first().mssql_error_code is None
    assert load(logs, include_exception=True).events.first().mssql_error_code == 1205


def test_descriptions(spark):
    df = spark.createDataFrame([(1205,), (547,), (77,)], "code bigint")
    got = [r[0] for r in df.select(describe_error(F.col("code"), "Unknown")).collect()]
    assert got == ["Deadlock victim", "Foreign key violation", "Unknown"]
    large = spark.createDataFrame([(3_000_000_000,), (4_294_967_295,)], "code bigint")
    assert [r[0] for r in large.select(describe_error(F.col("code"), "Unknown")).collect()] == ["Unknown"] * 2


CLASSES = [
    # name, level, ms, props -> severity, category
    ("dbmssql", 0, 0, "", "low", "database"),
    ("SDBL", 0, 0, "Exception=x", "critical", "database"),
    ("TLOCK", 0, 0, "", "low", "lock"),
    ("CALL", 0, 0, "Locks=x", "low", "lock"),
    ("HTTPERROR", 0, 0, "", "low", "error"),
    ("EXCP", 0, 0, "Exception=x", "critical", "error"),
    ("CALL", 0, 0, "Context='native=1205'", "critical", "error"),
    ("CALL", 0, 1000, "", "low", "info"),
    ("CALL", 0, 1000.001, "", "medium", "performance"),
    ("CALL", 0, 5000, "", "medium", "performance"),
    ("CALL", 0, 5000.001, "", "high", "performance"),
    ("CALL", 1, 0, "", "low", "info"),
    ("CALL", 2, 0, "", "medium", "info"),
    ("CALL", 3, 0, "", "high", "info"),
    ("CALL", 4, 0, "", "critical", "info"),
]


def test_classification(logs, load):
    text = "\n".join(f"00:01.0-{round(ms * 1000)},{name},{level},{props}" for name, level, ms, props, *_ in CLASSES)
    logs("ib/26031005.log", text)
    events = rows_by_line(load(logs).events)
    assert [(events[i + 1].severity, events[i + 1].category) for i in range(len(CLASSES))] == [c[4:] for c in CLASSES]
    constant = load(logs, rules="constant").events.select("severity", "category").distinct().collect()
    assert [tuple(r) for r in constant] == [("info", "other")]


def test_interval_is_inclusive_and_ordinals_stay(logs, load):
    logs(
        "ib/26031005.log",
        "\n".join(
            f"{m},A,1," for m in ("09:59.999999-1", "10:00.000000-1", "30:00.0-1", "20:00.0-1", "20:00.000001-1", "15:00.0-1")
        ),
    )
    logs("ib/26031006.log", "10:00.0-1,A,1,")
    kept = load(logs, US(5, 10), US(5, 20)).events.orderBy("line_number").collect()
    assert [r.line_number for r in kept] == [2, 4, 6]


@pytest.mark.parametrize("bad", ["other", ""])
def test_unknown_rules_are_refused(spark, bad):
    from tidelog.functions.codes import classified

    with pytest.raises(ValueError):
        classified(spark.range(1), bad)
