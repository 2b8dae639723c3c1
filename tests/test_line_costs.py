"""What is computed for every line or field: the same values without a cast that fails or work done again."""

from pyspark.sql import functions as F

from tidelog.functions.numbers import whole_number
from tidelog.operators.alternative import field_lists
from tidelog.sources.files import Layout, as_lines, local_path

NUMBERS = ["", None, " ", "7", " 8 ", "-9", "+1", "1.5", "x1", "many", "99999999999999999999", "٣"]


def test_a_text_without_a_digit_is_not_cast(spark):
    rows = spark.createDataFrame([(n,) for n in NUMBERS], "n string")
    for r in rows.select("n", whole_number(F.col("n")).alias("got"), F.col("n").try_cast("bigint").alias("want")).collect():
        assert r.got == r.want, r.n


def test_paths_keep_their_file_and_part(spark):
    paths = ["/r/a/1.log", "/r/a/1.log.7", "/r/a+b%2Bc/1.log", "/r/a%20b.log.1/1.log.12", "/r/1.log.x"]
    rows = spark.createDataFrame([(p, 0, "v") for p in paths], "uri string, block_start bigint, value string")
    got = [(r.file_path, r.part) for r in as_lines(rows, Layout("/r", parts=True)).collect()]
    assert got == [("/r/a/1.log", 0), ("/r/a/1.log", 7), ("/r/a+b+c/1.log", 0), ("/r/a b.log.1/1.log", 12), ("/r/1.log.x", 0)]


def test_the_part_of_a_plain_name_is_not_looked_for(spark):
    """Each line of a file without parts was cast from an empty text, which raises and catches an error."""
    part = str(Layout("/r", parts=True).part(F.col("p")))
    assert part.index("endswith") < part.index("CAST(0") < part.index("TRY_CAST")
    assert "contains" in str(local_path(F.col("p"))).lower()


def test_lines_are_split_once(spark):
    record = '2026-03-10 05:05:59.123\n usr ; "a;b" \n"x";"y"\nno field\nz;"\nx;'
    rows = spark.createDataFrame([(record,)], "r string").select(F.get(field_lists(F.col("r")), F.lit(0)).alias("f"))
    (row,) = rows.collect()
    assert row.f["keys"] == ["x", "z", "x", "usr"] and row.f["values"] == ["", "", "y", "a;b"]
    assert str(field_lists(F.col("r"))).lower().count("split(") == 1
