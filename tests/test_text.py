"""Text functions, globs and caps on single values."""

import pytest
from pyspark.sql import functions as F

from millrace.errors import InvalidQuery
from millrace.functions import globs
from millrace.functions import text as tx
from millrace.operators import caps, search


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("path", "glob", "hit"),
    [
        ("src/a/Order.cs", "*.cs", True),
        ("src/a/Order.cs", "src/*.cs", False),
        ("src/a/Order.cs", "src/**/*.cs", True),
        ("src/Order.cs", "src/**/*.cs", True),
        ("SRC/ORDER.CS", "src/order.cs", True),
        ("src\\a\\b.txt", "src/a/?.txt", True),
        ("a/b.c+d", "a/b.c+d", True),
        ("a/bxc+d", "a/b.c+d", False),
        ("deep/x/y", "deep/**", True),
    ],
)
def test_glob(spark, path, glob, hit):
    assert one(spark, globs.matches(F.lit(path), glob)) is hit


def test_glob_refuses():
    for bad in ("", " ", "*.{cs,txt}"):
        with pytest.raises(InvalidQuery):
            globs.pattern(bad)


def test_values(spark):
    assert one(spark, tx.trim_any(F.lit("\t  a b  \n"))) == "a b"
    assert one(spark, tx.cut(F.lit("x" * 205))) == "x" * 200 + "... (+5 chars)"
    assert one(spark, tx.placeholders(F.lit("{1} {0:x} {1,5} {{2}} {a}"))) == [1, 0, 2]
    assert one(spark, tx.occurrences(F.lit("aaaa"), "aa")) == 2
    assert one(spark, tx.occurrence_offset(F.lit("xaaxaa"), "aa", 2)) == 4
    assert one(spark, tx.occurrence_offset(F.lit("xaa"), "aa", 2)) == -1
    assert one(spark, tx.duration_ms(F.lit("01:02:03.5000000"))) == 3723500
    assert one(spark, tx.duration_ms(F.lit("soon"))) == 0
    assert one(spark, tx.identifiers(F.lit("a.b + c9"))) == ["a.b", "c9", "a", "b"]
    assert one(spark, tx.entity_decoded(F.lit("&lt;a&amp;lt;&gt;"))) == "<a&lt;>"
    assert one(spark, tx.dedented(F.array(F.lit("  a"), F.lit(""), F.lit("    b")))) == ["a", "", "  b"]
    assert one(spark, tx.common_prefix(F.lit("ab.c"), F.lit("ab.d"))) == "ab."
    assert one(spark, tx.dominant_ending(F.lit("a\r\nb\r\nc\n"))) == "\r\n"
    assert one(spark, tx.is_suffix_of(F.lit("B.C"), F.lit("A.B.C"))) is True
    assert one(spark, tx.is_suffix_of(F.lit("B.C"), F.lit("AB.C"))) is False
    assert one(spark, tx.arguments(F.lit("Map<A, B>, int[,], (x, y) z"))) == ["Map<A, B>", "int[,]", "(x, y) z"]
    assert one(spark, tx.arguments(F.lit(""))) == [""]


@pytest.mark.parametrize(("total", "cap", "shown"), [(110, 100, 110), (111, 100, 100), (56, 50, 50), (55, 50, 55), (5, 10, 5)])
def test_slack(spark, total, cap, shown):
    df = spark.range(total)
    got = caps.slack_cap(df, [F.col("id")], cap).collect()
    assert len(got) == shown and {r["total"] for r in got} == {total}


def test_search_refuses(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    for bad in ("", "  "):
        with pytest.raises(InvalidQuery):
            search.literal(docs, bad)
    with pytest.raises(InvalidQuery):
        search.multi(docs, ["x"] * 11)
    with pytest.raises(InvalidQuery):
        search.near_miss(docs, "abc")


def test_withhold_only_second_half_is_shown(spark):
    df = spark.createDataFrame([(1, True), (2, True)], "id long, test boolean")
    assert [r["withheld"] for r in caps.withhold(df, F.col("test")).collect()] == [0, 0]
    both = df.union(spark.createDataFrame([(3, False)], df.schema))
    assert [(r["id"], r["withheld"]) for r in caps.withhold(both, F.col("test")).collect()] == [(3, 2)]
