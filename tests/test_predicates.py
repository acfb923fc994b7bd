"""The condition truth table, the tag language and their edge cases."""

import pytest
from pyspark.sql import functions as F

from stackroom.operators import predicates as P
from stackroom.operators import search as S


def holds(spark, column, value, schema="string"):
    return spark.createDataFrame([(value,)], f"v {schema}").select(F.coalesce(column(F.col("v")), F.lit(False))).first()[0]


@pytest.mark.parametrize(
    "stored, operation, value, scalar, dated",
    [
        (None, "is", "x", False, False),
        (None, "isNot", "x", True, False),
        (None, "contains", "x", False, False),
        (None, "contains", "", True, False),
        (None, "doesNotContain", "x", True, False),
        (None, "isLessThan", "m", False, False),
        ("x", "is", "X", True, True),
        ("x", "isNot", "x", False, False),
        ("Müller", "is", "muller", True, True),
        ("a–b", "contains", "A-B", True, True),
        ("50%", "contains", "0%", True, True),
        ("50", "contains", "%", False, False),
        ("abc", "beginsWith", "AB", True, True),
        ("abc", "endsWith", "bc", True, True),
        ("9", "isLessThan", "10", True, True),
        ("nine", "isGreaterThan", "10", True, True),
        ("2016-10-01", "isBefore", "2016-11", True, True),
        ("2016-10-01", "isAfter", "2016-11", False, False),
    ],
)
def test_scalar_and_dated(spark, stored, operation, value, scalar, dated):
    assert holds(spark, lambda c: P.scalar(c, operation, value), stored) is scalar
    assert holds(spark, lambda c: P.dated(c, operation, value), stored) is dated


@pytest.mark.parametrize(
    "stored, operation, expected",
    [(None, "isNot", False), ([], "isNot", False), ([], "is", False), (["a", "x"], "is", True), (["a", "x"], "isNot", False), (["a", "b"], "isNot", True), (["ab"], "contains", False), (["xy"], "contains", True), (["a", "xy"], "doesNotContain", False)],
)
def test_multi(spark, stored, operation, expected):
    assert holds(spark, lambda c: P.multi(c, operation, "x"), stored, "array<string>") is expected


@pytest.mark.parametrize(
    "entries, tags, expected",
    [(["a", "b"], ["a", "b"], True), (["a", "b"], ["a"], False), (["a OR b"], ["b"], True), (["a||b"], ["b"], True), (["-draft"], None, True), (["-draft"], ["Draft"], False), (["a OR -b"], ["c"], True), ('["a"]', ["A"], True)],
)
def test_tags(spark, entries, tags, expected):
    assert holds(spark, lambda c: P.tag_filter(c, entries), tags, "array<string>") is expected


def test_tag_edges():
    assert P.tag_filter.__doc__ and P.normalize_tags([{"tag": "a"}, "b"]) == ["a", "b"]
    with pytest.raises(P.Unsupported):
        P.like_pattern("is", "x")


def test_tag_wildcard_and_blank(spark):
    with pytest.raises(P.Unsupported):
        P.tag_filter(F.array(F.lit("a")), "a*")
    assert P.tag_filter(F.array(F.lit("a")), [" - "]) is None


def test_membership(spark):
    assert holds(spark, lambda c: P.membership(c, "isNot", ["k"]), None, "array<string>")
    assert holds(spark, lambda c: P.membership(c, "is", ["k", "m"]), ["m"], "array<string>")


def test_unknown(spark):
    with pytest.raises(P.Unsupported):
        P.condition({}, "nothing", "is", "x")
    with pytest.raises(P.Unsupported):
        P.all_or_any({}, [], "some")


def test_limits_and_scope():
    assert [S.clamp_limit(x, 10, 100) for x in (None, "5", -1, 1000, "x")] == [10, 5, 10, 100, 10]
    assert [S.clamp_offset(x) for x in (None, "5", -1)] == [0, 5, 0]
    assert [S.parse_scope(x) for x in (None, "all", 0, "group:3", "7")] == [None, None, 0, 3, 7]
    assert P.escape_like("50%_\\") == "50\\%\\_\\\\"


def test_cascade_takes_first_with_rows(spark):
    rows = spark.range(3)
    i, found = S.cascade([lambda: rows.where("id > 9"), lambda: rows.where("id = 1"), lambda: rows])
    assert i == 1 and found.count() == 1
