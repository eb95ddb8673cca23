import pytest
from pyspark.sql import functions as F

from logfold.functions import text as X
from logfold.operators import filters as P
from logfold.operators import order as O
from logfold.operators import search as S
from logfold.operators import timesync


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_formats(spark):
    for ns, want in ((0, "0ms"), (17_000_000, "17ms"), (1_250_000_000, "1.250s"), (184_000_000_000, "3m 4s"), (7_500_000_000_000, "2h 5m")):
        assert one(spark, X.format_duration(F.lit(ns))) == want
    assert one(spark, X.human_size(F.lit(1536))) == "1.50 KB" and one(spark, X.human_duration(F.lit(0))) == "N/A"
    assert one(spark, X.format_time(F.lit(1_500_000_000_999_999_999))) == "2017-07-14 02:40:00 UTC"


def test_time_ranges():
    assert P.parse_time_range("1,2") == (10**9, 2 * 10**9) and P.parse_time_range("1-2") == (10**9, 2 * 10**9)
    assert P.parse_time_range("2023-01-01T00:00:00Z,2023-01-01T00:00:01Z") == (1672531200 * 10**9, 1672531201 * 10**9)
    assert P.parse_time("32503680000") == 32503680000
    for bad in ("2,1", "1,1", "x", "2023-01-01"):
        with pytest.raises(ValueError):
            P.parse_time_range(bad)


def test_search(spark):
    rows = spark.createDataFrame([(1, bytearray(b"aaaa\xffPK\x03")), (2, None), (3, bytearray())], "i int, d binary")
    assert sorted((r.i, r.offset) for r in S.find_bytes(rows, "d", "6161").collect()) == [(1, 0), (1, 2)]
    got = S.find_bytes(rows, "d", "0xff 50", context=2).collect()
    assert [(r.offset, r.context) for r in got] == [(4, "6161FF504B03")]
    with pytest.raises(ValueError):
        S.parse_hex(" ")
    text = spark.createDataFrame([("a.b.c",)], "t string")
    assert [r.offset for r in S.find_string(text, "t", ".", limit=1).collect()] == [1]


def test_sequence_is_gapless_for_a_hot_channel_with_ties(spark):
    rows = spark.range(5000).select(F.when(F.col("id") % 50 == 0, 1).otherwise(0).alias("channel_id"), F.call_function("div", F.col("id"), F.lit(7)).alias("log_time"), "id")
    out = O.with_sequence(rows, "id").collect()
    for c in (0, 1):
        mine = sorted((r.log_time, r.id, r.sequence) for r in out if r.channel_id == c)
        assert [s for _, _, s in mine] == list(range(len(mine)))
        times = [t for t, _, _ in mine]
        gaps = sorted((r.log_time, r.id, r.gap) for r in O.with_gap(rows, "id").collect() if r.channel_id == c)
        assert [g for _, _, g in gaps] == [None, *(b - a for a, b in zip(times, times[1:], strict=False))]
    assert O.with_sequence(rows.limit(0), "id").count() == 0


def test_as_of_tolerance(spark):
    left = spark.createDataFrame([(1, "a", 100), (2, "a", 500), (3, "b", 5), (4, "a", 10)], "k int, g string, t long")
    right = spark.createDataFrame([("a", 90, 1.0), ("a", 100, 2.0), ("a", 300, 3.0)], "g string, t long, v double")
    for width in (50, 1000):
        got = {r.k: r.v for r in timesync.as_of(left, right, "g", "t", "v", "k", slice_ns=width).collect()}
        assert got == {1: 2.0, 2: 3.0, 3: None, 4: None}
    assert {r.k: r.v for r in timesync.as_of(left, right, "g", "t", "v", "k", tolerance_ns=100).collect()}[2] is None


def test_glob(spark):
    topics = spark.createDataFrame([(t,) for t in ("/a/b", "/a.b", "/x", "/ab")], "topic string")
    keep = lambda *a: {r.topic for r in topics.where(P.glob_filter(*a)).collect()}
    assert keep(["/a?b"]) == {"/a/b", "/a.b"} and keep(["/a*"], [], ["/ab"]) == {"/a/b", "/a.b"} and keep([], ["/[xa].*"]) == {"/a/b", "/a.b", "/x", "/ab"} and len(keep()) == 4


def test_human_duration_beyond_a_long(spark, tmp_path):
    from logfold.queries import QUERIES

    ids = [0, 1, 500, 864_522, 864_523, 1_298_000, 5_999_999]
    spark.createDataFrame([(i,) for i in ids], "event_id long").write.parquet(str(tmp_path / "events.parquet"))
    got = dict(QUERIES["x10_human_duration"](spark, str(tmp_path)).collect())
    assert got == {
        0: "N/A",
        1: "12.34 ms",
        500: "51.42 minutes (3085s)",
        864_522: "2562045.00 hours (9223362004s)",
        864_523: "2562050.93 hours (9223383341s)",
        1_298_000: "5775426.21 hours (20791534363s)",
        5_999_999: "123406208.86 hours (444262351913s)",
    }
