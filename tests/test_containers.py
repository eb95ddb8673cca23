import io
import os

import pytest
from pyspark.sql import functions as F

from logfold.errors import FormatError, NotFoundError, TopicCollisionError, TypeCollisionError
from logfold.operators import rename as R
from logfold.operators import rewrite as W
from logfold.sources import bag, datasource, mcap
from logfold.sources.detect import detect

CHANNELS = [mcap.Channel(0, "/a", "x/A", "cdr", b"int32 v", "ros2msg"), mcap.Channel(3, "/b", "x/A", "cdr", b"string v", "ros2msg"), mcap.Channel(7, "/c", "", "json")]


def write_mcap(**options):
    f = io.BytesIO()
    w = mcap.Writer(f, **options)
    for c in CHANNELS:
        w.add_channel(c)
    for i in range(100):
        w.write((0, 3, 7)[i % 3], 1000 + i, 2000 + i, b"%d" % i)
    w.add_attachment("cal.json", "application/json", 5, b"{}")
    w.finish()
    return f


@pytest.mark.parametrize("options", [{}, {"chunk_size": 300}, {"chunk_size": 300, "compression": "lz4"}, {"compression": "none"}])
def test_mcap_round_trip_with_and_without_summary(options):
    f = write_mcap(**options)
    data = f.getvalue()
    cut = data[: data.rindex(bytes([mcap.DATA_END]) + (4).to_bytes(8, "little"))]
    for whole in (data, cut):
        f = io.BytesIO(whole)
        s = mcap.summary(f)
        assert {i: (c.topic, c.message_type, c.encoding, c.schema) for i, c in s.channels.items()} == {c.id: (c.topic, c.message_type, c.encoding, c.schema) for c in CHANNELS}
        rows = [m for c in s.chunks for m in mcap.messages(f, c.offset, c.length)]
        assert [(r[0], r[2], r[3], r[4]) for r in rows] == [((0, 3, 7)[i % 3], 1000 + i, 2000 + i, b"%d" % i) for i in range(100)]
        assert [r[1] for r in rows if r[0] == 3] == list(range(33))
    s = mcap.summary(io.BytesIO(data))
    assert s.message_count == 100 and s.counts == {0: 34, 3: 33, 7: 33} and (s.start, s.end) == (1000, 1099)
    assert list(mcap.attachments(io.BytesIO(data))) == [("cal.json", "application/json", 5, b"{}")]


def test_damage():
    with pytest.raises(FormatError):
        mcap.summary(io.BytesIO(b"nothing of the kind"))
    data = bytearray(write_mcap(compression="none").getvalue())
    at = data.index(b"\x05" + (24).to_bytes(8, "little"))
    data[at + 31] ^= 1  # a payload byte: the chunk's checksum no longer fits
    f = io.BytesIO(bytes(data))
    with pytest.raises(FormatError):
        list(mcap.messages(f, mcap.summary(f).chunks[0].offset, mcap.summary(f).chunks[0].length))


@pytest.mark.parametrize("options", [{}, {"chunk_size": 300}, {"chunk_size": 300, "compression": "bz2"}, {"compression": "lz4"}])
def test_bag_round_trip_with_and_without_index(options):
    f = io.BytesIO()
    w = bag.Writer(f, **options)
    for i, c in enumerate((("/a", "n1"), ("/a", "n2"), ("/b", None), ("/a", "n1"))):
        w.add_channel(mcap.Channel(i, c[0], "x/A", "ros1", b"int32 v", metadata={"callerid": c[1]} if c[1] else {}))
    for i in range(80):
        w.write(i % 4, 1_000_000_000 + i, 0, b"%d" % i)
    w.finish()
    data = f.getvalue()
    unindexed = bytearray(data)
    at = data.index(b"index_pos=") + 10
    unindexed[at : at + 8] = bytes(8)
    for whole in (data, bytes(unindexed)):
        f = io.BytesIO(whole)
        s, of = bag.summary(f)
        assert {(c.topic, c.metadata.get("callerid")) for c in s.channels.values()} == {("/a", "n1"), ("/a", "n2"), ("/b", None)}
        assert of == {0: 0, 1: 1, 2: 2, 3: 0} and sorted(s.channels) == [0, 1, 2]
        rows = [m for c in s.chunks for m in bag.messages(f, c.offset, of)]
        assert [(r[0], r[1], r[2], r[4]) for r in rows] == [(of[i % 4], 0, 1_000_000_000 + i, b"%d" % i) for i in range(80)]
    assert len(bag.MAGIC) + 4096 + 4 <= data.index(b"op=\x05") + 200


def test_detect():
    assert detect(mcap.MAGIC, "x") == "mcap" and detect(bag.MAGIC) == "bag" and detect(b"VERSION of a text", "a.txt") is None
    assert detect(b"", "A.MCAP") == "mcap" and detect(b"#ROSBAH", "b.bag") == "bag"


@pytest.fixture(scope="module")
def recorded(spark, tmp_path_factory):
    datasource.register(spark)
    path = str(tmp_path_factory.mktemp("rec") / "in")
    rows = spark.range(600).select(
        (F.col("id") % 3).cast("int").alias("channel_id"),
        F.concat(F.lit("/t"), (F.col("id") % 3).cast("string")).alias("topic"),
        F.when(F.col("id") % 3 == 0, "a/A").otherwise("b/B").alias("message_type"),
        F.lit("json").alias("encoding"),
        F.when(F.col("id") % 3 == 0, "int32 x").otherwise("int32 y").alias("schema"),
        (F.col("id") * 10).alias("log_time"),
        F.col("id").alias("sequence"),
        F.concat(F.lit('{"k":'), F.col("id").cast("string"), F.lit("}")).cast("binary").alias("data"),
    )
    W.write(rows.coalesce(2), path, "mcap", ordered=False, chunkSize=2000)
    return path


def test_pushdown_leaves_out_chunks(spark, recorded):
    reader = datasource.MessageReader({"path": recorded, "partitionbytes": "1"}, spark.read.format("logfold").load(recorded).schema)
    whole = len(reader.partitions())
    from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, LessThan

    filters = [GreaterThanOrEqual(("log_time",), 1000), LessThan(("log_time",), 1200), EqualTo(("topic",), "/t1")]
    assert list(reader.pushFilters(filters)) == filters
    assert 0 < len(reader.partitions()) < whole / 4
    rows = spark.read.format("logfold").load(recorded).where("topic = '/t1' and log_time >= 1000 and log_time < 1200").collect()
    assert sorted(r.sequence for r in rows) == [i for i in range(100, 120) if i % 3 == 1]
    assert spark.read.format("logfold").load(recorded).where("topic = 'none'").count() == 0


def test_write_commits_whole_files_only(spark, recorded, tmp_path):
    path = str(tmp_path / "out")
    bad = spark.read.format("logfold").load(recorded).withColumn("log_time", F.when(F.col("sequence") == 599, F.raise_error("stop").cast("long")).otherwise(F.col("log_time")))
    with pytest.raises(Exception, match="stop"):
        W.write(bad, path, ordered=False)
    assert not os.path.isdir(path) or not [n for n in os.listdir(path) if n.startswith("part-")]


def test_rewrite_convert_and_counts(spark, recorded, tmp_path):
    out = str(tmp_path / "out")
    stats = W.rewrite(spark, recorded, out, R.Rules().with_topic_rename_wildcard("/t*", "/x/*").with_type_rename("a/A", "c/C"), format="bag")
    assert stats["messages"] == 600 and stats["dropped"] == 0 and stats["topics_renamed"] == 6 and stats["types_renamed"] == 2
    rows = spark.read.format("logfold").load(out)
    assert {(r.topic, r.message_type) for r in rows.select("topic", "message_type").distinct().collect()} == {("/x/0", "c/C"), ("/x/1", "b/B"), ("/x/2", "b/B")}
    info = spark.read.format("logfold_files").load(out).collect()
    assert sum(i.message_count for i in info) == 600 and {i.format for i in info} == {"bag"}


def test_renamed_topics_of_many_files_count_once(spark, sf_dir):
    from logfold.queries import QUERIES

    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # turns in several files, as in a larger recording
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        row = QUERIES["t19_options"](spark, sf_dir).first()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", before)
    n = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet").count() for t in ("conversations", "events")}
    assert row.asDict() == {"messages": n["conversations"], "dropped": n["events"], "topics_renamed": 3}


def test_rules_are_checked(spark, recorded):
    channels = spark.read.format("logfold_channels").load(recorded)
    with pytest.raises(NotFoundError):
        R.Rules().with_topic_rename("/none", "/x").validate(channels)
    with pytest.raises(TypeCollisionError):
        R.Rules().with_type_rename("a/A", "n/N").with_type_rename("b/B", "n/N").validate(channels)
    one = channels.where("file like '%00000.mcap'")
    with pytest.raises(TopicCollisionError):
        R.Rules().with_topic_rename_wildcard("/t*", "/same").apply(one, on_collision="fail")
    named = {r.topic for r in R.Rules().with_topic_rename_wildcard("/t*", "/same").apply(one).collect()}
    assert named == {"/same", "/same_1", "/same_2"}


def test_rule_files():
    a = R.from_json('{"topic_renames": [{"from": "/a", "to": "/b"}], "topic_wildcards": [{"pattern": "/c/*", "target": "/d/*"}], "type_renames": [{"from": "x/Y", "to": "z/Y"}], "topic_type_renames": [{"topic": "/t", "from_type": "p", "to_type": "q"}]}')
    b = R.from_toml('[type_mappings]\n"x/Y" = "z/Y"\n[[topic_mappings]]\nfrom = "/c/*"\nto = "/d/*"\n[[topic_mappings]]\nfrom = "/a"\nto = "/b"')
    assert a.topics == b.topics == {"/a": "/b"} and a.types == b.types and a.topic_wildcards == b.topic_wildcards == [("/c/*", "/d/*")] and a.topic_types == {("/t", "p"): "q"}


def test_schema_text_references(spark):
    rules = R.Rules().with_type_rename("old_msgs/msg/Header", "new_msgs/msg/Header").with_type_rename_wildcard("lib/msg/*", "own/msg/*")
    text = "old_msgs/msg/Header header\nmy_old_msgs/msg/Header other\nlib/msg/Box[] b\nmodule lib { module msg {\nold_msgs::msg::Header h; lib::msg::Box x;"
    got = spark.createDataFrame([(text,)], "t string").select(rules.schema(F.col("t"))).first()[0]
    assert got == "new_msgs/msg/Header header\nmy_old_msgs/msg/Header other\nown/msg/Box[] b\nmodule own { module msg {\nnew_msgs::msg::Header h; own::msg::Box x;"


def test_stream_takes_each_file_once(spark, recorded, tmp_path):
    import shutil

    folder, out, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "c")
    folder.mkdir()
    names = sorted(n for n in os.listdir(recorded) if n.endswith(".mcap"))

    def run():
        stream = spark.readStream.format("logfold").load(str(folder)).select("topic", "sequence")
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(processingTime="100 milliseconds").start()
        query.processAllAvailable()
        query.stop()
        return spark.read.parquet(out)

    shutil.copy(f"{recorded}/{names[0]}", folder)
    first = run().count()
    assert 0 < first < 600
    shutil.copy(f"{recorded}/{names[1]}", folder)
    assert sorted(r.sequence for r in run().collect()) == list(range(600))
    assert run().count() == 600
