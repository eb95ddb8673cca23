import pytest
from pyspark.sql import functions as F

from logfold import api, cli
from logfold.codecs import cdr
from logfold.errors import LogfoldError, TypeNotFoundError
from logfold.plans import schema as S

SAID = S.parse("std_msgs/msg/String", "string data")


@pytest.fixture(scope="module")
def path(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("api") / "rec")
    w = api.Writer(spark, out)
    times = spark.range(50).select((F.col("id") * 1_000_000_000).alias("log_time"), "id")
    said = cdr.encode(times.select("log_time", F.concat(F.lit("text "), F.col("id").cast("string")).alias("data0")).withColumn("v", F.struct(F.col("data0").alias("data"))).drop("data0"), "v", SAID).drop("v")
    w.write(said, "/said", "std_msgs/msg/String", "cdr", "string data")
    w.write(times.select("log_time", F.concat(F.lit('{"k":'), F.col("id").cast("string"), F.lit("}")).cast("binary").alias("data")), "/json", "demo/K", "json")
    w.finish()
    return out


def rows(found):
    return [tuple(r) for r in found.collect()]


def test_reader(spark, path):
    r = api.Reader(spark, path)
    assert r.message_count() == 100 and r.attachments.count() == 0
    assert {x.message.data for x in r.decode("/said").collect()} == {f"text {i}" for i in range(50)}
    assert r.decode("/json").select(F.sum(F.variant_get("message", "$.k", "bigint"))).first()[0] == 49 * 25
    with pytest.raises(TypeNotFoundError):
        r.decode("/none")
    assert issubclass(TypeNotFoundError, LogfoldError) and TypeNotFoundError.kind == "type_not_found"


def test_commands(spark, path, tmp_path):
    run = lambda *a: cli.run(spark, a)
    assert sum(r[3] for r in rows(run("inspect", "info", path))) == 100
    assert rows(run("inspect", "topics", path, "--filter", "SAID")) == [("/said", "std_msgs/msg/String", "cdr", 50)]
    assert rows(run("inspect", "stats", path)) == [("/json", 50, 50.0), ("/said", 50, 50.0)]
    assert {r[0] for r in rows(run("search", "topics", path, "/"))} == {"/said", "/json"}
    assert rows(run("search", "fields", path, "/said")) == [("std_msgs/msg/String", 0, "data", "string")]
    assert len(rows(run("search", "bytes", path, "74 65 78 74 20", "-n", "7"))) == 7
    assert len(rows(run("search", "string", path, "text 4"))) == 10
    assert len(rows(run("search", "values", path, "/json", "k", "-n", "5"))) == 5
    assert dict(rows(run("schema", "list", path, "--group-by-type"))) == {"std_msgs/msg/String": "/said", "demo/K": "/json"}
    assert rows(run("schema", "diff", path, path)) == [("demo/K", "same"), ("std_msgs/msg/String", "same")]
    assert {(r[0], r[1]) for r in rows(run("schema", "validate", path))} == {("std_msgs/msg/String", "ok"), ("demo/K", "warning")}
    assert len(rows(run("schema", "show", path, "said"))) >= 1 and rows(run("schema", "list", path, "--standard-only"))[0][0] == "std_msgs/msg/String"
    for name, more, want in (("messages", ["-c", "5"], 5), ("per-topic", ["-c", "3"], 6), ("fixture", [], 2)):
        assert run("extract", name, path, str(tmp_path / name), *more) == {"messages": want}
    assert run("extract", "topics", path, "said,none", str(tmp_path / "t")) == {"messages": 50}
    assert run("extract", "time-range", path, "10,19", str(tmp_path / "r.bag")) == {"messages": 20}
    assert run("convert", "to-bag", path, str(tmp_path / "b"))["messages"] == 100
    config = tmp_path / "c.toml"
    config.write_text('[type_mappings]\n"demo/K" = "own/K"\n[[topic_mappings]]\nfrom = "/s*"\nto = "/z/*"')
    assert run("convert", "normalize", path, str(tmp_path / "n"), "--config", str(config))["types_renamed"] >= 1
    assert {r[0] for r in rows(run("inspect", "topics", str(tmp_path / "n")))} == {"/z/aid", "/json"}
