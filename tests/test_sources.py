"""Small sources and sinks."""

import sys
import types

from pyspark.sql import functions as F

from siltstone.sources import files as sf
from siltstone.streaming import jobs as sj


def test_head_content_prefers_the_job_and_stays_inside(spark):
    wanted = spark.createDataFrame([("j", "a.py"), ("j", "b.py"), ("j", "../c.py"), ("j", "/etc/x"), ("k", "a.py")], "job_id string, path string")
    shipped = spark.createDataFrame([("j", {"a.py": "own", "../c.py": "no"}), ("k", None)], "job_id string, head_files map<string,string>")
    other = spark.createDataFrame([("a.py", "found"), ("b.py", "found"), ("/etc/x", "no")], "path string, text string")
    got = {(r.job_id, r.path): r.text for r in sf.head_content(wanted, shipped, other).collect()}
    assert got == {("j", "a.py"): "own", ("j", "b.py"): "found", ("j", "../c.py"): None, ("j", "/etc/x"): None, ("k", "a.py"): "found"}


def test_markdown_and_publish_once(spark):
    f = spark.createDataFrame(
        [("j", "2", "b.py", None, "info", "Second", "m", None, 0.5), ("j", "1", "a.py", 3, "critical", "First", "m", "fix", 0.9)],
        "job_id string, id string, file string, line int, severity string, title string, message string, suggestion string, confidence double",
    )
    body = sf.review_markdown(f).first().body
    assert body == "**CRITICAL** First (90%)\na.py:3\nm\nSuggestion: fix\n\n**INFO** Second (50%)\nb.py\nm"
    reviews = spark.createDataFrame([("j",), ("j",), ("k",)], "job_id string")
    assert [r.job_id for r in sf.publish_once(reviews, spark.createDataFrame([("k",)], "job_id string")).collect()] == ["j"]


def test_upsert_and_delete(spark):
    index = spark.createDataFrame([("a", 1), ("b", 2)], "path string, v int")
    new = spark.createDataFrame([("b", 3), ("b", 4), ("c", 5)], "path string, v int")
    assert sorted(tuple(r) for r in sf.upsert(index, new, ["path"]).collect()) == [("a", 1), ("b", 3), ("b", 4), ("c", 5)]
    assert sf.delete_paths(index, new, ["path"]).count() == 1
    assert spark.range(1).select(sf.decode_content(F.lit("aGVs\nbG8=")).alias("v")).first().v == "hello"


def test_pull_request_pages():
    fake = types.ModuleType("fake_transport")
    fake.fetch = lambda repo, number, page, size: [{"filename": f"{page}-{i}"} for i in range(size if page < 3 else 7)]
    sys.modules["fake_transport"] = fake
    reader = sf.PullRequestFiles({"fetch": "fake_transport:fetch", "repo": "r", "number": "1", "max_files": "250"}).reader(None)
    rows = [r for p in reader.partitions() for r in reader.read(p)]
    assert len(reader.partitions()) == 3 and len(rows) == 207 and rows[0][0] == "1-0"


def test_fan_out(spark, tmp_path):
    spark.range(5).write.parquet(f"{tmp_path}/t.parquet")
    got = sj.fan_out(lambda: sj.stream_table(spark, str(tmp_path), "t"), {"all": lambda d: d, "even": lambda d: d.where("id % 2 = 0")})
    assert got["all"].count() == 5 and got["even"].count() == 3
