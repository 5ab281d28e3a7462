import json
import os

import pytest
import zstandard
from pyspark.sql import functions as F

from threadloom.session import Scratch, shared_dir
from threadloom.sources import jsonl, reports, tables
from threadloom.streaming import incremental

RECORDS = [
    {"id": "c1", "subreddit": "AskThings", "subreddit_name_prefixed": "r/AskThings", "author": "a", "score": 1, "created_utc": 1654000001, "body": "x"},
    {"id": 2, "subreddit": "science", "subreddit_name_prefixed": "r/Science", "author": None, "score": "3", "created_utc": "1654000002", "body": None},
    {"id": "c3", "subreddit": "funny", "subreddit_name_prefixed": "r/funny", "created_utc": 1654000003, "crosspost_parent_list": [{"subreddit_name_prefixed": "r/askthings", "created_utc": 1}]},
    {"id": "c4", "subreddit": "askthings", "subreddit_name_prefixed": " ", "created_utc": 1650000000},
]


def write(path, records, frames=1, window=None):
    params = zstandard.ZstdCompressionParameters(window_log=window, compression_level=3) if window else None
    with open(path, "wb") as out:
        for k in range(frames):
            make = zstandard.ZstdCompressor(compression_params=params) if params else zstandard.ZstdCompressor()
            out.write(make.compress("".join(json.dumps(r).replace("r/AskThings", "r\\/AskThings") + "\n" for r in records[k::frames]).encode() + b"\n{broken\n"))


def test_read_and_filter(spark, tmp_path):
    path = str(tmp_path / "RC_2022-06.zst")
    write(path, RECORDS, frames=2)
    lines = jsonl.read_lines(spark, [path])
    assert lines.count() == 6 and jsonl.parse_lines(lines).count() == 4
    kept = jsonl.filter_lines(lines, ["askthings", "SCIENCE"])
    assert sorted(r.id for r in kept.collect()) == ["2", "c1", "c4"]
    assert sorted(r.id for r in jsonl.filter_lines(lines, ["askthings"], 1654000000, 1654000002).collect()) == ["c1"]
    names = spark.createDataFrame([("science",)], "name string")
    assert [r.id for r in jsonl.filter_lines(lines, names).collect()] == ["2"]
    stats = jsonl.file_stats(lines, kept).first()
    assert (stats.rows_read, stats.rows_written, stats.first_utc, stats.last_utc) == (6, 3, 1650000000, 1654000002)
    canonical = {r.comment_id: r for r in jsonl.canonical_records(jsonl.parse_lines(lines), "comments").collect()}
    assert canonical["2"].score == 3.0 and canonical["2"].subreddit == "science" and canonical["c3"].month == "2022-05"


def test_long_window(spark, tmp_path):
    path = str(tmp_path / "RC_2022-07.zst")
    write(path, RECORDS, window=27)
    assert jsonl.read_lines(spark, [path]).count() == 5


def test_discovery(tmp_path):
    (tmp_path / "comments").mkdir()
    for m in ("2022-02", "2022-01"):
        (tmp_path / "comments" / f"RC_{m}.zst").write_bytes(b"x")
    assert [os.path.basename(p) for p in jsonl.find_raw(str(tmp_path), "comments")] == ["RC_2022-01.zst", "RC_2022-02.zst"]
    assert len(jsonl.find_raw(str(tmp_path), "comments", ["2022-02", "2022-01"])) == 2
    with pytest.raises(FileNotFoundError):
        jsonl.find_raw(str(tmp_path), "comments", ["2022-03"])
    assert jsonl.months_between("2022-11", "2023-02") == ["2022-11", "2022-12", "2023-01", "2023-02"]
    assert len(jsonl.target_paths("d", "submissions", "2022-01", "2022-12")) == 12


def test_name_list(tmp_path):
    good = tmp_path / "list.txt"
    good.write_text("subreddits = [\n 'AskThings', \"Science\",\n]\n")
    assert jsonl.load_name_list(str(good)) == ["askthings", "science"]
    good.write_text("nothing")
    with pytest.raises(ValueError):
        jsonl.load_name_list(str(good))


def test_resume(spark, tmp_path):
    a, b = str(tmp_path / "RC_2022-01.zst"), str(tmp_path / "RC_2022-02.zst")
    write(a, RECORDS)
    args = (str(tmp_path / "progress.json"), str(tmp_path / "out"), "comments", "t", ["askthings"])
    assert jsonl.resume_filter(spark, [a], *args) == {a: 2}
    write(b, RECORDS[:1])
    assert jsonl.resume_filter(spark, [a, b], *args) == {b: 1}
    assert jsonl.resume_filter(spark, [a, b], *args) == {}
    found = jsonl.find_filtered(str(tmp_path / "out"), "comments")
    assert len(found) == 2 and jsonl.read_lines(spark, found).count() == 3


def test_verify(spark, tmp_path):
    good, empty, bad = (str(tmp_path / n) for n in ("a.zst", "b.zst", "c.zst"))
    write(good, RECORDS)
    open(empty, "w").close()
    open(bad, "wb").write(b"nonsense")
    got = {os.path.basename(r.file): r.status for r in jsonl.verify(spark, [good, empty, bad, str(tmp_path / "d.zst")]).collect()}
    assert got == {"a.zst": "ok", "b.zst": "empty", "c.zst": "broken", "d.zst": "missing"}


def test_export_window_and_months(spark, tmp_path):
    spark.sql("select timestamp'2022-01-05' as created_at, 1 as a").write.parquet(str(tmp_path / "x"))
    spark.sql("select timestamp'2022-02-05' as created_at, 'z' as b").write.parquet(str(tmp_path / "y"))
    r = jsonl.export_window(spark, [str(tmp_path / "x"), str(tmp_path / "y")], "created_at", "2022-01-01", "2022-02-01", str(tmp_path / "out")).first()
    assert r.rows == 1 and "b" in spark.read.parquet(str(tmp_path / "out")).columns


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([("b", 1.26, None), ("a", 2.0, 1)], "k string, v double, n int")
    assert open(reports.write_csv(df, str(tmp_path / "t.csv"), ["k"], {"v": 1})).read().split() == ["k,v,n", "a,2.0,1", "b,1.3,"]
    assert "x,\"[1, 2]\"" in open(reports.write_summary({"x": [1, 2], "y": None}, str(tmp_path / "s.csv"))).read()
    back = tables.read_csv(spark, str(tmp_path / "t.csv"), "k string, v double, n int")
    assert [tuple(r) for r in back.orderBy("k").collect()] == [("a", 2.0, 1), ("b", 1.3, None)]
    stats = spark.createDataFrame([("x", 3, 2), ("y", 1, 0)], "file string, rows_read long, rows_written long")
    assert json.load(open(reports.write_manifest(stats, str(tmp_path / "m.json"), tag="t")))["totals"] == {"rows_read": 4, "rows_written": 2}
    with pytest.raises(ValueError):
        reports.bounded_rows(df, limit=1)

    def fail():
        raise RuntimeError("late")

    with pytest.raises(RuntimeError):
        reports.run_report({"first": lambda: df, "second": fail}, str(tmp_path / "r.md"))
    text = open(tmp_path / "r.md").read()
    assert "## first" in text and "failed: RuntimeError" in text


def test_cached_table(spark, tmp_path):
    source, calls = tmp_path / "in.txt", []
    source.write_text("1")

    def build():
        calls.append(1)
        return spark.range(3)

    for _ in range(2):
        assert reports.cached_table(spark, str(tmp_path / "c"), [str(source)], 1, build).count() == 3
    source.write_text("12")
    reports.cached_table(spark, str(tmp_path / "c"), [str(source)], 1, build)
    assert len(calls) == 2


def test_scratch(spark):
    scratch = Scratch(spark)
    df = scratch.save(spark.range(5), "x")
    assert df.count() == 5 and df._threadloom_path.startswith(shared_dir(spark))
    scratch.drop(df)
    assert not os.path.exists(df._threadloom_path.removeprefix("file://"))
    scratch.clear()


def test_streaming_filter_takes_each_file_once(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    run = lambda: incremental.filter_new_files(spark, str(inbox), str(tmp_path / "out"), str(tmp_path / "cp"), ["askthings"]).awaitTermination(60)
    for k in range(2):
        (inbox / f"{k}.jsonl").write_text("".join(json.dumps(r) + "\n" for r in RECORDS))
        run()
    run()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4


def test_streaming_first_deliveries(spark, tmp_path):
    rows = spark.sql("select 1L as delivery_id, 't3_A' as submission_id, timestamp'2022-01-01' as received_at union all select 2L, ' a', timestamp'2022-01-02' union all select 3L, null, timestamp'2022-01-02' union all select 4L, null, timestamp'2022-01-02'")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    incremental.first_deliveries(spark, str(tmp_path / "in"), rows.schema, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    kept = [r.submission_id for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert len(kept) == 3 and kept.count(None) == 2


def test_thread_key(spark):
    df = spark.createDataFrame([("c1", "t3_s1", None), ("c2", None, "t3_s2"), ("c3", None, "t1_x")], "id string, link_id string, parent_id string")
    assert [r.k for r in df.select(jsonl.thread_key("comments").alias("k")).collect()] == ["s1", "s2", "c3"]
    assert [r.k for r in df.select(F.coalesce(jsonl.thread_key("submissions")).alias("k")).collect()] == ["c1", "c2", "c3"]


def test_thread_shards_and_check(spark, tmp_path):
    df = spark.createDataFrame([(f"c{k}", f"t3_s{k % 3}", None) for k in range(12)] + [(None, None, None)], "id string, link_id string, parent_id string")
    jsonl.write_thread_shards(df, "comments", 4, str(tmp_path / "s"))
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == 12 and back.groupBy("link_id").agg(F.count_distinct("shard").alias("n")).where("n > 1").count() == 0
    assert jsonl.check_table(back, {"id": "string", "shard": "int"}, ["id"]) == []
    assert jsonl.check_table(df.limit(0), {"id": "int", "x": "int"}) == ["no column x", "id is string, not int", "no rows"]
    assert jsonl.check_table(back.select("link_id"), {}, ["link_id"]) == ["repeated link_id"]
