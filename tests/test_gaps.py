"""Discovery, caches, ragged and merged output, shards read back, and orders of names."""

import json

import pytest
from pyspark.sql import functions as F

from threadloom.operators import describe, panel
from threadloom.sources import jsonl, reports

zstandard = pytest.importorskip("zstandard")


def archive(path, records):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(zstandard.ZstdCompressor().compress("".join(r + "\n" for r in records).encode()))
    return str(path)


def record(k, **more):
    return json.dumps({"id": f"i{k}", "subreddit": "Alpha", "created_utc": 1650000000 + k, "link_id": f"t3_p{k % 3}", "parent_id": f"t3_p{k % 3}", "author": "x", "body": "b"} | more)


def test_missing_months_are_named_or_an_error(tmp_path):
    archive(tmp_path / "comments" / "RC_2022-01.zst", [record(1)])
    with pytest.raises(FileNotFoundError, match="2022-02"):
        jsonl.find_raw(str(tmp_path), "comments", ["2022-01", "2022-02"])
    with pytest.warns(UserWarning, match="2022-02"):
        assert [p[-11:] for p in jsonl.find_raw(str(tmp_path), "comments", ["2022-01", "2022-02"], missing="warn")] == ["2022-01.zst"]


def test_matching_submissions(tmp_path):
    for name in ("filter-comments-a.jsonl.zst", "filter-submissions-a.jsonl.zst", "filter-comments-b.jsonl.zst", "other.zst"):
        (tmp_path / name).write_bytes(b"")
    paths = [str(tmp_path / n) for n in ("filter-comments-a.jsonl.zst", "filter-comments-a.jsonl.zst", "filter-comments-b.jsonl.zst", "other.zst")]
    assert jsonl.matching_submissions(paths) == [str(tmp_path / "filter-submissions-a.jsonl.zst")]


def test_scan_report(spark):
    lines = [("f", record(1)), ("f", ""), ("f", None), ("f", "{broken"), ("f", "[1]"), ("f", '{"id": "a"}'), ("g", "﻿" + record(2)), ("g", '{"subreddit_name_prefixed": "r/x", "created_utc": ""}')]
    got = {r.file: r.asDict() for r in jsonl.scan_report(spark.createDataFrame(lines, "file string, value string")).collect()}
    assert got["f"] == {"file": "f", "lines": 6, "blank": 2, "parse_errors": 2, "missing_time": 1, "missing_community": 1}
    assert got["g"] == {"file": "g", "lines": 2, "blank": 0, "parse_errors": 0, "missing_time": 1, "missing_community": 0}


def test_merged_output_and_manifest(spark, tmp_path):
    paths = [archive(tmp_path / "comments" / f"RC_2022-0{m}.zst", [record(k) for k in range(m * 10, m * 10 + 4)] + [record(99, subreddit="other")]) for m in (1, 2)]
    lines = jsonl.read_lines(spark, paths)
    kept = jsonl.filter_lines(lines, ["alpha"])
    out = jsonl.write_merged(kept, jsonl.file_stats(lines, kept), str(tmp_path / "out"), "comments", "t")
    assert [json.loads(r.value)["id"] for r in jsonl.read_lines(spark, [out]).orderBy("line_no").collect()] == [f"i{k}" for k in (10, 11, 12, 13, 20, 21, 22, 23)]
    manifest = json.load(open(tmp_path / "out" / "manifest.json"))
    assert manifest["totals"] == {"rows_read": 10, "rows_written": 8} and len(list((tmp_path / "out").iterdir())) == 2


def test_shards_are_read_back(spark, tmp_path):
    paths = [archive(tmp_path / "RC.zst", [record(k) for k in range(30)])]
    rows = jsonl.parse_lines(jsonl.read_lines(spark, paths))
    jsonl.write_thread_shards(rows, "comments", 4, str(tmp_path / "shards"))
    assert jsonl.read_thread_shards(spark, str(tmp_path / "shards")).count() == 30
    build = lambda part: part.groupBy("link_id").agg(F.count(F.lit(1)).alias("n"))
    assert sorted(map(tuple, jsonl.by_shard(spark, str(tmp_path / "shards"), 4, build).collect())) == sorted(map(tuple, build(rows).collect()))


def test_cached_sample_follows_its_sources(spark, tmp_path):
    source, calls = str(tmp_path / "source"), []
    spark.range(5).write.parquet(source)

    def draw():
        calls.append(1)
        return spark.read.parquet(source).limit(3)

    for _ in range(2):
        assert reports.cached_sample(spark, str(tmp_path), "comments", 3, 42, ["2022-01"], [source], draw).count() == 3
    assert len(calls) == 1
    spark.range(7).write.mode("append").parquet(source)
    reports.cached_sample(spark, str(tmp_path), "comments", 3, 42, ["2022-01"], [source], draw)
    reports.cached_sample(spark, str(tmp_path), "comments", 3, 43, ["2022-01"], [source], draw)
    assert len(calls) == 3


def test_ragged_csv(spark, tmp_path):
    a = spark.createDataFrame([(1, "x")], "id int, a string")
    b = spark.createDataFrame([(2, "y, z")], "id int, b string")
    path = reports.write_ragged_csv([a, b], str(tmp_path / "r.csv"), ["id"])
    assert open(path).read().split("\n") == ["id,a,b", "1,x,", '2,,"y, z"', ""]
    assert open(reports.write_ragged_csv([], str(tmp_path / "e.csv"))).read() == "" and open(reports.write_ragged_csv([a.limit(0)], str(tmp_path / "e.csv"))).read() == ""


def test_tables_with_order_and_rounding(spark, tmp_path):
    queries = {"t": lambda s, d: s.createDataFrame([("b", 0.123456), ("a", None)], "k string, x double")}
    (path,) = reports.write_tables(spark, "", str(tmp_path), queries, {"t": (["k"], {"x": 2})})
    assert open(path).read().split() == ["k,x", "a,", "b,0.12"]


def test_top_rows_and_folded_order(spark):
    df = spark.createDataFrame([("b",), ("b",), ("A",), ("c",), ("a",), (None,)], "s string")
    assert sorted(r.s for r in describe.rows_of_top(df, "s", 2).collect()) == ["A", "b", "b"]
    assert [r.s for r in describe.folded_order(df, "s").orderBy("place").collect()] == ["A", "a", "b", "c"]


def test_exact_quantiles(spark):
    values = [("a", float(v)) for v in (1, 2, 2, 5, 9, -3, 0)] + [("b", 4.0), ("c", None)]
    df = spark.createDataFrame(values, "k string, value double")
    got = {r.k: (r.q, r.m) for r in panel.exact_quantiles(df, ["k"], {"q": 0.25, "m": 0.5}).collect()}
    want = {r.k: (r.q, r.m) for r in df.groupBy("k").agg(F.percentile("value", F.lit(0.25)).alias("q"), F.percentile("value", F.lit(0.5)).alias("m")).collect() if r.q is not None}
    assert got == want


def test_panel_has_depth_and_concentration(spark):
    s = spark.createDataFrame([("p", "ADHD", "op", "t", "", 1.0, 1, "2022-06")], "submission_id string, subreddit string, author string, title string, selftext string, score double, created_utc long, month string")
    rows = [("a", "t3_p", "x"), ("b", "t1_a", "x"), ("c", "t1_b", "y"), ("d", "t3_p", None)]
    c = spark.createDataFrame([(i, "p", parent, "ADHD", who, "b", 1.0, 2, "2022-06") for i, parent, who in rows], "comment_id string, link string, parent_id string, subreddit string, author string, body string, score double, created_utc long, month string")
    r = panel.panel(s, c).first()
    assert (r.mean_depth, r.threading_ratio, r.max_depth, r.community_type) == (1.75, 0.5, 3, "health")
    assert r.top1_share == pytest.approx(2 / 3) and r.top5_share == 1.0 and r.hhi == pytest.approx(5 / 9) and r.gini == pytest.approx(1 / 6) and r.pct1_share == pytest.approx(2 / 3)
