"""Cases that once gave wrong results in the general operators."""

from pyspark.sql import functions as F

from threadloom.operators import dedup, drift, skew


def test_only_copy_without_tie_is_kept(spark):
    df = spark.createDataFrame([("a", 1, None), ("b", 1, 7), ("b", 2, None), ("c", 1, 7), ("c", 2, 8)], "k string, t int, n long")
    got = sorted((r.n is None, r.n) for r in dedup.surplus_deliveries(df, F.col("k"), "t", "n").collect())
    assert got == [(False, 8), (True, None)]  # the later copies of c and b; the only copy of a stays


def feed(spark, *files):
    data = [("f", n, k, line) for n, lines in enumerate(files) for k, line in enumerate(lines, 1)]
    return spark.createDataFrame(data, "feed string, file_no int, line_no int, payload string")


def test_valid_objects_are_read(spark):
    lines = ['{"a": 1, "a": "x"}', '﻿{"a": 2}', ' {"a": 3} ', '{"a": 4} tail', '{"a": 5', "[1]", "", None]
    df = feed(spark, lines)
    got = {r.line_no: r.doc for r in drift.read_records(df).select("line_no", F.col("doc").cast("map<string,string>").alias("doc")).collect()}
    assert got == {1: {"a": "x"}, 2: {"a": "2"}, 3: {"a": "3"}}
    assert spark.conf.get(drift.REPEATED_KEYS, "false") == "false"
    table = {r.line_no: r for r in drift.rescue_ingest(df).collect()}
    assert table[1].rescued == '{"a":"x"}' and table[2].corrupt is None and table[4].corrupt == '{"a": 4} tail'


def test_records_without_fields_count(spark):
    df = feed(spark, ['{"a": 1}'] * 2 + ["{}"] * 8, ['{"a": 1}'] * 1 + ["{}"] * 8)  # a fifth in the first file, less in the second
    assert [(r.file_no, r.field, r.change) for r in drift.layout_changes(df).collect()] == [(1, "a", "removed")]


def test_key_sums_agree_with_key_totals(spark):
    rows = [("hot", f"m{i % 50}", i) for i in range(300)] + [(None, "x", 5), ("cold", None, None), ("cold", "y", 2)]
    df = spark.createDataFrame(rows, "k string, m string, v int")
    sums = {r.key: (r.n_rows, r.value_total) for r in skew.key_sums(df, F.col("k"), F.col("m"), F.col("v")).collect()}
    assert sums == {r.key: (r.n_rows, r.value_total) for r in skew.key_totals(df, F.col("k"), F.col("m"), F.col("v")).collect()}
    assert sums == {"hot": (300, sum(range(300))), None: (1, 5), "cold": (2, 2)}
    assert [r.key for r in skew.dominant_keys(skew.key_sums(df, F.col("k"), F.col("m"), F.col("v"))).collect()] == ["hot"]
