"""Bucketed bitmaps against sets, and a dictionary that begins with one member."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from threadloom.llm import distinct
from threadloom.session import Scratch

LEVELS = {"all": [], "day": ["day"], "both": ["day", "g"]}


def test_dictionary_of_one_member_grows(spark):
    old = spark.createDataFrame([("m0", 0)], "member string, code long")
    rows = spark.createDataFrame([("m0", "h"), ("m1", "h"), ("m2", "h")], "member string, home string")
    codes = {r.member: r.code for r in distinct.encode_members(rows, Scratch(spark), known=old).collect()}
    assert codes["m0"] == 0 and sorted(codes.values()) == [0, 1, 2]
    empty = old.limit(0)
    assert sorted(r.code for r in distinct.encode_members(rows, Scratch(spark), known=empty).collect()) == [0, 1, 2]


def test_bucketed_bitmaps_are_exact(spark):
    rng = random.Random(5)
    members = [f"m{i}" for i in range(300)] + ["hot"] * 150 + ["", None]
    data = [(rng.choice(["d1", "d2", None]), rng.choice(["a", "b", "hot", "hot", None]), rng.choice(["x", "y", "z"]), rng.choice(members)) for _ in range(3000)]
    df = spark.createDataFrame(data, "day string, g string, kind string, member string").withColumns({"code": F.lit(1), "word": F.lit(2), "bucket": F.lit(3)})
    want = defaultdict(lambda: (set(), set()))
    for d, g, k, m in data:
        if m is not None and k != "z":
            for level, columns in LEVELS.items():
                if all({"day": d, "g": g}[c] is not None for c in columns):
                    want[level, d if "day" in columns else None, g if "g" in columns else None][k == "y"].add(m)
    for buckets in (1, 3, 64):
        coded = distinct.bucketed(df.where("kind <> 'z'"), ["day", "g"], ["x", "y"], buckets)
        rolled = distinct.bucket_bitmaps(coded, ["day", "g"], ["x", "y"], LEVELS)
        counts = distinct.count_bits(rolled, ["level", "day", "g"], {"x": F.col("x"), "and": F.col("x").bitwiseAND(F.col("y")), "or": F.col("x").bitwiseOR(F.col("y"))})
        got = {(r.level, r.day, r.g): (r.x, r["and"], r["or"]) for r in distinct.level_names(counts, LEVELS).collect()}
        assert got == {k: (len(x), len(x & y), len(x | y)) for k, (x, y) in want.items()}
    assert distinct.bucketed(df.limit(0), ["day", "g"], ["x", "y"]).count() == 0
