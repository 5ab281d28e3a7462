"""Distinct counts, percentiles and packing against exact results."""

import random
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from threadloom.llm import distinct, packing, quantiles
from threadloom.session import Scratch


# distinct counts

def bitmap_input(spark, seed, n=400):
    rng = random.Random(seed)
    data = [(rng.choice(["d1", "d2", None]), rng.choice(["a", "b", "hot", "hot", "hot", None]), rng.choice(["x", "y"]), rng.choice([f"m{i}" for i in range(90)] + ["", None])) for _ in range(n)]
    return data, spark.createDataFrame(data, "day string, g string, kind string, member string").withColumn("code", F.lit(1)).withColumn("word", F.lit(2))


LEVELS = {"all": [], "day": ["day"], "both": ["day", "g"]}


def test_distinct_counts_are_exact(spark):
    data, df = bitmap_input(spark, 1)
    codes = distinct.encode_members(df.select("member", F.col("g").alias("home")), Scratch(spark))
    dense = sorted(r.code for r in codes.collect())
    assert dense == list(range(len({m for *_, m in data if m is not None})))
    parts = distinct.partial_bitmaps(df, codes, ["day", "g"], ["x", "y"])
    rolled = distinct.roll_up(parts, LEVELS, ["day", "g"], ["x", "y"])
    got = distinct.level_names(distinct.count_bits(rolled, ["level", "day", "g"], {"x": F.col("x"), "and": F.col("x").bitwiseAND(F.col("y")), "or": F.col("x").bitwiseOR(F.col("y"))}), LEVELS)
    want = defaultdict(lambda: (set(), set()))
    for d, g, k, m in data:
        if m is not None:
            for level, columns in LEVELS.items():
                key = (level, d if "day" in columns else None, g if "g" in columns else None)
                if all({"day": d, "g": g}[c] is not None for c in columns):
                    want[key][k == "y"].add(m)
    assert {(r.level, r.day, r.g): (r.x, r["and"], r["or"]) for r in got.collect()} == {k: (len(x), len(x & y), len(x | y)) for k, (x, y) in want.items()}


def test_partial_bitmaps_merge_and_dictionary_grows(spark):
    data, df = bitmap_input(spark, 2)
    scratch = Scratch(spark)
    half = df.where("day = 'd1'")
    old = distinct.encode_members(half.select("member", F.col("g").alias("home")), scratch)
    codes = distinct.encode_members(df.select("member", F.col("g").alias("home")), scratch, known=old)
    assert {(r.member, r.code) for r in old.collect()} <= {(r.member, r.code) for r in codes.collect()}
    assert sorted(r.code for r in codes.collect()) == list(range(codes.count()))
    a = distinct.partial_bitmaps(half, codes, ["g"], ["x", "y"])
    b = distinct.partial_bitmaps(df.where("day is null or day <> 'd1'"), codes, ["g"], ["x", "y"])
    merged = distinct.count_bits(distinct.merge_bitmaps(a.unionByName(b), ["g"], ["x", "y"]), ["g"], {"n": F.col("x").bitwiseOR(F.col("y"))})
    want = defaultdict(set)
    for _, g, _, m in data:
        if m is not None:
            want[g].add(m)
    assert {r.g: r.n for r in merged.collect()} == {g: len(s) for g, s in want.items()}


def test_distinct_empty(spark):
    _, df = bitmap_input(spark, 3)
    codes = distinct.encode_members(df.limit(0).select("member", F.col("g").alias("home")), Scratch(spark))
    assert codes.count() == 0 and distinct.partial_bitmaps(df, codes, ["g"], ["x"]).count() == 0


# percentiles

VALUES = [0.0, -3.5, 1e-9, 1e12, None, float("nan"), float("inf"), 7.0, 7.0, 7.0]


@pytest.mark.parametrize("alpha", [0.01, 0.05])
def test_percentiles_within_bound(spark, alpha):
    rng = random.Random(4)
    groups = {"log": [rng.lognormvariate(3, 2) for _ in range(801)], "neg": [-rng.random() * 100 - 1 for _ in range(200)], "one": [5.0], "ties": [3.0] * 50 + [9.0] * 51, "odd": VALUES}
    df = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs] + [("none", None)], "k string, v double").withColumn("n", F.lit("clash")).withColumn("bucket", F.lit(1))
    wanted = {"p0": 0.0, "p25": 0.25, "p50": 0.5, "p99": 0.99, "p100": 1.0}
    half = [quantiles.bucket_counts(part, ["k"], F.col("v"), alpha) for part in (df.where("v < 10"), df.where("not v < 10 or v is null"))]
    merged = quantiles.merge_counts(half[0].unionByName(half[1]), ["k"])
    got = {r.k: r for r in quantiles.percentiles(merged, ["k"], wanted, alpha).collect()}
    assert set(got) == set(groups)
    for k, vs in groups.items():
        xs = sorted(v for v in vs if v is not None and np.isfinite(v))
        assert got[k].n == len(xs)
        for name, q in wanted.items():
            place = q * (len(xs) - 1)
            low, high = xs[int(np.floor(place))], xs[int(np.ceil(place))]
            bound = alpha * (abs(np.quantile(xs, q)) if low * high >= 0 else max(abs(low), abs(high)))
            assert abs(got[k][name] - np.quantile(xs, q)) <= bound * (1 + 1e-6) + 1e-15, (k, name)


@given(st.floats(min_value=1e-300, max_value=1e300))
@settings(max_examples=200, deadline=None)
def test_bucket_formula(x):
    g = quantiles.gamma(0.01)
    i = np.ceil(np.log(x) / np.log(g))
    assert abs(2 * g**i / (g + 1) - x) <= 0.01 * x * (1 + 1e-9) + 1e-310


# packing

@given(st.lists(st.integers(1, 50), max_size=120))
@settings(max_examples=150, deadline=None)
def test_shard_packing(sizes):
    where = packing.pack_shard(sizes, 50)
    fill = defaultdict(int)
    for s, k in zip(sizes, where):
        fill[k] += s
    assert all(v <= 50 for v in fill.values()) and len(where) == len(sizes)
    assert len(fill) <= 2 * max(1, -(-sum(sizes) // 50)) + 1


def brute_square_choice(open_counts, size, cap):
    """Gap left after the best move, by trying all."""
    def cost(counts):
        return sum(n * n for g, n in counts.items() if 0 < g < cap)
    best = None
    for g in sorted([g for g, n in open_counts.items() if n and g >= size] + [cap]):
        after = dict(open_counts)
        if g < cap:
            after[g] -= 1
        left = g - size
        if left:
            after[left] = after.get(left, 0) + 1
        option = (cost(after), g == cap, left)
        best = option if best is None or option < best else best
    return best


@given(st.lists(st.integers(1, 12), max_size=60))
@settings(max_examples=150, deadline=None)
def test_every_placement_minimises_the_sum_of_squares(sizes):
    cap, packer = 12, packing.SquarePacker(12)
    for s in sizes:
        before = {g: int(packer.open[g]) for g in range(1, cap) if packer.open[g]}
        want = brute_square_choice(before, s, cap)[0]
        packer.place(s)
        assert int((packer.open[1:cap] ** 2).sum()) == want


def test_pack_documents(spark):
    texts = ["word " * n for n in (1, 5, 50, 900, 3000, 5000)] + ["", None, " ", "日本語のテキスト" * 50, "😀" * 40] * 3
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("n_tokens", F.lit("clash")).withColumn("piece", F.lit(1))
    counts = packing.token_counts(df)
    tokens = {r.doc_id: r.n_tokens for r in counts.collect()}
    encode = packing.encoder(None).encode_ordinary
    assert tokens == {k: len(encode(t or "")) for k, t in enumerate(texts)}
    got = packing.pack(counts, capacity=256, shard_items=8).collect()
    pieces, fill = defaultdict(list), defaultdict(int)
    for r in got:
        pieces[r.doc_id].append((r.piece, r.token_start, r.n_tokens))
        if r.container is None:
            assert r.n_tokens == 0
        else:
            fill[r.container] += r.n_tokens
    assert set(pieces) == set(tokens) and max(fill.values()) <= 256
    for doc, n in tokens.items():
        mine = sorted(pieces[doc])
        assert sum(k for *_, k in mine) == n and [s for _, s, _ in mine] == [256 * i for i in range(len(mine))]
        assert len(mine) == max(1, -(-n // 256))
    report = packing.fill_report(packing.pack(counts, capacity=256)).first()
    assert report.tokens == sum(tokens.values()) and report.containers >= report.least_containers
    assert packing.pack(counts.limit(0)).count() == 0 and packing.fill_report(packing.pack(counts.limit(0))).first().used_share == 1.0


def test_packing_wastes_little(spark):
    rng = random.Random(8)
    sizes = [min(2048, int(rng.lognormvariate(4.5, 1.3)) + 1) for _ in range(6000)]
    where = packing.pack_shard(sizes, 2048)
    assert len(set(where)) <= 1.01 * -(-sum(sizes) // 2048)
