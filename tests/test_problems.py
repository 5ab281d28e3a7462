"""The general data problems against brute force, with nulls, ties, repeats, empty tables and extra columns."""

import datetime as dt
import json
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from threadloom.functions.columns import compare_name, epoch_day, post_key
from threadloom.operators import dedup, drift, rolling, skew, trees


# rolling totals

def brute_rolling(events, n):
    days = defaultdict(Counter)
    for e, d, v in events:
        if e is not None and d is not None:
            days[e][d] += v or 0
    out = []
    for e, by in days.items():
        day = min(by)
        while day <= max(by):
            out.append((e, day, sum(by.get(day - dt.timedelta(k), 0) for k in range(n))))
            day += dt.timedelta(1)
    return sorted(out)


def test_rolling_totals(spark):
    rng = random.Random(1)
    start = dt.date(2022, 1, 1)
    events = [(rng.choice(["a", "b", None]), start + dt.timedelta(rng.choice([0, 3, 4, 40, 41, 90])), rng.choice([1, 2, None])) for _ in range(60)] + [("c", start, 5), ("a", None, 1)]
    df = spark.createDataFrame(events, "entity string, day date, value int").withColumn("total", F.lit("clash"))
    got = rolling.rolling_totals(df, F.col("entity"), F.col("day"), F.col("value"))
    for n in (7, 30):
        assert sorted((r.entity, r.day, r[f"total_{n}"]) for r in got.collect()) == brute_rolling(events, n)
    assert all(abs(r.mean_7 - r.total_7 / 7) < 1e-12 for r in got.collect())


def test_rolling_empty(spark):
    df = spark.createDataFrame([], "subreddit string, created_utc long")
    assert rolling.rolling_totals(df, compare_name(F.col("subreddit")), epoch_day(F.col("created_utc")), F.lit(1)).count() == 0


# hierarchies

def brute_tree(parents):
    """parents: id -> raw parent; returns id -> (state, path or None, cycle id)"""
    def up(raw):
        text = (raw or "").strip()
        head, rest = text[:3].lower(), text[3:]
        return ("c", rest) if head == "t1_" and rest else ("p", rest) if head == "t3_" and rest else ("x", None)
    out = {}
    for node in parents:
        path, seen = [node], {node}
        while True:
            kind, target = up(parents[path[0]])
            if kind == "p":
                out[node] = ("resolved", path, None)
                break
            if kind == "x":
                out[node] = ("malformed", path, None)
                break
            if target not in parents:
                out[node] = ("orphan", path, None)
                break
            if target in seen:
                ring = [target]
                while True:
                    nxt = up(parents[ring[-1]])[1]
                    if nxt == target:
                        break
                    ring.append(nxt)
                out[node] = ("cycle" if node in ring else "below_cycle", None, min(ring))
                break
            path.insert(0, target)
            seen.add(target)
    return out


def forest_case(seed):
    rng = random.Random(seed)
    ids = [f"k{i:03d}" for i in range(120)]
    rng.shuffle(ids)
    parents = {}
    for i, node in enumerate(ids):
        roll = rng.random()
        if roll < 0.2:
            parents[node] = rng.choice(["t3_p1", " T3_p2\t"])
        elif roll < 0.25:
            parents[node] = rng.choice([None, "", "t5_x", "t1_", "t1_gone", "k001"])
        else:
            parents[node] = rng.choice(["t1_", "T1_"]) + (rng.choice(ids[:i]) if i and roll < 0.95 else rng.choice(ids))
    chain = [f"z{i:03d}" for i in range(150)]
    parents |= {c: f"t1_{chain[i - 1]}" if i else "t3_deep" for i, c in enumerate(chain)}
    ring = [f"r{i}" for i in range(7)]
    parents |= {c: f"t1_{ring[(i + 1) % 7]}" for i, c in enumerate(ring)}
    parents |= {f"tail{i}": f"t1_tail{i - 1}" if i else "t1_r3" for i in range(40)}
    parents |= {"self": "t1_self", "leaf": "t1_self"}
    return parents


@pytest.mark.parametrize("seed", [1, 2])
def test_hierarchy(spark, seed):
    parents = forest_case(seed)
    records = list(parents.items()) * 2 + [(None, "t3_p1")]
    df = spark.createDataFrame(records, "comment_id string, parent_id string").withColumn("id", F.lit("clash"))
    got = {r.id: r for r in trees.with_descendant_counts(trees.hierarchy(trees.resolve_forest(trees.read_nodes(df, "comment_id", "parent_id")))).collect()}
    want = brute_tree(parents)
    assert set(got) == set(want)
    kids = Counter(a for _, path, _ in want.values() if path for a in path[:-1])
    for node, (state, path, cycle) in want.items():
        r = got[node]
        assert (r.state, r.path, r.cycle_id) == (state, path, cycle), node
        assert r.depth == (len(path) if state == "resolved" else None)
        assert r.n_descendants == (kids[node] if path else None)


def test_hierarchy_edges(spark):
    empty = spark.createDataFrame([], "comment_id string, parent_id string")
    forest = trees.resolve_forest(trees.read_nodes(empty, "comment_id", "parent_id"))
    assert forest.cycles.count() == 0 and trees.hierarchy(forest).count() == 0
    flat = spark.createDataFrame([("a", "t3_x"), ("b", "t1_a")], "comment_id string, parent_id string")
    pairs = trees.descendants(trees.hierarchy(trees.resolve_forest(trees.read_nodes(flat, "comment_id", "parent_id")))).collect()
    assert [(p.ancestor, p.descendant, p.distance) for p in pairs] == [("a", "b", 1)]


def test_hierarchy_does_not_depend_on_order_or_partitions(spark, rows):
    parents = list(forest_case(3).items())
    results = []
    for n, order in ((1, 1), (7, -1)):
        df = spark.createDataFrame(parents[::order], "comment_id string, parent_id string").repartition(n)
        results.append(rows(trees.hierarchy(trees.resolve_forest(trees.read_nodes(df, "comment_id", "parent_id")), paths=False), "id", "state", "level", "cycle_id"))
    assert results[0] == results[1]


# skew

def test_key_totals(spark):
    rng = random.Random(5)
    data = [(rng.choice(["hot"] * 8 + ["a", "b", None]), rng.choice([f"m{i}" for i in range(9)] + [None]), rng.choice([0, 1, 5, None])) for _ in range(500)] + [("lone", None, 3), ("zero", "m", 0)]
    df = spark.createDataFrame(data, "k string, m string, v long").withColumn("salt", F.lit(1)).withColumn("key", F.lit("clash"))
    got = {r.key: r for r in skew.key_totals(df, F.col("k"), F.col("m"), F.col("v"), share=0.01, salts=4).collect()}
    for key in {k for k, _, _ in data}:
        mine = [(m, v or 0) for k, m, v in data if k == key]
        sums = Counter()
        for m, v in mine:
            if m is not None:
                sums[m] += v
        total = sum(sums.values())
        ordered = sorted(sums.items(), key=lambda x: (-x[1], x[0]))
        r = got[key]
        assert (r.n_rows, r.value_total, r.n_members, r.member_total) == (len(mine), sum(v for _, v in mine), len(sums), total)
        for k in (1, 5):
            assert abs(r[f"top{k}_share"] - (sum(v for _, v in ordered[:k]) / total if total else 0.0)) < 1e-12


def test_skew_edges(spark):
    empty = spark.createDataFrame([], "k string, m string, v long")
    totals = skew.key_totals(empty, F.col("k"), F.col("m"), F.col("v"))
    assert totals.count() == 0 and skew.dominant_keys(totals).count() == 0
    few = spark.createDataFrame([("a", "m", 1)] + [(None, "m", 1)] * 19, "k string, m string, v long")
    assert [r.key for r in skew.dominant_keys(skew.key_totals(few, F.col("k"), F.col("m"), F.col("v"))).collect()] == ["a"]


def test_salting_leaves_no_hot_partial_group(spark):
    df = spark.range(20000).select(F.lit("hot").alias("key"), F.concat(F.lit("m"), F.col("id")).alias("member"))
    sizes = [r["count"] for r in skew.salted(df, "member", salts=16).groupBy("key", "salt").count().collect()]
    assert len(sizes) == 16 and max(sizes) < 2 * 20000 / 16


# redelivery

DELIVERIES = [(1, "t3_A", 5), (2, " a ", 3), (3, "T3_a", 3), (4, None, 1), (5, "t3_", 1), (6, "b", None), (7, "b", 9), (8, "c", None), (9, "c", None), (10, "d", 1)]


def deliveries(spark):
    t = dt.datetime(2022, 1, 1)
    data = [(i, s, None if h is None else t + dt.timedelta(hours=h)) for i, s, h in DELIVERIES]
    return spark.createDataFrame(data, "delivery_id long, submission_id string, received_at timestamp").withColumn("__key", F.lit(0)).withColumn("__row", F.lit(1))


def test_redelivery(spark):
    df = deliveries(spark)
    key = post_key(F.col("submission_id"))
    assert sorted(r.delivery_id for r in dedup.surplus_deliveries(df, key, "received_at", "delivery_id").collect()) == [1, 3, 6, 9]
    kept = dedup.keep_first(df.unionByName(df), key, "received_at", "delivery_id")
    assert sorted(r.delivery_id for r in kept.collect()) == [2, 4, 4, 5, 5, 7, 8, 10]
    assert kept.columns == df.columns
    assert dedup.surplus_deliveries(df.limit(0), key, "received_at", "delivery_id").count() == 0


# drift

def feed(spark, files, feed="f"):
    data = [(feed, n, k, line) for n, lines in enumerate(files) for k, line in enumerate(lines, 1)]
    return spark.createDataFrame(data, "feed string, file_no int, line_no int, payload string")


def lines(n, start=0, **rename):
    out = []
    for i in range(start, start + n):
        base = {"submission_id": f"m{i:05d}", "author": f"user_{i * 7}", "created_utc": 1640995200 + i * 977, "score": i % 5, "title": "x y"}
        out.append(json.dumps({rename.get(k, k): v for k, v in base.items() if rename.get(k, k)}))
    return out


def changes(df):
    return sorted((r.file_no, r.field, r.change) for r in drift.layout_changes(df).collect())


def test_layout_changes(spark):
    def later(text, **kw):
        doc = json.loads(text)
        return json.dumps({kw.get(k, k): v for k, v in doc.items()})
    first = lines(20)
    renamed = [later(x, author="user", created_utc="created_at") for x in first[-5:] + lines(20, 20)]
    objects = []
    for x in renamed[-6:] + [later(y, author="user", created_utc="created_at") for y in lines(20, 60)]:
        d = json.loads(x)
        d["poster"] = {"name": d.pop("user"), "n": 1}
        d["created_at"] = d["created_at"] * 1000.0 + 0.5
        del d["title"]
        d["flair"] = None
        objects.append(json.dumps(d))
    df = feed(spark, [first + ["", "[1]", '"x"', first[0][:20]], renamed, objects])
    assert changes(df) == [
        (1, "created_at", "renamed"), (1, "user", "renamed"),
        (2, "created_at", "retyped"), (2, "flair", "added"), (2, "poster", "renamed"), (2, "poster", "retyped"), (2, "title", "removed"),
    ]


def test_added_and_removed_without_redelivery(spark):
    df = feed(spark, [lines(20), [x.replace('"author"', '"writer"') for x in lines(20, 100)]])
    assert changes(df) == [(1, "author", "removed"), (1, "writer", "added")]


def test_drift_edges(spark):
    assert changes(feed(spark, [])) == []
    assert changes(feed(spark, [lines(5)])) == []
    assert changes(feed(spark, [lines(10), lines(9, 20) + [json.dumps({"rare": 1})]])) == []
    assert drift.rescue_ingest(feed(spark, [])).count() == 0


def test_rescue_and_replay(spark):
    first = lines(10)
    second = [x.replace('"author"', '"posted_by"') for x in first[-4:] + lines(10, 10)]
    odd = '{"submission_id": "odd", "Author": {"name": "bob", "id": 3}, "created_utc": "2022-01-01T00:00:00Z", "score": "many", "flair": "f", "num_comments": 3, "author": "bob"}'
    df = feed(spark, [first + [odd, "{broken", ""], second])
    got = drift.replay(drift.rescue_ingest(df))
    table = {(r.file_no, r.line_no): r for r in got.collect()}
    assert len(table) == df.count()
    r = table[0, 11]
    assert (r.submission_id, r.author, r.created_utc, r.score, r.flair, r.num_comments) == ("odd", "bob", 1640995200, None, "f", 3)
    assert json.loads(r.rescued) == {"Author": {"name": "bob", "id": 3}, "score": "many"}
    assert table[0, 12].corrupt == "{broken" and table[0, 12].submission_id is None
    assert table[1, 1].author == json.loads(second[0])["posted_by"] and table[1, 1].rescued is None
    assert dict(got.dtypes)["created_utc"] == "bigint" and dict(got.dtypes)["score"] == "double"
