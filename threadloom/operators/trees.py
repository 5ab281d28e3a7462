"""Parent-child rows to full hierarchies by pointer doubling, with detection of cycles."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions.columns import strip
from threadloom.session import Scratch

OPEN = "open"  # the pointer names a node whose own way up is not known yet
RESOLVED = "resolved"  # the way up ends below a post
ORPHAN = "orphan"  # the way up ends below a comment that is missing
MALFORMED = "malformed"  # the way up ends at a comment whose parent names nothing
CYCLE = "cycle"  # lies on a circle of parents
BELOW_CYCLE = "below_cycle"  # leads into one


def read_parent(parent: Column) -> tuple[Column, Column]:
    """(comment id, post id) named by a parent: ``t1_`` or ``t3_`` in any case after outer blanks; else nulls."""
    text = strip(parent)
    rest = F.substr(text, F.lit(4))
    kind = F.lower(F.substring(text, 1, 3))
    named = rest != ""
    return F.when((kind == "t1_") & named, rest), F.when((kind == "t3_") & named, rest)


def read_nodes(df: DataFrame, node: str, parent: str) -> DataFrame:
    """One row per node: ``id``, ``ptr`` (parent node or null), ``root`` (post or null).

    Repeated rows of a node collapse; should copies name different parents, the smallest parent in
    code-point order counts.  Rows without id name no node.
    """
    ptr, root = read_parent(F.col(parent))
    rows = df.where(F.col(node).isNotNull()).select(F.col(node).alias("id"), F.struct(ptr.alias("ptr"), root.alias("root")).alias("up"))
    return rows.groupBy("id").agg(F.min("up").alias("up")).select("id", "up.ptr", "up.root")


@dataclass
class Forest:
    """What doubling found out.

    ``nodes``: id, ptr, root, inner (has children).  ``ended``: inner nodes whose way up ended, with
    ptr, state, root and level.  ``cycles``: id, cycle_id.  ``below``: id, cycle_id of inner nodes
    that lead into a cycle.  ``rounds``: joins it took.
    """

    nodes: DataFrame
    ended: DataFrame
    cycles: DataFrame
    below: DataFrame
    rounds: int
    scratch: Scratch
    parts: list[DataFrame] = field(default_factory=list)

    def gather(self) -> None:
        """Writes ``ended`` in one part, for it is read several times from here on, and drops the tables of the rounds."""
        if self.parts:
            self.ended = self.scratch.save(self.ended, "ended")
            self.scratch.drop(*self.parts)
            self.parts = []


def union_all(parts: list[DataFrame]) -> DataFrame:
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def prefixed(df: DataFrame, prefix: str = "a_") -> DataFrame:
    return df.select(*[F.col(c).alias(prefix + c) for c in df.columns])


def resolve_forest(nodes: DataFrame) -> Forest:
    """Doubles ancestor pointers until every node without a cycle above it has reached its top.

    Only nodes with children take part: leaves hang on by one join later.  Each round replaces a
    pointer by the pointer of the node it names, so the jump doubles.  While any open node is free
    of cycles the one nearest to a top ends in the next round; hence when a round ends none, all
    that is open lies on or leads into a cycle.  For those the doubling goes on until the set of
    pointed-to nodes stops shrinking: that set is the nodes on cycles.

    Every round is written to the shared folder and read again.  Parents with many children are hot
    only on the side that adaptive execution splits; the other side has one row per node.
    """
    scratch = Scratch(nodes.sparkSession)
    named = nodes.where(F.col("ptr").isNotNull()).groupBy(F.col("ptr").alias("id")).agg(F.lit(True).alias("inner"))
    nodes = scratch.save(nodes.join(named, "id", "left").withColumn("inner", F.coalesce("inner", F.lit(False))), "nodes")

    inner = nodes.where("inner")
    known = inner.select(F.col("id").alias("a_id"))
    state = F.when(F.col("a_id").isNotNull(), OPEN).when(F.col("root").isNotNull(), RESOLVED).when(F.col("ptr").isNotNull(), ORPHAN).otherwise(MALFORMED)
    first = inner.join(known, F.col("ptr") == F.col("a_id"), "left")
    first = first.select("id", F.col("ptr").alias("up"), F.col("a_id").alias("ptr"), state.alias("state"), "root", F.lit(1).cast("long").alias("level"), F.col("id").alias("low"))
    is_open = F.col("state") == OPEN
    current, left = scratch.save_counting(first, "round", is_open)
    ended, rounds, written = [current.where(~is_open)], 0, [current]
    while left:
        opened = current.where(is_open)
        above = prefixed(union_all([opened, *ended]).select("id", "ptr", "state", "root", "level", "low"))
        step = opened.join(above, F.col("ptr") == F.col("a_id")).select(
            "id", "up", F.col("a_ptr").alias("ptr"), F.col("a_state").alias("state"), F.col("a_root").alias("root"),
            (F.col("level") + F.col("a_level")).alias("level"), F.least("low", "a_low").alias("low"),
        )
        before = left
        current, left = scratch.save_counting(step, "round", is_open)
        written.append(current)
        rounds += 1
        if left == before:  # nothing ended, so all that is open circles
            break
        ended.append(current.where(~is_open))
    finished = union_all(ended).select("id", F.col("up").alias("ptr"), "state", "root", "level")

    if not left:
        none = nodes.select("id", F.col("id").alias("cycle_id")).where(F.lit(False))
        return Forest(nodes, finished, none, none, rounds, scratch, written)

    circling = scratch.save(current.where(is_open).select("id", "ptr", "low"), "circling")

    def double(rows: DataFrame, name: str) -> tuple[DataFrame, int]:
        """Pointers of twice the length, and how many minima fell."""
        joined = rows.join(prefixed(rows), F.col("ptr") == F.col("a_id"))
        step = joined.select("id", F.col("a_ptr").alias("ptr"), F.least("low", "a_low").alias("low"), (F.col("a_low") < F.col("low")).alias("moved"))
        return scratch.save_counting(step.select("id", "ptr", "low", "moved"), name, F.col("moved"))

    image = circling.select("ptr").distinct().count()
    while True:
        before, (circling, _) = circling, double(circling, "circling")
        scratch.drop(before)
        rounds += 1
        now = circling.select("ptr").distinct().count()
        if now == image:
            break
        image = now
    tops = circling.select(F.col("ptr").alias("id")).distinct()
    cycles = scratch.save(circling.join(tops, "id", "left_semi").select("id", "ptr", "low"), "cycles")
    while True:  # until no minimum falls: it then covers the whole circle
        before, (cycles, moved) = cycles, double(cycles, "cycles")
        scratch.drop(before)
        rounds += 1
        if not moved:
            break
    cycles = cycles.select("id", F.col("low").alias("cycle_id"))
    outside = circling.join(tops, "id", "left_anti").select("id", "ptr")
    below = outside.join(cycles.select(F.col("id").alias("ptr"), "cycle_id"), "ptr").select("id", "cycle_id")
    return Forest(nodes, finished, cycles, scratch.save(below, "below"), rounds, scratch, written)


def inner_paths(forest: Forest) -> DataFrame:
    """``ended`` with ``path`` (top to node), again by doubling: a path is put before the one it leads to.

    It runs after the cycles are known, because on a cycle a path would double for ever.
    """
    is_open = F.col("jump").isNotNull()
    way = forest.ended.select("*", F.when(F.col("level") > 1, F.col("ptr")).alias("jump"), F.array("id").alias("path"))
    current, done = way, [way.where(~is_open)]
    left = 1
    while left:
        opened = current.where(is_open)
        above = prefixed(union_all([opened, *done]).select("id", "jump", "path"))
        step = opened.join(above, F.col("jump") == F.col("a_id"))
        columns = [c for c in opened.columns if c not in ("jump", "path")]
        step = step.select(*columns, F.col("a_jump").alias("jump"), F.concat("a_path", "path").alias("path"))
        current, left = forest.scratch.save_counting(step, "paths", is_open)
        done.append(current.where(~is_open))
    return union_all(done).drop("jump")


def hierarchy(forest: Forest, paths: bool = True) -> DataFrame:
    """Every node: ``id``, ``state``, ``root``, ``level``, ``depth``, ``path`` (top to node), ``cycle_id``.

    ``level`` counts nodes from the top reached; ``depth`` is that level below a post and null for
    any other state.  On or below a cycle there is no path, level or root.
    """
    none = {"state": "string", "root": "string", "level": "long", "path": "array<string>"}
    nothing = [F.lit(None).cast(kind).alias(c) for c, kind in none.items() if c != "state"]
    forest.gather()
    ended = inner_paths(forest) if paths else forest.ended.withColumn("path", F.lit(None).cast("array<string>"))
    inner = ended.select("id", "state", "root", "level", "path", F.lit(None).cast("string").alias("cycle_id"))
    inner = inner.unionByName(forest.cycles.select("id", F.lit(CYCLE).alias("state"), *nothing, "cycle_id"))
    inner = inner.unionByName(forest.below.select("id", F.lit(BELOW_CYCLE).alias("state"), *nothing, "cycle_id"))
    up = inner.select(F.col("id").alias("a_id"), *[F.col(c).alias(f"a_{c}") for c in ("state", "root", "level", "path", "cycle_id")])
    leaves = forest.nodes.where(~F.col("inner")).join(up, F.col("ptr") == F.col("a_id"), "left")
    hangs = F.col("a_id").isNotNull()
    circles = F.col("a_state").isin(CYCLE, BELOW_CYCLE)
    own = F.when(F.col("root").isNotNull(), RESOLVED).when(F.col("ptr").isNotNull(), ORPHAN).otherwise(MALFORMED)
    leaves = leaves.select(
        "id",
        F.when(circles, BELOW_CYCLE).when(hangs, F.col("a_state")).otherwise(own).alias("state"),
        F.when(hangs, F.col("a_root")).otherwise(F.col("root")).alias("root"),
        F.when(circles, F.lit(None)).when(hangs, F.col("a_level") + 1).otherwise(F.lit(1)).cast("long").alias("level"),
        F.when(circles, F.lit(None)).when(hangs, F.concat("a_path", F.array("id"))).otherwise(F.array("id")).alias("path"),
        F.col("a_cycle_id").alias("cycle_id"),
    )
    every = inner.select(*leaves.columns).unionByName(leaves)
    return every.withColumn("depth", F.when(F.col("state") == RESOLVED, F.col("level")))


def below_cycles(forest: Forest) -> DataFrame:
    """The trees that hang off circles, as ``hierarchy`` gives them: ``path`` and ``level`` count from the node right below the circle.

    Their tops name a parent on the circle, which is left out, so they come out like orphans.
    """
    circling = forest.cycles.unionByName(forest.below).select(F.col("id").alias("ptr"))
    nodes = forest.nodes.select("id", "ptr", "root").join(circling, "ptr", "left_semi").join(forest.cycles.select("id"), "id", "left_anti")
    return hierarchy(resolve_forest(nodes))


def descendants(nodes: DataFrame) -> DataFrame:
    """``ancestor``, ``descendant``, ``distance`` for every pair on a path, read off the paths without a join."""
    pairs = nodes.where(F.col("path").isNotNull()).select(F.col("id").alias("descendant"), "level", F.posexplode("path").alias("pos", "ancestor"))
    return pairs.where(F.col("ancestor") != F.col("descendant")).select("ancestor", "descendant", (F.col("level") - 1 - F.col("pos")).alias("distance"))


def with_descendant_counts(nodes: DataFrame) -> DataFrame:
    """Adds ``n_descendants``; null on or below a cycle, where descent is not a tree.

    Counted level by level in powers of eight and not over pairs: what hangs less than 8k levels below
    a node is what hangs less than k levels below it or below a node k, 2k, ... or 7k levels down.
    Every node carries only its ancestors at those distances, so a chain of any length makes no
    quadratic number of rows.
    """
    scratch = Scratch(nodes.sparkSession)
    nodes = scratch.save(nodes, "nodes")
    deepest = int(nodes.agg(F.max(F.when(F.col("path").isNotNull(), F.col("level"))).alias("n")).first().n or 0)
    steps = [8**k for k in range(deepest.bit_length()) if 8**k < deepest]
    ancestors = [F.filter(F.array(*[F.when(F.col("level") > j * k, F.try_element_at("path", F.lit(-j * k - 1))) for j in range(1, 8)]), lambda x: x.isNotNull()) for k in steps]
    counts = nodes.where(F.col("path").isNotNull()).select("id", F.array(*ancestors).cast("array<array<string>>").alias("above"), F.lit(1).cast("long").alias("n"))
    for k in range(len(steps)):
        below = counts.select(F.explode(F.col("above")[k]).alias("id"), "n").groupBy("id").agg(F.sum("n").alias("more"))
        before, counts = counts, scratch.save(counts.join(below, "id", "left").select("id", "above", (F.col("n") + F.coalesce("more", F.lit(0))).alias("n")), "counts")
        scratch.drop(before)
    return nodes.join(counts.select("id", (F.col("n") - 1).alias("n_descendants")), "id", "left")
