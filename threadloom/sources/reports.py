"""Sinks: single-file CSV, key-value summaries, pivots, JSON manifests with fingerprints and Markdown."""

from __future__ import annotations

import csv
import hashlib
import json
import os
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.sources.tables import file_marks

REPORT_ROWS = 100_000  # aggregated rows that a single report file may hold


def bounded_rows(df: DataFrame, order: Sequence[str] = (), limit: int = REPORT_ROWS) -> list:
    """Rows of an aggregate for a report; an error, never a cut, when there are more than the bound."""
    rows = (df.orderBy(*order) if order else df).limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows; write the table as Parquet instead")
    return rows


def write_csv(df: DataFrame, path: str, order: Sequence[str], decimals: Mapping[str, int] | None = None) -> str:
    """One CSV file in stable order; null is an empty field, named columns are rounded."""
    df = df.withColumns({c: F.round(F.col(c), d) for c, d in (decimals or {}).items()})
    rows = bounded_rows(df, order)
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path + ".part", "w", newline="", encoding="utf-8") as out:
        writer = csv.writer(out)
        writer.writerow(df.columns)
        writer.writerows([["" if v is None else v for v in row] for row in rows])
    os.replace(path + ".part", path)
    return path


def write_summary(stats: Mapping[str, object], path: str) -> str:
    """Key-value CSV; lists and maps as JSON, None as an empty field."""
    with open(path, "w", newline="", encoding="utf-8") as out:
        writer = csv.writer(out)
        writer.writerow(["key", "value"])
        for key, value in stats.items():
            writer.writerow([key, "" if value is None else json.dumps(value) if isinstance(value, (list, dict, tuple)) else value])
    return path


def fingerprint(paths: Sequence[str]) -> str:
    """SHA-256 over name, size and time of change of every file."""
    parts = {os.path.basename(p): [os.path.getsize(p), int(os.stat(p).st_mtime)] for p in paths}
    return hashlib.sha256(json.dumps(parts, sort_keys=True).encode()).hexdigest()


def _read_text(spark: SparkSession, path: str) -> str | None:
    """Content of a small file on any store, None without one."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return "".join(r.value for r in spark.read.text(path, wholetext=True).collect()) if fs.exists(target) else None


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    out.write(bytearray(text, "utf-8"))
    out.close()


def cached_table(spark: SparkSession, path: str, sources: Sequence[str], version: int, build: Callable[[], DataFrame]) -> DataFrame:
    """The Parquet table at ``path``, rebuilt when the marks of its sources or the version changed.

    Table and manifest may lie on any store; the manifest is written last, so a run that dies in the
    middle leaves no table that looks whole.
    """
    manifest = f"{path}.manifest.json"
    mark = json.dumps({"sources": file_marks(spark, *sources), "version": version}, sort_keys=True)
    if _read_text(spark, manifest) != mark:
        build().write.mode("overwrite").parquet(path)
        _write_text(spark, manifest, mark)
    return spark.read.parquet(path)


def cached_sample(spark: SparkSession, folder: str, kind: str, n: int, seed: int, months: Sequence[str], sources: Sequence[str], build: Callable[[], DataFrame]) -> DataFrame:
    """A sample kept under the hash of what it was asked for; drawn anew when its sources changed."""
    key = hashlib.sha256(f"{kind}-{n}-{seed}-{','.join(months)}".encode()).hexdigest()[:12]
    return cached_table(spark, f"{folder}/sample-{key}", sources, 1, build)


def write_ragged_csv(parts: Sequence[DataFrame], path: str, order: Sequence[str] = ()) -> str:
    """Records of different columns in one CSV; columns in the order in which they are first seen, missing ones empty.

    Without parts or rows the file is empty.
    """
    whole = parts[0] if parts else None
    for part in parts[1:]:
        whole = whole.unionByName(part, allowMissingColumns=True)
    rows = bounded_rows(whole, order) if whole is not None else []
    with open(path, "w", newline="", encoding="utf-8") as out:
        if rows:
            writer = csv.writer(out)
            writer.writerow(whole.columns)
            writer.writerows([["" if v is None else v for v in row] for row in rows])
    return path


def write_tables(spark: SparkSession, d: str, folder: str, queries: Mapping[str, Callable], tables: Mapping[str, tuple[Sequence[str], Mapping[str, int]]]) -> list[str]:
    """One CSV per named query, in its order and with its rounding; ``tables`` maps a query to (order, decimals)."""
    return [write_csv(queries[name](spark, d), f"{folder}/{name}.csv", order, decimals) for name, (order, decimals) in tables.items()]


# Long tables with their order and decimals.
LONG_TABLES = {
    "describe_counts": (["level", "subreddit", "month"], {}), "depth_buckets": (["subreddit", "month"], {"mean_depth": 4, "threading_ratio": 4}),
    "responsiveness_monthly": (["subreddit", "month"], {"reply_rate": 4, "unanswered_rate": 4, "op_followup_rate": 4, "median_latency_hours": 3}),
    "thread_structure": (["subreddit", "month"], {"op_return_share": 4, "multi_actor_share": 4, "focused_share": 4, "distributed_share": 4}),
    "support_capacity": (["subreddit", "month"], {"effective_helpers": 3, "helper_jaccard": 4}), "resilience_profile": (["subreddit"], {"pct_change": 2, "threading_ratio": 4, "mean_depth": 4}),
    "indexed_trend": (["group", "month"], {"index": 2}),
}


def markdown_table(df: DataFrame, order: Sequence[str] = (), limit: int = 50) -> str:
    """A table of a small aggregate; at most ``limit`` rows are shown and the rest is counted in a note."""
    rows = bounded_rows(df, order)
    text = ["| " + " | ".join(df.columns) + " |", "|" + " - |" * len(df.columns)]
    text += ["| " + " | ".join("" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v) for v in row) + " |" for row in rows[:limit]]
    return "\n".join(text + [f"\n{len(rows) - limit} more rows."] * (len(rows) > limit))


def run_report(stages: Mapping[str, Callable[[], DataFrame]], path: str) -> dict[str, str]:
    """Runs stages in order and rewrites the Markdown report after each, so a late failure leaves the earlier sections.

    Returns the state of each stage; the first error is raised after the report was written.
    """
    state, sections, error = {}, [], None
    for name, stage in stages.items():
        try:
            sections.append(f"## {name}\n\n{markdown_table(stage())}\n")
            state[name] = "done"
        except Exception as problem:  # noqa: BLE001
            state[name], error = "failed", problem
            sections.append(f"## {name}\n\nfailed: {type(problem).__name__}\n")
        with open(path, "w", encoding="utf-8") as out:
            out.write("# Report\n\n" + "\n".join(sections))
        if error:
            raise error
    return state


def write_manifest(stats: DataFrame, path: str, **facts: object) -> str:
    """JSON manifest of per-file statistics (a row per file) with totals and further facts."""
    rows = [r.asDict() for r in bounded_rows(stats, ["file"])]
    totals = {c: sum(r[c] or 0 for r in rows) for c in ("rows_read", "rows_written") if c in stats.columns}
    with open(path + ".part", "w", encoding="utf-8") as out:
        json.dump({"files": rows, "totals": totals, **facts}, out, indent=1, sort_keys=True)
    os.replace(path + ".part", path)
    return path
