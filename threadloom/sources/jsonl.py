"""Compressed JSON lines: discovery, reading with long windows, parsing, filtering, resuming and writing."""

from __future__ import annotations

import ast
import glob
import io
import json
import os
import re
import shutil
import warnings
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions.columns import epoch_month, epoch_seconds, shard_of, strip
from threadloom.operators.drift import with_document
from threadloom.session import Scratch
from threadloom.sources.reports import write_manifest

WINDOW = 1 << 31  # archives use longer windows than the built-in codec allows
BATCH_LINES = 20_000
PREFIXES = {"comments": "RC", "submissions": "RS"}


def months_between(first: str, last: str) -> list[str]:
    """All ``YYYY-MM`` from first to last, both included."""
    a, b = (int(m[:4]) * 12 + int(m[5:]) - 1 for m in (first, last))
    return [f"{k // 12:04d}-{k % 12 + 1:02d}" for k in range(a, b + 1)]


def target_paths(root: str, kind: str, first: str, last: str) -> list[str]:
    """The monthly archive files of a span, whether they exist or not."""
    return [f"{root}/{kind}/{PREFIXES[kind]}_{m}.zst" for m in months_between(first, last)]


def find_raw(root: str, kind: str, months: Sequence[str] | None = None, missing: str = "error") -> list[str]:
    """Existing monthly archives, sorted; with ``months`` only those.

    A month without archive is an error, or with ``missing`` = warn it is named in a warning and left out.
    """
    found = {m[1]: p for p in sorted(glob.glob(f"{root}/{kind}/{PREFIXES[kind]}_*.zst")) if (m := re.search(r"_(\d{4}-\d{2})\.zst$", p))}
    if months is None:
        return list(found.values())
    if absent := [m for m in months if m not in found]:
        if missing != "warn":
            raise FileNotFoundError(f"no {kind} archive for {', '.join(absent)}")
        warnings.warn(f"no {kind} archive for {', '.join(absent)}", stacklevel=2)
    return [found[m] for m in sorted(months) if m in found]


def matching_submissions(comment_paths: Sequence[str]) -> list[str]:
    """The filtered submission files that lie beside filtered comment files under the same name, each once, in their order."""
    out = []
    for path in comment_paths:
        folder, name = os.path.split(path)
        other = os.path.join(folder, name.replace("filter-comments-", "filter-submissions-", 1))
        if name.startswith("filter-comments-") and os.path.exists(other) and other not in out:
            out.append(other)
    return out


def find_filtered(folder: str, kind: str) -> list[str]:
    return sorted(glob.glob(f"{folder}/filter-{kind}-*.jsonl.zst"))


def load_name_list(path: str) -> list[str]:
    """Lower-case names from a file with a ``subreddits = [...]`` literal; ValueError without one."""
    m = re.search(r"subreddits\s*=\s*(\[.*?\])", open(path, encoding="utf-8").read(), re.DOTALL)
    if not m:
        raise ValueError(f"{path} has no list of subreddits")
    return sorted({str(x).strip().lower() for x in ast.literal_eval(m[1])})


def _open(path: str):
    raw = open(path.removeprefix("file://"), "rb")
    if path.endswith(".zst"):
        import zstandard

        raw = zstandard.ZstdDecompressor(max_window_size=WINDOW).stream_reader(raw, read_across_frames=True, closefd=True)
    return io.TextIOWrapper(io.BufferedReader(raw, 16 << 20), encoding="utf-8", errors="replace", newline="\n")


def read_lines(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """``file, line_no, value`` of all non-blank lines, one task per file, in batches of bounded size.

    The files are read where the task runs, so they must lie in storage that all executors mount.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["file"]:
                rows: list[tuple[str, int, str]] = []
                with _open(path) as lines:
                    for number, line in enumerate(lines, 1):
                        if line.strip():
                            rows.append((path, number, line.rstrip("\r\n")))
                        if len(rows) >= BATCH_LINES:
                            yield pd.DataFrame(rows, columns=["file", "line_no", "value"])
                            rows = []
                yield pd.DataFrame(rows, columns=["file", "line_no", "value"]).astype({"line_no": "int64"})

    files = spark.createDataFrame([(p,) for p in paths], "file string").repartition(max(1, len(paths)))
    return files.mapInPandas(run, "file string, line_no long, value string")


FIELDS = ("id", "created_utc", "subreddit", "subreddit_name_prefixed", "author", "score", "body", "title", "selftext", "parent_id", "link_id")


def parse_lines(lines: DataFrame) -> DataFrame:
    """Adds the known fields as text; null for a missing key and for JSON null.  Malformed lines are left out."""
    rows = lines.withColumn("__v", F.try_parse_json("value")).where(F.col("__v").isNotNull() & F.ltrim(F.col("value")).startswith("{"))
    return rows.select(*lines.columns, *[F.try_variant_get("__v", f"$.{f}", "string").alias(f) for f in FIELDS])


def scan_report(lines: DataFrame, keys: Sequence[str] = ("file",), value: str = "value") -> DataFrame:
    """Per key: lines, blank ones, those that are no JSON object (``parse_errors``) and records without time or community."""
    text = F.trim(F.coalesce(F.col(value), F.lit("")), F.lit(" \t\r\n\ufeff"))
    seen = with_document(lines, value)
    blank, parsed = text == "", F.col("__v").isNotNull()
    field = lambda f: F.try_variant_get("__v", f"$.{f}", "string")
    count = lambda rule: F.sum(rule.cast("long"))
    return seen.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("lines"), count(blank).alias("blank"), count(~blank & ~parsed).alias("parse_errors"), count(parsed & (F.coalesce(field("created_utc"), F.lit("")) == "")).alias("missing_time"),
        count(parsed & F.coalesce(field("subreddit"), field("subreddit_name_prefixed")).isNull()).alias("missing_community"),
    )


def community_of(prefixed: Column, plain: Column) -> Column:
    """Lower-case community: the prefixed name without ``r/``, else the plain one."""
    first = F.regexp_replace(F.lower(strip(prefixed)), "^/?r/", "")
    return F.coalesce(F.when(first != "", first), F.lower(strip(plain)))


def filter_lines(lines: DataFrame, names: Sequence[str] | DataFrame, start: int | None = None, end: int | None = None) -> DataFrame:
    """Parsed records of listed communities in [start, end) by their own top-level fields."""
    rows = parse_lines(lines).withColumn("community", community_of(F.col("subreddit_name_prefixed"), F.col("subreddit"))).withColumn("time", epoch_seconds(F.col("created_utc")))
    if start is not None:
        rows = rows.where(F.col("time") >= start)
    if end is not None:
        rows = rows.where(F.col("time") < end)
    if isinstance(names, DataFrame):
        return rows.join(names.select(F.lower("name").alias("community")), "community", "left_semi")
    return rows.where(F.col("community").isin([n.lower() for n in names]))


def file_stats(lines: DataFrame, kept: DataFrame) -> DataFrame:
    """Per file: lines read, kept, first and last time kept."""
    read = lines.groupBy("file").agg(F.count(F.lit(1)).alias("rows_read"))
    out = kept.groupBy("file").agg(F.count(F.lit(1)).alias("rows_written"), F.min("time").alias("first_utc"), F.max("time").alias("last_utc"))
    return read.join(out, "file", "left").fillna({"rows_written": 0})


def filtered_path(folder: str, kind: str, tag: str, path: str) -> str:
    """Where the kept lines of one input file go."""
    return f"{folder}/filter-{kind}-{tag}-{os.path.basename(path).split('.')[0]}.jsonl.zst"


def write_filtered(kept: DataFrame, folder: str, kind: str, tag: str) -> DataFrame:
    """Writes the raw lines as zstd JSON lines, one frame per input file, and returns (file, rows).

    Lines of one input are written by one task in order; frames can be appended by concatenation.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        sinks: dict[str, tuple] = {}
        for batch in batches:
            for path, part in batch.groupby("file", sort=False):
                if path not in sinks:
                    out = filtered_path(folder, kind, tag, path)
                    sinks[path] = [zstandard.ZstdCompressor().stream_writer(open(out + ".part", "wb")), out, 0]
                sinks[path][0].write("".join(v + "\n" for v in part["value"]).encode())
                sinks[path][2] += len(part)
        for writer, out, _ in sinks.values():
            writer.close()
            os.replace(out + ".part", out)
        yield pd.DataFrame([(p, n) for p, (_, _, n) in sinks.items()], columns=["file", "rows"]).astype({"rows": "int64"})

    os.makedirs(folder, exist_ok=True)
    ordered = kept.select("file", "line_no", "value").repartition("file").sortWithinPartitions("file", "line_no")
    return ordered.mapInPandas(run, "file string, rows long")


def write_merged(kept: DataFrame, stats: DataFrame, folder: str, kind: str, tag: str) -> str:
    """All kept lines in one zstd file beside a manifest of the statistics per input file.

    The frames of the inputs are written by tasks and then joined byte by byte, for frames concatenate.
    """
    inputs = [r.file for r in write_filtered(kept, folder, kind, f"{tag}-part").orderBy("file").collect()]  # one row per input file
    made = [filtered_path(folder, kind, f"{tag}-part", p) for p in inputs]
    path = f"{folder}/merged-{kind}-{tag}.jsonl.zst"
    with open(path + ".part", "wb") as out:
        for part in made:
            with open(part, "rb") as frame:
                shutil.copyfileobj(frame, out, 16 << 20)
    os.replace(path + ".part", path)
    for part in made:
        os.remove(part)
    write_manifest(stats, f"{folder}/manifest.json", output=os.path.basename(path))
    return path


def resume_filter(spark: SparkSession, paths: Sequence[str], progress: str, folder: str, kind: str, tag: str, names: Sequence[str], start: int | None = None, end: int | None = None) -> dict[str, int]:
    """Filters only files that the progress file does not name, and adds them to it; returns rows per new file."""
    done = json.load(open(progress)) if os.path.exists(progress) else {}
    todo = [p for p in paths if p not in done]
    if todo:
        lines = read_lines(spark, todo)
        written = {r.file: r.rows for r in write_filtered(filter_lines(lines, names, start, end), folder, kind, tag).collect()}  # one row per file
        done |= {p: written.get(p, 0) for p in todo}
        with open(progress + ".part", "w") as out:
            json.dump(done, out, indent=1, sort_keys=True)
        os.replace(progress + ".part", progress)
    return {p: done[p] for p in todo}


def verify(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """``file, status``: missing, empty, broken or ok, tested by decompressing the first byte."""

    def status(path: str) -> str:
        if not os.path.exists(path):
            return "missing"
        if not os.path.getsize(path):
            return "empty"
        try:
            with _open(path) as lines:
                return "ok" if lines.read(1) else "empty"
        except Exception:
            return "broken"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(status=[status(p) for p in batch["file"]])

    return spark.createDataFrame([(p,) for p in paths], "file string").mapInPandas(run, "file string, status string")


def canonical_records(parsed: DataFrame, kind: str) -> DataFrame:
    """Canonical submissions or comments of parsed lines; see ``sources.canonical``."""
    from threadloom.sources.canonical import canonical_comments, canonical_submissions

    rows = parsed.withColumn("subreddit", community_of(F.col("subreddit_name_prefixed"), F.col("subreddit")))
    if kind == "submissions":
        return canonical_submissions(rows, "id")
    return canonical_comments(rows.withColumn("submission_id", F.coalesce("link_id", F.when(F.lower("parent_id").startswith("t3_"), F.col("parent_id")))), "id")


def write_canonical(records: DataFrame, path: str, mode: str = "append") -> None:
    """Parquet partitioned by month, the store all later analyses prune by month."""
    records.withColumn("month", F.coalesce("month", F.lit("unknown"))).write.mode(mode).partitionBy("month").option("compression", "zstd").parquet(path)


def export_window(spark: SparkSession, paths: Sequence[str], time: str, start: str, end: str, out: str) -> DataFrame:
    """Union by name of Parquet files cut to [start, end), written as zstd Parquet; returns rows and time range."""
    rows = spark.read.option("mergeSchema", "true").parquet(*paths).where((F.col(time) >= F.lit(start).cast("timestamp")) & (F.col(time) < F.lit(end).cast("timestamp")))
    rows.write.mode("overwrite").option("compression", "zstd").parquet(out)
    return spark.read.parquet(out).agg(F.count(F.lit(1)).alias("rows"), F.min(time).alias("first"), F.max(time).alias("last"))


def thread_key(kind: str) -> Column:
    """Thread of a parsed record: its post by link, else by a ``t3_`` parent, else its own id."""
    if kind == "submissions":
        return F.col("id")
    strip3 = lambda c: F.when(F.lower(c).startswith("t3_"), F.substr(c, F.lit(4)))
    return F.coalesce(strip3(F.col("link_id")), strip3(F.col("parent_id")), F.col("id"))


def write_thread_shards(records: DataFrame, kind: str, shards: int, path: str) -> None:
    """Parquet partitioned by ``shard`` = CRC-32 of the thread modulo ``shards``; all records of a thread share a shard.

    Rows are spread over tasks as they come and not by shard, so one huge thread fills no single task.
    Records without any id are left out.
    """
    key = thread_key(kind)
    placed = records.withColumn("shard", shard_of(key, shards)).where(F.col("shard").isNotNull())
    placed.write.mode("overwrite").partitionBy("shard").option("compression", "zstd").parquet(path)


def read_thread_shards(spark: SparkSession, path: str, shards: Sequence[int] | None = None) -> DataFrame:
    """Records of the named shards, or of all; only their folders are read."""
    rows = spark.read.parquet(path)
    return rows if shards is None else rows.where(F.col("shard").isin(*shards))


def by_shard(spark: SparkSession, path: str, shards: int, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``build`` run shard by shard and united, for results per thread: no thread lies in two shards.

    Each part is written before the next begins, so one shard's work is held at a time.
    """
    scratch, whole = Scratch(spark), None
    for shard in range(shards):
        part = scratch.save(build(read_thread_shards(spark, path, [shard]).drop("shard")), "shard")
        whole = part if whole is None else whole.unionByName(part)
    return whole


def check_table(df: DataFrame, columns: dict[str, str], keys: Sequence[str] = ()) -> list[str]:
    """What is wrong with a stored table: missing columns, other types, no rows, repeated keys."""
    kinds = dict(df.dtypes)
    wrong = [f"no column {c}" for c in columns if c not in kinds] + [f"{c} is {kinds[c]}, not {k}" for c, k in columns.items() if c in kinds and kinds[c] != k]
    if not df.limit(1).count():
        wrong.append("no rows")
    elif keys and not wrong and df.groupBy(*keys).count().where("count > 1").limit(1).count():
        wrong.append(f"repeated {', '.join(keys)}")
    return wrong


def monthly_coverage(records: DataFrame) -> DataFrame:
    return records.groupBy(epoch_month(F.col("created_utc")).alias("month")).agg(F.count(F.lit(1)).alias("rows"))
