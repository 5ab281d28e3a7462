"""Session helper and the shared scratch area in which lineage is cut."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def build_session(app: str = "threadloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC times and adaptive execution; keyword names use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in (DEFAULTS | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it in ``spark.checkpoint.dir``.

    Only a local session may lack the setting; it then gets a temporary folder.  On a cluster a
    missing setting is an error, because a machine-local folder would be lost with its executor.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="threadloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


class Scratch:
    """Tables written to the shared folder so that a long plan restarts from files.

    ``save`` runs the plan once and returns a scan of what was written: a lost executor costs only
    the tasks that read it, and the planner sees real sizes.  ``drop`` deletes a table that is no
    longer read; whatever is left goes when the driver ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/threadloom-{uuid.uuid4().hex}"
        self.made = 0
        atexit.register(self.clear)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        self.made += 1
        path = f"{self.root}/{self.made:03d}-{name}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._threadloom_path = path
        return out

    def save_counting(self, df: DataFrame, name: str, rule: Column) -> tuple[DataFrame, int]:
        """The same, with the number of written rows for which the rule holds, counted while writing."""
        seen = Observation()
        out = self.save(df.observe(seen, F.count(F.when(rule, 1)).alias("n")), name)
        return out, seen.get["n"]

    def drop(self, *tables: DataFrame | None) -> None:
        for table in tables:
            if table is not None and getattr(table, "_threadloom_path", None):
                self._delete(table._threadloom_path)

    def clear(self) -> None:
        self._delete(self.root)

    def _delete(self, path: str) -> None:
        try:
            jvm = self.spark.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the gateway may be gone when the driver ends
            pass
