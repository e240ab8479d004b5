"""Places for intermediate tables that every executor can see.

Lineage is cut by writing a table into the folder named by ``spark.checkpoint.dir`` and reading it
back: the work before it then runs once, and a lost executor cannot take a result with it.
"""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Temporary folders of applications that run in one process and have no shared folder, by application.
_OWN: dict[str, str] = {}
#: Rows of the batches that go through Python on the way to a table: texts may be long, and several tasks share an executor.
ROWS, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "2500"
#: With this setting, the shuffle files of a written table go when the table is there.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_root(spark: SparkSession) -> str:
    """The shared folder of the session, qualified; where none is configured the warehouse, and a temporary folder only where all runs in one process (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            _OWN[app] = tempfile.mkdtemp(prefix="vocalis-")
        root = f"file://{_OWN[app]}"
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root or spark.conf.get("spark.sql.warehouse.dir"))
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(place).toString()


class Workspace:
    """A fresh subfolder of the shared folder; it is removed when the application ends."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.path = f"{shared_root(spark).rstrip('/')}/vocalis-{label}-{uuid.uuid4().hex}"
        jvm = spark.sparkContext._jvm
        place = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        fs.mkdirs(place)
        fs.deleteOnExit(place)

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` as Parquet and return a DataFrame that reads the files."""
        path = f"{self.path}/{name}"
        conf, settings = self.spark.conf, {CLEANUP: "true", ROWS: BATCH_ROWS}
        before = {k: conf.get(k, None) for k in settings}
        for k, v in settings.items():
            conf.set(k, v)
        try:
            df.write.mode("overwrite").parquet(path)
        finally:
            for k, v in before.items():
                conf.unset(k) if v is None else conf.set(k, v)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        """Delete a table that no later plan reads."""
        jvm = self.spark.sparkContext._jvm
        place = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)

    def keep_only(self, *starts: str) -> None:
        """Delete all tables but those whose names begin so."""
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        for status in fs.listStatus(place):
            if not status.getPath().getName().startswith(starts):
                fs.delete(status.getPath(), True)

    def release(self) -> None:
        """Let go of plans that are no longer referenced, so that Spark's cleaner can delete what they hold."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fresh(name: str, columns: list[str]) -> str:
    """The name, lengthened until no column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name
