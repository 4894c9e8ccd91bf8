"""Session defaults."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def build_session(name: str = "rollmark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC; ``conf`` overrides, dots written as two underscores."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for key, value in (DEFAULTS | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once per Spark context: functions that workers call by
    reference are importable there, however the cluster was started."""
    context = spark.sparkContext
    if getattr(context, "_rollmark_shipped", False):
        return
    package = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="rollmark-")) / "rollmark_code.zip"
    with zipfile.ZipFile(target, "w") as out:
        for path in sorted(package.rglob("*.py")):
            out.write(path, path.relative_to(package.parent))
    context.addPyFile(str(target))
    context._rollmark_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the one the cluster names in ``spark.checkpoint.dir``.

    Where that is unset a session with a local master, as in tests, takes a temporary folder; any other
    master is refused, since its machines would each write to a disk of their own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    java_context = context._jsc.sc()
    if java_context.getCheckpointDir().isEmpty():
        if not named:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
            named = tempfile.mkdtemp(prefix="rollmark-")
            atexit.register(shutil.rmtree, named, True)
        context.setCheckpointDir(named)
        _delete_at_exit(spark, java_context.getCheckpointDir().get())
    return named or java_context.getCheckpointDir().get()


def _delete_at_exit(spark: SparkSession, path: str) -> None:
    """Delete a folder of this application when the driver ends; tables in it may be read until then."""
    jvm, configuration = spark._jvm, spark._jsc.hadoopConfiguration()

    def delete() -> None:
        with contextlib.suppress(Exception):  # the JVM may be gone
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(configuration).delete(target, True)

    atexit.register(delete)


def table_dir(spark: SparkSession) -> str:
    """A folder of this application within the shared one, deleted when the driver ends."""
    context = spark.sparkContext
    found = getattr(context, "_rollmark_tables", None)
    if found is None:
        found = context._rollmark_tables = f"{shared_dir(spark).rstrip('/')}/rollmark-{uuid.uuid4().hex}"
        _delete_at_exit(spark, found)
    return found


def saved(frame: DataFrame) -> DataFrame:
    """Cut the lineage: write ``frame`` to the shared folder once, and read it from there."""
    shared_dir(frame.sparkSession)
    return frame.checkpoint(eager=True)


def stored(frame: DataFrame) -> DataFrame:
    """Like ``saved``, as a Parquet table: its size is known, so that small tables are broadcast. For loops, too: a
    checkpoint keeps the estimated size of the plan it was made by, and estimates that multiply from
    round to round end as numbers of millions of digits."""
    path = f"{table_dir(frame.sparkSession)}/{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)
