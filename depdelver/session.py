"""Session set-up and the one place that cuts lineage.

Intermediate tables are written as Parquet below the folder that the cluster names in
``spark.checkpoint.dir``; every executor sees that folder, so a lost executor costs a
re-read, never a recomputation of the plan that made the table.
"""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("depdelver")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def command_session(cores: str = "*") -> SparkSession:
    """The session of spark-submit or of whoever called, else a local one."""
    submitted = "PYSPARK_GATEWAY_PORT" in os.environ or "SPARK_REMOTE" in os.environ or "--master" in os.environ.get("PYSPARK_SUBMIT_ARGS", "")
    if submitted and not SparkSession.getActiveSession():
        return SparkSession.builder.appName("depdelver").getOrCreate()
    return SparkSession.getActiveSession() or local_session(cores)


def ship_code(spark: SparkSession) -> None:
    """Give Python workers this package, where they would not find it by themselves."""
    package = Path(__file__).resolve().parent
    root, sc = str(package.parent), spark.sparkContext
    if os.getcwd() == root or root in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(sc, "_has_depdelver", False):
        return
    archive = Path(tempfile.mkdtemp(prefix="depdelver-")) / "depdelver.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    sc.addPyFile(str(archive))  # served by the driver to every executor
    sc._has_depdelver = True


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. One is made where none is set, on one machine only."""
    sc = spark.sparkContext
    found = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="depdelver-"))
        found = sc.getCheckpointDir()
    return found


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session is gone: its owner clears the folder
        pass


#: Paths of the tables that were written inside each open ``settle``.
_open: list[list[str]] = []


@contextmanager
def freed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is planned and run meanwhile go when it has run, not when the driver collects its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def cut(df: DataFrame, by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder, with a folder for each value of the column ``by``, and return the table that was written."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    with freed(spark):
        (df.write.partitionBy(by) if by else df.write).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    atexit.register(_delete, spark, path)
    if _open:
        _open[-1].append(path)
    return out


def settle(make: Callable[[], DataFrame]) -> DataFrame:
    """The table of what ``make`` returns; the tables that were cut on the way are deleted."""
    _open.append([])
    try:
        out = cut(make())
    finally:
        made = _open.pop()
    for path in made:
        if path != out._cut_path:
            _delete(out.sparkSession, path)
    if _open:
        _open[-1].append(out._cut_path)
    return out


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is such a folder or file."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def size_of(df: DataFrame) -> int:
    """Bytes on disk of a table made by :func:`cut`."""
    jvm = df.sparkSession.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(df._cut_path)
    return p.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).getContentSummary(p).getLength()


def drop_cut(df: DataFrame) -> None:
    """Delete a table made by :func:`cut` that nothing reads any more."""
    _delete(df.sparkSession, df._cut_path)
