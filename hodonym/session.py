"""Sessions and the shared scratch folder in which operators cut their lineage."""

from __future__ import annotations

import atexit
import io
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_FOLDERS: dict[str, str] = {}
_SHIPPED: set[str] = set()


def session(name: str = "hodonym", cpus: int | str = "*", **conf: str) -> SparkSession:
    """A local session with the settings that the operators expect; on a cluster use the one at hand."""
    b = SparkSession.builder.appName(name).master(f"local[{cpus}]")
    for k, v in {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "12g",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }.items():
        b = b.config(k, v)
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_dir(spark: SparkSession) -> str:
    """This application's folder in ``spark.checkpoint.dir``, which all executors share; in local mode without that setting an own one.

    The folder and what is in it are deleted when the driver's JVM ends, as results are read from it until then.
    """
    context = spark.sparkContext
    app = context.applicationId
    if app not in _FOLDERS:
        at = spark.conf.get("spark.checkpoint.dir", None)
        if not at and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not at:
            at = tempfile.mkdtemp(prefix="hodonym-")
            atexit.register(shutil.rmtree, at, ignore_errors=True)
            at = "file://" + at
        folder = context._jvm.org.apache.hadoop.fs.Path(f"{at.rstrip('/')}/hodonym-{app}-{uuid.uuid4().hex[:8]}")
        files = folder.getFileSystem(context._jsc.hadoopConfiguration())
        files.mkdirs(folder)
        files.deleteOnExit(folder)
        _FOLDERS[app] = folder.toString()
    return _FOLDERS[app]


def ship_code(spark: SparkSession) -> None:
    """Give this package to the Python workers, wherever they run; once per application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    _SHIPPED.add(app)
    package, packed = Path(__file__).resolve().parent, io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    jvm, context = spark.sparkContext._jvm, spark.sparkContext
    at = jvm.org.apache.hadoop.fs.Path(f"{scratch_dir(spark)}/{package.name}.zip")
    out = at.getFileSystem(context._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(packed.getvalue())
    finally:
        out.close()
    context.addPyFile(at.toString())


#: Bytes on disk up to which the planner may broadcast a written table.
FEW_BYTES = 1 << 20


def materialize(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back, so that losing executors costs no more than a re-read.

    What is on disk is compressed and tells little of its size in memory. So joins with a table of more than ``FEW_BYTES`` are asked to
    sort and merge; those with a smaller one are left to the planner.
    """
    spark = df.sparkSession
    at, context = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}", spark.sparkContext
    df.write.parquet(at)
    path = context._jvm.org.apache.hadoop.fs.Path(at)
    size = path.getFileSystem(context._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    back = spark.read.schema(df.schema).parquet(at)
    return back if size <= FEW_BYTES else back.hint("merge")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def parallelism(spark: SparkSession) -> int:
    """Partitions for an explicit repartition: the session's setting, but never fewer than the cores."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
