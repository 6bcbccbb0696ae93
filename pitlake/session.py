"""Session defaults and the shared working folder."""

from __future__ import annotations

import os
import pathlib
import re
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

#: Settings of a session of our own. A cluster's own settings always hold over these.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build(master: str = "local[*]", app: str = "pitlake", **conf: str) -> SparkSession:
    builder = SparkSession.builder.master(master).appName(app)
    for key, value in (DEFAULTS | conf).items():
        builder = builder.config(key, value)
    return ship(builder.getOrCreate())


#: Tables written by each application, in the order of their making.
_written: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which all executors share.

    Where the session names none, a temporary folder is set on it in local mode, where driver and executors are one process (tests); elsewhere that is an
    error, since other machines would find nothing there.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        folder = "file://" + tempfile.mkdtemp(prefix="pitlake-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A path for a table of its own in the shared folder; clear() deletes it."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def clear(spark: SparkSession) -> int:
    """Deletes the tables that this application's operators have written so far, once no result that reads them is needed any more; returns their number."""
    paths = _written.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    return len(paths)


def materialised(df: DataFrame, label: str, **options: object) -> DataFrame:
    """df written to the shared folder and read again: its lineage is cut and losing executors loses nothing."""
    spark, path = df.sparkSession, scratch(df.sparkSession, label)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def local_path(uri: str) -> str:
    return uri.removeprefix("file://") if uri.startswith("file://") else os.path.abspath(uri)


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package to the executors, once per application, so that their Python workers can import it."""
    context = spark.sparkContext
    if not getattr(context, "_pitlake_shipped", False):
        package = pathlib.Path(__file__).parent
        archive = pathlib.Path(tempfile.mkdtemp(prefix="pitlake-ship-")) / "pitlake_package.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for path in sorted(package.rglob("*.py")):
                z.write(path, f"{package.name}/{path.relative_to(package)}")
        context.addPyFile(str(archive))
        context._pitlake_shipped = True
    return spark


def spread(df: DataFrame) -> DataFrame:
    """df over all cores, where it comes from too few files for that; else df as it is, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
