"""Session and table helpers shared by queries, tests and the bench."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", memory: str = "8g", partitions: str = "8") -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("sparkloom")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Give the package to the executors, once a Spark context: Python workers import it from there."""
    context = spark.sparkContext
    if "sparkloom.zip" in {os.path.basename(x) for x in context.listFiles}:
        return
    home = Path(__file__).resolve().parent
    with tempfile.TemporaryDirectory() as there:
        skip = shutil.ignore_patterns("__pycache__")
        shutil.copytree(home, f"{there}/src/sparkloom", ignore=skip)
        made = shutil.make_archive(f"{there}/sparkloom", "zip", f"{there}/src")
        # The context copies the archive to its own folder and serves it from there.
        kept = os.path.join(SparkFiles.getRootDirectory(), "shipped")
        os.makedirs(kept, exist_ok=True)
        context.addPyFile(shutil.copy(made, kept))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's parquet tables; the path may be of any Hadoop file system."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``; one of our own only where none is set and the session is local."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="sparkloom-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        found = f"file://{own}"
        spark.conf.set("spark.checkpoint.dir", found)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which its owner clears."""
    return f"{shared_dir(spark)}/sparkloom-{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The same rows from a checkpoint in the folder that all executors share."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def default_dir() -> str:
    return os.environ.get("SPARKLOOM_SMOKE_DIR", "/root/testdata/sf0.001")
