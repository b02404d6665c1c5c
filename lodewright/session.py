"""Session helpers: input tables and lineage cuts that survive the loss of an executor."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
_LOCAL_DIRS: dict[str, str] = {}


def _find_package(spark: SparkSession) -> None:
    """Let Python workers import this package also where only the driver's own path has it."""
    here, env = str(Path(__file__).resolve().parent.parent), spark.sparkContext.environment
    if here not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [here, env.get("PYTHONPATH", "")]))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table of a data directory."""
    _find_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as named in spark.checkpoint.dir.

    Where the setting is missing, a local session gets a temporary folder; any other master is an error, because a
    machine-local folder is lost with its machine.
    """
    if found := spark.conf.get(CHECKPOINT_KEY, None):
        return found.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_DIRS:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_KEY} to a folder that all executors share")
        _LOCAL_DIRS[app] = tempfile.mkdtemp(prefix="lodewright-")
        atexit.register(shutil.rmtree, _LOCAL_DIRS[app], ignore_errors=True)
    return _LOCAL_DIRS[app]


class Scratch:
    """Tables written to the shared folder to cut lineage in iterative operators.

    Unlike a cached or locally checkpointed frame, a written table can be read again after any executor is lost.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/lodewright/{uuid.uuid4().hex}"
        self._count = 0

    def save(self, df: DataFrame) -> DataFrame:
        """Write a frame and give it back as a scan of what was written."""
        self._count += 1
        path = f"{self.root}/{self._count:04d}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Delete tables that no later plan reads."""
        jvm = self.spark.sparkContext._jvm
        for df in frames:
            if path := getattr(df, "_scratch_path", None):
                target = jvm.org.apache.hadoop.fs.Path(path)
                target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
