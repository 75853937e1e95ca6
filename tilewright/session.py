"""Session, table access and durable intermediate tables shared by every operator."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_PACKAGE = Path(__file__).resolve().parent
_made: dict[str, str] = {}


def local_session(cores: str = "8", shuffle: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tilewright")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )
    ship_package(spark)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship_package(spark: SparkSession) -> None:
    """Sends this package to Python workers, which need not share the driver's file system or working folder; once an application."""
    sc = spark.sparkContext
    if _made.get("shipped") == sc.applicationId:
        return
    _made["shipped"] = sc.applicationId
    path = Path(tempfile.mkdtemp()) / "tilewright.zip"
    with zipfile.ZipFile(path, "w") as z:
        for p in _PACKAGE.rglob("*.py"):
            z.write(p, p.relative_to(_PACKAGE.parent))
    sc.addPyFile(str(path))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir where the session names one, else, on one machine (tests), a local one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        sc = spark.sparkContext
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        if _made.get("local_app") != sc.applicationId:
            _made["local_app"] = sc.applicationId
            _made["local_dir"] = tempfile.mkdtemp(prefix="tilewright-")
            sc.setCheckpointDir(_made["local_dir"])
        root = _made["local_dir"]
    return root.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be gone already
        pass


class Scratch:
    """Tables written to the shared folder to cut lineage.

    Parquet with zstd is several times smaller than a checkpoint of rows and any executor can read it, so losing one costs
    nothing but its running tasks. ``drop`` removes a table that a later one supersedes; the rest goes when Python exits.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.root = f"{shared_dir(spark)}/tilewright-{name}-{uuid.uuid4().hex[:12]}"
        self.n = 0
        atexit.register(_delete, spark, self.root)

    def write(self, df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n:04d}"
        w = df.write.mode("overwrite").option("compression", "zstd")
        if partition_by:
            w = w.partitionBy(*partition_by)
        w.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._tilewright_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        path = getattr(df, "_tilewright_path", None)
        if path:
            _delete(self.spark, path)


def fits_broadcast(df: DataFrame, row_bytes: int, limit_bytes: int = 64 << 20) -> bool:
    """Whether a written table is proven small: its counted rows times row_bytes stay within limit_bytes."""
    return df.count() * row_bytes <= limit_bytes


def cores(spark: SparkSession) -> int:
    return max(1, spark.sparkContext.defaultParallelism)


def env_path(name: str, default: str) -> str:
    return os.environ.get(name, default)

