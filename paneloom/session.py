"""Session helpers: shared working folders and shipping of this package to Python workers."""

from __future__ import annotations

import atexit
import contextlib
import os
import re
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_PACKAGE = Path(__file__).resolve().parent


def build_session(app: str = "paneloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session for tests, benches and notebooks; a cluster's own settings win where they exist."""
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder.appName(app)
        .master(master or f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", conf.pop("shuffle_partitions", cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", conf.pop("driver_memory", "8g"))
        .config("spark.sql.adaptive.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


BATCH_ROWS, BATCH_BYTES = 512, 4 << 20  # of an Arrow batch: rows hold whole texts


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per context, and bound the Arrow batches of the session by rows and bytes.

    A batch ends when either bound is met, so only a text longer than the byte bound makes a larger one. Plans read
    these settings when they run, which is after an operator returned, so they are lowered for the session and not
    put back; a caller's smaller bounds stay.
    """
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{key}"
        now = _bytes(spark.conf.get(name))
        if not 0 < now <= most:
            spark.conf.set(name, str(most))
    sc = spark.sparkContext
    if getattr(sc, "_paneloom_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="paneloom-ship-")  # Spark copies the file when it is added
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    target = Path(folder) / "paneloom_src.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(_PACKAGE.rglob("*.py")):
            z.write(f, f.relative_to(_PACKAGE.parent).as_posix())
    sc.addPyFile(str(target))
    sc._paneloom_shipped = True


def _bytes(value: str) -> int:
    """A number with a unit such as 4m, as Spark writes sizes."""
    found = re.fullmatch(r"(-?\d+)\s*([kmgt]?)b?", value.strip().lower())
    return int(found[1]) << {"": 0, "k": 10, "m": 20, "g": 30, "t": 40}[found[2]] if found and int(found[1]) >= 0 else -1


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where driver and executors are one process, a temporary one may stand in."""
    root = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark.sparkContext, "_paneloom_root", None)
    if root is None:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        folder = tempfile.mkdtemp(prefix="paneloom-shared-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        root = "file://" + folder
        spark.sparkContext._paneloom_root = root
    return root.rstrip("/")


class Scratch:
    """A uniquely named folder below the shared root, in which a job cuts lineage with written tables.

    The tables must outlive the operator that wrote them, as its result is read later. ``clear_scratch`` deletes all
    folders made since a ``mark_scratch``; those that are left go when the program ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
        self._n = 0
        made = _made(spark)
        if not made:
            atexit.register(_at_exit, spark)
        made.append(self.root)

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write df once as Parquet and return the written table."""
        path = self.path(name)
        df.write.option("compression", "zstd").parquet(path)
        schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema])
        out = self.spark.read.schema(schema).parquet(path)
        out._paneloom_path = path
        return out

    def drop(self, *kept: DataFrame) -> None:
        """Delete tables that no later step reads."""
        for df in kept:
            _delete(self.spark, df._paneloom_path)


def _made(spark: SparkSession) -> list[str]:
    sc = spark.sparkContext
    if not hasattr(sc, "_paneloom_scratch"):
        sc._paneloom_scratch = []
    return sc._paneloom_scratch


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def mark_scratch(spark: SparkSession) -> int:
    return len(_made(spark))


def clear_scratch(spark: SparkSession, since: int) -> None:
    """Delete the folders made since the mark: what was computed from them must be written by now. A stopped session deletes nothing."""
    if spark.sparkContext._jsc is None:
        return
    made = _made(spark)
    for path in made[since:]:
        _delete(spark, path)
    del made[since:]


def _at_exit(spark: SparkSession) -> None:
    with contextlib.suppress(OSError, Py4JError):  # the gateway may be gone by then
        clear_scratch(spark, 0)


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of plans that are no longer referenced."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
