"""Session defaults and shared work tables."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "twinframe", master: str | None = None, partitions: int | None = None,
                  driver_memory: str | None = None) -> SparkSession:
    """A session with the defaults the library is tuned for. A cluster's own settings win where they are given."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    b = (
        b.config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        # Plans here are built from many small expressions; call sites for each of them cost more than they tell.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if partitions:
        b = b.config("spark.sql.shuffle.partitions", str(partitions))
    if driver_memory:
        b = b.config("spark.driver.memory", driver_memory)
    return b.getOrCreate()


def work_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Where it is not set, a local master gets a temporary folder that goes when Python ends. A cluster gets an error:
    its executors would each write to a disk of their own, and later reads would miss rows.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="spark-twinframe-", dir=os.environ.get("TMPDIR", "/tmp"))
        atexit.register(shutil.rmtree, root, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


_written: dict[str, list[str]] = {}


def materialise(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts lineage, survives the loss of executors, and gives the optimizer the real size of the table,
    so it broadcasts what is small and shuffles what is not. The folder belongs to the caller: ``clean_work`` empties
    it when a run's results are stored.
    """
    spark = df.sparkSession
    path = f"{work_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def clean_work(spark: SparkSession) -> int:
    """Delete the work tables of this session and say how many there were. Results that still read them must be
    stored first."""
    from pyarrow.fs import FileSystem

    paths = _written.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        if path.startswith("file:/") and not path.startswith("file://"):
            path = "file://" + path[5:]
        store, place = FileSystem.from_uri(path)
        store.delete_dir(place)
    return len(paths)
