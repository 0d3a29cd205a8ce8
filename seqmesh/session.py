"""Session helpers shared by every part of the package.

Scratch tables go to the folder the session names in ``spark.checkpoint.dir``
(shared by the driver and all executors); lineage is cut by writing a table
there and reading it back, so a lost executor costs a re-read, not a re-run.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_FOLDERS: dict[int, str] = {}


def local_session(cores: int = 8, partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests, the CLI and the benchmark."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("seqmesh")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )


def scratch(spark: SparkSession) -> str:
    """This session's own folder under ``spark.checkpoint.dir``; it is removed at exit."""
    key = id(spark.sparkContext)
    if key not in _FOLDERS:
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            base = tempfile.mkdtemp(prefix="seqmesh-checkpoint-")
            spark.sparkContext.setCheckpointDir(base)
        _FOLDERS[key] = f"{base.rstrip('/')}/seqmesh-{uuid.uuid4().hex}"
        atexit.register(release, spark)
    return _FOLDERS[key]


def delete(spark: SparkSession, path: str) -> None:
    """Remove a scratch path through Hadoop's file system, wherever it is."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Remove all scratch tables of the session; safe after the session has ended."""
    folder = _FOLDERS.pop(id(spark.sparkContext), None)
    if folder and spark.sparkContext._jsc is not None:
        try:
            delete(spark, folder)
        except Exception as e:  # the gateway may be gone when the interpreter ends
            if "Py4J" not in type(e).__name__ and not isinstance(e, (OSError, AttributeError)):
                raise


#: Spark deletes the files of a query's shuffles as soon as it ends, instead of when the driver's memory is next cleared.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared scratch folder and read it back; what it shuffled is deleted."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/{name}-{uuid.uuid4().hex[:8]}"
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEAN)
        else:
            spark.conf.set(_CLEAN, before)
    written = spark.read.schema(df.schema).parquet(path)
    written._seqmesh_path = path
    return written


def discard(written: DataFrame) -> None:
    """Delete a table that ``materialise`` wrote, once nothing reads it any more; others are left alone."""
    if path := getattr(written, "_seqmesh_path", None):
        delete(written.sparkSession, path)


#: Bytes of an Arrow batch, in place of Spark's 64 MB; a setting of the user's own is left alone.
BATCH_BYTES = 16 << 20


def ship(spark: SparkSession) -> None:
    """Ready a session for Python workers: they can import this package, and their batches are small."""
    sc = spark.sparkContext
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") in ("67108864b", "67108864", "64MB"):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    if getattr(sc, "_seqmesh_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="seqmesh-")
    path = os.path.join(folder, "seqmesh.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for at, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(at, n)
                    z.write(full, os.path.join("seqmesh", os.path.relpath(full, root)))
    sc.addPyFile(path)
    sc._seqmesh_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
