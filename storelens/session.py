"""Spark session helpers.

The library never creates its own cluster settings on a real cluster: it reads
``spark.checkpoint.dir`` from the session and only sets a scratch directory
when nothing is configured (local tests).
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, shuffle_partitions: int = 8, app: str = "storelens") -> SparkSession:
    """Session for tests and the bench; on a cluster pass the existing session instead."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.driver.memory", os.environ.get("STORELENS_DRIVER_MEMORY", "16g"))
    for key, value in DEFAULT_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder that ``spark.checkpoint.dir`` names.

    Where it is unset, a local session gets a temporary folder of its own; on a
    cluster that is an error, as executors could not read each other's folders.
    """
    current = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not current:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder shared by the executors of {master}")
        current = tempfile.mkdtemp(prefix="storelens-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", current)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(current)
    return current


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the cluster's shared checkpoint folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: What ``freed_shuffles`` sets.
FREED = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
#: Tables of the library's own: ids that are hashes in hex are half redundant, which a codec without entropy coding (Snappy,
#: LZ4) leaves in, and a task reads whole row groups, so their size bounds what it sorts.
TABLE_CODEC, ROW_GROUP_BYTES = "zstd", 8 << 20


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """A write inside removes its shuffle files when it is done, and a stream started inside those of each of its jobs.

    By themselves they stay until the driver happens to collect garbage.
    """
    before = {key: spark.conf.get(key, None) for key in FREED}
    for key, value in FREED.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def table_options(spark: SparkSession) -> dict[str, str]:
    """How the library writes its Parquet tables; the codec is the session's own where it states one."""
    codec = spark.conf.get("spark.sql.parquet.compression.codec", None) or TABLE_CODEC
    return {"compression": codec, "parquet.block.size": str(ROW_GROUP_BYTES)}


def staged(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared checkpoint folder as compressed columns and read back.

    For rows that several steps read: they are made once, and what was shuffled to make them is
    removed before the steps shuffle their own.
    """
    spark = df.sparkSession
    path = os.path.join(ensure_checkpoint_dir(spark), "staged", uuid.uuid4().hex)
    with freed_shuffles(spark):
        df.write.options(**table_options(spark)).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Gives the executors this package, once per application.

    Spark serves the zip from the driver, so tasks that run Python of this package can
    import it wherever they run and whatever their working folder is.
    """
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="storelens-py-")) / "storelens.zip"
    with zipfile.ZipFile(path, "w") as z:
        for source in sorted(package.rglob("*.py")):
            z.write(source, source.relative_to(package.parent))
    context.addPyFile(str(path))
    _SHIPPED.add(context.applicationId)


#: Sizes are of compressed rows, which catalog text multiplies twenty times and more in memory: what a task sorts
#: and what is broadcast through the driver stay of one size however large the tables are.
TASK_BOUNDS = {
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8m",
    "spark.sql.files.maxPartitionBytes": "8m",
    "spark.sql.autoBroadcastJoinThreshold": "2m",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "2m",
}


def bound_tasks(spark: SparkSession) -> None:
    """Bounds for a task's share of a shuffle or of files and for broadcasts; what the session states itself is left."""
    for key, value in TASK_BOUNDS.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)


#: State stores on disk, changes logged per batch: a lookup's cost does not follow the state's size. All stores of an
#: executor share one bounded memory (500 MB unless the session states another): by themselves each keeps buffers of its own.
#: Files and change logs are written with zstd in larger blocks, as a key's first row is mostly text.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.compression.codec": "zstd",
    "spark.sql.streaming.stateStore.rocksdb.compression": "zstd",
    "spark.sql.streaming.stateStore.rocksdb.blockSizeKB": "32",
}


def use_state_store(spark: SparkSession) -> None:
    """Streams started from now on keep their state in RocksDB; a stream's first start decides for its checkpoint."""
    for key, value in STATE_STORE.items():
        spark.conf.set(key, value)
