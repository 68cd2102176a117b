"""Session helpers: building a local session and cutting lineage in shared storage."""

from __future__ import annotations

import atexit
import logging
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_DIR: list[str] = []
_FOLDERS: dict[str, str] = {}


def local_session(cores: int | str = 8, app: str = "lexaris", shuffle: int = 8, **conf: str) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as named by ``spark.checkpoint.dir``.

    Only a session on one machine may leave it unset; it gets a temporary folder of its
    own. On a cluster a folder of one machine would lose rows, so that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _OWN_DIR:
        _OWN_DIR.append(tempfile.mkdtemp(prefix="lexaris-"))
    return "file://" + _OWN_DIR[0]


def _drop(spark: SparkSession, folder: str) -> None:
    from py4j.protocol import Py4JError, Py4JNetworkError

    try:
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    except (Py4JError, Py4JNetworkError, AttributeError, OSError):
        # the session has ended; the folder belongs to the clean-up of the shared storage then
        logging.getLogger(__name__).info("could not remove %s", folder)


def release(spark: SparkSession, app: str | None = None) -> None:
    """Removes the tables that ``cut`` has written in this session; results that still read them become unusable."""
    folder = _FOLDERS.pop(app or spark.sparkContext.applicationId, None)
    if folder:
        _drop(spark, folder)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed with the tables of ``cut``."""
    app = spark.sparkContext.applicationId
    if app not in _FOLDERS:
        _FOLDERS[app] = f"{shared_dir(spark)}/lexaris-{app}-{uuid.uuid4().hex[:8]}"
        atexit.register(release, spark, app)
    return f"{_FOLDERS[app]}/{name}-{uuid.uuid4().hex[:12]}"


def cut(df: DataFrame, name: str = "step", partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    The plan behind the result is a plain scan: an executor that is lost costs a
    re-read, not a recomputation, and repeated passes prune columns. The folder goes
    away when the Python process ends, or earlier by ``release``.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a list, such as the categories, up to which it is sent to every executor.
BROADCAST_ROWS = 100_000


def checked(df: DataFrame) -> DataFrame:
    """``df`` marked to be sent to every executor if it has at most BROADCAST_ROWS rows, else as it is."""
    few = df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return F.broadcast(df) if few else df
