"""Session helpers.

The library never assumes it owns the session: every operator works with
whatever session the caller built.  ``get_spark`` is only a convenience for
tests, the bench and local runs.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "clausewise") -> SparkSession:
    """Build (or reuse) a session tuned for this library.

    AQE is on so shuffle partition counts are coalesced at runtime and skewed
    join partitions are split; the Spark UI is off (no server).
    """
    master = master or os.environ.get("CLAUSEWISE_MASTER", "local[8]")
    n = shuffle_partitions or int(os.environ.get("CLAUSEWISE_SHUFFLE_PARTITIONS", "8"))
    builder = (
        SparkSession.builder.master(master).appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("CLAUSEWISE_DRIVER_MEMORY", "16g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    ship_package(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder of the session.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used as
    is.  Only when nothing is configured (local tests) is a private folder
    created, and only for a local master.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not conf:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        conf = tempfile.mkdtemp(prefix="clausewise-ckpt-")
    sc.setCheckpointDir(conf)
    return sc.getCheckpointDir() or conf


#: A checkpoint is written by at least so many tasks a core, and by one for so many shuffle partitions.
CHECKPOINT_TASKS, CHECKPOINT_PARTITIONS = 4, 8


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (survives executor loss).

    Many small partitions are merged into fewer files: at most ``CHECKPOINT_PARTITIONS``
    of the session's shuffle partitions a task, so that tasks stay small where the
    session has partitions for the size of its data, and never below
    ``CHECKPOINT_TASKS`` tasks a core.  A task reads its partitions one after the
    other and holds one at a time."""
    checkpoint_dir(df.sparkSession)
    return df.coalesce(_tasks(df.sparkSession)).checkpoint(eager=True)


def _tasks(spark: SparkSession) -> int:
    return max(CHECKPOINT_TASKS * spark.sparkContext.defaultParallelism,
               int(spark.conf.get("spark.sql.shuffle.partitions")) // CHECKPOINT_PARTITIONS)


def written(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet into the checkpoint folder and read back.

    For narrow rows with several readers: columns are encoded and compressed, where a
    checkpoint holds whole rows as they are in memory (several times as large)."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/rows-{uuid.uuid4()}"
    df.coalesce(_tasks(spark)).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Give CPU-heavy narrow work enough tasks.

    A scan of a few large files (here: one row group per table) arrives as one
    partition; then one task would do all the text work.  Only in that case
    rows are dealt round-robin over the default parallelism.  A scan that is
    already split (the normal case for large inputs) is returned unchanged, so
    no shuffle is added at scale.
    """
    target = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < target:
        return df.repartition(target)
    return df


#: Texts are dealt over so many tasks for each partition of their scan: they become many rows there.
DEALT = 16


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` with the rows of one key in one task, for texts of which all parts are grouped by the key and more.

    The texts are shuffled once, as they are; groupings and windows over the rows made of
    them, by ``keys`` and other columns, need no further exchange.  The number of tasks
    grows with the scan, so that a task's rows stay as many, whatever the input."""
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), DEALT * df.rdd.getNumPartitions())
    return df.repartition(n, *keys)


#: Rows that a table may have at most to be sent to every executor at once.
FEW = 200_000


def few(df: DataFrame) -> DataFrame:
    """``df`` written once and, if it is counted to have few rows, marked to be broadcast; a larger one is
    joined as any other.  For narrow tables whose size Spark can only guess."""
    kept = written(df)
    return F.broadcast(kept) if kept.count() <= FEW else kept


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``clausewise`` importable in the Python workers of every executor.

    Python UDFs and ``mapInPandas`` functions defined in this package are
    pickled by reference; the package is zipped once per application and
    distributed with ``SparkContext.addPyFile`` (the standard way to ship
    Python code to a cluster)."""
    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    import zipfile

    import clausewise
    root = os.path.dirname(os.path.abspath(clausewise.__file__))
    parent = os.path.dirname(root)
    path = os.path.join(tempfile.mkdtemp(prefix="clausewise-pkg-"), "clausewise.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for base, dirs, files in os.walk(root):
            dirs[:] = [d for d in dirs if d != "__pycache__"]
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(base, f)
                    z.write(full, os.path.relpath(full, parent))
    sc.addPyFile(path)
    _SHIPPED.add(app)
