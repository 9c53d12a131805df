"""Session settings and the shared working folder."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Callable
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

# Runtime settings the operators rely on. All of them can be changed on a live session.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Broadcasts planned from file sizes stay well below those planned from sizes measured while running: files are
    # compressed, measured sizes are not guesses.
    "spark.sql.autoBroadcastJoinThreshold": "4MB",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "16MB",
    # A hot join key is split even where that costs one more shuffle afterwards.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # A task sorts and groups several times what it reads, and files are compressed: tasks of a few MB keep the memory of
    # one task the same however large the tables are.
    "spark.sql.files.maxPartitionBytes": "16MB",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4MB",
    # Sessions of one hot user are merged on the map side first.
    "spark.sql.sessionWindow.merge.sessions.in.local.partition": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session somebody else has built."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


# Stored bytes for each partition that a shuffle begins with. Partitions are merged while running but never cut for an
# aggregate or a window, so a fixed number of them would make the memory of one task grow with the tables.
STORED_BYTES = 4 << 20
INITIAL_PARTITIONS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"


def shuffles_for(spark: SparkSession, stored_bytes: int) -> None:
    """Let shuffles begin with a partition for every STORED_BYTES read, where that is more than the cluster's own number."""
    own = spark.sparkContext.getConf().get(INITIAL_PARTITIONS)
    wanted = math.ceil(stored_bytes / STORED_BYTES)
    if wanted > int(own or spark.conf.get("spark.sql.shuffle.partitions")):
        spark.conf.set(INITIAL_PARTITIONS, str(wanted))
    elif own:
        spark.conf.set(INITIAL_PARTITIONS, own)
    else:
        spark.conf.unset(INITIAL_PARTITIONS)


def build_session(app: str = "larder", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the runtime settings; partition counts and memory belong to the cluster's own settings."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_CONF, **conf}.items():
        builder = builder.config(key, value)
    return configure(builder.getOrCreate())


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it in ``spark.checkpoint.dir``.

    Only a local master, where driver and executors are one process, may fall back to a folder of its own.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(configured)
        return configured
    if context.getCheckpointDir():
        return context.getCheckpointDir()
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = tempfile.mkdtemp(prefix="larder-")
    context.setCheckpointDir(path)
    return context.getCheckpointDir()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str = "table") -> DataFrame:
    """``df`` computed once and read back from the shared folder, for a result several plans build on."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


VECTOR_BYTES = 256 << 20  # of feature vectors in a task


def fit_tasks(spark: SparkSession, rows: int, features: int, per_core: int = 1) -> int:
    """Tasks for the many short passes of a fit: as many as cores (or ``per_core`` times that), more where vectors outgrow them."""
    return max(spark.sparkContext.defaultParallelism * per_core, math.ceil(rows * (features + 4) * 8 / VECTOR_BYTES))


BOOST_ROWS = 20_000  # rows of a task from which a level of a boosted tree takes longer than starting the task


def boost_tasks(rows: int, most: int) -> int:
    """Tasks for the hundreds of passes of boosting, one after another: few rows go to few tasks, many to ``most``."""
    return max(1, min(most, math.ceil(rows / BOOST_ROWS)))


def fit_together(spark: SparkSession, fits: list[Callable[[], object]], at_once: int = 4) -> list:
    """Run independent model fits side by side, so that the short jobs of one fill the gaps of another."""
    pool = ThreadPool(min(at_once, len(fits)))
    try:
        return pool.map(lambda fit: fit(), [inheritable_thread_target(spark)(f) for f in fits])
    finally:
        pool.close()
