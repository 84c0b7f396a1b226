"""Session helpers: a local session for tests and the checkpoint folder lookup."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
SHUFFLE_CLEANUP_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cores: int | str = "*", app: str = "reviewlens", **conf: str) -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def use_checkpoints(spark: SparkSession) -> None:
    """Point the context at the shared checkpoint folder the cluster names; on one machine, without one, below the warehouse."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get(CHECKPOINT_CONF, None)
    if named is None and not context.master.startswith("local"):
        raise ValueError(f"{CHECKPOINT_CONF} must name a folder that all executors share")
    context.setCheckpointDir(named or f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below the checkpoint folder, for tables and stream state."""
    use_checkpoints(spark)
    import uuid

    root = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return f"{root}/{name}-{uuid.uuid4().hex}"


def spread(df: DataFrame) -> DataFrame:
    """Rows of a small scan over all cores, for work that is heavy per row.

    Large inputs come in more partitions than there are cores and are left as they are, without a shuffle.
    """
    execution = df._jdf.queryExecution()
    if df.isStreaming or "Exchange" in execution.executedPlan().toString():
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if execution.toRdd().getNumPartitions() >= cores else df.repartition(cores)


def settled(df: DataFrame) -> DataFrame:
    """A frame that a loop reads again and again: written once if computing it takes a shuffle."""
    if "Exchange" not in df._jdf.queryExecution().executedPlan().toString():
        return df
    use_checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def brief_shuffles(spark: SparkSession) -> Iterator[None]:
    """Inside, a finished action's shuffle files go at once, not when the driver happens to collect its garbage.

    For jobs of many actions that each write what the next one reads. A frame that is run again shuffles again.
    """
    before = spark.conf.get(SHUFFLE_CLEANUP_CONF, None)
    spark.conf.set(SHUFFLE_CLEANUP_CONF, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP_CONF)
        else:
            spark.conf.set(SHUFFLE_CLEANUP_CONF, before)
