"""Session settings and lineage helpers shared by jobs and tests."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Settings every job relies on for right results (not for speed).
REQUIRED_CONF = {
    "spark.sql.session.timeZone": "UTC",
}

#: Speed settings that suit any cluster size; AQE picks the real partition
#: counts, splits skewed join partitions and turns small sides into broadcasts
#: from sizes it has measured.
TUNING_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
}

#: State store that keeps streaming state on disk rather than on the heap.
STREAMING_CONF = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the settings the operators need to a session that exists."""
    for key, value in {**REQUIRED_CONF, **TUNING_CONF}.items():
        spark.conf.set(key, value)
    return spark


def measured_broadcasts(spark: SparkSession) -> SparkSession:
    """Joins broadcast only a side whose size a finished stage has measured.

    Before that Spark goes by the size of files, and knows nothing of how many rows a page or a body
    becomes: sides of millions of rows were sent through the driver.
    """
    at, measured = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    if spark.conf.get(measured, None) is None:
        spark.conf.set(measured, spark.conf.get(at))
    spark.conf.set(at, "-1")
    return spark


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "wayfold") -> SparkSession:
    """A session for tests and the bench; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    for key, value in {**REQUIRED_CONF, **TUNING_CONF, **STREAMING_CONF}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The reliable folder loops cut their lineage in.

    The cluster names it in ``spark.checkpoint.dir``. Where nothing is set, a session
    in one process makes a temporary folder; any other master is refused, for its
    executors could not share one.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not named and not context.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = named or tempfile.mkdtemp(prefix="wayfold-ckpt-")
    context.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """Write ``df`` to the checkpoint folder and carry on from the files."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


def spread(df: DataFrame, parts: int | None = None) -> DataFrame:
    """Rows dealt anew before costly per-row work, where the caller knows that the input is too coarse.

    Without ``parts`` nothing is moved: a large table has pieces enough.
    """
    return df if parts is None else df.repartition(parts)
