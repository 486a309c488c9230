"""Session helpers: a tuned local session and the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from loomline.sources.files import remove


def local_session(cores: str = "*", app: str = "loomline", shuffle_partitions: int = 8) -> SparkSession:
    """A session for one machine. On a cluster the session comes from spark-submit and is used as it is."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where the session names none, a temporary one is set in local mode; on
    a cluster that is an error, as no machine's own folder is seen by the others."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="loomline-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


_swept: set[str] = set()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, below a folder of this session that goes when the process ends."""
    base = f"{shared_dir(spark)}/loomline/{spark.sparkContext.applicationId}"
    if base not in _swept:
        _swept.add(base)
        atexit.register(_sweep, spark, base)
    return f"{base}/{name}-{uuid.uuid4().hex}"


def _sweep(spark: SparkSession, base: str) -> None:
    try:
        if spark.sparkContext._jsc is not None:
            remove(spark, base)
    except Exception:  # noqa: BLE001, S110  (the session may be gone; then the folder stays for its owner to clear)
        pass


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df as a table in the shared folder and read it again.

    The copy survives the loss of executors, unlike a cached or locally checkpointed one.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """df in at least as many partitions as tasks can run at once, for work that is heavy per row.

    Only an input of fewer partitions, which is small, is shuffled; a large one is read as it is split.
    """
    want = df.sparkSession.sparkContext.defaultParallelism
    have = df._jdf.queryExecution().toRdd().getNumPartitions()
    return df if have >= want else df.repartition(want)
