"""Session helpers: table access, lineage cuts, checkpoint folder."""

from __future__ import annotations

import gc
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a short table that are broadcast at most.
MAX_BROADCAST_ROWS = 100_000


def local_session(cores: str = "8", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and local benchmarks; on a cluster use the one given."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("reportlake")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One of the given parquet tables (a file or a folder of files)."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``.  Where the setting is absent, a local
    master gets a temporary folder; on a cluster that is refused, as other machines
    would not see it."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return tempfile.mkdtemp(prefix="reportlake-")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the rows are written to shared storage and the lineage
    ends there, so a lost executor costs a re-read and not a re-computation."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(*cuts: DataFrame) -> None:
    """Delete the files of checkpoints that nothing will read again (rounds of a loop)."""
    for df in cuts:
        plan = df._jdf.queryExecution().logical()
        file = plan.rdd().getCheckpointFile() if plan.getClass().getSimpleName() == "LogicalRDD" else None
        if file is not None and file.isDefined():
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(file.get())
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def sweep(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps: it does so only after the
    driver has collected its garbage, which a quiet driver leaves for half an hour."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def small(df: DataFrame, most: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """A written table marked for broadcast where a count finds it small, else as it is
    (skewed keys are then split by adaptive execution)."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
