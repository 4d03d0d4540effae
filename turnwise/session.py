"""Session helpers: local builder, runtime SQL settings, shared scratch tables."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Groups kept in a hash map by ``median``/``percentile`` before Spark falls back
#: to sorting. The built-in 128 makes every per-game aggregation sort its input.
OBJECT_AGG_GROUPS = "4096"


def local_session(cores: int | str = "*", app: str = "turnwise", memory: str = "16g") -> SparkSession:
    """Single-machine session for tests and the benchmark."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


def tune(spark: SparkSession) -> SparkSession:
    """Set the runtime SQL options the operators rely on; cluster sizing stays as it is."""
    spark.conf.set("spark.sql.objectHashAggregate.sortBased.fallbackThreshold", OBJECT_AGG_GROUPS)
    # rows that come sorted by the keys are aggregated group by group, without a map of all groups
    spark.conf.set("spark.sql.execution.replaceHashWithSortAgg", "true")
    return spark


@functools.cache
def _local_scratch() -> str:
    return tempfile.mkdtemp(prefix="turnwise-")


def scratch_folder(spark: SparkSession) -> str:
    """Shared folder for intermediate tables.

    A cluster names it in ``spark.checkpoint.dir``. Only a local master may fall
    back to a folder of this machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if spark.sparkContext.master.startswith("local"):
        return _local_scratch()
    raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")


def materialise(df: DataFrame, label: str, *, partition_by: tuple[str, ...] = (), rows_per_file: int = 0) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage and survives lost executors. Used where a frame feeds many
    jobs, such as the fits of a cross validation; a filter on ``partition_by`` then reads
    only its part. ``rows_per_file`` bounds the rows that a task reads back where they take few bytes, since Spark puts
    at most 32 files into one task by default. The table goes when the driver ends.
    """
    spark = df.sparkSession
    path = f"{scratch_folder(spark)}/{label}-{uuid.uuid4().hex}"
    writer = df.write.option("maxRecordsPerFile", rows_per_file)
    writer = writer.partitionBy(*partition_by) if partition_by else writer
    writer.parquet(path)
    jvm = spark.sparkContext._jvm
    written = jvm.org.apache.hadoop.fs.Path(path)
    written.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(written)
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)
