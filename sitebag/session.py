"""Session defaults and the shared folder used to cut lineage or stage files."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def build_session(
    app: str = "sitebag", master: str = "local[*]", shuffle_partitions: int = 8, shared: str | None = None, **conf
) -> SparkSession:
    """A session with AQE, skew handling and UTC; ``shared`` is the folder for staged tables, extra settings go through ``conf``.

    Input splits are small enough that a few whole-text files still occupy all cores.
    """
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.files.maxPartitionBytes", "32m")
    )
    if shared:
        builder = builder.config(CHECKPOINT_DIR, shared)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), str(value))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which driver and executors share.

    Only a local master may leave it unset: it gets a fresh folder that goes when the process ends. Elsewhere executors
    would write to their own disks and later reads miss those files, so an unset folder is an error.
    """
    path = spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getConf().get(CHECKPOINT_DIR)
    if not path:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"set {CHECKPOINT_DIR} to a folder that all executors share (master is {master})")
        path = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        spark.conf.set(CHECKPOINT_DIR, path)
    return path


def stage_path(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def staged(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` below the shared folder and read it back.

    For small derived tables that feed several branches of one plan: the branches then share one computation, the
    rows survive the loss of executors, and the optimiser sees their real size.
    """
    path = stage_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unstaged(df: DataFrame) -> None:
    """Delete the files of a table that :func:`staged` returned, once all that read it is written."""
    if files := df.inputFiles():
        spark = df.sparkSession
        folder = spark._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
