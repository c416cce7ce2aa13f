"""Session construction and the shared folder that staged tables live in."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWNED: list[tuple[SparkSession, str]] = []


def build_session(app: str = "siltstone", cpus: str | int = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings tests and the bench use.

    On a cluster the session comes from outside; nothing in the library
    depends on the settings made here.
    """
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", conf.pop("driver_memory", "8g"))
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Only where that setting is absent and the master is local (tests, the
    bench) a temporary folder takes its place; a cluster without the setting
    is an error, because a machine-local folder would lose data with its host.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder shared by all executors")
    folder = f"file://{tempfile.mkdtemp(prefix='siltstone-')}"
    spark.conf.set("spark.checkpoint.dir", folder)
    _OWNED.append((spark, folder))
    return folder


def _drop(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may be gone already; the folder is only scratch space
        pass


@atexit.register
def _drop_all() -> None:
    while _OWNED:
        _drop(*_OWNED.pop())


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage like ``checkpoint()`` does, survives the loss of any
    executor, and keeps columns in Parquet so later reads prune them. The
    table goes when the process ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/siltstone/{name}-{uuid.uuid4().hex}"
    _OWNED.append((spark, path))
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    staged = spark.read.schema(df.schema).parquet(path)
    staged._staged_path = path
    return staged


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where its files give fewer partitions than there are.

    For heavy map-only work on a table of one small file; a table of many
    files is left as it is and nothing is shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 0 < df.rdd.getNumPartitions() < cores else df


def unstage(df: DataFrame) -> None:
    """Drop the files of a staged table that no later step reads."""
    for spark, path in list(_OWNED):
        if path == getattr(df, "_staged_path", None):
            _drop(spark, path)
            _OWNED.remove((spark, path))
