"""Session settings and the shared working folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def get_spark(app_name: str = "tidemark", master: str | None = None, **conf: str) -> SparkSession:
    """Build (or reuse) a session with the settings the jobs here rely on."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def work_dir(spark: SparkSession, default: str | None = None) -> str:
    """The shared folder named by ``spark.checkpoint.dir``, else ``default``.

    Intermediate results go there so that a lost executor costs a re-read, not
    a re-extraction. Every executor must reach it, so a default on the driver's
    own disk is only taken by a local session.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and default:
        local = spark.sparkContext.master.split("[")[0] == "local"
        scheme = default.split(":", 1)[0] if ":" in default else "file"
        folder = default if local or scheme != "file" else None
    if not folder:
        raise RuntimeError("spark.checkpoint.dir must name a folder every executor can reach.")
    return folder.rstrip("/")


class Staging:
    """Results written once to the shared folder and read back.

    Columnar, so each later consumer reads only the columns it needs, and
    lineage is cut: an expensive step upstream never runs twice.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.root = f"{folder}/staged/{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def discard(self, *names: str) -> None:
        """Remove results by name, or all of them."""
        for name in names or ("",):
            fs, target = file_system(self.spark, f"{self.root}/{name}".rstrip("/"))
            fs.delete(target, True)


def file_system(spark: SparkSession, path: str):
    """Hadoop file system that serves ``path``, and the path for it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target
