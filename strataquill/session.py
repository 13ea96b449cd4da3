"""Session settings and the few helpers every plan needs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def local_session(cores: int = 8, memory: str = "8g", shuffle_partitions: int | None = None, app: str = "strataquill") -> SparkSession:
    """A local session for tests and benches; on a cluster the caller brings its own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app).config("spark.driver.memory", memory)
    for key, value in (SETTINGS | {"spark.sql.shuffle.partitions": str(shuffle_partitions or cores)}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder: the one the cluster names in ``spark.checkpoint.dir``.

    Only a local session without the setting (tests, a laptop) takes a temporary folder; on a cluster
    a folder of one machine would be lost with it, so a missing setting is an error there.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not (context.master == "local" or context.master.startswith("local[")):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="strataquill-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def run_sql(spark: SparkSession, sql: str, **frames: DataFrame) -> DataFrame:
    """The result of ``sql`` in which every ``@name@`` stands for a DataFrame; no view is left behind."""
    views = {name: f"{name}_{uuid.uuid4().hex}" for name in frames}
    for name, view in views.items():
        frames[name].createOrReplaceTempView(view)
        sql = sql.replace(f"@{name}@", view)
    result = spark.sql(sql)
    for view in views.values():
        spark.catalog.dropTempView(view)
    return result
