"""Session helpers: defaults for local runs and durable lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

#: Settings of a local session; a cluster brings its own.
LOCAL = {
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def local_session(cores: int = 8, memory: str = "8g", **conf: str) -> SparkSession:
    """A local[cores] session with as many shuffle partitions as cores."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("mergeloom").config("spark.driver.memory", memory)
    for k, v in (LOCAL | {"spark.sql.shuffle.partitions": str(cores)} | conf).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate data that all executors see: the session's spark.checkpoint.dir.

    Only a local session without the setting, as in tests, gets a folder of this machine; a cluster
    without it is an error.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        given = spark.conf.get("spark.checkpoint.dir", None)
        if not given and not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(given or tempfile.mkdtemp(prefix="mergeloom-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Write `df` to the shared checkpoint folder and return it with its lineage cut.

    Executors can be lost afterwards: the files are read again. The size that the planner inherits
    from the sources is dropped, since it can be far too low, so no join broadcasts the result
    before its size is measured at run time; the partitioning is kept.
    """
    _shared_folder(df.sparkSession)
    kept = df.checkpoint(eager=True)
    jvm, session, plan = df.sparkSession._jvm, df.sparkSession._jsparkSession, kept._jdf.queryExecution().logical()
    none = jvm.scala.Option.empty()
    rdd = jvm.org.apache.spark.sql.execution.LogicalRDD(plan.output(), plan.rdd(), plan.outputPartitioning(), plan.outputOrdering(), False, none, session, none, none)
    return DataFrame(jvm.org.apache.spark.sql.classic.Dataset.ofRows(session, rdd), df.sparkSession)


def stored(df: DataFrame) -> DataFrame:
    """Write `df` as a compressed table below the shared checkpoint folder and return it as read from there.

    For wide rows of which later steps read some columns only. The table stays until the folder is emptied.
    """
    path = f"{_shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, so that Python workers can import it.

    The archive is served by the driver; where the package is installed on the workers it changes nothing.
    """
    sc = spark.sparkContext
    if getattr(sc, "_mergeloom_shipped", False):
        return
    home = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="mergeloom-package-"), "mergeloom.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(home):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(home)))
    sc.addPyFile(archive)
    sc._mergeloom_shipped = True
