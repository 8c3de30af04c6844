"""Session settings and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "caseweave", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on; a cluster's own settings win unless passed here."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def work_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and staged tables.

    It is the one named by ``spark.checkpoint.dir``. Only a local session may do without that
    setting: it gets a temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(folder)
        return folder
    folder = spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        folder = "file://" + tempfile.mkdtemp(prefix="caseweave-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path of its own for one staged data set inside the shared folder."""
    return f"{work_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame) -> DataFrame:
    """Write a frame to the shared folder and go on from there.

    It cuts the lineage, survives lost executors, and later readers scan only their columns.
    """
    path = fresh_path(df.sparkSession, "stage")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(*staged: DataFrame | None) -> None:
    """Delete the folders of staged frames that nothing reads any more, and let go of the shuffles behind them.

    Iterative jobs call it for a round's tables when the next round's are written, so their disk doesn't grow with the rounds.
    """
    for df in staged:
        if df is not None:
            jvm, conf = df.sparkSession._jvm, df.sparkSession._jsparkSession.sessionState().newHadoopConf()
            for folder in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
                if "/stage-" in folder:
                    path = jvm.org.apache.hadoop.fs.Path(folder)
                    path.getFileSystem(conf).delete(path, True)
    if kept := [df for df in staged if df is not None]:
        kept[0].sparkSession._jvm.System.gc()  # the context drops the files of shuffles that are out of reach


def spread(df: DataFrame) -> DataFrame:
    """Repartition an input of fewer splits than there are cores; a large one stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
