"""Session factory, table access and the shared checkpoint folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "docfathom", cores: int | None = None, **conf: str) -> SparkSession:
    """A local session with the settings the tests and the bench use; on a cluster the running session is returned."""
    cores = cores or int(os.environ.get("BENCH_CPUS", "8"))
    settings = {
        "spark.sql.shuffle.partitions": str(cores),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
    } | conf
    return SparkSession.builder.master(f"local[{cores}]").appName(app).config(map=settings).getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by the session in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder of its own; on a cluster its absence is an error,
    as executors on other machines could not read a folder of this one.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not named and not sc.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or _own_folder())
    return named or sc._jsc.sc().getCheckpointDir().get()


def _own_folder() -> str:
    path = tempfile.mkdtemp(prefix="docfathom-checkpoint-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared checkpoint folder and read from there, so that a lost executor costs no recomputation."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared checkpoint folder, which goes when the session ends.

    Unlike a checkpoint, its size is known to the planner: what is small is then broadcast, what is not is shuffled.
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/written-{uuid.uuid4().hex}"
    df.write.parquet(path)
    spark = df.sparkSession
    if not _written:
        atexit.register(remove_written, spark)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt out over the cores if it is read from fewer files than there are cores, else as it is.

    One small file is one task, however costly the work on its rows. A table of many files is never shuffled by this.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 0 < len(df.inputFiles()) < cores else df


_written: list[str] = []


def remove_written(spark: SparkSession) -> None:
    """Removes the tables that ``written`` has made; those still in use must not be read any more."""
    while _written:
        path = _written.pop()
        try:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session has ended; a shared folder is then cleared by its owner
            return
