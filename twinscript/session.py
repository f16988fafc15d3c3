"""Session defaults and the shared checkpoint folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(cores: int | str = "*", app: str = "twinscript", **conf: str) -> SparkSession:
    """A local session with the settings the operators expect; on a cluster the submitter's settings win."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; only a session on this machine alone may do without, and gets a folder of its own."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir isn't set: tables between steps need a folder that all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="twinscript-tables-"))
    return _own[0]


def cut_lineage(df: DataFrame) -> DataFrame:
    """df as a table written to the shared folder and read again; any executor may be lost after that.

    A written table is columnar and compressed, unlike a checkpoint. The tables of this process are removed when it
    ends, or by drop_tables() once the results that need them have been used.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_tables(spark: SparkSession) -> int:
    """Removes the tables that cut_lineage wrote so far; results that were made from them can't be computed again. Returns their number."""
    n = len(_written)
    while _written:
        where = spark._jvm.org.apache.hadoop.fs.Path(_written.pop())
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    return n


_written: list[str] = []
_own: list[str] = []


@atexit.register
def _remove() -> None:
    try:
        drop_tables(SparkSession.getActiveSession())
    except Exception:  # the session may be gone; the folder's owner cleans up then
        pass
    for path in _own:
        shutil.rmtree(path, ignore_errors=True)
