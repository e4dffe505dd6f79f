"""Staging of intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """Folder for staged tables and checkpoints.

    A cluster names it in ``spark.checkpoint.dir``. Only where that is unset and the master
    is local, as in tests, a temporary folder is made and put into the session.
    """
    at = spark.conf.get(_SETTING, None) or spark.sparkContext.getConf().get(_SETTING)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"{_SETTING} must name a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="veldra-")
        spark.conf.set(_SETTING, at)
    return at.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a staged table; a session that has ended is no error."""
    if not path:
        return
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001
        pass


_STAGED: dict[int, tuple[SparkSession, str]] = {}


def stage(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    Cuts the lineage: a lost executor costs no recomputation, and later reads get
    column pruning and pushed filters. The files go with ``release()``, or when the
    Python process ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/veldra-{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    keep(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def keep(spark: SparkSession, path: str) -> None:
    """Count the table at ``path`` among those staged."""
    _STAGED[len(_STAGED)] = spark, path


def release(since: int = 0) -> None:
    """Delete the tables staged so far (from the ``since``-th on); their frames can't be read any more."""
    for number in [n for n in _STAGED if n >= since]:
        remove(*_STAGED[number])
        _STAGED[number] = (_STAGED[number][0], "")


def staged() -> int:
    """How many tables were staged: a mark for ``release``."""
    return len(_STAGED)


atexit.register(release)
