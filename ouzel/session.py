"""Session defaults, table access and staging of intermediate results."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_session(name: str = "ouzel", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    return builder.config(map=DEFAULTS | conf).getOrCreate()


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once per session, wherever they run."""
    sc = spark.sparkContext
    if getattr(sc, "_ouzel_shipped", False):
        return
    sc._ouzel_shipped = True
    place = tempfile.mkdtemp(prefix="ouzel-code-")  # the driver serves it; nothing else reads it
    root = Path(__file__).resolve().parent
    with zipfile.ZipFile(f"{place}/ouzel_code.zip", "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(f"{place}/ouzel_code.zip")
    atexit.register(shutil.rmtree, place, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: the session's ``spark.checkpoint.dir``.

    Only a local master may go without the setting; it gets a folder of its own.
    """
    sc = spark.sparkContext
    place = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if place is None and sc.master.startswith("local") and not sc.master.startswith("local-cluster"):
        place = getattr(sc, "_ouzel_shared", None)
        if place is None:
            place = sc._ouzel_shared = tempfile.mkdtemp(prefix="ouzel-")
            atexit.register(shutil.rmtree, place, True)
    if place is None:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return place


FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stage(df: DataFrame, label: str = "stage", free: bool = False) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    This cuts the lineage as ``checkpoint()`` does, survives lost executors, keeps the columns
    prunable and tells the optimizer the true size of the result. With ``free``, the shuffle files it was made
    from are deleted as soon as it is written; otherwise they stay until the driver collects its garbage.
    """
    spark = df.sparkSession
    ship(spark)
    base = shared_dir(spark)
    path = os.path.join(base, "ouzel", f"{label}-{uuid.uuid4().hex}")
    before = spark.conf.get(FREE, "false")
    spark.conf.set(FREE, "true" if free else before)
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(FREE, before)
    _forget_later(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def drop_staged(df: DataFrame) -> None:
    """Delete a table that ``stage`` returned; nothing that reads it may run any more."""
    sc = df.sparkSession.sparkContext
    sc._ouzel_staged.remove(df.staged_at)
    _delete(sc, df.staged_at)


def _forget_later(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    if not hasattr(sc, "_ouzel_staged"):
        sc._ouzel_staged = []
        atexit.register(_forget, sc)
    sc._ouzel_staged.append(path)


def clear_staged(spark: SparkSession) -> None:
    """Delete all staged tables of the session; results that read them must have been written before."""
    sc = spark.sparkContext
    if hasattr(sc, "_ouzel_staged"):
        _forget(sc)
        sc._ouzel_staged.clear()


def _forget(sc) -> None:
    for path in sc._ouzel_staged:
        _delete(sc, path)


def _delete(sc, path: str) -> None:
    try:
        hadoop = sc._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(sc._jsc.hadoopConfiguration()).delete(hadoop, True)
    except Exception:  # the JVM is gone; a shared folder is cleared by its owner
        if path.startswith("/"):
            shutil.rmtree(path, ignore_errors=True)


def is_small(df: DataFrame, limit_bytes: int = 8 << 20) -> bool:
    """Whether the optimizer's size estimate of ``df`` (exact for staged data) is within a bound."""
    stats = df._jdf.queryExecution().optimizedPlan().stats()
    return int(str(stats.sizeInBytes())) <= limit_bytes
