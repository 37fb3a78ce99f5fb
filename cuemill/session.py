"""Session helpers shared by all operators: reading tables, shared scratch space."""

from __future__ import annotations

import atexit
import functools
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Where the session names no shared folder (tests on one machine), this one is made once.
_OWN: dict[str, str] = {}


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives this package to the executors' Python workers, once an application, however the driver found it."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    _SHIPPED.add(app)
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="cuemill-")) / "cuemill.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"{root.name}/{f.relative_to(root)}")
    spark.sparkContext.addPyFile(str(target))


def shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """A query that ships the package before it runs."""

    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """This application's folder below `spark.checkpoint.dir`, which all executors see; on one machine a folder of our own where that is unset."""
    app = spark.sparkContext.applicationId
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return f"{named.rstrip('/')}/cuemill-{app}"
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors see")
    if app not in _OWN:
        own = tempfile.mkdtemp(prefix="cuemill-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        _OWN[app] = "file://" + own
        spark.sparkContext.setCheckpointDir(_OWN[app])
    return _OWN[app]


def clean(spark: SparkSession) -> None:
    """Deletes all that this application wrote to the shared folder: once none of its results is read any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Writes df to the shared folder and reads it back; cuts lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, wanted: str) -> str:
    """`wanted`, lengthened until it clashes with none of df's columns (Spark compares without case)."""
    have = {c.lower() for c in df.columns}
    while wanted.lower() in have:
        wanted = "_" + wanted
    return wanted
