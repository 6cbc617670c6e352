"""Helpers the training-data operators share: scratch folders that every executor sees, and row ids."""

from __future__ import annotations

import atexit
import gc
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the class [\x20\x09-\x0D].
WHITE = " \t\n\x0b\x0c\r"


#: Scratch paths of this driver that still exist, in the order of their making, and the session of each.
_PATHS: dict[str, SparkSession] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Only a session on one machine (local master) may have none: it gets one
    under its warehouse."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"{spark.conf.get('spark.sql.warehouse.dir')}/textward-scratch"
        spark.conf.set("spark.checkpoint.dir", root)
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed by remove_paths() or when the driver ends."""
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    _PATHS[path] = spark
    return path


def mark() -> set[str]:
    """A point in time for made_since()."""
    return set(_PATHS)


def made_since(before: set[str]) -> list[str]:
    """The scratch paths made since mark() gave `before` that still exist."""
    return [p for p in _PATHS if p not in before]


def remove_paths(paths: list[str]) -> None:
    """Remove scratch paths. Frames that still read them can no longer run."""
    for path in list(paths):
        if path in _PATHS:
            _remove(_PATHS.pop(path), path)


def discard(*frames: DataFrame) -> None:
    """Remove the tables behind frames that materialise() returned and that nothing reads any more."""
    remove_paths([p for f in frames for p in getattr(f, "_scratch_paths", ())])


def reclaim(spark: SparkSession) -> None:
    """Ask the driver's JVM to notice frames that are gone, so that Spark removes their shuffle files now. What Python
    still holds in cycles goes first, and the removal, which runs beside the driver, gets a moment: twice, as what the
    first round ends may have held more."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.4)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001  the JVM may be gone by now
        return


atexit.register(lambda: remove_paths(list(_PATHS)))


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage, survives lost executors, and fixes
    what monotonically_increasing_id() gave."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_paths = (path,)
    return out


def numbered(docs: DataFrame, column: str, name: str) -> DataFrame:
    """docs with a number of its own for each row, written so that it stays the same."""
    if column in docs.columns:
        raise ValueError(f"a column named {column} is in the way")
    return materialise(docs.withColumn(column, F.monotonically_increasing_id()), name)


def row_numbers(row_col: str | None) -> Column:
    """The given column of row numbers, or new ones, which last only as far as the frame is written."""
    return F.monotonically_increasing_id() if row_col is None else F.col(row_col)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row, also when body uses it inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
