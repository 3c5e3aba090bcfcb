"""Session helpers: shipping the package to executors and cutting lineage."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"

_shipped: set[str] = set()
_folders: dict[str, str] = {}


def ship(spark: SparkSession) -> SparkSession:
    """Make this package importable in the Python workers of every executor, once per application."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        base = os.path.join(tempfile.mkdtemp(prefix="plotweave-"), "plotweave")
        sc.addPyFile(shutil.make_archive(base, "zip", root, "plotweave"))
        _shipped.add(sc.applicationId)
    return spark


def scratch_folder(spark: SparkSession) -> str:
    """Folder for intermediate tables, below the one the cluster names in ``spark.checkpoint.dir``.

    Only a local session without the setting gets a folder of its own. Removed when the
    application ends.
    """
    sc = spark.sparkContext
    if sc.applicationId not in _folders:
        base = spark.conf.get(CHECKPOINT_DIR, None) or sc.getConf().get(CHECKPOINT_DIR)
        if base is None:
            if not sc.master.startswith("local"):
                raise RuntimeError(f"set {CHECKPOINT_DIR} to a folder all executors share")
            base = tempfile.mkdtemp(prefix="plotweave-checkpoint-")
        folder = f"{base.rstrip('/')}/plotweave-{sc.applicationId}"
        path = sc._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(path)
        _folders[sc.applicationId] = folder
    return _folders[sc.applicationId]


def stored(df: DataFrame) -> DataFrame:
    """Materialize as a table in the shared folder and continue from it.

    Survives lost executors, keeps plans short, lets later steps read only the columns
    they need and gives the optimizer true row counts (a checkpoint keeps estimates, which
    multiply over repeated self-joins).
    """
    path = f"{scratch_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """``stored``, for tables with coordinates: joins on them are merge joins.

    Their files pack regular coordinates a hundred times, so by their size the driver would
    collect and broadcast tables that do not fit it. ``F.broadcast`` on a side still goes first.
    """
    return stored(df).hint("merge")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt out by ``keys`` to as many tasks as a shuffle has.

    A small file is read by one task, whatever work its rows make afterwards. Joins on the
    rows are merge joins, as for ``cut``: a packed file says little of their size.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys).hint("merge")


def discard(*tables: DataFrame) -> None:
    """Delete tables made by ``cut`` that no later step reads."""
    for df in tables:
        for name in df.inputFiles()[:1]:
            sc = df.sparkSession.sparkContext
            path = sc._jvm.org.apache.hadoop.fs.Path(name).getParent()
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
