"""What a cluster needs of a session: this package in the Python workers, and a folder that all executors share."""

from __future__ import annotations

import os
import re
import tempfile
import zipfile
from pathlib import Path

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

_HERE = Path(__file__).resolve().parent


def packaged() -> None:
    """Send the package to the executors of the running context, if there is one and it hasn't got it yet."""
    context = SparkContext._active_spark_context
    if context is None or getattr(context, "_quillon_sent", False):
        return
    handle, path = tempfile.mkstemp(prefix="quillon-", suffix=".zip")  # the driver serves it to every executor
    os.close(handle)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for file in sorted(_HERE.rglob("*.py")):
            out.write(file, file.relative_to(_HERE.parent))
    context.addPyFile(path)
    context._quillon_sent = True


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where it is unset a local session gets a folder of its own; a cluster is refused."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = held.get() if held.isDefined() else None
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="quillon-scratch-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """df, written to the shared folder, so that its lineage ends there."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()
