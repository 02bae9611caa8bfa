"""Sessions, and the package on executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def session(name: str = "chronofold", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings that the operators assume: UTC, ANSI, adaptive execution, Arrow batches bounded in bytes."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.ansi.enabled": "true", "spark.sql.adaptive.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": "64m"} | conf
    return builder.config(map=settings).getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each Spark application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    out = os.path.join(tempfile.mkdtemp(), "chronofold.zip")
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
        extra = root.parent / "corpus_pipeline.py"
        if extra.exists():
            z.write(extra, extra.name)
    context.addPyFile(out)
    _shipped.add(context.applicationId)


_shipped: set[str] = set()


def scratch(spark: SparkSession) -> str:
    """A new folder below that of the checkpoints, which all executors share."""
    checkpoints(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` as written to the checkpoint folder: neither its plan nor its lineage goes on into what is made of it."""
    checkpoints(df.sparkSession)
    return df.checkpoint()


def checkpoints(spark: SparkSession) -> None:
    """See that ``checkpoint()`` has a folder: that of ``spark.checkpoint.dir``, or on a local master one of its own."""
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    folder = context.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="chronofold-")
    context.setCheckpointDir(folder)
