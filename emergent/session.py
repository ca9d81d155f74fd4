"""Things that every operator needs from a session."""

from __future__ import annotations

import os
import re
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


#: Rows and bytes of an Arrow batch, where the session sets none: what workers hold at once is small however long texts are.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


def ship(spark: SparkSession) -> None:
    """Make this package importable in the Python workers, once for each application, and bound Arrow batches.

    The zip is served by the driver to every executor, so nothing depends on a shared or local folder.
    """
    for key, value in BATCH.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)
    context = getattr(spark, "sparkContext", None)
    if context is None or context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="emergent-")) / "emergent_package.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, Path("emergent") / file.relative_to(root))
    context.addPyFile(str(target))
    _shipped.add(context.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share for checkpoints; set only where the session has none and runs in one process."""
    directory = spark.conf.get("spark.checkpoint.dir", None)
    jsc = spark.sparkContext._jsc.sc()
    if directory is None:
        current = jsc.getCheckpointDir()
        if current.isDefined():
            return current.get()
        if not re.match(r"local(\[[^\]]*\])?$", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        directory = os.path.join(tempfile.gettempdir(), "emergent-checkpoints")
    if jsc.getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(directory)
    return directory


def checkpointed(df):
    """The rows of df in the shared folder, with its lineage cut; survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
