"""Sends this package to the Python workers of a session, once for each SparkContext."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

#: Arrow batches to and from Python hold at most so many bytes, however long the rows are.
BATCH_BYTES = 8 << 20
_sent: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """After this, functions of this package run on executors that don't have it installed."""
    context = spark.sparkContext
    if context.applicationId not in _sent:
        top = Path(__file__).parent
        archive = Path(tempfile.mkdtemp(prefix="wavelake-")) / "wavelake.zip"
        with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
            for file in sorted(top.rglob("*.py")):
                z.write(file, Path("wavelake") / file.relative_to(top))
        context.addPyFile(str(archive))
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
        _sent.add(context.applicationId)
    return spark
