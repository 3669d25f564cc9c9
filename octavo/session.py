"""Prepares a session: the package's source on the executors, and small Arrow batches."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()
#: Rows and bytes of an Arrow batch. Whole texts may be long, and a batch is held by the JVM and by Python at once.
ARROW = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "4m"}


def ship(spark: SparkSession) -> SparkSession:
    """Sends the package's source to the executors, once for each application.

    Arrow batches get smaller, for all work of the session, unless it has settings of its own.
    """
    own = spark.conf.getAll
    for key, value in ARROW.items():
        if key not in own:
            spark.conf.set(key, value)
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = Path(__file__).parent
        path = os.path.join(tempfile.mkdtemp(prefix="octavo-src-"), "octavo.zip")
        with zipfile.ZipFile(path, "w") as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f"octavo/{f.relative_to(root)}")
        spark.sparkContext.addPyFile(path)
        _shipped.add(app)
    return spark
