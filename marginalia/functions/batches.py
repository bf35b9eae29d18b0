"""Bounds of the Arrow batches that go to Python."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession

#: Rows and bytes of an Arrow batch handed to Python, whichever is reached first.  A text longer than that is a batch.
BATCH_ROWS, BATCH_BYTES = 256, 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches, so that a Python worker's memory follows neither a partition's size nor its texts'.

    Plans read these settings when they run, which is after an operator returns; so they
    stay set, but are only ever lowered.
    """
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = re.fullmatch(r"(\d+)([kmgt]?)b?", (spark.conf.get(name, None) or "").strip().lower())
        if not now or not 0 < int(now[1]) << 10 * " kmgt".index(now[2] or " ") <= most:
            spark.conf.set(name, str(most))
