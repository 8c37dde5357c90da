"""How much of a table a Python worker holds at a time."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Bytes of an Arrow batch: workers keep a few times that, whatever the rows' lengths.
BATCH_BYTES = 8 << 20
_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches by bytes; a smaller bound that is set stays."""
    set_to = spark.conf.get(_SETTING).removesuffix("b")
    if not set_to.isdigit() or not 0 < int(set_to) <= BATCH_BYTES:
        spark.conf.set(_SETTING, f"{BATCH_BYTES}b")
