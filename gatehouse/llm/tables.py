"""Intermediate tables of the corpus operators."""

from __future__ import annotations

import gc
import time

from pyspark.sql import DataFrame, SparkSession

from gatehouse.session import stored

#: Bytes of an Arrow batch on its way to Python: texts are long, and a task holds a few batches.
BATCH_BYTES = "4m"


def bounded_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by their bytes, not only by their rows.

    Spark reads this setting when a result is computed, so it stays set in the session.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")


def finished(rows: DataFrame, name: str) -> DataFrame:
    """Rows written to the shared folder and read back, when a costly step ends with them.

    Nothing needs the shuffle files behind them any more. Spark deletes those once the driver's
    garbage collector has found them, so it is asked to run now, not in half an hour; and once
    more when the last events of the job, which still name it, have been handled.
    """
    spark = rows.sparkSession
    table = stored(rows, name)
    del rows
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.7)
    return table


def emptied(*tables: DataFrame) -> None:
    """Frees the disk of tables from `stored` that nothing needs any more: each is overwritten by an empty one."""
    for table in tables:
        files = table.inputFiles()
        if files:
            none = table.sparkSession.createDataFrame([], table.schema)
            none.coalesce(1).write.mode("overwrite").parquet(files[0].rsplit("/", 1)[0])
