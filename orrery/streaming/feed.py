"""Work that is done in bounded micro-batches by one streaming query, and goes on where it stopped.

A feed is a folder with a table of what is to be done, in files of a bounded number of rows, and the query's checkpoint. The table is
written once and read as a stream, some files a micro-batch; the query's log tells which files are done. A program
that is killed after batch n finds the feed again, and the next run starts with batch n + 1; a batch that was under way is done
again. A feed whose table isn't whole was never begun, and is dropped.
"""

from __future__ import annotations

import os
import shutil
from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession

FILE_ROWS = 4096


class Feed:
    def __init__(self, spark: SparkSession, path: str, schema):
        self.spark, self.path, self.schema = spark, path, schema
        if os.path.isdir(path) and not os.path.exists(f"{path}/rows/_SUCCESS"):
            self.drop()

    @property
    def begun(self) -> bool:
        return os.path.exists(f"{self.path}/rows/_SUCCESS")

    def write(self, rows: DataFrame, order: str, batch: int) -> None:
        """What is to be done, ``batch`` rows at a time at most."""
        size = max(1, min(batch, FILE_ROWS))
        rows.repartitionByRange(order).sortWithinPartitions(order).write.option("maxRecordsPerFile", size).parquet(f"{self.path}/rows")

    def drain(self, handle: Callable[[DataFrame], None], batch: int) -> None:
        """Call ``handle`` with what is left, micro-batch by micro-batch, and delete the feed; an error ends it and is raised, and the
        feed stays for the next run."""
        failed: list[Exception] = []

        def each(rows: DataFrame, _: int) -> None:
            try:
                handle(rows)
            except Exception as e:
                failed.append(e)
                raise

        files = max(1, batch // FILE_ROWS)
        stream = self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", files).parquet(f"{self.path}/rows")
        query = stream.writeStream.foreachBatch(each).option("checkpointLocation", f"{self.path}/checkpoint").trigger(availableNow=True).start()
        try:
            query.awaitTermination()
        except StreamingQueryException as e:
            raise (failed or [e])[0] from None
        self.drop()

    def drop(self) -> None:
        shutil.rmtree(self.path, ignore_errors=True)
