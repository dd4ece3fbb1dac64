"""Change feeds into the index, one commit for each micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.contracts import CHANGES
from orrery.sources.snapshot import Index


def ingest(changes: DataFrame, index: Index, checkpoint: str, order: str = "seq"):
    """Start a query that commits a stream of CHANGES rows; of several for one path in a micro-batch the last by
    ``order`` counts. Commits are upserts and deletes by key, so a batch that is replayed changes nothing."""

    def commit(batch: DataFrame, _: int) -> None:
        last = F.row_number().over(Window.partitionBy("path").orderBy(F.desc(order)))
        rows = batch.withColumn("_n", last).where("_n = 1").select(*[f.name for f in CHANGES.fields])
        with index.locked():
            index.commit(rows)

    return changes.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
