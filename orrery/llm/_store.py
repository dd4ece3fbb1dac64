"""Tables that cut lineage, in the folder which the cluster shares."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where that is unset, a folder of our own for a local master, else an error, as
    executors on other machines would each write to their own disk."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[.*)?$", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="orrery-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def free(df: DataFrame, *names: str) -> list[str]:
    """The names, each changed until no column of df has it."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        name = f"_{name}"
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def _delete(spark: SparkSession, path: str) -> None:
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001  the session may have ended; the cluster's cleaner takes what is left
        pass


class Scratch:
    """A folder of written tables for one run of an operator; it goes when the program ends or on drop()."""

    def __init__(self, spark: SparkSession):
        self.spark, self.path = spark, f"{shared_dir(spark)}/orrery-{uuid.uuid4().hex}"
        self.n = 0
        self.made: list[tuple[DataFrame, str]] = []
        atexit.register(_delete, spark, self.path)

    def keep(self, df: DataFrame) -> DataFrame:
        """df written once and read back: later plans start from files, which outlive any executor."""
        self.n += 1
        path = f"{self.path}/{self.n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.made.append((out, path))
        return out

    def same(self, df: DataFrame, kept: DataFrame) -> DataFrame:
        """df, whose drop() shall delete the table of kept, which it is derived from."""
        self.made = [(df if x is kept else x, path) for x, path in self.made]
        return df

    def drop(self, df: DataFrame) -> None:
        """Delete a table that nothing will read again."""
        for path in [path for x, path in self.made if x is df]:
            _delete(self.spark, path)
        self.made = [own for own in self.made if own[0] is not df]
