"""Incremental reconciliation of what is there with what is indexed."""

from __future__ import annotations

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from orrery.sources.shared import kept, new_folder


def plan(found: DataFrame, indexed: DataFrame, key: str = "path", version: tuple[str, ...] = ("mtime_ns", "size")) -> DataFrame:
    """key and op of every key on either side: missing, stale, changed or same. One full outer join on narrow columns;
    versions differ if any part does (null equals null)."""
    left = found.select(F.col(key).alias("_l"), F.struct(*version).alias("_lv"))
    right = indexed.select(F.col(key).alias("_r"), F.struct(*version).alias("_rv"))
    op = F.when(F.col("_r").isNull(), "missing").when(F.col("_l").isNull(), "stale").when(F.col("_lv").eqNullSafe(F.col("_rv")), "same").otherwise("changed")
    return left.join(right, F.col("_l") == F.col("_r"), "full_outer").select(F.coalesce("_l", "_r").alias(key), op.alias("op"))


def missing(found: DataFrame, indexed: DataFrame, key: str = "path", version: tuple[str, ...] = ("mtime_ns", "size")) -> DataFrame:
    """Rows of found that must be embedded: new or changed. An anti join on key and version, null equal to null as in plan."""
    known = indexed.select(F.col(key).alias("_key"), F.struct(*version).alias("_version"))
    return found.join(known, (found[key] == F.col("_key")) & F.struct(*[found[v] for v in version]).eqNullSafe(F.col("_version")), "left_anti")


def only_in(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Rows of a whose key is not in b."""
    return a.join(b.select(key), key, "left_anti")


def apply_changes(base: DataFrame, changes: DataFrame, key: str = "path") -> DataFrame:
    """base with Upsert and Delete rows (op) taken in; the last word on a key is the change's."""
    kept = base.join(changes.select(key), key, "left_anti")
    return kept.unionByName(changes.where(F.col("op") == "upsert").select(*base.columns))


def numbered(rows: DataFrame, order: list[Column | str]) -> tuple[DataFrame, dict[int, tuple[int, int]]]:
    """rows in a total order with _p, the range partition that each is in, and _k, its place there; and of each partition how many
    rows stand before it and in it. The places are counted where the partitions are sorted, so rows travel once, and they
    are written, so that all uses see one dealing. One row a partition reaches the driver."""
    schema = StructType([*rows.schema.fields, StructField("_p", IntegerType()), StructField("_k", LongType())])

    def count(batches):
        part, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            size = len(batch)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * size, pa.int32()), pa.array(range(n, n + size), pa.int64())], [*batch.schema.names, "_p", "_k"])
            n += size

    dealt = kept(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(count, schema))
    ahead, total = {}, 0
    for r in sorted(dealt.groupBy("_p").agg(F.max("_k").alias("k")).collect()):
        ahead[r["_p"]] = (total, r["k"] + 1)
        total += r["k"] + 1
    return dealt, ahead


def place(ahead: dict[int, tuple[int, int]]) -> Column:
    """The place of a numbered row among all, from 0."""
    if not ahead:
        return F.col("_k")
    return F.element_at(F.create_map(*[x for p, (n, _) in ahead.items() for x in (F.lit(p), F.lit(n).cast("long"))]), F.col("_p")) + F.col("_k")


def chunks(rows: DataFrame, order: list[Column | str], size: int, name: str = "chunk") -> DataFrame:
    """rows with the number of the chunk of ``size`` that each falls in, in a total order."""
    dealt, ahead = numbered(rows, order)
    return dealt.withColumn(name, F.floor(place(ahead) / size).cast("long")).drop("_p", "_k")


class BucketedSnapshot:
    """A snapshot as a table in ``buckets`` by key, sorted inside, so that reconciling with it moves what was found and never what
    is indexed, and taking in changes moves the changes alone. Every version is a table of its own."""

    def __init__(self, spark: SparkSession, name: str, key: str, buckets: int = 256):
        self.spark, self.name, self.key, self.buckets, self.version = spark, name, key, buckets, 0

    def _save(self, rows: DataFrame) -> None:
        self.version += 1
        table = f"{self.name}_{self.version}"
        rows.write.bucketBy(self.buckets, self.key).sortBy(self.key).option("path", new_folder(self.spark, table)).saveAsTable(table)

    def write(self, rows: DataFrame) -> BucketedSnapshot:
        """The first version; rows are dealt to the buckets first, so that each is one file."""
        self._save(rows.repartition(self.buckets, self.key))
        return self

    @property
    def rows(self) -> DataFrame:
        return self.spark.table(f"{self.name}_{self.version}")

    def plan(self, found: DataFrame, version: tuple[str, ...] = ("mtime_ns", "size")) -> DataFrame:
        """plan() against this snapshot. found is dealt to the buckets; the table is read in them."""
        return plan(found.repartition(self.buckets, self.key), self.rows, self.key, version)

    def apply(self, changes: DataFrame) -> None:
        """A new version with Upsert and Delete rows (op, and the snapshot's columns) taken in; a key may change once."""
        now, own = self.rows, changes.repartition(self.buckets, self.key)
        told = own.select(F.col(self.key).alias("_key"), F.col("op").alias("_op"), *[F.col(c).alias(f"_new_{c}") for c in now.columns if c != self.key])
        both = now.join(told, F.col(self.key) == F.col("_key"), "full_outer").where("_op is null or _op = 'upsert'")
        new = lambda c: F.when(F.col("_op").isNull(), F.col(c)).otherwise(F.col(f"_new_{c}")).alias(c)
        self._save(both.select(*[F.coalesce(self.key, "_key").alias(self.key) if c == self.key else new(c) for c in now.columns]))

    def drop(self) -> None:
        for k in range(1, self.version + 1):
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name}_{k}")
