"""Benchmark corpora from JSON files: images with checksums, and captions with the image that each describes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.errors import CorpusError


def _rows(spark: SparkSession, path: str, field: str, schema: str) -> DataFrame:
    """The elements of one array of a JSON object; its other fields are not parsed."""
    found = spark.read.schema(f"{field} array<struct<{schema}>>").json(path, multiLine=True)
    return found.select(F.explode(field).alias("_x")).select("_x.*")


def checked_images(spark: SparkSession, images: str, checksums: str) -> DataFrame:
    """file_name and sha256 of every image listed; reading one without a checksum fails the job."""
    known = spark.read.text(checksums, wholetext=True).select(F.explode(F.from_json("value", "map<string,struct<sha256:string>>")).alias("_name", "_sum"))
    listed = _rows(spark, images, "images", "file_name: string")
    lost = F.raise_error(F.concat(F.lit("no checksum of "), F.col("file_name")))
    joined = listed.join(known, F.col("file_name") == F.col("_name"), "left")
    return joined.select("file_name", F.coalesce(F.col("_sum.sha256"), lost.cast("string")).alias("sha256"))


def captions(spark: SparkSession, path: str, n_images: int | None = None, least_captions: int = 0) -> DataFrame:
    """caption and file_name of its image. EngineError if image ids repeat, a caption's image is unknown, an image has
    no caption, or there are other than n_images images or fewer than least_captions captions."""
    images = _rows(spark, path, "images", "id: long, file_name: string")
    told = _rows(spark, path, "annotations", "image_id: long, caption: string")
    n, distinct = images.agg(F.count("*"), F.count_distinct("id")).first()
    if n != distinct:
        raise CorpusError(cause="image ids are not unique")
    if n_images is not None and n != n_images:
        raise CorpusError(cause=f"expected {n_images} images, found {n}")
    joined = told.join(images, told.image_id == images.id, "left")
    total, orphans, described = joined.agg(F.count("*"), F.count_if(F.col("id").isNull()), F.count_distinct("id")).first()
    if orphans or total < least_captions or described != n:
        raise CorpusError(cause="the captions are incomplete")
    return joined.select("caption", "file_name")


def verified(spark: SparkSession, folder: str, checks: DataFrame) -> DataFrame:
    """file_name of each file of checks (file_name, sha256) below folder; a file that is not there, or whose bytes hash
    otherwise, fails the job. Bytes are hashed where they are read."""
    files = spark.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("_name"), F.sha2("content", 256).alias("_sum"))
    wrong = F.raise_error(F.concat(F.lit("missing or changed: "), F.col("file_name"))).cast("string")
    joined = checks.join(files, F.col("file_name") == F.col("_name"), "left")
    return joined.select(F.when(F.col("_sum") == F.lower("sha256"), F.col("file_name")).otherwise(wrong).alias("file_name"))
