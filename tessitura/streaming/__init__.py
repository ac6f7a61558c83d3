"""Predicates over streams. A compiled predicate keeps no state, so it is the same over a stream as over a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.predicate import Predicate, compiled
from ..sources.discover import only_candidates
from ..sources.reader import AudioCatalog, layouts


def filtered(stream: DataFrame, predicate: Predicate) -> DataFrame:
    return predicate.filter(stream)


def counted(stream: DataFrame, predicate: Predicate, time: str, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Answers by event time: examined, matched and unanswered in each window, closed once the watermark has passed."""
    seen = stream.withWatermark(time, late).withColumn("truth", predicate.truth)
    return seen.groupBy(F.window(time, window)).agg(F.count("*").alias("examined"), F.count_if("truth").alias("matched"), F.count_if(F.col("truth").isNull()).alias("unanswered"))


def arriving(spark: SparkSession, folder: str, where: str) -> DataFrame:
    """Audio files that arrive in a folder of any store and match: path and size."""
    catalog = AudioCatalog()
    predicate = compiled(where, catalog)
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    stream = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").load(folder)
    read = layouts(only_candidates(stream), catalog.requests)
    return read.filter("readable").filter(predicate.truth).select("path", "size")
