"""Exact deduplication against a persistent digest index.

The index is a table bucketed and sorted by digest. New rows are digested, grouped, set against it by a
sort-merge anti-join, and the digests not yet in it are appended. A rerun after a failure finds its own
digests in the index and appends nothing twice.

The number of buckets is the index's own, written in the name of its generation: it is chosen from the first batch, and
when a batch makes the buckets too large, or many batches have left many small files in each, the index is written anew
as the next generation, with as many buckets as it needs. A generation counts once its marker is written, so a failure
leaves the one before in place.

Defined cases: a null text counts as empty; null ids sort before all others; of repeated rows with one id and
one text exactly one is kept; an empty input gives an empty result; other columns of the input are not looked at.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_CLASS, _store, delete, durable, fresh, parts, scratch_path, text_or_empty

SCHEMA = "digest BINARY, keep_id BIGINT, keep_seq BIGINT, batch STRING"
PER_BUCKET, APPENDS = 2_000_000, 16  # digests of a bucket, files of a bucket


def digest(column: str = "text") -> Column:
    """SHA-256 of the text with each run of white space replaced by one space."""
    return F.unhex(F.sha2(F.regexp_replace(text_or_empty(column), f"{SPACE_CLASS}+", " "), 256))


class DigestIndex:
    """A bucketed, sorted table of digests at `path`; opening the same path again finds what was appended before."""

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None, per_bucket: int = PER_BUCKET):
        self.spark, self.path, self.per_bucket = spark, path.rstrip("/"), per_bucket
        self.generation, self.buckets, self.least = -1, 0, buckets or spark.sparkContext.defaultParallelism
        store, root = _store(spark, self.path)
        if store.exists(root):
            done = [re.fullmatch(r"(\d+)-(\d+)\.done", f.getPath().getName()) for f in store.listStatus(root)]
            if done := [m for m in done if m]:
                newest = max(done, key=lambda m: int(m[1]))
                self.generation, self.buckets = int(newest[1]), int(newest[2])
                self._table()

    @property
    def folder(self) -> str:
        return f"{self.path}/{self.generation}-{self.buckets}"

    @property
    def table(self) -> str:
        return f"digest_index_{uuid.uuid5(uuid.NAMESPACE_URL, self.folder).hex}"

    def _table(self) -> None:
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.table} ({SCHEMA}) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.folder}'"
        )

    def _write(self, rows: DataFrame) -> None:
        spread = rows.repartition(self.buckets, "digest").write.mode("append").format("parquet")
        spread.bucketBy(self.buckets, "digest").sortBy("digest").option("path", self.folder).saveAsTable(self.table)
        self.spark.catalog.refreshTable(self.table)

    def _grow(self, coming: int) -> None:
        """Makes sure that buckets hold `coming` more digests, in few files: a new generation if they don't."""
        old, held = (self.read() if self.buckets else None), 0
        if old is not None:
            held = old.count()
            files = len(old.inputFiles())
            if held + coming <= 2 * self.per_bucket * self.buckets and files <= APPENDS * self.buckets:
                return
        before, dropped = self.folder, self.table
        self.generation, self.buckets = self.generation + 1, max(self.least, self.buckets, parts(held + coming, self.per_bucket))
        self._table()
        if old is not None:
            self._write(old)
        store, at = _store(self.spark, f"{self.folder}.done")
        store.create(at, True).close()
        if old is not None:
            self.spark.sql(f"DROP TABLE {dropped}")
            delete(self.spark, f"{before}.done")
            delete(self.spark, before)

    def close(self) -> None:
        """Forgets the table's name; its files stay."""
        if self.buckets:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")

    def read(self) -> DataFrame:
        return self.spark.table(self.table)

    def add(self, rows: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Appends what is new; returns id, digest, keep_id, group_size (in this batch) and kept, for every row."""
        batch = uuid.uuid4().hex
        seen = durable(
            rows.select(F.col(id_col).cast("long").alias("id"), digest(text_col).alias("digest")).withColumn("seq", F.monotonically_increasing_id()),
            "digests",
        )
        # Groups of copies collapse before the shuffle; what is shuffled is a row for each digest and task.
        groups = durable(seen.groupBy("digest").agg(F.min(F.struct(F.col("id").isNotNull().alias("some"), "id", "seq")).alias("first"), F.count("*").alias("group_size")), "groups")
        self._grow(groups.count())
        known = self.read().select("digest", "keep_id")
        # Stored, so that both sides of the last join are exchanged and a hot digest can be split at run time.
        new = groups.join(known.select("digest").hint("merge"), "digest", "left_anti")
        new = durable(new.select("digest", "group_size", F.col("first.id").alias("keep_id"), F.col("first.seq").alias("keep_seq")), "new-digests")
        old = groups.join(known.hint("merge"), "digest").select("digest", "group_size", "keep_id", F.lit(None).cast("long").alias("keep_seq"))
        stays = durable(new.unionByName(old), "stays")  # before the append, after which nothing is new
        self._write(new.select("digest", "keep_id", "keep_seq", F.lit(batch).alias("batch")))
        mine = F.col("keep_seq").eqNullSafe(F.col("seq"))
        return seen.join(stays, "digest").select("id", "digest", "keep_id", "group_size", mine.alias("kept"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of a new index's only batch."""
    index = DigestIndex(docs.sparkSession, scratch_path(docs.sparkSession, "index"))
    out = index.add(docs)
    index.close()
    return out


def op5_exact_dedup(docs: DataFrame) -> DataFrame:
    """The contract's result: every document with the row that stays for its text."""
    out = deduplicated(docs)
    return out.select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


def keep_first(docs: DataFrame) -> DataFrame:
    """The documents whose row stays, with all their columns."""
    kept = deduplicated(docs).filter("kept").select("id", "digest")
    own = fresh(docs, "own_digest")
    marked = docs.withColumn(own, digest())
    same = marked["doc_id"].eqNullSafe(kept["id"]) & (marked[own] == kept["digest"])
    return marked.join(kept, same, "left_semi").dropDuplicates(["doc_id", own]).drop(own)


ORACLE = r"""
WITH normal AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
grouped AS (SELECT *, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size FROM normal)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM grouped
"""
