"""Sharding indivisible groups by Karmarkar-Karp differencing.

A partial partition is a tuple of shard sizes. Differencing starts from one tuple per group (its bytes and zeros)
and repeatedly merges the two tuples of largest spread, the largest part of one onto the smallest of the other.
It is done in rounds: groups are hashed to buckets and each bucket is differenced to one tuple, then up to FAN
buckets' tuples are differenced to one, until one is left. Merging partial partitions is the method's own step,
so the rounds change nothing but the order of merges; no task holds more than a bucket of groups or FAN tuples.

Defined cases: a null text counts as empty, of the same group as the empty text; null ids come first within a shard's
bucket; repeated rows each take a slot; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, parts, text_or_empty

SHARDS, FAN, GROUPS_PER_BUCKET, ROWS_PER_BUCKET = 40, 500, 50_000, 1_000_000


def difference(tuples: np.ndarray) -> np.ndarray:
    """labels[i, j]: the shard that part j of partial partition i goes to; tuples: one row of part sizes each."""
    n, k = tuples.shape
    order = np.argsort(-tuples, axis=1, kind="stable")
    sums: dict[int, np.ndarray] = dict(enumerate(np.take_along_axis(tuples, order, 1)))
    heap = [(int(s[-1] - s[0]), i) for i, s in sums.items()]
    heapq.heapify(heap)
    merges: list[tuple[int, int, np.ndarray]] = []
    while len(heap) > 1:
        (_, a), (_, b) = heapq.heappop(heap), heapq.heappop(heap)
        merged = sums.pop(a) + sums.pop(b)[::-1]
        by_size = np.argsort(-merged, kind="stable")
        sums[n + len(merges)] = merged = merged[by_size]
        heapq.heappush(heap, (int(merged[-1] - merged[0]), n + len(merges)))
        merges.append((a, b, by_size))
    labels: dict[int, np.ndarray] = {n + len(merges) - 1: np.arange(k)}
    for i in range(len(merges) - 1, -1, -1):  # from the last merge back to the leaves
        a, b, by_size = merges[i]
        at = np.empty(k, np.int64)
        at[by_size] = labels.pop(n + i)
        labels[a], labels[b] = at, at[::-1]
    out = np.empty((n, k), np.int64)
    for i in range(n):
        out[i, order[i]] = labels[i]
    return out


def _bucket(shards: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["bytes", "digest"], ascending=False)
        whole = np.zeros((len(pdf), shards), np.int64)
        whole[:, 0] = pdf["bytes"]
        return pdf.assign(part=difference(whole)[:, 0])

    return run


def _combine(shards: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes, at = np.unique(pdf["node"].to_numpy(), return_inverse=True)
        sums = np.zeros((len(nodes), shards), np.int64)
        sums[at, pdf["part"].to_numpy()] = pdf["bytes"]
        labels = difference(sums)
        up = np.bincount(labels.ravel(), sums.ravel(), shards)  # exact below 2**53 bytes a bucket of tuples
        return pd.DataFrame({"node": np.repeat(nodes, shards), "part": np.tile(np.arange(shards), len(nodes)), "to": labels.ravel(), "parent": pdf["parent"].iloc[0], "up": up[labels.ravel()].astype(np.int64)})

    return run


def assign(groups: DataFrame, shards: int = SHARDS, per_bucket: int = GROUPS_PER_BUCKET) -> DataFrame:
    """From (digest, bytes), one row for each group: digest, shard."""
    buckets = parts(groups.count(), per_bucket)
    placed = durable(
        groups.withColumn("node", F.pmod(F.xxhash64("digest"), F.lit(buckets)))
        .groupBy("node")
        .applyInPandas(_bucket(shards), "digest binary, bytes long, node long, part long"),
        "parts",
    )
    sums = placed.groupBy("node", "part").agg(F.sum("bytes").alias("bytes"))
    route = None  # (node, part) of the first round -> part of the newest
    while True:
        step = durable(
            sums.withColumn("parent", F.floor(F.col("node") / FAN).cast("long")).groupBy("parent").applyInPandas(_combine(shards), "node long, part long, to long, parent long, up long"),
            "merges",
        )
        if route is None:
            route = step.select("node", "part", F.col("parent").alias("at"), "to")
        else:
            here = step.select(F.col("node").alias("at"), F.col("part").alias("to"), F.col("parent").alias("next"), F.col("to").alias("next_to"))
            route = route.join(here, ["at", "to"]).select("node", "part", F.col("next").alias("at"), F.col("next_to").alias("to"))
        buckets = parts(buckets, FAN)
        if buckets == 1:
            break
        sums = step.groupBy(F.col("parent").alias("node"), F.col("to").alias("part")).agg(F.first("up").alias("bytes"))
    return placed.join(route, ["node", "part"]).select("digest", F.col("to").cast("int").alias("shard"))


def shard(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, size, text_crc32, shard, slot for every row."""
    text = text_or_empty(text_col)
    place = F.when(F.col(id_col).isNull(), F.monotonically_increasing_id())  # spreads rows without an id; stored with them
    rows = durable(
        docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.md5(text)).alias("digest"), place.alias("place")),
        "sizes",
    )
    buckets = max(64, parts(rows.count(), ROWS_PER_BUCKET))
    groups = durable(rows.groupBy("digest").agg(F.sum("size").alias("bytes")), "groups")
    placed = durable(rows.join(assign(groups, shards), "digest").drop("digest"), "placed")
    # Slots: a rank within each hash bucket of a shard, and the count of the buckets before it.
    placed = placed.withColumn("bucket", F.pmod(F.xxhash64("id", "place"), F.lit(buckets)))
    counts = placed.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    start = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rank = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("id", "text_crc32", "size"))
    return placed.join(counts.withColumn("start", start).drop("n"), ["shard", "bucket"]).withColumn("slot", F.col("start") + rank - 1).drop("bucket", "start", "place")


def op10_sharding(docs: DataFrame) -> DataFrame:
    """The contract's result, under the law `bytes`."""
    return shard(docs).select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
