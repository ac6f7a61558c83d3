"""Mixing sources to target weights by systematic sampling; DataFrame functions only.

Documents of a source are put in order of size (then of a hash of the id), each is expected `target / source size`
times, and a document is taken once per whole number that the running sum of expectations, started at one random
offset, crosses. In order of size the taken words differ from the target by less than the largest document.

The running sum is distributed: a histogram of (source, size), hash buckets within each of its cells (as many as the
largest cell needs), and a rank within a bucket; no task ever sees a whole source. Expectations are fixed-point numbers
with 24 binary places, so that results don't depend on the order of additions.

Defined cases: a null text has size 0; null is a source of its own, the last; null ids take part like others;
repeated rows are documents of their own; a source of size 0 has target 0 and an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_CLASS, SPACES, durable, fresh, parts, text_or_empty

WEIGHTS, CAP, SEED, PLACES, ROWS_PER_BUCKET = (5, 2, 1), 3, 17, 24, 500_000


def word_count(column: str = "text") -> Column:
    bare = F.btrim(text_or_empty(column), F.lit(SPACES))
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, f"{SPACE_CLASS}+"))).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """From (source, total) rows: weight and target, filled up by weight with each source closed at cap x total.

    Sources in order of cap x total / weight close one after another; the level at which the next one would not
    close is the level of all that remain. One row per source passes through the windows.
    """
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    w = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(Window.orderBy("source")) - 1) % len(weights) + 1)
    out = sizes.withColumn("weight", w).withColumn("most", F.col("total") * cap).withColumn("all", F.sum("total").over(every))
    closing = Window.orderBy(F.col("most") / F.col("weight"), "source")
    out = out.withColumn("before", F.coalesce(F.sum("most").over(closing.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    out = out.withColumn("rest", F.sum("weight").over(closing.rowsBetween(0, Window.unboundedFollowing)))
    out = out.withColumn("level", (F.col("all") - F.col("before")) / F.col("rest"))
    full = F.col("most") / F.col("weight") <= F.col("level")
    out = out.withColumn("level", F.max(F.when(~full, F.col("level"))).over(every))
    target = F.when(F.col("level").isNull() | (F.col("most") / F.col("weight") <= F.col("level")), F.col("most").cast("double"))
    return out.select("source", "total", target.otherwise(F.col("weight") * F.col("level")).alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: int = SEED, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """id, text hash (rid), size, source_size, target, copies for every row."""
    order = F.md5(F.coalesce(F.col("id").cast("string"), F.lit("")))
    rows = durable(
        docs.select(
            F.col(id_col).alias("id"),
            # '=' sorts before '~', so that a null source comes last
            F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("~")).alias("source"),
            word_count(text_col).alias("size"),
            F.xxhash64(text_or_empty(text_col)).alias("rid"),
        ),
        "sizes",
    )
    cells = durable(rows.groupBy("source", "size").agg(F.count("*").alias("n")), "cells")
    largest = cells.agg(F.max("n")).first()[0]
    digits = max(2, -(-(parts(largest, ROWS_PER_BUCKET) - 1).bit_length() // 4))
    rows = rows.withColumn("order", order).withColumn("bucket", F.substring("order", 1, digits))
    buckets = rows.groupBy("source", "size", "bucket").agg(F.count("*").alias("n"))
    aims = targets(cells.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("total")), weights, cap)
    one = F.lit(1 << PLACES)
    step = F.when(F.col("total") == 0, F.lit(0)).otherwise(F.least(F.round(F.col("target") / F.col("total") * one).cast("long"), F.lit(cap << PLACES)))
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), "source")), 1, PLACES // 4), 16, 10).cast("long")
    aims = aims.withColumn("step", step).withColumn("offset", offset)
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = cells.withColumn("cell_start", before(Window.partitionBy("source").orderBy("size"))).drop("n")
    buckets = buckets.withColumn("start", before(Window.partitionBy("source", "size").orderBy("bucket"))).drop("n")
    starts = buckets.join(cells.join(aims, "source"), ["source", "size"])
    rank = F.col("cell_start") + F.col("start") + F.row_number().over(Window.partitionBy("source", "size", "bucket").orderBy("order", "id", "rid")) - 1
    taken = rows.join(starts, ["source", "size", "bucket"]).withColumn("rank", rank)
    crossed = lambda r: F.shiftright(F.col("offset") + r * F.col("step"), PLACES)
    copies = (crossed(F.col("rank") + 1) - crossed(F.col("rank"))).cast("long")
    return taken.select("id", "rid", "size", F.col("total").alias("source_size"), "target", copies.alias("copies"))


def op2_mixing(docs: DataFrame) -> DataFrame:
    """The contract's result."""
    return mix(docs).select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The documents with all their columns, each as many times as the mix takes it.

    Which of the rows with one id and one text are taken, and how often, can't be told apart: their copies are dealt out
    evenly over them, in order of a hash of the whole row, so that none is lost.
    """
    mine = {c: fresh(docs, f"mix_{c}") for c in ("id", "rid", "copies", "rows", "copy", "row", "n", "start", "all")}
    share = durable(mix(docs, **options).groupBy("id", "rid").agg(F.sum("copies").alias("copies"), F.count("*").alias("rows")), "shares")
    taken = share.filter("copies > 0").withColumnsRenamed({c: mine[c] for c in share.columns})
    same = docs["doc_id"].eqNullSafe(taken[mine["id"]]) & (F.xxhash64(text_or_empty("text")) == taken[mine["rid"]])
    joined = docs.join(taken, same)
    times = lambda n: F.explode(F.sequence(F.lit(1), n.cast("int")))
    single = joined.filter(F.col(mine["rows"]) == 1).withColumn(mine["copy"], times(F.col(mine["copies"]))).select(*docs.columns)
    if share.filter("rows > 1").isEmpty():
        return single
    # Rows alike in every column are one class; the classes of a group stand in order and share its copies by their places.
    group = [mine["id"], mine["rid"], mine["copies"], mine["rows"], mine["row"]]
    classes = joined.filter(F.col(mine["rows"]) > 1).withColumn(mine["row"], F.xxhash64(F.to_json(F.struct(*docs.columns)))).groupBy(*group)
    classes = classes.agg(F.first(F.struct(*docs.columns)).alias(mine["all"]), F.count("*").alias(mine["n"]))
    before = Window.partitionBy(mine["id"], mine["rid"]).orderBy(mine["row"]).rowsBetween(Window.unboundedPreceding, -1)
    classes = classes.withColumn(mine["start"], F.coalesce(F.sum(mine["n"]).over(before), F.lit(0)))
    each = F.floor(F.col(mine["copies"]) / F.col(mine["rows"]))
    more = F.col(mine["copies"]) % F.col(mine["rows"])
    own = F.col(mine["n"]) * each + F.greatest(F.lit(0), F.least(more, F.col(mine["start"]) + F.col(mine["n"])) - F.col(mine["start"]))
    several = classes.withColumn(mine["copy"], own).filter(F.col(mine["copy"]) > 0).withColumn(mine["copy"], times(F.col(mine["copy"])))
    return single.unionByName(several.select(f"{mine['all']}.*"))


ORACLE = r"""
WITH docs AS (
  SELECT doc_id, coalesce('=' || source, '~') AS source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents),
totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS total, 3 * CAST(sum(size) AS BIGINT) AS most FROM docs GROUP BY source),
weighed AS (SELECT *, CASE (row_number() OVER (ORDER BY source) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, sum(total) OVER () AS everything FROM totals),
levels AS (
  SELECT *, CAST(most AS DOUBLE) / weight AS ratio,
    CAST(everything - coalesce(sum(most) OVER (ORDER BY CAST(most AS DOUBLE) / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
      / CAST(sum(weight) OVER (ORDER BY CAST(most AS DOUBLE) / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level
  FROM weighed),
level AS (SELECT max(level) AS level FROM levels WHERE ratio > level),
aims AS (
  SELECT l.source, l.total, CASE WHEN v.level IS NULL OR l.ratio <= v.level THEN CAST(l.most AS DOUBLE) ELSE l.weight * v.level END AS target,
    CAST('0x' || substr(md5('17:' || l.source), 1, 6) AS BIGINT) AS start
  FROM levels l, level v),
steps AS (SELECT *, CASE WHEN total = 0 THEN 0 ELSE least(CAST(round(target / total * 16777216) AS BIGINT), 50331648) END AS step FROM aims),
ranked AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY size, md5(CAST(doc_id AS VARCHAR)), doc_id) - 1 AS rank FROM docs)
SELECT doc_id, size, total AS source_size, target,
  CAST(((start + (rank + 1) * step) >> 24) - ((start + rank * step) >> 24) AS BIGINT) AS copies,
  CAST(size * (((start + (rank + 1) * step) >> 24) - ((start + rank * step) >> 24)) AS BIGINT) AS taken
FROM ranked JOIN steps USING (source)
"""
