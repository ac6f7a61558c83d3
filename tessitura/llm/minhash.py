"""Document fingerprints by one-permutation MinHash; DataFrame functions only.

A text's five-word shingles are hashed once each. The hash's top 8 bits choose one of 256 bins, and a bin keeps its
least hash: after sorting, the first of each run. An empty bin borrows from a bin that has one, found by
trying other bins in an order of its own until one is filled (optimal densification); the order depends on the bin
alone, so two texts that borrow do so alike. Of each bin the low 8 bits are stored, eight bins to a long. Two
different hashes share their low bits once in 256, which the likeness is corrected for.

The document after each one comes from a rank over ids: (id, text hash) pairs are range-partitioned, each partition
finds its successors, and one row for each partition closes the gaps. Texts are exchanged once, in partitions of
TASK_BYTES, since fingerprinting costs more than its bytes suggest; only the part of the next text that replaces
something is moved to the document it goes to.

Defined cases: a null or empty text has no shingles and an empty fingerprint, with likeness 1 to another such and 0 to
any other; fewer than five words are one shingle; null ids come first and stay null; rows that repeat both id and
text have one place in the order and one fingerprint, and all of them come back; an empty table gives an empty
result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_CLASS, SPACES, durable, parts, text_or_empty

WIDTH, BINS, LANE, PROBES = 5, 256, 8, 12
TASK_BYTES, REPEATS = 8 << 20, 1000
_LOWEST = -(1 << 63)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once: a lambda variable is never evaluated again, wherever it is used."""
    return F.element_at(F.transform(F.array(value), body), 1)


def shingle_hashes(text: Column, width: int = WIDTH) -> Column:
    bare = F.btrim(text, F.lit(SPACES))
    words = F.when(bare != "", F.split(bare, f"{SPACE_CLASS}+")).otherwise(F.array().cast("array<string>"))

    def over(h: Column) -> Column:
        n = F.size(h)
        full = F.transform(F.sequence(F.lit(0), n - width), lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(width))))
        return F.when(n >= width, full).when(n > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>"))

    return let(F.transform(words, lambda w: F.xxhash64(w)), over)


def _bin(h: Column) -> Column:
    return F.shiftright(h, 56).cast("int") + BINS // 2


def minima(hashes: Column) -> Column:
    """The least hash of each filled bin, in order of bins."""
    first = lambda s: F.filter(s, lambda x, i: ~F.shiftright(x, 56).eqNullSafe(F.shiftright(F.get(s, i - 1), 56)))
    return let(F.sort_array(hashes), first)


def lanes(least: Column) -> Column:
    """All bins' low bits, the empty bins densified; null without any hash."""
    low = lambda x: x.bitwiseAND((1 << LANE) - 1).cast("int")
    gap = lambda n: F.array_repeat(F.lit(None).cast("int"), n)

    def spread(m: Column) -> Column:
        before = lambda x, i: gap(_bin(x) - F.coalesce(_bin(F.get(m, i - 1)), F.lit(-1)) - 1)
        filled = F.flatten(F.transform(m, lambda x, i: F.concat(before(x, i), F.array(low(x)))))
        sparse = F.concat(filled, gap(BINS - 1 - _bin(F.element_at(m, -1))))

        def dense(s: Column) -> Column:
            probe = lambda i, t: F.get(s, F.xxhash64(i, F.lit(t)).bitwiseAND(BINS - 1).cast("int"))
            # After PROBES tries the rest of the bin's order is by hash, which costs as much as there are filled bins.
            rest = lambda i: F.array_min(F.transform(m, lambda x: F.struct(F.xxhash64(i, _bin(x), F.lit(PROBES)).alias("h"), low(x).alias("v"))))["v"]
            return F.transform(s, lambda v, i: F.coalesce(v, *(probe(i, t) for t in range(PROBES)), rest(i)))

        return let(sparse, dense)

    return let(least, lambda m: F.when(F.size(m) > 0, spread(m)))


def packed(text: Column) -> Column:
    """The fingerprint: BINS lanes of LANE bits in longs; null for a text without words."""
    each = 64 // LANE
    pack = lambda d, k: F.aggregate(F.slice(d, k * each + 1, each), F.lit(0).cast("long"), lambda acc, x: F.shiftleft(acc, LANE).bitwiseOR(x.cast("long")))
    return let(lanes(minima(shingle_hashes(text))), lambda d: F.when(d.isNotNull(), F.transform(F.sequence(F.lit(0), F.lit(BINS // each - 1)), lambda k: pack(d, k))))


def printed(fingerprint: Column) -> Column:
    return F.coalesce(F.lower(F.array_join(F.transform(fingerprint, lambda x: F.lpad(F.hex(x), 16, "0")), "")), F.lit(""))


def likeness(a: Column, b: Column) -> Column:
    """The estimated resemblance: the share of equal lanes, less what chance makes equal."""

    def different(z: Column) -> Column:  # folds each lane's bits into its lowest
        for k in (4, 2, 1):
            z = z.bitwiseOR(F.shiftrightunsigned(z, k))
        return F.bit_count(z.bitwiseAND(0x0101010101010101))

    apart = F.aggregate(F.zip_with(a, b, lambda x, y: different(x.bitwiseXOR(y)).cast("int")), F.lit(0), lambda s, x: s + x)
    chance = 1 / (1 << LANE)
    value = F.greatest(F.lit(0.0), (1 - apart / F.lit(float(BINS)) - chance) / (1 - chance))
    return F.when(a.isNull() | b.isNull(), (a.isNull() & b.isNull()).cast("double")).otherwise(value)


def neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows_per_task: int = 1_000_000) -> DataFrame:
    """id, rid (text hash), n, bytes, copies, next_id, next_rid for every distinct (id, text)."""
    text = text_or_empty(text_col)
    keyed = docs.select(_id(id_col), F.xxhash64(text).alias("rid"), F.char_length(text).cast("long").alias("n"), F.octet_length(text).cast("long").alias("bytes"))
    rows = durable(keyed.groupBy("id", "rid", "n", "bytes").agg(F.count("*").alias("copies")), "ids")
    ranged = rows.repartitionByRange(parts(rows.count(), rows_per_task), "id", "rid").withColumn("part", F.spark_partition_id())
    ranged = durable(ranged, "ranges")  # from here on a row's part is a stored value
    firsts = ranged.groupBy("part").agg(F.min(F.struct("id", "rid")).alias("first"))
    # One row for each partition: the first after its end, and round the whole table.
    whole = Window.orderBy("part")
    every = whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = firsts.select("part", F.coalesce(F.lead("first").over(whole), F.first("first").over(every)).alias("after"))
    inside = Window.partitionBy("part").orderBy("id", "rid")
    out = ranged.withColumn("follows", F.lead(F.struct("id", "rid")).over(inside)).join(ends, "part").withColumn("follows", F.coalesce("follows", "after"))
    return out.select("id", "rid", "n", "bytes", "copies", F.col("follows.id").alias("next_id"), F.col("follows.rid").alias("next_rid"))


def _id(column: str) -> Column:
    return F.coalesce(F.col(column).cast("long"), F.lit(_LOWEST)).alias("id")


def edited_prints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", task_bytes: int = TASK_BYTES) -> DataFrame:
    """id, n, edited_sha256, print, edited_print, next_print for every row."""
    order = durable(neighbours(docs, id_col, text_col), "order")
    held = order.agg(F.sum("bytes").alias("bytes"), F.max("copies").alias("copies")).first()
    tasks = max(parts(held["bytes"], task_bytes), 2 * docs.sparkSession.sparkContext.defaultParallelism)
    text = text_or_empty(text_col)
    texts = docs.select(_id(id_col), F.xxhash64(text).alias("rid"), text.alias("text"))
    if (held["copies"] or 0) > 1:
        texts = texts.dropDuplicates(["id", "rid"])
    texts = texts.repartition(tasks, "id", "rid")
    back = order.select(F.col("id").alias("to_id"), F.col("rid").alias("to_rid"), F.col("next_id").alias("id"), F.col("next_rid").alias("rid"), F.floor(F.col("n") / 4).alias("take"))
    heads = texts.join(back, ["id", "rid"]).select(F.col("to_id").alias("id"), F.col("to_rid").alias("rid"), F.expr("substring(text, 1, int(take))").alias("head"))
    both = texts.join(heads, ["id", "rid"]).join(order, ["id", "rid"])
    edited = F.expr("concat(substring(text, 1, int(n - floor(n / 4))), head)")
    made = both.select("id", "rid", "n", "copies", "next_id", "next_rid", "text", edited.alias("edited"))
    made = made.select("id", "rid", "n", "copies", "next_id", "next_rid", packed(F.col("text")).alias("print"), F.sha2("edited", 256).alias("edited_sha256"), packed(F.col("edited")).alias("edited_print"))
    made = durable(made, "prints")
    after = made.select(F.col("id").alias("next_id"), F.col("rid").alias("next_rid"), F.col("print").alias("next_print"))
    out = made.join(after, ["next_id", "next_rid"])
    if (held["copies"] or 0) <= 1:
        return out.drop("copies")
    few = out.filter(F.col("copies") <= REPEATS).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    if held["copies"] <= REPEATS:
        return few.drop("copies", "copy")
    # A row that repeats very often is multiplied in two steps, so that no task makes all of its copies.
    pieces = out.filter(F.col("copies") > REPEATS).withColumn("piece", F.explode(F.sequence(F.lit(0), F.floor((F.col("copies") - 1) / REPEATS))))
    size = F.least(F.lit(REPEATS), F.col("copies") - F.col("piece") * REPEATS)
    many = pieces.repartition("id", "rid", "piece").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), size))).drop("piece")
    return few.unionByName(many).drop("copies", "copy")


def op7_minhash(docs: DataFrame) -> DataFrame:
    """The contract's result."""
    return edited_prints(docs).select(
        F.nullif("id", F.lit(_LOWEST)).alias("doc_id"),
        F.col("n").alias("n_chars"),
        "edited_sha256",
        printed(F.col("print")).alias("fingerprint"),
        printed(F.col("edited_print")).alias("edited_fingerprint"),
        likeness(F.col("print"), F.col("edited_print")).alias("near_edited"),
        likeness(F.col("print"), F.col("next_print")).alias("near_next"),
    )
