"""Line deduplication by keep bitmaps.

Each document's repeated-line keys are hashed to 128 bits, range-partitioned by (hash, document) and sorted with
documents descending, so a key's first document in the stream is the one that keeps its lines. The stream holds
back the rows of the second document at most; from the third on, it knows that the key is common. Rows without an id are
the last document of their key, after which nothing changes, so they are never held. A key so frequent
that it crosses partitions is settled by one small row per partition edge. What comes back is, per document, a
compressed bitmap of the lines that stay; no text passes through the sort.

Defined cases: a null or empty text is one empty line; null ids sort below all others and count as one document;
rows with one id are one document, each with its own bitmap by the hash of its text; an empty table gives an
empty result; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, parts, small_batches, text_or_empty

MIN_CHARS, MIN_DOCS = 20, 3
_LOWEST = -(1 << 63)  # stands for a null id
_KEYS = "key binary, doc long, rid long, pos array<int>"
_FLAGS = "key binary, doc long, rid long, pos array<int>, docs int, settled boolean"


def _keys(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nameless: set[int] = set()  # texts without an id, of which one row speaks for all
        for b in batches:
            keys, docs, rids, pos = [], [], [], []
            for doc, rid, text in zip(*(c.to_pylist() for c in b.columns)):
                if doc == _LOWEST:
                    if rid in nameless:
                        continue
                    nameless.add(rid)
                found: dict[bytes, list[int]] = {}
                for i, line in enumerate(text.encode().lower().split(b"\n")):
                    line = line.strip()
                    if len(line) >= min_chars and (len(line) >= 4 * min_chars or len(line.decode()) >= min_chars):
                        found.setdefault(xxhash.xxh3_128_digest(line), []).append(i)
                keys += found
                pos += found.values()
                docs += [doc] * len(found)
                rids += [rid] * len(found)
            yield pa.record_batch([pa.array(keys, pa.binary()), pa.array(docs, pa.int64()), pa.array(rids, pa.int64()), pa.array(pos, pa.list_(pa.int32()))], names=["key", "doc", "rid", "pos"])

    return run


def _stream(min_docs: int):
    """Over one sorted partition: the rows whose lines go, and those that only the neighbouring partitions can settle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        key, doc, docs, first, held, opening = None, None, 0, None, [], True

        def close(last: bool) -> None:
            # Fewer documents than needed so far: harmless inside a partition, open at its end.
            if last and not opening:
                if docs < min_docs:
                    out.extend(held)
                else:  # tells the next partition that the key is common and which document keeps it
                    out.append((key, first, 0, [], docs, False))

        def batch() -> pa.RecordBatch:
            cols = list(zip(*out)) or [[]] * 6
            kinds = (pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.int32(), pa.bool_())
            out.clear()
            return pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds)], names=["key", "doc", "rid", "pos", "docs", "settled"])

        for b in batches:
            for k, d, r, p in zip(*(c.to_pylist() for c in b.columns)):
                if k != key:
                    if key is not None:
                        close(False)
                        opening = False
                    key, doc, docs, first, held = k, None, 0, d, []
                new = d != doc
                doc, docs = d, docs + new
                if opening:  # may continue from the partition before: left to the edges
                    out.append((k, d, r, p, int(new), False))
                elif docs < min_docs:
                    if d == first:  # keeps its lines; its first row counts it
                        held += [(k, d, r, [], 1, False)] * new
                    elif d != _LOWEST:
                        held.append((k, d, r, p, int(new), False))
                else:
                    out.extend((*x[:4], 0, True) for x in held if x[1] != first)
                    held = []
                    out.append((k, d, r, p, 0, True))
            yield batch()
        if key is not None:
            close(True)
        yield batch()

    return run


def dropped_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, keys_per_task: int = 500_000) -> DataFrame:
    """doc, rid, pos: the positions of the lines that go, sorted, for each row that loses any."""
    spark = df.sparkSession
    small_batches(spark)
    keyed = durable(_rows(df, id_col, text_col).mapInArrow(_keys(min_chars), _KEYS), "line-keys")
    n = parts(keyed.count(), keys_per_task)
    flags = durable(
        keyed.repartitionByRange(max(n, spark.sparkContext.defaultParallelism), "key", F.desc("doc"), "rid").sortWithinPartitions("key", F.desc("doc"), "rid").mapInArrow(_stream(min_docs), _FLAGS),
        "line-flags",
    )
    # At most two keys of each partition are open, so the edges are twice the partitions at most; whether they are small
    # enough to be broadcast is found out when they are there.
    edges = flags.filter(~F.col("settled")).groupBy("key").agg(F.max("doc").alias("keeper"), F.sum("docs").alias("n")).filter(F.col("n") >= min_docs)
    late = flags.filter(~F.col("settled")).join(edges, "key").filter(F.col("doc") != F.col("keeper"))
    gone = flags.filter("settled").select("doc", "rid", "pos").unionByName(late.select("doc", "rid", "pos"))
    return gone.groupBy("doc", "rid").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("pos")))).alias("pos"))


def _rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = text_or_empty(text_col)
    return df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_LOWEST)).alias("doc"), F.xxhash64(text).alias("rid"), text.alias("text"))


def pack(keep: np.ndarray) -> bytes:
    return zlib.compress(np.packbits(keep).tobytes(), 1)


def unpack(bitmap: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), count=n).astype(bool)


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        maps = []
        for n, pos in zip(b["n_lines"].to_pylist(), b["pos"].to_pylist()):
            keep = np.ones(n, bool)
            keep[pos or []] = False
            maps.append(pack(keep))
        yield pa.record_batch([b["doc"], b["rid"], b["n_lines"], pa.array([len(p or ()) for p in b["pos"].to_pylist()], pa.int64()), pa.array(maps, pa.binary())], names=["doc", "rid", "n_lines", "n_dropped", "keep"])


def keep_bitmaps(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc, rid (the text's hash), n_lines, n_dropped, keep (zlib of the packed bits, first line first), for every distinct row."""
    lines = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"))) + 1
    every = _rows(df, id_col, text_col).select("doc", "rid", lines.cast("long").alias("n_lines")).dropDuplicates(["doc", "rid"])
    return every.join(dropped_lines(df, id_col, text_col, **options), ["doc", "rid"], "left").mapInArrow(_bitmaps, "doc long, rid long, n_lines long, n_dropped long, keep binary")


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        kept = []
        for text, n, gone, keep in zip(*(b[c].to_pylist() for c in ("text", "n_lines", "n_dropped", "keep"))):
            kept.append("\n".join(x for x, k in zip(text.split("\n"), unpack(keep, n)) if k) if gone else text)
        yield pa.record_batch([b["doc"], b["n_lines"], b["n_dropped"], pa.array(kept, pa.string())], names=["doc", "n_lines", "n_dropped", "text"])


def apply_bitmaps(df: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_lines, n_dropped and the text that stays."""
    rows = _rows(df, id_col, text_col).join(bitmaps, ["doc", "rid"])
    return rows.mapInArrow(_apply, "doc long, n_lines long, n_dropped long, text string").select(F.nullif("doc", F.lit(_LOWEST)).alias(id_col), "n_lines", "n_dropped", "text")


def op1_line_dedup(docs: DataFrame) -> DataFrame:
    """The contract's result, with the kept text as its digest."""
    out = apply_bitmaps(docs, keep_bitmaps(docs))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def brute_force(rows: list[tuple[int, str | None]]) -> dict[int, tuple[int, int, str]]:
    """For tests: the same result for distinct ids, by a dictionary."""
    holders: dict[bytes, set[int]] = {}
    lines = {d: [(x, x.encode().lower().strip()) for x in (t or "").split("\n")] for d, t in rows}
    for d, xs in lines.items():
        for _, k in xs:
            holders.setdefault(k, set()).add(d)
    out = {}
    for d, xs in lines.items():
        kept = [x for x, k in xs if len(k.decode()) < MIN_CHARS or len(holders[k]) < MIN_DOCS or max(holders[k]) == d]
        out[d] = (len(xs), len(xs) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


ORACLE = r"""
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS xs FROM documents),
lines AS (SELECT doc_id, unnest(xs) AS line, unnest(range(len(xs))) AS pos FROM split),
keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
common AS (SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
judged AS (SELECT k.*, c.key IS NULL OR c.keeper = k.doc_id AS stays FROM keyed k LEFT JOIN common c ON k.key = c.key)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE NOT stays) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE stays), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
