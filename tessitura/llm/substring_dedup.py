"""Substring deduplication by difference-cover anchors.

Two equal windows of WIDTH words, wherever they start, have at one offset below PERIOD both a position that lies in
COVER modulo PERIOD, since every difference modulo PERIOD is one of two members of COVER. So it is enough to hash
anchors of WIDTH - PERIOD + 1 words at the cover's positions (three of seven): any repeated window holds an anchor
aligned with its copy's. Anchors that lie in one document only are dropped; around the others, match candidates
extend to whole windows, whose hashes decide, with the smallest id that has each.

Documents are dealt to groups of about GROUP_BYTES by a hash of their id (without one, by their place in the input), and what is exchanged are arrays of
hashes for each group and hash bucket, each hash once for a group: a passage that a third of all documents share
costs no more than one that a group holds. Three passes over a group's texts (anchors, candidates, removal)
share one exchange of the texts. Anchors only filter and travel as 32 bits within their bucket; windows are told
apart by 64 bits of one hash and their bucket by another, independent one.

Defined cases: a null text has no words; null ids sort below all others and are one document; rows with one id are
one document and are not set against each other; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parts, small_batches, text_or_empty

WIDTH, PERIOD, COVER = 13, 7, (0, 1, 3)
ANCHOR = WIDTH - PERIOD + 1
GROUP_BYTES, BUCKET_GROUPS = 8 << 20, 4  # a bucket holds the hashes of as much text as so many groups
_LOWEST = -(1 << 63)
_NOTES = "g long, bucket long, keys binary, ids binary, kind int"


def covers(cover: tuple[int, ...], period: int) -> bool:
    return {(a - b) % period for a in cover for b in cover} == set(range(period))


assert covers(COVER, PERIOD)
_AT_COVER = np.isin(np.arange(PERIOD), COVER)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


class Group:
    """The words of some documents as one array of hashes; windows are named by their first word's index in it."""

    def __init__(self, ids: np.ndarray, texts: list[bytes]):
        self.ids, self.texts = ids, texts
        hashes = []
        for t in texts:
            words = t.split()
            hashes.append(np.fromiter(map(xxhash.xxh64_intdigest, words, repeat(7)), np.uint64, len(words)))
        self.counts = np.array([len(h) for h in hashes], np.int64)
        self.starts = np.cumsum(self.counts) - self.counts
        self.words = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        self.doc = np.repeat(np.arange(len(texts)), self.counts)
        self.at = np.arange(len(self.words)) - np.repeat(self.starts, self.counts)
        self.left = np.repeat(self.counts, self.counts) - self.at  # words from here to the document's end

    def hash(self, begin: np.ndarray, width: int, factor: int) -> np.ndarray:
        out = np.zeros(len(begin), np.uint64)
        for k in range(width):
            out = out * np.uint64(factor) + self.words[begin + k]
        return _mixed(out)

    def anchors(self, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """Where anchors begin, and each one's code: its bucket above 32 bits of its hash."""
        begin = np.flatnonzero((self.left >= ANCHOR) & _AT_COVER[self.at % PERIOD] & (self.at + self.left >= WIDTH))
        h = self.hash(begin, ANCHOR, 0x9E3779B97F4A7C15)
        return begin, ((h >> np.uint64(32)) % np.uint64(buckets) << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF))

    def candidates(self, buckets: int, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows around shared anchors: where they begin, their hashes and buckets."""
        begin, code = self.anchors(buckets)
        begin = begin[np.isin(code, shared)]
        marked = np.zeros(len(self.words), bool)
        for k in range(PERIOD):
            marked[begin[self.at[begin] >= k] - k] = True
        begin = np.flatnonzero(marked & (self.left >= WIDTH))
        return begin, self.hash(begin, WIDTH, 0xC2B2AE3D27D4EB4F), self.hash(begin, WIDTH, 0x165667B19E3779F9) % np.uint64(buckets)


def _group(t: pa.Table) -> Group:
    return Group(t["id"].to_numpy(), pc.cast(t["text"], pa.binary()).to_pylist())


def _rows(rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows)) or [[]] * 5
    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int32())
    return pa.table([pa.array(c, k) for c, k in zip(cols, kinds)], names=["g", "bucket", "keys", "ids", "kind"])


def _by(bucket: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """For each bucket, the indices of its members, in their order."""
    order = np.argsort(bucket, kind="stable")
    edges = np.flatnonzero(np.diff(bucket[order])) + 1
    return [(int(bucket[x[0]]), x) for x in np.split(order, edges) if len(x)]


def _least(hashes: np.ndarray, buckets: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For distinct (bucket, hash): an index of its least id, and for every member the number of its pair."""
    order = np.lexsort((ids, hashes, buckets))
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(hashes[order]) != 0) | (np.diff(buckets[order]) != 0)
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    return order[new], number


def _emit_anchors(buckets: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        g = _group(table)
        begin, code = g.anchors(buckets)
        ids = g.ids[g.doc[begin]]
        order = np.lexsort((ids, code))
        code, ids = code[order], ids[order]
        new = np.ones(len(code), bool)
        new[1:] = np.diff(code) != 0
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(code))[: len(first)] - 1
        code, several = code[first], ids[first] != ids[last]
        bucket = (code >> np.uint64(32)).astype(np.int64)
        keys = code.astype(np.uint32)
        return _rows([(key[0].as_py(), b, keys[x].tobytes(), np.packbits(several[x]).tobytes(), 0) for b, x in _by(bucket)])

    return run


def _shared(key: tuple, table: pa.Table) -> pa.Table:
    """Of one bucket: to each group its anchors that another document has too."""
    keys = [np.frombuffer(x, np.uint32) for x in table["keys"].to_pylist()]
    several = [np.unpackbits(np.frombuffer(x, np.uint8), count=len(k)).astype(bool) for x, k in zip(table["ids"].to_pylist(), keys)]
    found, number, counts = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
    common = counts > 1
    common[number[np.concatenate(several)]] = True
    kept = np.split(common[number], np.cumsum([len(k) for k in keys])[:-1])
    return _rows([(g, key[0].as_py(), k[x].tobytes(), b"", 0) for g, k, x in zip(table["g"].to_pylist(), keys, kept) if x.any()])


def _codes(notes: pa.Table) -> np.ndarray:
    out = [np.empty(0, np.uint64)]
    for b, k, kind in zip(notes["bucket"].to_pylist(), notes["keys"].to_pylist(), notes["kind"].to_pylist()):
        if kind == 0:
            out.append(np.frombuffer(k, np.uint32).astype(np.uint64) | np.uint64(b << 32))
    return np.concatenate(out)


def _emit_windows(buckets: int):
    def run(key: tuple, table: pa.Table, notes: pa.Table) -> pa.Table:
        if not table.num_rows or not notes.num_rows:
            return _rows([])
        g = _group(table)
        begin, h, bucket = g.candidates(buckets, _codes(notes))
        ids = g.ids[g.doc[begin]]
        first, _ = _least(h, bucket, ids)
        first.sort()  # in order of position, ids come in runs that compress
        h, bucket, ids = h[first], bucket[first], ids[first]
        return _rows([(key[0].as_py(), b, h[x].tobytes(), ids[x].tobytes(), 1) for b, x in _by(bucket.astype(np.int64))])

    return run


def _smallest(key: tuple, table: pa.Table) -> pa.Table:
    """Of one bucket: to each group the windows for which another group has a smaller id, with that id."""
    hashes = [np.frombuffer(x, np.uint64) for x in table["keys"].to_pylist()]
    ids = [np.frombuffer(x, np.int64) for x in table["ids"].to_pylist()]
    h, i = np.concatenate(hashes), np.concatenate(ids)
    first, number = _least(h, np.zeros(len(h), np.uint8), i)
    least = i[first][number]
    out, at = [], 0
    for g, mine in zip(table["g"].to_pylist(), hashes):
        x = slice(at, at := at + len(mine))
        lower = least[x] < i[x]
        if lower.any():
            out.append((g, key[0].as_py(), mine[lower].tobytes(), least[x][lower].tobytes(), 1))
    return _rows(out)


def _remove(buckets: int):
    def run(key: tuple, table: pa.Table, notes: pa.Table) -> pa.Table:
        g = _group(table)
        gone = np.zeros(len(g.words), bool)
        if notes.num_rows:
            begin, h, bucket = g.candidates(buckets, _codes(notes))
            ids = g.ids[g.doc[begin]]
            theirs = [(b, np.frombuffer(k, np.uint64), np.frombuffer(i, np.int64)) for b, k, i, kind in zip(*(notes[c].to_pylist() for c in ("bucket", "keys", "ids", "kind"))) if kind == 1]
            every_h = np.concatenate([h, *(x[1] for x in theirs)])
            every_b = np.concatenate([bucket, *(np.full(len(x[1]), x[0], np.uint64) for x in theirs)])
            every_i = np.concatenate([ids, *(x[2] for x in theirs)])
            first, number = _least(every_h, every_b, every_i)
            covered = begin[every_i[first][number[: len(begin)]] < ids]
            edge = np.zeros(len(gone) + 1, np.int64)
            np.add.at(edge, covered, 1)
            np.add.at(edge, covered + WIDTH, -1)
            gone = np.cumsum(edge[:-1]) > 0
        kept, removed = [], []
        for t, a, n in zip(g.texts, g.starts.tolist(), g.counts.tolist()):
            out = gone[a : a + n]
            removed.append(int(out.sum()))
            words = t.split()
            kept.append(b" ".join(words if not removed[-1] else [words[i] for i in np.flatnonzero(~out).tolist()]))
        text = pc.cast(pa.array(kept, pa.binary()), pa.string())
        return pa.table([pa.array(g.ids), pa.array(g.counts), pa.array(removed, pa.int64()), text], names=["id", "n_words", "n_removed", "text"])

    return run


def without_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", group_bytes: int = GROUP_BYTES) -> DataFrame:
    """id, n_words, n_removed and the text that stays, its words joined by one space, for every row."""
    spark = df.sparkSession
    small_batches(spark)
    text = text_or_empty(text_col)
    total = df.select(F.sum(F.octet_length(text))).first()[0]
    n = max(parts(total, group_bytes), 2 * spark.sparkContext.defaultParallelism)
    m = max(parts(total, BUCKET_GROUPS * group_bytes), spark.sparkContext.defaultParallelism)
    # Rows without an id are one document, but needn't be in one group: only ids are compared.
    place = F.when(F.col(id_col).isNull(), F.monotonically_increasing_id())
    ids = F.coalesce(F.col(id_col).cast("long"), F.lit(_LOWEST))
    texts = df.select(ids.alias("id"), text.alias("text"), F.pmod(F.xxhash64(ids, place), F.lit(n)).alias("g")).repartition(n, "g")
    anchors = texts.groupBy("g").applyInArrow(_emit_anchors(m), _NOTES)
    shared = anchors.repartition(m, "bucket").groupBy("bucket").applyInArrow(_shared, _NOTES)
    windows = texts.groupBy("g").cogroup(shared.repartition(n, "g").groupBy("g")).applyInArrow(_emit_windows(m), _NOTES)
    smallest = windows.repartition(m, "bucket").groupBy("bucket").applyInArrow(_smallest, _NOTES)
    notes = shared.unionByName(smallest).repartition(n, "g")
    return texts.groupBy("g").cogroup(notes.groupBy("g")).applyInArrow(_remove(m), "id long, n_words long, n_removed long, text string")


def op6_substring_dedup(docs: DataFrame) -> DataFrame:
    """The contract's result, with the kept text as its digest."""
    return without_repeats(docs).select(F.nullif("id", F.lit(_LOWEST)).alias("doc_id"), "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


ORACLE = r"""
WITH split AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
starts AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS p FROM split WHERE len(ws) >= 13),
windows AS (SELECT doc_id, p, md5(array_to_string(ws[p:p + 12], ' ')) AS h FROM starts),
least AS (SELECT h, min(doc_id) AS d FROM windows GROUP BY h HAVING count(DISTINCT doc_id) > 1),
covered AS (SELECT DISTINCT w.doc_id, unnest(range(w.p, w.p + 13)) AS i FROM windows w JOIN least l ON w.h = l.h WHERE l.d < w.doc_id),
words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM split),
judged AS (SELECT w.doc_id, w.word, w.i, c.i IS NOT NULL AS gone FROM words w LEFT JOIN covered c ON w.doc_id = c.doc_id AND w.i = c.i),
kept AS (
  SELECT doc_id, count(*) AS n_words, count(*) FILTER (WHERE gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone), '') AS kept
  FROM judged GROUP BY doc_id)
SELECT s.doc_id, coalesce(k.n_words, 0) AS n_words, coalesce(k.n_removed, 0) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM split s LEFT JOIN kept k ON s.doc_id = k.doc_id
"""
