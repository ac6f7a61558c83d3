"""SimHash near-duplicates by a binary trie self-join.

All distinct fingerprints form one binary trie, joined with itself from the root down: a node pair (two nodes of one
depth, or a node with itself) is followed into its child pairs, each pair of different bits is taken from the error
budget of two bits, and a pair is pruned when the budget is exceeded or a side is empty. A subtree of a single
fingerprint is a leaf; two leaves are compared in the bits left against the budget left.

The upper levels are traversed by DataFrame operations: at a depth that gives about NODE_ROWS fingerprints a node, each
fingerprint goes to the pairs that its node forms with the nodes whose prefix differs from its own in two bits at most.
A pair of more than PAIR_ROWS rows, or of many more than the others, is followed STEP levels further down, again
and again, which ends since fingerprints are distinct: at depth 48 a pair holds 2 x 2**16 at most. Each task then
traverses whole node pairs, many at a time and level by level, and hands on their links as stars, so that links
never grow with the square of a group.

Defined cases: a null or empty text has the fingerprint zero, linked like any other; null ids sort below all others;
equal or null ids link nothing, so where components share their smallest id, its value doesn't tell them apart; repeated rows come back as often as they went in; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, fresh, parts, small_batches, text_or_empty
from .components import components

SHINGLE, SEED, BUDGET = 3, 42, 2
NODE_ROWS, PAIR_ROWS, STEP, DEEPEST = 1 << 16, 1 << 18, 8, 48
FRONTIER = 1 << 15  # node pairs that are followed at once
_LOWEST = -(1 << 63)
_BITS = np.left_shift(np.uint64(1), np.arange(63, -1, -1, dtype=np.uint64))


def fingerprint(text: bytes, width: int = SHINGLE) -> int:
    """The 64-bit SimHash of one text, as a signed number."""
    words = text.lower().split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)))) if len(words) >= width else [b" ".join(words)]
    h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.dtype(">u8"))
    set_in = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        set_in += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(_BITS[set_in * 2 > len(h)].sum(dtype=np.uint64).astype(np.int64))


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        prints = [fingerprint(t) for t in pc.cast(b["text"], pa.binary()).to_pylist()]
        yield pa.record_batch([b["id"], b["rid"], pa.array(prints, pa.int64())], names=["id", "rid", "print"])


class Trie:
    """The trie below sorted runs of numbers; a node is a range of `values` whose members agree in all bits above."""

    def __init__(self, values: np.ndarray):
        self.values, self.followed = values, 0  # node pairs followed, leaf pairs included
        self._ones: dict[int, np.ndarray] = {}

    def ones(self, bit: int) -> np.ndarray:
        """How many values before each index have this bit set."""
        if bit not in self._ones:
            out = np.zeros(len(self.values) + 1, np.int32)
            np.cumsum((self.values >> np.uint64(bit)) & np.uint64(1), out=out[1:], dtype=np.int32)
            self._ones[bit] = out
        return self._ones[bit]

    def links(self, pairs: np.ndarray, bit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Index pairs within the budget, from node pairs: rows (begin, end, begin, end, budget); `bit` is their next."""
        stack = [(pairs, bit)]
        while stack:
            pairs, bit = stack.pop()
            if pairs.shape[1] > FRONTIER:
                stack += [(pairs[:, at : at + FRONTIER], bit) for at in range(0, pairs.shape[1], FRONTIER)]
                continue
            a, b, c, d, budget = pairs
            self.followed += len(a)
            leaves = (b - a == 1) & (d - c == 1)
            if leaves.any():
                i, j = a[leaves], c[leaves]
                left = np.uint64((1 << (bit + 1)) - 1)
                near = np.bitwise_count((self.values[i] ^ self.values[j]) & left) <= budget[leaves]
                yield i[near], j[near]
                pairs = pairs[:, ~leaves]
                a, b, c, d, budget = pairs
            if not len(a):
                continue
            ones = self.ones(bit)
            m, k = b - (ones[b] - ones[a]), d - (ones[d] - ones[c])  # where the ones begin
            spend, cross = budget > 0, a != c
            both = spend & cross
            children = np.concatenate(
                [
                    np.stack([a, m, c, k, budget]),
                    np.stack([m, b, k, d, budget]),
                    np.stack([a, m, k, d, budget - 1])[:, spend],
                    np.stack([m, b, c, k, budget - 1])[:, both],
                ],
                axis=1,
            )
            a, b, c, d, _ = children
            alive = (a < b) & (c < d) & ((a != c) | (b - a > 1))
            if alive.any():
                stack.append((children[:, alive], bit - 1))


def _forest(left: np.ndarray, right: np.ndarray, n: int) -> np.ndarray:
    """The least index of each one's component."""
    at = np.arange(n)
    while True:
        old = at.copy()
        np.minimum.at(at, left, at[right])
        np.minimum.at(at, right, at[left])
        at = at[at]
        if np.array_equal(at, old):
            return at


def stars(found: Iterator[tuple[np.ndarray, np.ndarray]], n: int, limit: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """The links among n indices as one star for each component; never more than about `limit` links are held."""
    left, right, held = [], [], 0

    def shrink() -> None:
        root = _forest(np.concatenate(left), np.concatenate(right), n)
        moved = np.flatnonzero(root != np.arange(n))
        left[:], right[:] = [moved], [root[moved]]

    for i, j in found:
        left.append(i)
        right.append(j)
        if (held := held + len(i)) > limit:
            shrink()
            held = 0
    if left:
        shrink()
    return (left[0], right[0]) if left else (np.empty(0, np.int64), np.empty(0, np.int64))


_PAIR = ("depth", "mask", "low", "print")


def joined(rows: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, int]:
    """The links (u, v) of whole node pairs, rows sorted by _PAIR, and how many node pairs were followed."""
    n = len(rows["print"])
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64), 0
    # With the sign bit turned, the order of signed numbers is that of unsigned ones; distances stay.
    values = rows["print"].astype(np.uint64) ^ np.uint64(1 << 63)
    new = np.ones(n, bool)
    new[1:] = np.logical_or.reduce([rows[c][1:] != rows[c][:-1] for c in _PAIR[:3]])
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], n)
    depth, mask = rows["depth"][begin], rows["mask"][begin]
    lower = (values >> (np.uint64(64) - rows["depth"].astype(np.uint64))).astype(np.int64) == rows["low"]
    cut = begin + np.add.reduceat(lower.astype(np.int64), begin)
    own = mask == 0
    pairs = np.stack([begin, np.where(own, end, cut), np.where(own, begin, cut), end, BUDGET - np.bitwise_count(mask.astype(np.uint64)).astype(np.int64)]).astype(np.int32)
    a, b, c, d, _ = pairs
    alive = (a < b) & (c < d) & ((a != c) | (b - a > 1))
    trie = Trie(values)

    def found() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for at in np.unique(depth[alive]).tolist():
            yield from trie.links(pairs[:, alive & (depth == at)], 63 - at)

    u, v = stars(found(), n)
    return rows["print"][u], rows["print"][v], trie.followed


def _join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by _PAIR: the links of the node pairs, a pair at least and about NODE_ROWS rows at a time."""
    held: list[dict[str, np.ndarray]] = []

    def run(rows: dict[str, np.ndarray]) -> pa.RecordBatch:
        u, v, _ = joined(rows)
        return pa.record_batch([pa.array(u), pa.array(v)], names=["u", "v"])

    for b in batches:
        if not b.num_rows:
            continue
        held.append({c: b[c].to_numpy(zero_copy_only=False) for c in _PAIR})
        if sum(len(x["print"]) for x in held) >= NODE_ROWS:
            rows = {c: np.concatenate([x[c] for x in held]) for c in _PAIR}
            same = np.logical_and.reduce([rows[c] == rows[c][-1] for c in _PAIR[:3]])
            cut = int(np.argmax(same))  # rows are sorted, so the open pair is the tail
            held = [{c: x[cut:] for c, x in rows.items()}]
            if cut:
                yield run({c: x[:cut] for c, x in rows.items()})
    if held:
        yield run({c: np.concatenate([x[c] for x in held]) for c in _PAIR})


def masks(bits: int, budget: int = BUDGET) -> list[int]:
    """The numbers of so many bits with `budget` bits set at most."""
    return [sum(1 << i for i in chosen) for k in range(budget + 1) for chosen in combinations(range(bits), k)]


def _prefix(depth: int) -> Column:
    return F.shiftrightunsigned(F.col("print").bitwiseXOR(F.lit(_LOWEST)), 64 - depth)


def _pairs(prints: DataFrame, depth: int, bits: int) -> DataFrame:
    """Each print of each node pair (their bits above the last `bits` differ in `mask`) in the child pairs `bits` further down, which are at `depth`."""
    further = F.explode(F.array(*(F.lit(m).cast("long") for m in masks(bits))))
    out = prints.withColumn("further", further).withColumn("mask", F.shiftleft("mask", bits).bitwiseOR(F.col("further"))).filter(F.bit_count("mask") <= BUDGET)
    prefix = _prefix(depth)
    return out.select(F.lit(depth).alias("depth"), "mask", F.least(prefix, prefix.bitwiseXOR(F.col("mask"))).alias("low"), "print")


def links(prints: DataFrame, node_rows: int = NODE_ROWS, pair_rows: int = PAIR_ROWS, rows_per_task: int = 1_000_000) -> DataFrame:
    """From distinct prints: edges (u, v) between prints that connect all within the budget."""
    tasks, n = prints.sparkSession.sparkContext.defaultParallelism, prints.count()
    depth = max(1, (max(parts(n, node_rows), 2 * tasks) - 1).bit_length())
    level = _pairs(prints.select("print", F.lit(0).cast("long").alias("mask")), depth, depth)
    # Four times an even share, but not so few that more levels cost more than they spare.
    even, keys, done = max(4 * parts(2 * n, 1 << depth), min(pair_rows, 2048)), ["mask", "low"], []
    spread = max(parts(n * len(masks(depth)), rows_per_task), tasks)
    while True:
        lower = F.count_if(_prefix(depth) == F.col("low"))
        sizes = level.groupBy(*keys).agg(F.count("*").alias("n"), lower.alias("a"))
        sizes = sizes.filter(F.when(F.col("mask") == 0, F.col("n") > 1).otherwise((F.col("a") > 0) & (F.col("a") < F.col("n"))))
        if done:  # below hot nodes most pairs have an empty side
            sizes = durable(sizes, "pair-sizes")
            level = level.join(sizes.select(*keys), keys, "left_semi")
        hot = durable(sizes.filter(F.col("n") > min(pair_rows, even)).select(*keys), "hot-pairs")
        if depth >= DEEPEST or hot.isEmpty():
            done.append(level)
            break
        done.append(level.join(hot, keys, "left_anti"))
        bits = min(STEP, DEEPEST - depth)
        depth += bits
        # The child's mask keeps the differences spent above, of which only their number counts.
        level = durable(_pairs(level.join(hot, keys, "left_semi").select("print", "mask"), depth, bits), "deeper-pairs")
    every = functools.reduce(DataFrame.unionByName, done)
    return every.repartition(spread, "depth", *keys).sortWithinPartitions(*_PAIR).mapInArrow(_join, "u long, v long")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, rid (the text's hash), print, root (the component's smallest print), component (its smallest id) for every row."""
    small_batches(docs.sparkSession)
    text = text_or_empty(text_col)
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_LOWEST)).alias("id"), F.xxhash64(text).alias("rid"), text.alias("text"))
    rows = durable(rows.mapInArrow(_fingerprints, "id long, rid long, print long"), "prints")
    # A fingerprint is its own node, since ids may be null or repeat.
    prints = durable(rows.groupBy("print").agg(F.min("id").alias("least")), "distinct-prints")
    found = components(links(prints.select("print")))
    rooted = durable(prints.join(found, prints["print"] == found["node"], "left").select("print", "least", F.coalesce("root", "print").alias("root")), "roots")
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component")), "root").select("print", "root", "component")
    return rows.join(named, "print").select("id", "rid", "print", "root", "component")


def op9_simhash(docs: DataFrame) -> DataFrame:
    """The contract's result."""
    out = classes(docs)
    null = lambda c: F.nullif(c, F.lit(_LOWEST))
    return out.select(null("id").alias("doc_id"), F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), null("component").alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each group (the one with the smallest id), with all its columns."""
    first = classes(docs).filter("id = component").groupBy("root").agg(F.min(F.struct("id", "rid")).alias("r"))
    first = first.select(F.nullif("r.id", F.lit(_LOWEST)).alias("id"), F.col("r.rid").alias("rid"))
    own = fresh(docs, "own_rid")
    marked = docs.withColumn(own, F.xxhash64(text_or_empty("text")))
    same = marked["doc_id"].eqNullSafe(first["id"]) & (marked[own] == first["rid"])
    return marked.join(first, same, "left_semi").dropDuplicates(["doc_id", own]).drop(own)
