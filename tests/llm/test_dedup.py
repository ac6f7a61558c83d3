"""Line, exact, substring and SimHash deduplication against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from words import prose
from pyspark.sql import functions as F
from tessitura.llm import exact_dedup, line_dedup, simhash, substring_dedup
from tessitura.llm.components import components

SPACES = re.compile("[ \t-\r]+")


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def rows_of(df):
    return {r["doc_id"]: r for r in df.collect()}


@pytest.mark.parametrize("op", [line_dedup.op1_line_dedup, exact_dedup.op5_exact_dedup, substring_dedup.op6_substring_dedup, simhash.op9_simhash])
def test_empty_tables(op, none):
    assert op(none).collect() == []


def test_lines(spark, docs_of):
    rng = random.Random(1)
    lines = [prose(rng, 6) for _ in range(40)] + ["  Common Footer Line of All \x0b", "short"]
    rows = [(i, "\n".join(rng.choice(lines).upper() if rng.random() < 0.2 else rng.choice(lines) for _ in range(rng.randrange(0, 9))), "s") for i in range(120)]
    want = line_dedup.brute_force([(i, t) for i, t, _ in rows])
    for per_task in (500_000, 25):  # the second cuts keys between many partitions
        bitmaps = line_dedup.keep_bitmaps(docs_of(rows), keys_per_task=per_task)
        got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], sha(r["text"])) for r in line_dedup.apply_bitmaps(docs_of(rows), bitmaps).collect()}
        assert got == want


def test_a_line_in_every_document(spark, docs_of):
    rows = [(i, f"the same long line in all documents\nown line number {i} of its document", "s") for i in range(400)]
    bitmaps = line_dedup.keep_bitmaps(docs_of(rows), keys_per_task=20).collect()
    assert sorted(r["n_dropped"] for r in bitmaps) == [0] + [1] * 399
    assert next(r["doc"] for r in bitmaps if r["n_dropped"] == 0) == 399


def test_bitmaps_round_trip():
    keep = np.random.default_rng(0).random(1003) < 0.5
    assert (line_dedup.unpack(line_dedup.pack(keep), 1003) == keep).all()


def test_lines_of_odd_rows(odd):
    out = line_dedup.op1_line_dedup(odd[0])
    got = {}
    for r in out.collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert len(got) == 11 and sum(map(len, got.values())) == 12  # the repeated row twice
    assert (got[3][0]["n_lines"], got[3][0]["kept_sha256"]) == (1, sha("")) and got[5][0]["n_lines"] == 2
    # the line stands in documents 1, 2, 10 and the one without an id; 10 keeps it
    assert got[1][0]["n_dropped"] == got[2][0]["n_dropped"] == got[None][0]["n_dropped"] == 1 and got[10][0]["n_dropped"] == 0


def test_exact(odd):
    got = {}
    for r in exact_dedup.op5_exact_dedup(odd[0]).collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert (got[1][0]["keep_id"], got[1][0]["kept"], got[1][0]["group_size"]) == (None, False, 3)
    assert got[None][0]["kept"] and not got[2][0]["kept"]
    assert got[3][0]["kept"] and not got[4][0]["kept"] and got[4][0]["keep_id"] == 3
    assert got[5][0]["text_sha256"] == sha(" ") and got[5][0]["group_size"] == 1
    assert sorted(r["kept"] for r in got[8]) == [False, True]
    kept = exact_dedup.keep_first(odd[0])
    assert kept.columns == odd[0].columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 3, 5, 6, 7, 8, 9, 10]


def test_index_persists_and_reruns_append_nothing(spark, docs_of, tmp_path):
    first, later = docs_of([(1, "a b", "s"), (2, "c", "s")]), docs_of([(9, "a  b", "s"), (8, "d", "s")])
    index = exact_dedup.DigestIndex(spark, str(tmp_path / "index"), 4)
    index.add(first).collect()
    assert {r["id"]: r["keep_id"] for r in index.add(later).collect()} == {9: 1, 8: 8}
    spark.sql(f"DROP TABLE {index.table}")  # the files stay: another session opens them
    again = exact_dedup.DigestIndex(spark, str(tmp_path / "index"), 4)
    assert again.read().count() == 3
    again.add(later).collect()
    assert again.read().count() == 3
    plan = again.read().select("digest").join(again.read().select("digest").hint("merge"), "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def brute_substring(rows):
    texts = {i: re.findall("[^ \t-\r]+", t or "") for i, t, _ in rows}
    first = {}
    for i, ws in texts.items():
        for p in range(len(ws) - 12):
            w = tuple(ws[p : p + 13])
            first[w] = min(first.get(w, i), i)
    out = {}
    for i, ws in texts.items():
        gone = set()
        for p in range(len(ws) - 12):
            if first[tuple(ws[p : p + 13])] < i:
                gone.update(range(p, p + 13))
        out[i] = (len(ws), len(gone), sha(" ".join(w for k, w in enumerate(ws) if k not in gone)))
    return out


@pytest.mark.parametrize("group_bytes", [8 << 20, 3000])
def test_substrings(docs_of, group_bytes):
    rng = random.Random(2)
    passages = [prose(rng, n) for n in (12, 13, 14, 30, 60)]
    rows = []
    for i in range(150):
        parts = [rng.choice(passages) if rng.random() < 0.5 else prose(rng, rng.randrange(1, 25)) for _ in range(rng.randrange(0, 5))]
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(parts), "s"))
    out = substring_dedup.without_repeats(docs_of(rows), group_bytes=group_bytes)
    assert {r["id"]: (r["n_words"], r["n_removed"], sha(r["text"])) for r in out.collect()} == brute_substring(rows)


def test_substrings_of_odd_rows(odd):
    got = {}
    for r in substring_dedup.op6_substring_dedup(odd[0]).collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert got[3][0]["n_words"] == 0 and got[6][0]["n_removed"] == 0 and got[7][0]["n_removed"] == 80_000 and len(got[8]) == 2
    assert got[7][0]["kept_sha256"] == sha("more")


def half_without_ids(rng, make):
    """A third of the rows have no id, and some of these repeat."""
    rows = [(None if i % 3 == 0 else i, make(rng), "s") for i in range(120)]
    return rows + rows[:9:3] * 3


def test_substrings_without_ids(docs_of):
    """Rows without an id are one document, the first, wherever they are dealt to."""
    rng = random.Random(12)
    passages = [prose(rng, n) for n in (13, 20, 40)]
    rows = half_without_ids(rng, lambda r: " ".join(r.choice(passages) if r.random() < 0.5 else prose(r, 12) for _ in range(r.randrange(1, 4))))
    first, low = {}, -1
    for i, t, _ in rows:
        ws, i = t.split(), low if i is None else i
        for p in range(len(ws) - 12):
            first[tuple(ws[p : p + 13])] = min(first.get(tuple(ws[p : p + 13]), i), i)
    want = []
    for i, t, _ in rows:
        ws, gone = t.split(), set()
        for p in range(len(ws) - 12):
            if first[tuple(ws[p : p + 13])] < (low if i is None else i):
                gone.update(range(p, p + 13))
        want.append((i or 0, len(ws), len(gone), " ".join(w for k, w in enumerate(ws) if k not in gone)))
    out = substring_dedup.without_repeats(docs_of(rows), group_bytes=2000).collect()
    assert sorted((max(r["id"], 0), r["n_words"], r["n_removed"], r["text"]) for r in out) == sorted(want)


@pytest.mark.parametrize("per_task", [500_000, 15])
def test_lines_without_ids(docs_of, per_task):
    rng = random.Random(13)
    lines = [f"line number {i} that is long enough to count" for i in range(25)]
    rows = half_without_ids(rng, lambda r: "\n".join(r.choice(lines) for _ in range(r.randrange(0, 6))))
    holders = {}
    for i, t, _ in rows:
        for x in t.split("\n"):
            holders.setdefault(x, set()).add(-1 if i is None else i)
    gone = lambda x, i: len(x) >= 20 and len(holders[x]) >= 3 and max(holders[x]) != i
    want = [(i or 0, len(xs), [x for x in xs if not gone(x, -1 if i is None else i)]) for i, t, _ in rows for xs in [t.split("\n")]]
    docs = docs_of(rows)
    out = line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs, keys_per_task=per_task)).collect()
    assert sorted((r["doc_id"] or 0, r["n_lines"], r["n_dropped"], r["text"]) for r in out) == sorted((i, n, n - len(k), "\n".join(k)) for i, n, k in want)


def test_the_index_grows_by_generations(spark, docs_of, tmp_path):
    """Buckets follow the digests, many small files are written anew, and a generation without its marker doesn't count."""
    path = str(tmp_path / "index")
    index = exact_dedup.DigestIndex(spark, path, 2, per_bucket=10)
    seen = {}
    for batch in range(6):
        rows = [(100 * batch + i, f"text {(7 * batch + i) % 60}", "s") for i in range(25)]
        for r in index.add(docs_of(rows)).collect():
            text = f"text {(7 * (r['id'] // 100) + r['id'] % 100) % 60}"
            assert r["keep_id"] == seen.setdefault(text, r["keep_id"]) and r["kept"] == (r["keep_id"] == r["id"])
    assert index.generation > 0 and index.buckets > 2 and index.read().count() == len(seen) == index.read().select("digest").distinct().count()
    held = index.buckets
    index.close()
    (tmp_path / "index" / "99-1").mkdir()
    again = exact_dedup.DigestIndex(spark, path)
    assert again.buckets == held and again.read().count() == len(seen)


def test_every_difference_is_covered():
    assert substring_dedup.covers((0, 1, 3), 7) and not substring_dedup.covers((0, 1, 2), 7)


def brute_print(text):
    words = [w for w in re.split("[ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)) if w]
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints, budget=2):
    root = {i: i for i in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(prints)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            if (prints[i] ^ prints[j]).bit_count() <= budget:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids}


def test_simhash(docs_of):
    rng = random.Random(3)
    rows = []
    for i in range(90):
        base = rng.choice(rows)[1] if rows and rng.random() < 0.6 else prose(rng, rng.randrange(0, 200))
        words = base.split()
        if words and rng.random() < 0.7:
            words[rng.randrange(len(words))] = "changed"
        rows.append((i, " ".join(words), "s"))
    got = rows_of(simhash.op9_simhash(docs_of(rows)))
    prints = {i: brute_print(t) for i, t, _ in rows}
    assert {i: int(r["fingerprint"], 16) for i, r in got.items()} == prints
    assert {i: r["component_id"] for i, r in got.items()} == brute_components(prints)


def signed(p):
    return p - (1 << 64) if p >> 63 else p


@pytest.mark.parametrize("node_rows,pair_rows", [(1 << 16, 1 << 18), (20, 3)])
def test_links_of_dense_prints(spark, node_rows, pair_rows):
    """Many prints around a few centres; the second limits send their node pairs many levels further down."""
    rng = random.Random(4)
    prints = set()
    for _ in range(3):
        centre = rng.getrandbits(64)
        prints |= {centre ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(60)} | {centre ^ rng.getrandbits(12) for _ in range(40)}
    df = spark.createDataFrame([(signed(p),) for p in prints], "print long")
    root = {r["node"]: r["root"] for r in components(simhash.links(df, node_rows, pair_rows, rows_per_task=500)).collect()}
    got = {p: root.get(signed(p), signed(p)) for p in prints}
    want = brute_components({p: p for p in prints})
    assert len({(got[p], want[p]) for p in prints}) == len(set(want.values())) == len(set(got.values()))


def test_trie_pairs():
    rng = np.random.default_rng(5)
    v = np.unique(rng.integers(0, 1 << 12, 900)).astype(np.uint64)
    trie = simhash.Trie(v)
    found = [(a, b) for i, j in trie.links(np.array([[0], [len(v)], [0], [len(v)], [2]], np.int32), 11) for a, b in zip(i.tolist(), j.tolist())]
    want = {(a, b) for a in range(len(v)) for b in range(a + 1, len(v)) if int(v[a] ^ v[b]).bit_count() <= 2}
    assert set(found) == want and len(found) == len(want)


def test_links_come_from_followed_node_pairs(spark):
    """A task gets whole node pairs and follows many more below them; pruning keeps these far from all pairs. A tenth of the prints have near ones planted."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    prints = {brute_print(r["text"] or "") for r in docs.select("text").collect()}
    rng = random.Random(6)
    prints |= {p ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for p in sorted(prints)[::10]}
    prints = sorted(map(signed, prints))
    n = len(prints)
    rows = [(4, m, min(x, x ^ m), p) for p in prints for x in [(p + (1 << 63)) >> 60] for m in simhash.masks(4)]
    rows = dict(zip(("depth", "mask", "low", "print"), np.array(sorted(rows), np.int64).T))
    u, v, followed = simhash.joined(rows)
    pairs = len(set(zip(rows["mask"].tolist(), rows["low"].tolist())))
    assert len(u) and 10 * pairs < followed < n * (n - 1) / 2
    root = {r["node"]: r["root"] for r in components(simhash.links(spark.createDataFrame([(p,) for p in prints], "print long"))).collect()}
    want = brute_components({p & ((1 << 64) - 1): p & ((1 << 64) - 1) for p in prints})
    got = {p & ((1 << 64) - 1): root.get(p, p) for p in prints}
    assert len({(got[p], want[p]) for p in want}) == len(set(want.values())) == len(set(got.values()))


def test_simhash_of_odd_rows(odd):
    got = {}
    for r in simhash.op9_simhash(odd[0]).collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert got[3][0]["fingerprint"] == "0" * 16 and got[3][0]["component_id"] == got[5][0]["component_id"] == 3
    assert got[1][0]["component_id"] is None and got[None][0]["component_id"] is None and len(got[8]) == 2
    kept = simhash.keep_one(odd[0])
    assert kept.columns == odd[0].columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == sorted({r[0]["component_id"] or 0 for r in got.values()})


def test_rows_that_share_an_id_are_not_linked(docs_of):
    """Null and repeated ids over different texts: a component for each text, and one row of each is kept."""
    texts = [prose(random.Random(i), 120) for i in range(5)]
    rows = [(None, texts[0], "a"), (None, texts[1], "a"), (9, texts[1], "a"), (5, texts[2], "a"), (5, texts[3], "a"), (7, texts[3], "a"), (8, texts[4], "a")]
    assert len(set(brute_components({i: brute_print(t) for i, t in enumerate(texts)}).values())) == 5
    got = sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in simhash.op9_simhash(docs_of(rows)).collect())
    assert got == [(0, 0), (0, 0), (5, 5), (5, 5), (7, 5), (8, 8), (9, 0)]
    kept = sorted((r["doc_id"] or 0, r["text"]) for r in simhash.keep_one(docs_of(rows)).collect())
    assert kept == sorted([(0, texts[0]), (0, texts[1]), (5, texts[2]), (5, texts[3]), (8, texts[4])])


def test_components_of_a_long_path(spark):
    df = spark.range(1, 200).select(F.col("id").alias("u"), (F.col("id") - 1).alias("v"))
    assert {r["root"] for r in components(df).collect()} == {0}
