"""Mixing, sharding, archives, tokens, fingerprints, languages and the pipeline."""

import base64
import collections
import hashlib
import io
import random
import re
import struct
import zlib

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F
from tessitura.llm import bpe, language, minhash, mixing, sharding, warc
from words import prose


def sha(b):
    return hashlib.sha256(b if isinstance(b, bytes) else b.encode()).hexdigest()


def size_of(t):
    return len(re.findall("[^ \t-\r]+", t or ""))


@pytest.mark.parametrize("op", [mixing.op2_mixing, sharding.op10_sharding, bpe.op8_bpe, minhash.op7_minhash])
def test_empty_tables(op, none):
    assert op(none).collect() == []


# Mixing


def brute_targets(sizes, weights=(5, 2, 1), cap=3):
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, closed = float(sum(sizes.values())), {}
    while True:
        open_ = [s for s in order if s not in closed]
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > cap * sizes[s]]
        if not over:
            return {**closed, **{s: left * weight[s] / total for s in open_}}
        for s in over:
            closed[s] = cap * sizes[s]
        left = sum(sizes.values()) - sum(closed.values())


def test_mixing(docs_of):
    rng = random.Random(1)
    rows = [(i, prose(rng, int(rng.paretovariate(0.7)) % 900), rng.choice(["a"] * 12 + ["b", "b", "c", "d", None, "é"])) for i in range(700)]
    got = mixing.op2_mixing(docs_of(rows)).collect()
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += size_of(t)
    want, taken = brute_targets(sizes), collections.Counter()
    by = {i: (t, s) for i, t, s in rows}
    for r in got:
        t, s = by[r["doc_id"]]
        assert r["size"] == size_of(t) and r["source_size"] == sizes[s] and abs(r["target"] - want[s]) < 1e-6 * (1 + want[s])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
    largest = {s: max(size_of(t) for _, t, x in rows if x == s) for s in sizes}
    assert all(abs(taken[s] - want[s]) <= largest[s] + 1 for s in sizes)
    again = mixing.op2_mixing(docs_of(rows[::-1]).repartition(7)).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))


def test_mixing_of_odd_rows(odd):
    got = mixing.op2_mixing(odd[0]).collect()
    assert len(got) == len(odd[1]) and all(r["size"] == 0 for r in got if r["doc_id"] in (3, 4, 5))
    assert mixing.mixed(odd[0]).columns == odd[0].columns
    whole, want = collections.Counter(r["doc_id"] for r in mixing.mixed(odd[0]).collect()), collections.Counter()
    for r in got:
        want[r["doc_id"]] += r["copies"]
    assert whole == +want


def test_repeated_rows_share_their_copies(spark):
    """Rows of one id and text, alike or not in other columns, are taken as often as the mix says in all."""
    rows = [(None, "four words of text", "a", i % 3) for i in range(60)] + [(5, "other words", "b", 0)] * 30 + [(9, "single one here now", "b", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, extra int")
    want, whole = collections.Counter(), collections.Counter(r["doc_id"] for r in mixing.mixed(df).collect())
    for r in mixing.op2_mixing(df).collect():
        want[r["doc_id"]] += r["copies"]
    assert whole == +want and 0 < whole[None] != 60
    kinds = collections.Counter(r["extra"] for r in mixing.mixed(df).collect() if r["doc_id"] is None)
    assert max(kinds.values()) - min(kinds.values()) <= 20 and sum(kinds.values()) == want[None]


def test_mixing_of_blank_texts(docs_of):
    assert {(r["target"], r["taken"]) for r in mixing.op2_mixing(docs_of([(1, "", "a"), (2, None, None)])).collect()} == {(0.0, 0)}


# Sharding


def test_differencing_beats_dealing_in_order():
    rng = np.random.default_rng(0)
    sizes = np.sort(rng.pareto(2, 400) * 1000).astype(np.int64)[::-1]
    whole = np.zeros((400, 8), np.int64)
    whole[:, 0] = sizes
    labels = sharding.difference(whole)
    assert sorted(labels[0]) == list(range(8))
    sums = np.bincount(labels[:, 0], sizes, 8)
    greedy = np.zeros(8)
    for s in sizes:
        greedy[greedy.argmin()] += s
    assert np.ptp(sums) <= np.ptp(greedy)


def plain_difference(sizes, shards):
    """The largest differencing method by lists of lists: labels by what ends up together."""
    heap = [([s] + [0] * (shards - 1), [[i]] + [[] for _ in range(shards - 1)]) for i, s in enumerate(sizes)]
    while len(heap) > 1:
        heap.sort(key=lambda x: -(max(x[0]) - min(x[0])))
        (a, la), (b, lb) = heap[0], heap[1]
        up, down = sorted(range(shards), key=lambda i: -a[i]), sorted(range(shards), key=lambda i: b[i])
        heap = [([a[i] + b[j] for i, j in zip(up, down)], [la[i] + lb[j] for i, j in zip(up, down)]), *heap[2:]]
    return heap[0]


@pytest.mark.parametrize("seed", range(4))
def test_differencing_equals_a_plain_version(seed):
    """Distinct sizes leave no ties among large spreads, so the sums of shards must be the same."""
    rng = np.random.default_rng(seed)
    sizes = rng.choice(100_000, 60, replace=False) + 1
    whole = np.zeros((60, 5), np.int64)
    whole[:, 0] = sizes
    labels = sharding.difference(whole)[:, 0]
    assert sorted(np.bincount(labels, sizes, 5)) == sorted(plain_difference(sizes.tolist(), 5)[0])


def test_rows_without_ids_get_slots(docs_of):
    got = sharding.op10_sharding(docs_of([(None, f"text {i % 7}", "s") for i in range(500)])).collect()
    slots = collections.defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert len(got) == 500 and all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_shards(docs_of):
    rng = random.Random(2)
    rows = [(i, prose(rng, rng.randrange(1, 60)), "s") for i in range(900)]
    rows += [(1000 + i, rows[i % 3][1], "s") for i in range(40)]
    df = docs_of(rows)
    got = sharding.op10_sharding(df).collect()
    by = {i: t for i, t, _ in rows}
    shards, slots, home = collections.Counter(), collections.defaultdict(list), {}
    for r in got:
        raw = by[r["doc_id"]].encode()
        assert r["size"] == len(raw) + 16 and r["text_crc32"] == zlib.crc32(raw) and r["law"] == "bytes" and r["grown_shard"] is None
        assert home.setdefault(raw, r["shard"]) == r["shard"]
        shards[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert sorted(shards) == list(range(40)) and all(sorted(v) == list(range(len(v))) for v in slots.values())
    largest = max(collections.Counter(by.values()).items(), key=lambda x: x[1] * len(x[0]))
    assert max(shards.values()) - min(shards.values()) <= max(60, largest[1] * (len(largest[0]) + 16) - sum(shards.values()) / 40 + 60)
    # many small buckets and rounds give the same law
    placed = sharding.assign(df.groupBy(F.unhex(F.md5("text")).alias("digest")).agg(F.sum(F.octet_length("text") + 16).alias("bytes")), 8, per_bucket=2)
    assert placed.count() == len(set(by.values())) and placed.select("shard").distinct().count() == 8


def test_shards_of_odd_rows(odd):
    got = sharding.op10_sharding(odd[0]).collect()
    assert len(got) == len(odd[1]) and {(r["size"], r["text_crc32"]) for r in got if r["doc_id"] in (3, 4)} == {(16, 0)}


# Archives


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, digest string, first long")


ROWS = [(1, "http://a/é x\r\ny", "<p>" + "a" * 200, None, None), (2, None, "<p>" + "a" * 200, None, None), (3, "http://c", "short", None, None), (4, "http://d", "short", None, None), (5, "u", None, None, None), (6, "u", "", None, None), (None, "u", "<p>" + "a" * 200, None, None), (7, "u", "ß" * 50, None, None), (8, "u", "ß" * 50, None, None), (9, "u", "x" * 300_000, None, None)]


def test_archives(spark):
    got = {r["page_id"]: r for r in warc.op4_warc(pages(spark, ROWS)).collect()}
    for page, _, html, *_ in ROWS:
        raw = (html or "").encode()
        first = min((p for p, _, h, *_ in ROWS if p is not None and (h or "") == (html or "")), default=None)
        again = len(raw) >= 100 and page != first
        assert (got[page]["payload_bytes"], got[page]["payload_digest"]) == (len(raw), sha(raw))
        assert (got[page]["record_type"], got[page]["refers_to"]) == (("revisit", first) if again else ("response", None))
    assert warc.op4_warc(pages(spark, [])).collect() == []


def test_archives_roll_and_keep_payloads(spark, tmp_path):
    root = f"file://{tmp_path}/w"
    manifest = warc.write(pages(spark, ROWS).coalesce(1), root, archive_bytes=700)
    assert manifest.count() > 1 and manifest.agg(F.sum("records")).first()[0] == len(ROWS)
    back = {r["record_id"]: r for r in warc.read(manifest).collect()}
    assert bytes(back["urn:page:9"]["payload"]) == b"x" * 300_000 and back["urn:page:1"]["url"] == "http://a/é x\r\ny" and back["urn:page:2"]["payload"] == b""
    assert warc.read(manifest.select("path"), ["revisit"]).select("record_type").distinct().collect() == [("revisit",)]
    # the same pages make the same archives, whatever the order of rows: the dictionary is chosen by hashes
    heads = set()
    for k, rows in enumerate((ROWS, ROWS[::-1])):
        raw = open(warc.write(pages(spark, rows), f"file://{tmp_path}/v{k}").first()["path"].removeprefix("file://"), "rb").read()
        magic, size = struct.unpack("<II", raw[:8])
        heads.add((magic, raw[8 : 8 + size]))
    assert len(heads) == 1 and heads.pop()[0] == warc.SKIPPABLE


def archive(records, dictionary=b"", together=False, packed_dictionary=False):
    packer = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
    held = zstandard.ZstdCompressor().compress(dictionary) if packed_dictionary else dictionary
    head = struct.pack("<II", warc.SKIPPABLE, len(held)) + held if dictionary else b""
    return head + (packer.compress(b"".join(records)) if together else b"".join(map(packer.compress, records)))


def test_reader_checks_what_it_reads():
    good = warc.record(1, "http://a", b"payload", sha(b"payload"), None)
    assert [warc.parse(x).payload for x in warc.frames(io.BytesIO(archive([good, good], b"http payload HTTP WARC" * 20)))] == [b"payload"] * 2
    assert list(warc.frames(io.BytesIO(b""))) == []
    bad = [good.replace(b"WARC/1.1", b"WARC/9"), good.replace(b"WARC-Date", b"X-Date"), good[:-1], good + b"x", good.replace(b"payload\r\n", b"paylord\r\n"), good.replace(b"Content-Length: 7", b"Content-Length: 8"), good + good]
    for x in bad:
        with pytest.raises(warc.BadRecord):
            warc.parse(x)
    for raw in (archive([good])[:-3], archive([good], b"d" * 99)[:40], archive([good])[:3]):
        with pytest.raises(warc.BadRecord):
            list(warc.frames(io.BytesIO(raw)))
    with pytest.raises(warc.BadRecord):  # two records in one frame
        [warc.parse(x) for x in warc.frames(io.BytesIO(archive([good, good], together=True)))]


def foreign(kind, block, *headers, uid="<urn:uuid:12345678-1234-1234-1234-123456789abc>"):
    lines = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: {uid}", "WARC-Date: 2024-05-06T07:08:09Z", *headers, f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def test_archives_of_others(spark, tmp_path):
    """What a crawler writes: all record types, ids of its own, SHA-1 in base32, folded headers, a compressed dictionary."""
    body = "Grüße".encode() * 30
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nX-Long: a\r\n b\r\n\r\n"
    sha1 = base64.b32encode(hashlib.sha1(body).digest()).decode()
    records = [
        foreign("warcinfo", b"software: crawler\r\n", "Content-Type: application/warc-fields"),
        foreign("request", b"GET / HTTP/1.1\r\nHost: a\r\n\r\n", "Content-Type: application/http; msgtype=request", "WARC-Target-URI: <http://a/>"),
        foreign("response", http + body, "Content-Type: application/http; msgtype=response", "WARC-Target-URI: http://a/", f"WARC-Payload-Digest: sha1:{sha1}", f"WARC-Block-Digest: sha1:{hashlib.sha1(http + body).hexdigest()}"),
        foreign("response", b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\nContent-Length: 9\r\n\r\nabc", "WARC-Payload-Digest: blake9:xyz"),
        foreign("revisit", b"HTTP/1.1 304 Not Modified\r\n\r\n", "WARC-Refers-To: <urn:uuid:0>", f"WARC-Payload-Digest: sha1:{sha1}"),
        foreign("metadata", b"k: v"), foreign("resource", b"\x00\xff", "Content-Type: image/png"), foreign("conversion", b"text"),
    ]
    raw = archive(records, b"WARC/1.0 WARC-Type: response HTTP/1.1 200 OK Content-Type" * 9, packed_dictionary=True)
    (tmp_path / "c.warc.zst").write_bytes(raw + struct.pack("<II", warc.SKIPPABLE - 3, 4) + b"skip" + archive(records[:1]))
    got = warc.read(spark.createDataFrame([(f"file://{tmp_path}/c.warc.zst",)], "path string")).collect()
    assert [r["record_type"] for r in got] == ["warcinfo", "request", "response", "response", "revisit", "metadata", "resource", "conversion", "warcinfo"]
    assert bytes(got[2]["payload"]) == body and got[2]["payload_digest"] == sha(body) and got[2]["record_id"] == "urn:uuid:12345678-1234-1234-1234-123456789abc"
    assert got[1]["url"] == "http://a/" and got[4]["refers_to"] == "urn:uuid:0" and got[4]["payload_bytes"] is None and got[4]["payload_digest"] == f"sha1:{sha1}"
    assert bytes(got[6]["payload"]) == b"\x00\xff" and got[0]["date"] == "2024-05-06T07:08:09Z"
    for wrong in (records[2].replace(sha1.encode(), b"A" * 32), records[2].replace(b"Block-Digest: sha1:", b"Block-Digest: sha1:0")):
        with pytest.raises(warc.BadRecord):
            warc.parse(wrong)


# Tokens


TEXTS = ["x" * 9000, "a" * 300 + " <|endoftext|> it's " + "b" * 400, "日本語" * 1500, " é " * 300, "", " ", "a\u0085b\x1c c", "I'll don't 12 3½", " private ", "é́ ö̈"]


@pytest.mark.parametrize("soft,hard", [(5, 13), (9, 5), (0, 3)])
def test_tokens_agree_with_the_library(soft, hard):
    mine, table = bpe.Codec(bpe.default_tokenizer(), soft, hard), {}
    rng = random.Random(3)
    shared = prose(rng, 300)
    texts = [*TEXTS, *(shared + prose(rng, 40) for _ in range(20)), shared, prose(rng, 2000)]
    for _ in range(2):
        ids, said = mine.transcode(texts, table)
        for t, i, d in zip(texts, ids, said):
            want = mine.tokenizer.encode(t, add_special_tokens=False).ids
            assert i.tolist() == want and d == mine.tokenizer.decode(want, skip_special_tokens=False)
    assert mine.repaired > 0 or hard > 10


def test_shared_passages_are_encoded_once():
    mine = bpe.Codec(bpe.default_tokenizer())
    shared = prose(random.Random(4), 3000)
    mine.encode([f"start{i} " + shared for i in range(50)])
    assert mine.encoded < 0.05 * mine.asked


def test_a_chunk_of_several_groups_is_encoded_by_one(spark, docs_of, tmp_path, monkeypatch):
    """A passage that all documents share, dealt to many groups: one group encodes its chunks, the others are sent the ids."""
    rng = random.Random(5)
    shared = prose(rng, 2000)
    rows = [(i, f"{prose(rng, 30)} {shared} {prose(rng, 30)}", "s") for i in range(48)]
    shared_bytes = len(shared.encode())
    log = str(tmp_path)

    def noted(self, table, chunks, learn=bpe.Codec.learn):
        before = self.encoded
        learn(self, table, chunks)
        with open(f"{log}/{__import__('uuid').uuid4().hex}", "w") as f:
            f.write(str(self.encoded - before))

    first, group = bpe._first, bpe._group

    def logged(make):
        def outer(*args):
            run = make(*args)

            def inner(key, texts, notes):
                from tessitura.llm import bpe as there

                kept, there.Codec.learn = there.Codec.learn, noted
                try:
                    return run(key, texts, notes)
                finally:
                    there.Codec.learn = kept

            return inner

        return outer

    monkeypatch.setattr(bpe, "_first", logged(first))
    monkeypatch.setattr(bpe, "_group", logged(group))
    got = {r["id"]: r["ids"] for r in bpe.encode(docs_of(rows), group_bytes=20_000).collect()}
    plain = bpe.codec(bpe.default_tokenizer()).tokenizer
    assert got == {i: plain.encode(t, add_special_tokens=False).ids for i, t, _ in rows}
    encoded = sum(int(f.read_text()) for f in tmp_path.iterdir())
    own = sum(len(t.encode()) for _, t, _ in rows) - 48 * shared_bytes
    assert encoded < 2 * shared_bytes + 3 * own < 0.5 * 48 * shared_bytes


def test_tokens(odd):
    mine = bpe.codec(bpe.default_tokenizer()).tokenizer
    by = {i: t or "" for i, t, _ in odd[1]}
    got = bpe.op8_bpe(odd[0]).collect()
    assert len(got) == len(odd[1])
    for r in got:
        ids = mine.encode(by[r["doc_id"]], add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(" ".join(map(str, ids))), sha(mine.decode(ids, skip_special_tokens=False)))
    both = bpe.decode(bpe.encode(odd[0])).select(F.sha2("text", 256)).collect()
    assert sorted(r[0] for r in both) == sorted(r["decoded_sha256"] for r in got)


# Fingerprints


def shingles(t):
    w = re.findall("[^ \t-\r]+", t)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def resemblance(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def test_fingerprints(docs_of):
    rng = random.Random(5)
    rows = [(i * 3, prose(rng, rng.choice([0, 1, 3, 8, 40, 400, 900])), "s") for i in range(60)]
    rows += [(500, rows[9][1], "s"), (501, rows[9][1], "s")]
    by, ids = {i: t for i, t, _ in rows}, sorted(i for i, _, _ in rows)
    after = dict(zip(ids, ids[1:] + ids[:1]))
    errors, prints = [], {}
    for r in minhash.op7_minhash(docs_of(rows)).collect():
        t, n = by[r["doc_id"]], by[after[r["doc_id"]]]
        q = len(t) // 4
        edited = t[: len(t) - q] + n[:q]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == sha(edited)
        assert prints.setdefault(t, r["fingerprint"]) == r["fingerprint"]
        errors += [r["near_edited"] - resemblance(t, edited), r["near_next"] - resemblance(t, n)]
    assert max(map(abs, errors)) < 0.16 and abs(np.mean(errors)) < 0.02
    assert prints[""] == "" if "" in prints else True


def test_fingerprints_of_odd_rows(odd):
    rows = minhash.op7_minhash(odd[0]).collect()
    got = {r["doc_id"]: r for r in rows}
    assert sorted(r["doc_id"] or 0 for r in rows) == sorted(i or 0 for i, _, _ in odd[1]) and got[3]["near_next"] == 1.0 and got[3]["fingerprint"] == got[5]["fingerprint"] == ""
    # the one without an id comes first and follows the last
    assert got[10]["edited_sha256"] == sha("HERE IT IS, QUITE" [: 22 - 5] + "same text"[:5])
    assert got[1]["near_next"] == 1.0


def test_repeated_rows_come_back(docs_of, monkeypatch):
    monkeypatch.setattr(minhash, "REPEATS", 7)
    rows = [(None, "the same text without any id", "s")] * 40 + [(1, "another text that stands alone here", "s")] + [(2, "twice", "s")] * 2
    got = minhash.op7_minhash(docs_of(rows)).collect()
    assert collections.Counter(r["doc_id"] for r in got) == {None: 40, 1: 1, 2: 2} and len(set(got)) == 3


def plain_print(text):
    """One-permutation MinHash by loops, over hashes that Spark gives for the shingles."""
    bins = {}
    for h in text:
        bins[(h >> 56) + 128] = min(h, bins.get((h >> 56) + 128, h))
    return bins


def test_prints_equal_plain_one_permutation_minhash(spark):
    """Filled bins hold the least hash's low bits; empty ones borrow from the first filled bin in their own order."""
    rng = random.Random(9)
    df = spark.createDataFrame([(prose(rng, n),) for n in (1, 4, 5, 6, 30, 300, 2000)], "t string")
    order = {tuple(r[:2]): r["h"] for r in spark.range(256).select(F.col("id").cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(minhash.PROBES - 1))).alias("t")).withColumn("h", F.xxhash64("i", "t")).collect()}
    for r in df.select("t", minhash.shingle_hashes(F.col("t")).alias("h"), minhash.packed(F.col("t")).alias("p")).collect():
        words = r["t"].split()
        assert len(r["h"]) == max(1, len(words) - 4) and len(set(r["h"])) == len({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))})
        bins = plain_print(r["h"])
        lanes = [x >> s & 255 for x in r["p"] for s in range(56, -8, -8)]
        assert len(lanes) == 256
        for i, lane in enumerate(lanes):
            at = [i, *(order[i, t] & 255 for t in range(minhash.PROBES))]
            first = next((b for b in at if b in bins), None)
            assert lane == bins[first] & 255 if first is not None else lane in {h & 255 for h in bins.values()}


def test_one_document(docs_of):
    (r,) = minhash.op7_minhash(docs_of([(5, "abcdefgh", "s")])).collect()
    assert r["edited_sha256"] == sha("abcdefab") and r["near_next"] == 1.0


def test_densification_has_no_bias(spark):
    """Short texts fill few bins; the borrowed ones must not make them look alike or apart."""
    rng = random.Random(6)
    rows = []
    for _ in range(300):
        words = [f"w{rng.randrange(10**6)}" for _ in range(40)]
        rows.append((" ".join(words), " ".join(words[:30] + [f"v{rng.randrange(10**6)}" for _ in range(10)])))
    df = spark.createDataFrame(rows, "a string, b string").select("a", "b", minhash.likeness(minhash.packed(F.col("a")), minhash.packed(F.col("b"))).alias("x"))
    errors = [r["x"] - resemblance(r["a"], r["b"]) for r in df.collect()]
    assert abs(np.mean(errors)) < 0.02


def test_fingerprints_run_no_python(docs_of):
    plan = minhash.op7_minhash(docs_of([(1, "a b", "s")]))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# Languages


SAMPLES = {"en": "the and of to in that was with for you they have from this", "de": "der die und nicht ein mit für auf ist das wir sind über schön", "fr": "le la les des est une dans que pour sur avec être où ça", "es": "el los que una por con para está más niño años pero como"}


def sentence(rng, lang, n):
    words = SAMPLES[lang].split()
    return " ".join(rng.choice(words) + rng.choice(["", rng.choice(words)]) for _ in range(n))


@pytest.fixture(scope="module")
def spoken(spark):
    rng = random.Random(7)
    rows = [(i, sentence(rng, lang, rng.randrange(3, 60)), lang, f"host{lang}" if i % 3 else "mixed") for i in range(400) for lang in [rng.choice(list(SAMPLES))]]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def test_held_out_accuracy(spark, spoken):
    rows, df = spoken
    model = language.train(df.filter("doc_id % 2 = 0"))
    got = language.fuse(language.scored(language.of_documents(df.filter("doc_id % 2 = 1")), model), model).collect()
    truth = {i: lang for i, _, lang, _ in rows}
    assert np.mean([r["language"] == truth[r["doc_id"]] for r in got]) > 0.97 and all(r["kept"] for r in got)


def test_evidence_decides_where_the_text_does_not(spark, spoken):
    model = language.train(spoken[1])
    rng = random.Random(8)
    rows = [(i, sentence(rng, "fr", 40), "fr", "www.site.fr") for i in range(20)] + [(100 + i, sentence(rng, "de", 40), "de", "www.ort.de") for i in range(20)]
    rows += [(200, "Okapi", None, "neu.ort.de"), (201, "Okapi", None, "sub.site.fr"), (202, "Okapi", "es", None), (203, "12 34 !", "fr", "www.site.fr"), (204, "Okapi", None, "other.fr")]
    df = spark.createDataFrame(rows, "id long, text string, markup string, host string")
    got = {r["id"]: r for r in language.fuse(language.scored(df, model), model).collect()}
    assert [got[i]["language"] for i in (200, 201, 202, 203, 204)] == ["de", "fr", "es", None, "fr"] and not got[203]["kept"]


def plain_fusion(rows, langs):
    """(evidence, own, n, markup, host) to (language, probability), by dictionaries and loops."""
    ks = range(len(langs))
    levels = {"suffix": lambda h: h.rpartition(".")[2], "domain": lambda h: ".".join(h.split(".")[-2:]), "host": lambda h: h}
    sums = {name: collections.defaultdict(lambda: [0.0] * len(langs)) for name in levels}
    whole, agree, said = [0.0] * len(langs), 0.0, 0
    for evidence, own, n, markup, host in rows:
        if not n:
            continue
        for k in ks:
            whole[k] += own[k]
            for name, of in levels.items():
                if host is not None:
                    sums[name][of(host)][k] += own[k]
        if markup and markup.lower() in langs:
            agree, said = agree + own[langs.index(markup.lower())], said + 1
    trust = min(0.99, max(0.5, (agree + 9) / (said + 10)))
    out = []
    for evidence, own, n, markup, host in rows:
        mine = own if n else [0.0] * len(langs)
        prior = [(whole[k] - mine[k] + 1) / (sum(whole) + len(langs)) for k in ks]
        for name, of in levels.items():
            there = [x - y for x, y in zip(sums[name][of(host)], mine)] if host is not None and of(host) in sums[name] else [0.0] * len(langs)
            size = max(sum(there), 0.0) if host is not None else 0.0
            prior = [(max(there[k], 0.0) + language.PULL * prior[k]) / (size + language.PULL) for k in ks]
        known = bool(markup) and markup.lower() in langs
        score = [evidence[k] + np.log(prior[k]) + (np.log(trust if langs[k] == markup.lower() else (1 - trust) / max(1, len(langs) - 1)) if known else 0.0) for k in ks]
        p = np.exp(np.array(score) - max(score))
        out.append((langs[int(np.argmax(score))] if n else None, float(p.max() / p.sum())))
    return out


def test_fusion_equals_a_plain_version(spark):
    """All documents and pages of the smallest tables."""
    data = "/root/testdata/sf0.001"
    docs, page = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/pages.parquet")
    model = language.train(docs)
    rows = language.scored(language.of_documents(docs), model).unionByName(language.scored(language.of_pages(page), model, strip=True))
    key = lambda r: (r["page_id"] is None, r["page_id"] if r["doc_id"] is None else r["doc_id"])
    held = sorted(rows.collect(), key=key)
    got = {key(r): r for r in language.fuse(rows, model).collect()}
    want = plain_fusion([(r["evidence"], r["own"], r["n"], r["markup"], r["host"]) for r in held], list(model.languages))
    assert len(held) == len(got) > 200
    for r, (lang, p) in zip(held, want):
        assert got[key(r)]["language"] == lang and abs(got[key(r)]["probability"] - p) < 1e-6, key(r)
    # and the evidence itself, by counting trigrams one at a time
    text = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for r in held[:40]:
        if r["doc_id"] is not None:
            letters = "".join(c if ord(c) > 127 else c.lower() if c.isalpha() else " " for c in text[r["doc_id"]])
            raw = b" " + " ".join(x for x in letters.split(" ") if x).encode() + b" "
            grams = [raw[i : i + 3] for i in range(len(raw) - 2)]
            assert r["n"] == len(grams)
            logs = sum((model.table[(int.from_bytes(g, "big") * 2654435761 % 2**32) >> (32 - language.HASH_BITS)].astype(float) for g in grams), np.zeros(len(model.languages)))
            scaled = logs * min(1.0, model.weight / max(len(grams), 1))
            assert np.allclose(np.array(r["evidence"]), scaled - scaled.max(), atol=1e-3)


def test_languages_of_odd_rows(spark, odd, spoken):
    model = language.train(spoken[1])
    got = {}
    for r in language.fuse(language.scored(language.of_documents(odd[0]), model), model).collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert not got[3][0]["kept"] and got[3][0]["language"] is None and not got[5][0]["kept"] and len(got[8]) == 2
    other = spark.createDataFrame([(1, "Съешь же ещё этих мягких французских булок да выпей чаю " * 3, "ru", "x"), (2, sentence(random.Random(1), "es", 30), "es", "x")], "doc_id long, text string, lang string, source string")
    kept = {r["doc_id"]: r["kept"] for r in language.fuse(language.scored(language.of_documents(other), model), model).collect()}
    assert kept == {1: False, 2: True}


def test_texts_in_no_language_of_the_model(spark, spoken):
    """Latin letters alone make no language: foreign prose and random letters are rejected, held-out texts are kept."""
    rows, df = spoken
    rng = random.Random(11)
    foreign = ["Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem", "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto", "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler", "Tutti gli esseri umani nascono liberi ed eguali in dignità e diritti. Essi sono dotati di ragione e di coscienza"]
    foreign += [" ".join("".join(rng.choice(letters) for _ in range(rng.randrange(2, 9))) for _ in range(60)) for letters in ("abcdefghijklmnopqrstuvwxyz", "abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(10)]
    new = [(1000 + i, t, None, "mixed") for i, t in enumerate(foreign)] + [(2000 + i, sentence(rng, lang, 40), lang, "mixed") for i, lang in enumerate([*SAMPLES] * 10)]
    model = language.train(df)
    got = language.fuse(language.scored(language.of_documents(spark.createDataFrame(new, df.schema)), model), model).collect()
    assert {r["doc_id"]: r["kept"] for r in got} == {i: i >= 2000 for i, *_ in new}


def test_rare_languages_are_known(spark):
    """A language of 8 rows among 9,000 is in the model and named; one of 4 rows isn't; the sample stays bounded."""
    rng = random.Random(12)
    labels = ["en"] * 6000 + ["de"] * 3000 + ["fr"] * 8 + ["es"] * 4
    schema = "doc_id long, text string, lang string, source string"
    model = language.train(spark.createDataFrame([(i, sentence(rng, k, 40), k, "mixed") for i, k in enumerate(labels)], schema))
    assert model.languages == ("de", "en", "fr")
    new = spark.createDataFrame([(i, sentence(rng, "fr", 40), None, "mixed") for i in range(10)], schema)
    got = language.fuse(language.scored(language.of_documents(new), model), model).collect()
    assert all(r["language"] == "fr" and r["kept"] for r in got)
    assert language.shares({"en": 10**9, "de": 10**6, "fr": 8}) == {"fr": 8, "de": 1996, "en": 1996}


def test_pages_and_unlabelled(spark, spoken, none):
    _, df = spoken
    rows = [(1, "https://User@www.Beispiel.de:8080/x?y", '<!DOCTYPE html><HTML class="a" lang="de-AT"><script>the and of</script><p>' + sentence(random.Random(2), "de", 30)), (2, None, None)]
    page = spark.createDataFrame(rows, "page_id long, url string, html string")
    first = language.of_pages(page).orderBy("page_id").first()
    assert (first["markup"], first["host"]) == ("de", "www.beispiel.de")
    model = language.train(df)
    got = {r["page_id"]: r for r in language.fuse(language.scored(language.of_pages(page), model, strip=True), model).collect()}
    assert got[1]["language"] == "de" and got[1]["kept"] and not got[2]["kept"]
    blank = language.train(none)
    out = language.fuse(language.scored(language.of_documents(df.limit(3)), blank), blank).collect()
    assert blank.languages == () and all(r["kept"] and r["language"] is None for r in out)
    assert language.keep_known(none).collect() == []
