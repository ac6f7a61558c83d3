"""WARC archives in Zstandard: one frame for each record, the dictionary in a leading skippable frame.

The writer makes archives of about ARCHIVE_BYTES in a folder that all executors share, under a name of its own for
each attempt, and returns a manifest; files of attempts that were lost are in no manifest. The reader takes a
manifest, or the paths of any archives, loads an archive's dictionary from its first frame (which may itself be
compressed), decodes a frame at a time and checks it: the version line, the headers that every record must have,
Content-Length against the block, digests against block and payload in any algorithm and spelling it knows, the HTTP
length where nothing says that the payload was changed on its way, and that the frame holds one record and nothing
else. Records of all types are read, with their ids as text; other skippable frames are passed over.

Payloads seen before become `revisit` records (those of MIN_REVISIT bytes or more, equal by SHA-256): the
record with the smallest id holds the payload, the others refer to it. Which these are is worked out over ids and
digests alone, and payloads are joined by id, so that a popular payload is no hot key.

Defined cases: a null payload counts as empty; a null URL leaves the header out, and characters that can't stand in
a header are percent-encoded; rows without an id are revisits wherever a row with an id holds their payload; rows
that repeat the smallest id are all responses; an empty table gives no archive; other columns are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import urllib.parse
import uuid
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
import pyarrow.compute as pc
import zstandard as zstd
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, scratch_path, small_batches, text_or_empty

SKIPPABLE = 0x184D2A5D  # fixed value: the frame that holds a WARC dictionary; the format's skippable frames differ in four bits
FRAME = b"\x28\xb5\x2f\xfd"  # fixed value: how a Zstandard frame begins
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"  # fixed value
MIN_REVISIT, ARCHIVE_BYTES, DATE = 100, 64 << 20, "2000-01-01T00:00:00Z"
DICT_BYTES, DICT_SAMPLES, DICT_SAMPLE_CHARS = 64 << 10, 400, 8_000  # the sample's bound
_MANIFEST = "path string, records long, bytes long"
_RECORDS = "record_id string, record_type string, date string, url string, payload binary, payload_bytes long, payload_digest string, refers_to string"
_LOWEST = -(1 << 63)  # stands for a null id


class BadRecord(ValueError):
    pass


def train(samples: list[bytes], size: int = DICT_BYTES) -> bytes:
    """A Zstandard dictionary of the samples; of too few of them, their own bytes."""
    try:
        return zstd.train_dictionary(size, samples).as_bytes()
    except (zstd.ZstdError, ValueError):
        return b"".join(samples)[-size:]


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record: the payload behind an HTTP header, or the header alone in a revisit."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        lines.insert(3, f"WARC-Target-URI: {urllib.parse.quote(url, safe=''.join(map(chr, range(0x21, 0x7F))))}")
    if refers_to is not None:
        lines[4:4] = [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class Record(NamedTuple):
    record_id: str
    record_type: str
    date: str
    url: str | None
    payload: bytes  # of an HTTP message its body, of other records the block
    payload_bytes: int | None  # of a revisit what its HTTP header says, if it does
    payload_digest: str  # SHA-256 in lower-case hex; of a revisit as it is written, if that is another
    refers_to: str | None


def _headers(lines: list[bytes]) -> dict[str, str]:
    """Names in lower case; a line that begins with white space continues the one before."""
    out: dict[str, str] = {}
    name = ""
    for line in lines:
        if line[:1] in (b" ", b"\t") and name:
            out[name] += " " + line.decode(errors="replace").strip()
            continue
        raw, colon, value = line.partition(b":")
        if not colon:
            raise BadRecord(f"not a header: {line[:60]!r}")
        name = raw.decode(errors="replace").strip().lower()
        out[name] = value.decode(errors="replace").strip()
    return out


def _digested(written: str, data: bytes) -> bool:
    """Whether a labelled digest (hex, base32 or base64) is that of the data; an unknown algorithm can't be held against it."""
    algorithm, _, value = written.partition(":")
    algorithm = algorithm.lower().replace("-", "")
    if algorithm not in ("md5", "sha1", "sha256", "sha512"):
        return True
    own = hashlib.new(algorithm, data).digest()
    return value.lower() == own.hex() or value.upper().rstrip("=") == base64.b32encode(own).decode().rstrip("=") or value.rstrip("=") == base64.b64encode(own).decode().rstrip("=")


def _bare(uri: str) -> str:
    return uri[1:-1] if uri.startswith("<") and uri.endswith(">") else uri


def parse(data: bytes) -> Record:
    """One record, or BadRecord."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not gap or lines[0] not in (b"WARC/1.0", b"WARC/1.1"):
        raise BadRecord(f"not a WARC record: {data[:20]!r}")
    h = _headers(lines[1:])
    if missing := {"warc-type", "warc-record-id", "warc-date", "content-length"} - h.keys():
        raise BadRecord(f"headers missing: {sorted(missing)}")
    length, kind = h["content-length"], h["warc-type"].lower()
    if not length.isdigit() or len(rest) != int(length) + 4 or not rest.endswith(b"\r\n\r\n"):
        raise BadRecord(f"Content-Length is {length}, the block has {len(rest) - 4} bytes")
    block = rest[:-4]
    if (written := h.get("warc-block-digest")) and not _digested(written, block):
        raise BadRecord(f"block digest is {written}")
    payload, http = block, None
    if kind in ("response", "revisit", "request") and h.get("content-type", "application/http").startswith("application/http"):
        top, gap, body = block.partition(b"\r\n\r\n")
        first, *fields = top.split(b"\r\n")
        if gap and (kind == "request" or first.startswith(b"HTTP/")):
            payload, http = body, _headers([x for x in fields if b":" in x or x[:1] in (b" ", b"\t")])
        elif kind == "response":
            raise BadRecord("no HTTP header in the block")
    size = (http or {}).get("content-length", "")
    written = h.get("warc-payload-digest", "")
    refers, count, digest = None, len(payload), None
    if kind == "revisit":
        if payload and http is not None:
            raise BadRecord("a revisit with a payload")
        refers = h.get("warc-refers-to")
        payload, count = b"", int(size) if size.isdigit() else None
        digest = written.removeprefix("sha256:")
    elif kind == "response":
        whole = "warc-truncated" not in h and not {"transfer-encoding", "content-encoding"} & (http or {}).keys()
        if written and "warc-truncated" not in h and not _digested(written, payload):
            raise BadRecord(f"payload digest is {written}")
        if size and whole and size != str(len(payload)):
            raise BadRecord(f"HTTP Content-Length is {size}, the payload has {len(payload)} bytes")
    url = h.get("warc-target-uri")
    return Record(_bare(h["warc-record-id"]), kind, h["warc-date"], url and urllib.parse.unquote(_bare(url)), payload, count, hashlib.sha256(payload).hexdigest() if digest is None else digest, refers and _bare(refers))


def _dictionary(raw: bytes) -> zstd.ZstdCompressionDict:
    """A dictionary as it stands in its frame: plain, or compressed itself."""
    return zstd.ZstdCompressionDict(zstd.ZstdDecompressor().decompressobj().decompress(raw) if raw.startswith(FRAME) else raw)


def frames(stream, path: str = "") -> Iterator[bytes]:
    """The contents of an archive's frames, one after another; the dictionary is taken from a leading skippable frame."""
    opener, left, leading = zstd.ZstdDecompressor(), b"", True
    while True:
        while len(left) < 8 and (more := stream.read(1 << 16)):
            left += more
        if not left:
            return
        if len(left) >= 8 and struct.unpack("<I", left[:4])[0] & 0xFFFFFFF0 == SKIPPABLE & 0xFFFFFFF0:
            magic, size = struct.unpack("<II", left[:8])
            left = left[8:]
            while len(left) < size and (more := stream.read(max(1 << 16, size - len(left)))):
                left += more
            if len(left) < size:
                raise BadRecord(f"{path}: a skippable frame is cut off")
            if leading and magic == SKIPPABLE and size:
                opener = zstd.ZstdDecompressor(dict_data=_dictionary(left[:size]))
            left, leading = left[size:], False
            continue
        frame, out, leading = opener.decompressobj(), [], False
        while True:
            try:
                out.append(frame.decompress(left))
            except zstd.ZstdError as e:
                raise BadRecord(f"{path}: {e}") from e
            if frame.eof:
                left = frame.unused_data
                break
            if not (left := stream.read(1 << 16)):
                raise BadRecord(f"{path}: the last frame is cut off")
        yield b"".join(out)


def _write(root: str, dictionary: bytes, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = fs.FileSystem.from_uri(root)
        store.create_dir(folder, recursive=True)
        packer = zstd.ZstdCompressor(level=3, dict_data=zstd.ZstdCompressionDict(dictionary) if dictionary else None)
        done, out, path, count = [], None, "", 0

        def close() -> None:
            out.close()
            done.append((f"{root.rstrip('/')}/{path.rpartition('/')[2]}", count, store.get_file_info(path).size))

        for b in batches:
            payloads = pc.cast(b["html"], pa.binary()).to_pylist()
            for page, url, payload, digest, refers in zip(b["page_id"].to_pylist(), b["url"].to_pylist(), payloads, b["digest"].to_pylist(), b["refers_to"].to_pylist()):
                if out is None:
                    path, count = f"{folder}/{uuid.uuid4().hex}.warc.zst", 0
                    out = store.open_output_stream(path, compression=None)  # not by the name: frames are packed here
                    if dictionary:
                        out.write(struct.pack("<II", SKIPPABLE, len(dictionary)) + dictionary)
                out.write(packer.compress(record(page, url, payload, digest, refers)))
                count += 1
                if out.tell() >= limit:
                    close()
                    out = None
        if out is not None:
            close()
        cols = list(zip(*done)) or [[], [], []]
        yield pa.record_batch([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())], names=["path", "records", "bytes"])

    return run


def write(pages: DataFrame, root: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes the archives under `root` and returns their manifest: path, records, bytes."""
    small_batches(pages.sparkSession)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), text_or_empty(payload_col).alias("html"))
    # The sample is chosen by hashes, so that every run makes the same dictionary; a bound under which about twice as many
    # hashes lie as it takes keeps tasks from sending more to the driver, however many they are.
    few = 2 * DICT_SAMPLES / max(pages.count(), 1)
    hashed = rows.filter("html != ''").select(F.xxhash64("html", "page_id").alias("o"), F.substring("html", 1, DICT_SAMPLE_CHARS).alias("html"))
    chosen = hashed.filter(F.col("o") < int(few * (1 << 64)) - (1 << 63)) if few < 1 else hashed
    some = [r[1:] for r in chosen.orderBy("o").limit(DICT_SAMPLES).collect()]
    dictionary = train([record(0, "http://example.com/", x[0].encode(), "0" * 64, None) for x in some]) if some else b""
    rows = rows.withColumn("digest", F.sha2("html", 256))
    # Only payloads held more than once go to the join; copies are counted before the shuffle.
    key = F.coalesce("page_id", F.lit(_LOWEST)).alias("key")
    large = durable(rows.filter(F.octet_length("html") >= MIN_REVISIT).select(key, F.unhex("digest").alias("bits")), "payloads")
    shared = large.groupBy("bits").agg(F.min(F.nullif("key", F.lit(_LOWEST))).alias("first"), F.count("*").alias("n")).filter("n > 1 AND first IS NOT NULL").select("bits", "first")
    again = durable(large.join(shared, "bits").filter("key <> first").select("key", "bits", F.col("first").alias("refers_to")).distinct(), "revisits")
    marked = rows.withColumns({"key": key, "bits": F.unhex("digest")}).join(again, ["key", "bits"], "left").select("page_id", "url", "html", "digest", "refers_to")
    return durable(marked.mapInArrow(_write(root, dictionary, archive_bytes), _MANIFEST), "manifest")


def _read(types: frozenset[str] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string())
        pack = lambda held: pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held), kinds)], names=Record._fields)
        for b in batches:
            for path, records in zip(b["path"].to_pylist(), b["records"].to_pylist()):
                store, inside = fs.FileSystem.from_uri(path)
                seen, held, size = 0, [], 0
                with store.open_input_stream(inside, compression=None) as stream:
                    for data in frames(stream, path):
                        try:
                            record = parse(data)
                        except BadRecord as e:
                            raise BadRecord(f"{path}, record {seen}: {e}") from e
                        seen += 1
                        if types is None or record.record_type in types:
                            held.append(record)
                            size += len(data)
                        if size >= 4 << 20:
                            yield pack(held)
                            held, size = [], 0
                if held:
                    yield pack(held)
                if records is not None and seen != records:
                    raise BadRecord(f"{path}: {seen} records, the manifest has {records}")

    return run


def read(manifest: DataFrame, types: Iterable[str] | None = None) -> DataFrame:
    """The records of all archives (path, and records where their number is known), each archive read by one task, a frame at
    a time. With `types`, records of other types are checked and left out."""
    files = manifest if "records" in manifest.columns else manifest.withColumn("records", F.lit(None).cast("long"))
    files = files.select("path", "records").repartition(max(1, manifest.sparkSession.sparkContext.defaultParallelism), F.xxhash64("path"))
    return files.mapInArrow(_read(None if types is None else frozenset(types)), _RECORDS)


def _page(uri: Column) -> Column:
    """The page that a record's id names, if it is one of the writer's."""
    return F.nullif(F.regexp_extract(uri, "^urn:page:([0-9-]+)$", 1), F.lit("")).cast("long")


def op4_warc(pages: DataFrame) -> DataFrame:
    """The contract's result: written, read back, and described without the payloads."""
    root = scratch_path(pages.sparkSession, "archives")
    back = read(write(pages, root), ("response", "revisit"))
    return back.select(_page(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", _page(F.col("refers_to")).alias("refers_to"))


ORACLE = """
WITH held AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
sized AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM held),
firsts AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM sized)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM firsts
"""
