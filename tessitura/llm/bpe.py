"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over 32 bytes cuts each text where its content says so: before a space where the hash's upper SOFT
bits are zero, or between any two characters where the upper HARD are. Equal passages of different documents thus fall
into equal chunks. A chunk is encoded once, wherever it stands: documents are dealt to groups of about GROUP_BYTES;
each group tells the digests of its chunks, those of several groups are encoded by the first group alone, and their ids
are sent to the others; within a group each chunk is encoded once in any case. What travels are digests of all chunks
and ids of the shared ones, once for each group that holds them, however many of its documents do; the texts
are exchanged once and read three times.

Then chunks are joined. Joins at white space are exact by the tokenizer's own rules: it separates words, and no normal
form joins a character with it. At any other join the text between the nearest spaces on both sides is encoded anew
and put in place of what the chunks gave for it; if a chunk's own ids don't end (or begin) with the ids of that
fragment, the seam moves one word further until they agree exactly.

Defined cases: a null text counts as empty and has no tokens; ids, nulls and repeated rows pass through (rows without an
id are dealt to groups by their place in the input); an empty table gives an empty result; other columns are not
looked at.
"""

from __future__ import annotations

import functools
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import durable, parts, small_batches, text_or_empty

SOFT, HARD, GROUP_BYTES, HELD_BYTES = 5, 13, 8 << 20, 128 << 20
_IDS = "a long, b long, ids binary"
# The normal form that simple texts take in Python: they are in form C already, and lower their letters one by one.
_KNOWN_STEPS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
_BLANKS = "\t\n\v\f\r\x85\xa0"
# Maps bytes to characters, printable ASCII to itself.
_BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
_NONE = np.empty(0, np.int32)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def gear() -> np.ndarray:
    """A random number for each byte value, by a rule (splitmix)."""
    z = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) & np.uint64(0xFFFFFFFFFFFFFFFF)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return (z >> np.uint64(24)).astype(np.uint32)


_GEAR, WINDOW = gear(), 32
_ROLL = 0x9E3779B1  # odd, so that it has an inverse modulo 2**32


@functools.lru_cache(4)
def _powers(blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of _ROLL, and of its inverse, modulo 2**32, for so many blocks of 64 Ki places."""
    n, out = blocks << 16, []
    for base in (_ROLL, pow(_ROLL, -1, 1 << 32)):
        steps = np.full(n, base, np.uint32)
        steps[0] = 1
        out.append(np.multiply.accumulate(steps, dtype=np.uint32))
    return out[0], out[1]


def cuts(data: bytes, soft: int = SOFT, hard: int = HARD) -> tuple[np.ndarray, np.ndarray]:
    """Where chunks begin (without 0), and whether each of these joins is at a space.

    The hash of the WINDOW bytes up to a place is a sum of powers of _ROLL times the bytes' numbers, taken from running
    sums over the text; its upper bits see the whole window.
    """
    raw = np.frombuffer(data, np.uint8)
    n = len(raw) - 1
    if n < 1:
        return np.empty(0, np.int64), np.empty(0, bool)
    up, down = _powers(1 << (n >> 16).bit_length())
    sums = np.cumsum(_GEAR[raw[:-1]] * down[:n], dtype=np.uint32)
    sums[WINDOW:] -= sums[:-WINDOW].copy()
    h = sums * up[:n]
    spaces = np.flatnonzero(raw[1:] == 0x20)
    inside = np.flatnonzero(h < np.uint32(1 << (32 - hard)))
    inside = inside[raw[inside + 1] & 0xC0 != 0x80]
    at = np.union1d(spaces[h[spaces] < np.uint32(1 << (32 - soft) if soft else 0xFFFFFFFF)], inside)
    return at + 1, raw[at + 1] == 0x20


def split(data: bytes, soft: int = SOFT, hard: int = HARD) -> tuple[list[bytes], np.ndarray]:
    """The chunks of a text, and for each but the first whether it begins at a space."""
    at, at_space = cuts(data, soft, hard)
    ends = [0, *at.tolist(), len(data)]
    return [data[a:b] for a, b in zip(ends, ends[1:])], at_space


digest = xxhash.xxh3_128_digest


class Codec:
    """Encodes and decodes texts by chunks."""

    def __init__(self, path: str, soft: int = SOFT, hard: int = HARD):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        # Without a decoder, decoding joins the tokens by spaces.
        self.joins = self.tokenizer.decoder is None
        size = self.tokenizer.get_vocab_size()
        self.tokens = [self.tokenizer.id_to_token(i) or "" for i in range(size)] if self.joins else []
        self.kind = np.dtype(np.uint16 if size <= 1 << 16 else np.int32)  # of ids that travel
        self.soft, self.hard = soft, hard
        self.added = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.latin, self.ascii = self._lighter()
        self.asked = self.encoded = self.repaired = 0  # bytes of texts, bytes of chunks encoded, joins inside words

    def _lighter(self) -> list:
        """For Latin-1 and for printable ASCII: the tokenizer without the steps that Python does for such texts, or that
        change nothing in them; None each where the steps aren't the known ones."""
        config = json.loads(self.tokenizer.to_str())
        steps, before = config["normalizer"] or {}, config["pre_tokenizer"] or {}
        if steps.get("normalizers", steps) != _KNOWN_STEPS:
            return [None, None]
        latin = {**config, "normalizer": None}
        first, *last = before.get("pretokenizers", [None])
        ascii_ = {**latin, "pre_tokenizer": first} if last == [_BYTE_LEVEL] else latin
        return [self.tokenizer.from_str(json.dumps(c)) for c in (latin, ascii_)]

    def _simple(self, texts: list[str]) -> list[str] | None:
        """Latin-1 texts in normal form by the known steps; None if any has what only the tokenizer should judge."""
        joined = "\0".join(texts)
        for blank in _BLANKS:
            joined = joined.replace(blank, " ")
        while "  " in joined:
            joined = joined.replace("  ", " ")
        joined = joined.lower()
        out = joined.split("\0")
        return out if len(out) == len(texts) and not any(t in joined for t in self.added) else None

    def plain(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray] = [_NONE] * len(texts)

        def encoded(tokenizer, at: list[int], some: list[str]) -> None:
            for i, e in zip(at, tokenizer.encode_batch_fast(some, add_special_tokens=False)):
                out[i] = np.array(e.ids, np.int32)

        rest = list(range(len(texts)))
        if self.latin is not None:
            kinds: tuple[list[int], list[int], list[int]] = ([], [], [])
            for i, t in enumerate(texts):
                kinds[0 if t.isascii() else 1 if max(t) < "\u0100" else 2].append(i)
            rest = kinds[2]
            for kind, at in enumerate(kinds[:2]):
                simple = self._simple([texts[i] for i in at]) if at else []
                if simple is None:
                    rest += at
                elif at:
                    light = self.ascii if kind == 0 and "".join(simple).isprintable() else self.latin
                    encoded(light, at, simple)
        if rest:
            encoded(self.tokenizer, rest, [texts[i] for i in rest])
        return out

    def learn(self, table: dict[bytes, np.ndarray], chunks: dict[bytes, bytes]) -> None:
        """Adds to a table of ids by digest the chunks that it doesn't hold, each encoded once."""
        new = [d for d in chunks if d not in table]
        for at in range(0, len(new), 256):
            some = new[at : at + 256]
            table.update(zip(some, self.plain([chunks[d].decode() for d in some])))
            self.encoded += sum(len(chunks[d]) for d in some)

    def transcode(self, texts: list[str], table: dict[bytes, np.ndarray] | None = None) -> tuple[list[np.ndarray], list[str]]:
        """The ids of texts, and what these decode to. The table holds what is known of chunks, and learns."""
        table = {} if table is None else table
        pieces, held = [], {}
        for text in texts:
            data = text.encode()
            self.asked += len(data)
            chunks, at_space = split(data, self.soft, self.hard)
            names = list(map(digest, chunks))
            held.update(zip(names, chunks))
            pieces.append((chunks, names, at_space))
        self.learn(table, held)
        ids = []
        for chunks, names, at_space in pieces:
            made = [table[d] for d in names]
            ids.append(np.concatenate(made if at_space.all() else self._repaired(chunks, made, at_space)))
        return ids, self.decode(ids)

    def _repaired(self, chunks: list[bytes], ids: list[np.ndarray], at_space: np.ndarray) -> list[np.ndarray]:
        """Joins that are not at a space are closed one after another, the closed part being the left chunk of the next."""
        done_text, done_ids, out = chunks[0], ids[0], []
        for chunk, x, soft in zip(chunks[1:], ids[1:], at_space):
            if soft:
                out.append(done_ids)
                done_text, done_ids = chunk, x
                continue
            done_ids = self._joined(done_text, done_ids, chunk, x)
            done_text += chunk
            self.repaired += 1
        return [*out, done_ids]

    def _joined(self, a: bytes, x: np.ndarray, b: bytes, y: np.ndarray) -> np.ndarray:
        i, j = a.rfind(b" "), b.find(b" ")
        while True:
            i, j = max(i, 0), j if j >= 0 else len(b)
            left, right, both = self.plain([a[i:].decode(), b[:j].decode(), (a[i:] + b[:j]).decode()])
            ends = len(left) <= len(x) and np.array_equal(x[len(x) - len(left) :], left)
            starts = len(right) <= len(y) and np.array_equal(y[: len(right)], right)
            if ends and starts:
                return np.concatenate([x[: len(x) - len(left)], both, y[len(right) :]])
            if not ends:  # at the text's ends both always agree
                i = a.rfind(b" ", 0, i)
            if not starts:
                j = b.find(b" ", j + 1)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return self.transcode(texts)[0]

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        if self.joins:
            tokens = self.tokens
            return [" ".join([tokens[i] for i in x.tolist()]) for x in ids]
        return self.tokenizer.decode_batch([x.tolist() for x in ids], skip_special_tokens=False)


@functools.cache
def codec(path: str) -> Codec:
    # A worker has one core; more threads would only give it more memory to hold.
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Codec(path)


def _halves(digests: list[bytes]) -> list[np.ndarray]:
    both = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
    return [np.ascontiguousarray(both[:, k]) for k in (0, 1)]


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Half the digests of the chunks of this partition, each once for a group."""
    for b in batches:
        seen: dict[int, set[bytes]] = {}
        for g, data in zip(b["g"].to_pylist(), pc.cast(b["text"], pa.binary()).to_pylist()):
            seen.setdefault(g, set()).update(map(digest, split(data)[0]))
        half = [np.unique(_halves(list(digests))[0]) for digests in seen.values()]
        groups = [np.full(len(x), g, np.int32) for g, x in zip(seen, half)]
        if half:
            yield pa.record_batch([pa.array(np.concatenate(half)), pa.array(np.concatenate(groups))], names=["a", "g"])


def _first(path: str):
    """Encodes the chunks of a group that other groups have too and wait for."""

    def run(key: tuple, texts: pa.Table, notes: pa.Table) -> pa.Table:
        table: dict[bytes, np.ndarray] = {}
        if notes.num_rows and texts.num_rows:
            wanted, found = {a.to_bytes(8, "little", signed=True) for a in notes["a"].to_pylist()}, {}
            for data in pc.cast(texts["text"], pa.binary()).to_pylist():
                for c in split(data)[0]:
                    if (d := digest(c))[:8] in wanted:
                        found[d] = c
            codec(path).learn(table, found)
        a, b = map(pa.array, _halves(list(table)))
        return pa.table([a, b, pa.array([x.astype(codec(path).kind).tobytes() for x in table.values()], pa.binary())], names=["a", "b", "ids"])

    return run


def _group(path: str, decoded: bool, kind: pa.DataType):
    """Encodes the texts of a group, with the ids of its shared chunks at hand."""

    def run(key: tuple, texts: pa.Table, notes: pa.Table) -> pa.Table:
        mine = codec(path)
        names = np.stack([notes[c].to_numpy() for c in ("a", "b")], axis=1).astype("<i8").tobytes() if notes.num_rows else b""
        table = {names[16 * i : 16 * i + 16]: np.frombuffer(x, mine.kind).astype(np.int32) for i, x in enumerate(notes["ids"].to_pylist())}
        out = []
        for at in range(0, texts.num_rows, 256):
            part = texts.slice(at, 256)
            ids, said = mine.transcode(part["text"].to_pylist(), table)
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, ids)]), pa.int32()), pa.array(np.concatenate(ids)))
            out.append(pa.table([part["id"], lists, *([pa.array(said, pa.string())] * decoded)], names=["id", "ids", *(["text"] * decoded)]))
        fields = [pa.field("id", kind), pa.field("ids", pa.list_(pa.int32())), *([pa.field("text", pa.string())] * decoded)]
        return pa.concat_tables(out) if out else pa.schema(fields).empty_table()

    return run


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = codec(path)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                ids = [np.array(x, np.int32) for x in b["ids"].slice(at, 256).to_pylist()]
                yield pa.record_batch([b["id"].slice(at, 256), b["ids"].slice(at, 256), pa.array(mine.decode(ids), pa.string())], names=["id", "ids", "text"])

    return run


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, decoded: bool = False, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """id, ids (the token ids) for every row; with `decoded`, also the text that the ids decode to."""
    spark, path = df.sparkSession, tokenizer or default_tokenizer()
    small_batches(spark)
    kind = df.schema[id_col].dataType.simpleString()
    text = text_or_empty(text_col)
    total, tasks = df.select(F.sum(F.octet_length(text))).first()[0], spark.sparkContext.defaultParallelism
    n = max(parts(total, group_bytes), 2 * tasks)
    place = F.when(F.col(id_col).isNull(), F.monotonically_increasing_id())
    g = F.pmod(F.xxhash64(F.col(id_col), text, place), F.lit(n)).cast("int")
    rows = df.select(F.col(id_col).alias("id"), text.alias("text"), g.alias("g"))
    # Chunks that agree in half a digest are told apart in the end: the other half comes with the ids.
    alike = Window.partitionBy("a")
    held = rows.mapInArrow(_held, "a long, g int").repartition(max(parts(total, HELD_BYTES), tasks), "a")
    held = held.withColumns({"first": F.min("g").over(alike), "last": F.max("g").over(alike)})
    shared = durable(held.filter("first < last").select("a", "g", "first").distinct(), "shared-chunks")
    texts = rows.repartition(n, "g")
    waited = shared.filter("g = first").select("a", "g").repartition(n, "g")
    first = texts.groupBy("g").cogroup(waited.groupBy("g")).applyInArrow(_first(path), _IDS)
    notes = shared.select("a", "g").join(first, "a").select("g", "a", "b", "ids").repartition(n, "g")
    arrow = to_arrow_type(df.schema[id_col].dataType)
    return texts.groupBy("g").cogroup(notes.groupBy("g")).applyInArrow(_group(path, decoded, arrow), f"id {kind}, ids array<int>" + ", text string" * decoded)


def decode(df: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """A frame of (id, ids) with the decoded text."""
    return df.mapInArrow(_decode(tokenizer or default_tokenizer()), f"id {df.schema['id'].dataType.simpleString()}, ids array<int>, text string")


def op8_bpe(docs: DataFrame) -> DataFrame:
    """The contract's result: encoded, decoded, and both as digests."""
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return encode(docs, decoded=True).select(
        F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256")
    )
