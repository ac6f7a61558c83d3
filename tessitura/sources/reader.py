"""Audio files as a frame: one row each, with what a predicate asked for.

The reader runs once for each file in an Arrow map, opens it, reads its edges within the policy's budgets, and gives the
concepts, the requested fields and the playing time. What no expression uses is not read: the plan of columns is made
from the compiled predicate before any file is opened.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.catalog import Catalog, Identifier, Rejected, SourceFunction, present
from . import audio
from .discover import base_name, extension, extension_column
from .tags import DESCRIBED, KEPT, RENAMED, frame_form
from .window import Policy, in_memory

_NUMBER = "decimal(29,0)"


@dataclass(frozen=True, order=True)
class Request:
    """Something to read of a tag source: a concept, a field's text or its bytes."""

    kind: str  # concept, field or bytes
    source: str
    key: str
    description: str = "\0"  # \0: any

    @property
    def column(self) -> str:
        return f"{self.kind}_{self.source}_" + "".join(f"{ord(c):x}_" for c in self.key + self.description) if self.kind != "concept" else f"{self.source}_{self.key}"

    @property
    def element(self) -> str:
        if self.kind == "bytes":
            return "binary"
        return _NUMBER if self.kind == "concept" and audio.CONCEPTS[self.key][0] == "number" else "string"


@dataclass
class Requests:
    wanted: set[Request] = field(default_factory=set)
    duration: bool = False

    def column(self, r: Request) -> Column:
        self.wanted.add(r)
        return present(F.col(r.column))


class AudioCatalog(Catalog):
    """The identifiers of audio files. What a predicate looks up is noted in `requests`, for the reader."""

    def __init__(self):
        self.requests = Requests()
        path = F.regexp_replace(F.col("path"), "^file:/*", "/")
        file = {
            "path": Identifier("file::path", "string", path, spark_type="string", unreadable=False),
            "name": Identifier("file::name", "string", base_name(path), spark_type="string", unreadable=False),
            "extension": Identifier("file::extension", "string", extension_column(base_name(path)), False, spark_type="string", unreadable=False),
            "size": Identifier("file::size", "bytecount", F.col("size"), spark_type="bigint", unreadable=False),
            "duration": Identifier("file::duration", "duration", F.col("duration"), opens=True, spark_type="bigint"),
        }
        known: dict[tuple[str | None, str], Identifier] = {("file", k): v for k, v in file.items()}
        for concept, (kind, cells) in audio.CONCEPTS.items():
            known[None, concept] = Identifier(concept, kind, F.lit(None), False, True, True, True, True)
            for source in cells:
                known[source, concept] = Identifier(f"{source}::{concept}", kind, F.lit(None), False, source != "id3v1", True, True, True)
        functions = {(s, n): self._function(s, n) for s in ("id3v2", "ape", "vorbis") for n in ("field", "bytes")}
        super().__init__(known, functions)

    def lookup(self, source, name):
        found = super().lookup(source, name)
        if not isinstance(found, Identifier) or not found.opens:
            return found
        if found.name == "file::duration":
            self.requests.duration = True
            return found
        concept, number = name.lower(), found.type == "number"
        cells = [source.lower()] if source else list(audio.SOURCES)
        bags = [self.requests.column(Request("concept", s, concept)) for s in cells]
        bags = [F.transform(b, lambda x: x.cast("decimal(38,9)")) if number else b for b in bags]
        usable = [F.when(F.exists(b, lambda x: x.isNotNull()), b) for b in bags]
        column = bags[0] if source else F.coalesce(*usable, *bags)
        return Identifier(found.name, found.type, column, False, found.several, True, True, True)

    def _function(self, source: str, name: str) -> SourceFunction:
        text = name == "field"
        several = text or source != "ape"

        def resolve(args: tuple[str, ...]) -> Identifier | Rejected:
            key = args[0]
            if source == "id3v2":
                key = key.upper()
                if key in RENAMED:
                    return Rejected(0, f"{args[0]} is read as {RENAMED[key]}", RENAMED[key])
                if not (key.isascii() and key.isalnum() and (len(key) == 4 or key in KEPT)):
                    return Rejected(0, f"{args[0]} isn't a frame identifier")
                if text and frame_form(key) == "binary":
                    return Rejected(0, f"{key} holds no text")
                if len(args) > 1 and key not in DESCRIBED:
                    return Rejected(1, f"{key} carries no description")
            else:
                key = key.upper()
            r = Request(name, source, key, args[1].upper() if len(args) > 1 else "\0")
            shown = f"{source}::{name}({', '.join([key, *[a.upper() for a in args[1:]]])})"
            return Identifier(shown, "string" if text else "blob", self.requests.column(r), False, several, True, True, True)

        return SourceFunction(f"{source}::{name}", "string" if text else "blob", several, 1, 2 if source == "id3v2" and text else 1, resolve)


def _schema(requests: list[Request], hashed: bool) -> str:
    extra = [f"`{r.column}` array<{r.element}>" for r in requests] + ["hash string"] * hashed
    conditions = "conditions array<struct<kind:string,at:bigint,reason:string>>"
    return ", ".join(["path string", "size bigint", "error string", "readable boolean", "duration bigint", "incomplete boolean", conditions, *extra])


_CONDITION = pa.struct([("kind", pa.string()), ("at", pa.int64()), ("reason", pa.string())])
_KINDS = {"string": pa.string(), "binary": pa.binary(), _NUMBER: pa.decimal128(29, 0)}


def _row(path: str, whole: bytes | None, requests: list[Request], algorithm: str | None, policy: Policy) -> dict:
    out = {"path": path, "size": None, "error": None, "readable": False, "duration": None, "incomplete": False, "conditions": [], "hash": None}
    ext = (extension(os.path.basename(path)) or "").lower()
    close = None
    try:
        if whole is None:
            r, pull, close = audio.opened(path, policy)
            out["size"] = r.length
        else:
            r = in_memory(whole, policy)
            out["size"], pull = len(whole), r.pull
        layout = audio.analysed(r, ext if ext in audio.FORMATS else "mp3")
        out["readable"], out["incomplete"] = layout.audio is not None, layout.incomplete
        out["error"] = None if layout.audio else {"mp3": "no MPEG audio found", "flac": "no FLAC audio found"}.get(ext)
        out["conditions"] = [{"kind": c.kind, "at": c.at, "reason": c.reason} for c in layout.conditions]
        out["duration"] = layout.playing.seconds
        for q in requests:
            tag = layout.source(q.source)
            if q.kind == "concept":
                bag = audio.concept_values(tag, q.key, q.source, policy.payload)
            elif q.kind == "field":
                bag = audio.field_values(tag, q.key, None if q.description == "\0" else q.description, policy.payload)
            else:
                bag = audio.byte_values(tag, q.key, policy.payload)
            out[q.column] = bag or None
        if algorithm and layout.audio:
            out["hash"] = audio.digest(layout, pull, algorithm)
    except OSError as e:
        out |= {"error": e.strerror or str(e), "readable": False}
    finally:
        if close:
            close()
    return out


def _reader(requests: list[Request], algorithm: str | None, policy: Policy, from_content: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            contents = b["content"].to_pylist() if from_content else [None] * b.num_rows
            rows = [_row(p, c, requests, algorithm, policy) for p, c in zip(b["path"].to_pylist(), contents)]
            pick = lambda k, t: pa.array([r.get(k) for r in rows], t)
            names = ["path", "size", "error", "readable", "duration", "incomplete", "conditions"]
            kinds = [pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.int64(), pa.bool_(), pa.list_(_CONDITION)]
            for q in requests:
                names.append(q.column)
                kinds.append(pa.list_(_KINDS[q.element]))
            if algorithm:
                names.append("hash")
                kinds.append(pa.string())
            yield pa.record_batch([pick(n, k) for n, k in zip(names, kinds)], names=names)

    return run


def layouts(files: DataFrame, requests: Requests | None = None, algorithm: str | None = None, policy: Policy = Policy()) -> DataFrame:
    """One row for each file of a frame of paths (or of paths and contents): its layout and what was requested of it."""
    wanted = sorted((requests or Requests()).wanted)
    from_content = "content" in files.columns
    source = files.select("path", *["content"] * from_content)
    return source.mapInArrow(_reader(wanted, algorithm, policy, from_content), _schema(wanted, bool(algorithm)))


_FAULTS = pa.schema([("path", pa.string()), ("kind", pa.string()), ("at", pa.int64()), ("number", pa.int64())])


def _faults_of(path: str, whole: bytes | None, policy: Policy) -> list[tuple]:
    close = None
    try:
        if whole is None:
            r, pull, close = audio.opened(path, policy)
        else:
            r = in_memory(whole, policy)
            pull = r.pull
        layout, found = audio.analysed(r, "flac"), []
        if layout.audio:
            audio.audio_bytes(layout, pull, found)
        return [(path, f.kind, f.at, f.number) for f in found]
    except OSError as e:
        return [(path, f"can't be read: {e.strerror or e}", None, None)]
    finally:
        if close:
            close()


def faults(files: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """path, kind, at, number: a row for each fault in the frames of the FLAC files of a frame of paths (or of paths and
    contents), in order of place; a file that can't be read is one row, a sound one none, and other formats are left out."""
    from_content = "content" in files.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            contents = b["content"].to_pylist() if from_content else [None] * b.num_rows
            rows = [x for p, c in zip(b["path"].to_pylist(), contents) for x in _faults_of(p, c, policy)]
            cols = list(zip(*rows)) or [[]] * 4
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(cols, _FAULTS)], schema=_FAULTS)

    flac = F.lower(extension_column(base_name(F.col("path")))) == "flac"
    return files.filter(flac).select("path", *["content"] * from_content).mapInArrow(run, "path string, kind string, at bigint, number bigint")
