"""One audio file read: its tags, playing time and audio range, and the values of the concepts the tags hold."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from decimal import Decimal
from typing import Any

from pyarrow import fs

from ..functions import interpret
from ..functions.text import trimmed
from . import flac, mpeg
from .tags import Condition, Field, Tag, Unreadable, content, description, description_and_values, edges, vorbis, with_sources
from .window import SEARCH, SNIFF, STRUCTURE, Bounded, Policy, Stream

FORMATS = ("mp3", "flac")
SOURCES = ("vorbis", "ape", "id3v2", "id3v1")  # in order of preference
# The fields in which each format holds the concepts.
CONCEPTS: dict[str, tuple[str, dict[str, str]]] = {
    "artist": ("string", {"vorbis": "ARTIST", "ape": "Artist", "id3v2": "TPE1", "id3v1": "artist"}),
    "album": ("string", {"vorbis": "ALBUM", "ape": "Album", "id3v2": "TALB", "id3v1": "album"}),
    "genre": ("string", {"vorbis": "GENRE", "ape": "Genre", "id3v2": "TCON", "id3v1": "genre"}),
    "title": ("string", {"vorbis": "TITLE", "ape": "Title", "id3v2": "TIT2", "id3v1": "title"}),
    "track": ("number", {"vorbis": "TRACKNUMBER", "ape": "Track", "id3v2": "TRCK", "id3v1": "track"}),
    "year": ("number", {"vorbis": "DATE", "ape": "Year", "id3v2": "TDRC", "id3v1": "year"}),
}


@dataclass
class Layout:
    format: str
    tags: list[Tag]
    audio: tuple[int, int] | None  # the first frame, and where the trailing tags begin
    why: str  # there is no audio
    playing: mpeg.Playing
    conditions: list[Condition] = field(default_factory=list)
    summary: mpeg.Summary | None = None
    info: flac.StreamInfo | None = None

    @property
    def incomplete(self) -> bool:
        return any(c.incomplete for c in self.conditions)

    def source(self, format: str) -> Tag | None:
        return next((t for t in self.tags if t.format == format and t.source and t.state != "unusable"), None)


def analysed(r: Bounded, format: str) -> Layout:
    tags: list[Tag] = []
    conditions: list[Condition] = []
    edge = edges(r, tags, conditions)
    out = Layout(format, tags, None, "", mpeg.Playing(problem="no-frames"), conditions)
    found = _mpeg(r, edge, out) if format == "mp3" else _flac(r, edge, out)
    if isinstance(found, bool):
        out.why = "search-gave-up" if found else "no-frame"
    else:
        out.audio = (found, edge.tail)
        if out.playing.problem:
            conditions.append(Condition("duration-unusable", -1, out.playing.problem))
    out.tags = with_sources(tags, conditions)
    conditions += [Condition("read-limit-reached", -1, p) for p in (SNIFF, STRUCTURE, SEARCH) if p in r.refused]
    return out


def _mpeg(r: Bounded, edge, out: Layout) -> int | bool:
    found = mpeg.search(r, edge.head, edge.tail, edge.tail)
    if isinstance(found, bool):
        return found
    if edge.trusted and found[0] > edge.head:
        out.conditions.append(Condition("junk-before-audio", edge.head))
    out.playing, out.summary = mpeg.duration(r, found[0], edge.tail, out.conditions)
    return found[0]


def _flac(r: Bounded, edge, out: Layout) -> int | bool:
    at = flac.marker(r, edge.head, edge.tail)
    if isinstance(at, bool):
        return at
    if edge.trusted and at > edge.head:
        out.conditions.append(Condition("junk-before-audio", edge.head))
    blocks = flac.chain(r, at + 4, out.conditions)
    out.info = blocks.info
    for listed, begin, end in blocks.comments:
        found = vorbis(r, listed, begin, end)
        out.tags.append(found.tag)
        out.conditions.extend(found.conditions)
    first = blocks.end if blocks.end is not None else flac.first_frame(r, blocks.at, edge.tail, blocks.info)
    if isinstance(first, bool):
        return first
    if first >= edge.tail:
        return False
    out.playing = flac.duration(r, blocks.info, first, edge.tail, out.conditions)
    return first


# Values. A bag is a list in which None is an occurrence that can't be read; an empty one is absent.

Bag = list[Any]


def _texts(f: Field, limit: int) -> list[str] | None:
    try:
        return description_and_values(f, limit)[1]
    except Unreadable:
        return None


def fields_of(tag: Tag | None, key: str) -> list[Field]:
    """The fields a name reads: in APE the last of that key alone, in Vorbis also comments whose name doesn't decode."""
    if tag is None:
        return []
    if tag.format in ("id3v2", "id3v1"):
        return [f for f in tag.fields if f.key == key]
    same = [f for f in tag.fields if f.nameless or f.key.upper() == key.upper()]
    return same[-1:] if tag.format == "ape" else same


def field_values(tag: Tag | None, key: str, said: str | None, limit: int) -> Bag:
    """What field() reads: the text as recorded; with a description, of the frames that have it or can't tell."""
    out: Bag = []
    for f in fields_of(tag, key):
        if said is not None:
            try:
                own = description(f, limit)
            except Unreadable:
                out.append(None)
                continue
            if own is not None and own.upper() != said.upper():
                continue
        texts = None if f.nameless else _texts(f, limit)
        out += [None] if texts is None else texts
    return out


def byte_values(tag: Tag | None, key: str, limit: int) -> Bag:
    """What bytes() reads: the content as recorded, one for each field."""
    out: Bag = []
    for f in fields_of(tag, key):
        try:
            out.append(None if f.nameless else content(f, limit))
        except Unreadable:
            out.append(None)
    return out


def _interpreted(concept: str, format: str, text: str) -> Bag:
    if concept == "track":
        return [_number(interpret.track(text))]
    if concept == "year":
        return [_number(interpret.year(text))]
    if concept == "genre" and format == "id3v2":
        return list(interpret.genres(text))
    return [trimmed(text)] if trimmed(text) else []


def _number(n: int | None) -> Decimal | None:
    return None if n is None else Decimal(n)


def concept_values(tag: Tag | None, concept: str, format: str, limit: int) -> Bag:
    key = CONCEPTS[concept][1][format]
    out: Bag = []
    for f in fields_of(tag, key):
        if f.form == "byte":
            b = f.stored()[0]
            if concept == "track":
                out += [Decimal(b)] if b else []
            elif b != interpret.NO_GENRE:
                out.append(interpret.GENRES[b] if b < len(interpret.GENRES) else None)
            continue
        texts = None if f.nameless else _texts(f, limit)
        if texts is None:
            out.append(None)
        elif not (f.form == "padded" and texts == [""]):
            out += [x for t in texts for x in _interpreted(concept, format, t)]
    return out


# Hashes


def audio_bytes(layout: Layout, pull: Callable[[int, int], bytes], faults: list | None = None) -> tuple[int, int]:
    """The range of bytes that are audio, whatever tags surround them."""
    at, end = layout.audio
    s = Stream(pull, end)
    if layout.format == "mp3":
        return mpeg.audio_range(s, at, end, layout.playing, layout.summary)
    return flac.audio_range(s, at, end, layout.info, faults)


def digest(layout: Layout, pull: Callable[[int, int], bytes], algorithm: str = "md5", block: int = 80 << 10) -> str:
    start, stop = audio_bytes(layout, pull)
    h = hashlib.new(algorithm)
    for at in range(start, stop, block):
        piece = pull(at, min(block, stop - at))
        if len(piece) != min(block, stop - at):
            raise OSError("the file changed while it was being read")
        h.update(piece)
    return h.hexdigest()


def opened(path: str, policy: Policy = Policy()) -> tuple[Bounded, Callable[[int, int], bytes], Callable[[], None]]:
    """A file of this machine, or of any store that Arrow knows by the address's scheme, read by ranges alone."""
    if "://" in path and not path.startswith("file:"):
        store, inside = fs.FileSystem.from_uri(path)
        remote = store.open_input_file(inside)
        return Bounded(remote.size(), lambda at, n: remote.read_at(n, at), policy), lambda at, n: remote.read_at(n, at), remote.close
    handle = open(re.sub("^file:/+", "/", path), "rb")  # noqa: SIM115
    length = handle.seek(0, 2)

    def pull(at: int, n: int) -> bytes:
        handle.seek(at)
        return handle.read(n)

    return Bounded(length, pull, policy), pull, handle.close
