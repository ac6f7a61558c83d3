"""Tags of audio files: ID3v2, APE, ID3v1, Vorbis comments and Lyrics3, as lists of fields.

Nothing here raises for damaged data: what can't be read becomes a condition of the file or an unreadable field.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import NamedTuple

from .window import PAYLOAD, SNIFF, STRUCTURE, Bounded

# The identifiers of older ID3v2 revisions and those they became; frames of v2.2 that have no successor.
RENAMED = {
    "IPLS": "TIPL", "TORY": "TDOR", "TYER": "TDRC", "BUF": "RBUF", "CNT": "PCNT", "COM": "COMM", "CRA": "AENC", "ETC": "ETCO",
    "GEO": "GEOB", "IPL": "TIPL", "MCI": "MCDI", "MLL": "MLLT", "POP": "POPM", "REV": "RVRB", "SLT": "SYLT", "STC": "SYTC",
    "TAL": "TALB", "TBP": "TBPM", "TCM": "TCOM", "TCO": "TCON", "TCR": "TCOP", "TDY": "TDLY", "TEN": "TENC", "TFT": "TFLT",
    "TKE": "TKEY", "TLA": "TLAN", "TLE": "TLEN", "TMT": "TMED", "TOA": "TOPE", "TOF": "TOFN", "TOL": "TOLY", "TOR": "TDOR",
    "TOT": "TOAL", "TP1": "TPE1", "TP2": "TPE2", "TP3": "TPE3", "TP4": "TPE4", "TPA": "TPOS", "TPB": "TPUB", "TRC": "TSRC",
    "TRK": "TRCK", "TSS": "TSSE", "TT1": "TIT1", "TT2": "TIT2", "TT3": "TIT3", "TXT": "TEXT", "TXX": "TXXX", "TYE": "TDRC",
    "UFI": "UFID", "ULT": "USLT", "WAF": "WOAF", "WAR": "WOAR", "WAS": "WOAS", "WCM": "WCOM", "WCP": "WCOP", "WPB": "WPUB",
    "WXX": "WXXX",
}
KEPT = frozenset(("CRM", "EQU", "LNK", "PIC", "RVA", "TDA", "TIM", "TRD", "TSI"))
DESCRIBED = frozenset(("TXXX", "WXXX", "COMM", "USLT"))
_TEXT_FRAMES = frozenset(("GRP1", "MVNM", "MVIN"))


class Condition(NamedTuple):
    kind: str
    at: int = -1
    reason: str = ""

    @property
    def incomplete(self) -> bool:
        return self.kind in ("tag-unusable", "tag-structure-broken", "read-limit-reached", "duration-unusable", "metadata-chain-lost")


@dataclass
class Field:
    """A field as recorded: `stored` gives its bytes, or None where they are too many."""

    key: str
    form: str
    stored: Callable[[], bytes | None]
    cut: bool = False  # its recorded size runs past the tag
    nameless: bool = False  # its name doesn't decode, so it might be any
    prefix: int = 0
    unsync: bool = False
    encrypted: bool = False
    packed: bool = False


@dataclass
class Tag:
    format: str
    revision: int
    start: int
    end: int
    state: str = "intact"  # intact, broken-off or unusable
    fields: list[Field] = field(default_factory=list)
    source: bool = True


@dataclass
class Found:
    tag: Tag
    conditions: list[Condition] = field(default_factory=list)
    sized: bool = True  # the recorded size can be trusted


def _unusable(format: str, revision: int, start: int, end: int, reason: str, sized: bool = False) -> Found:
    return Found(Tag(format, revision, start, end, "unusable"), [Condition("tag-unusable", start, reason)], sized)


def syncsafe(b: bytes) -> int:
    out = 0
    for x in b:
        out = out << 7 | x & 0x7F
    return out


def _is_syncsafe(b: bytes) -> bool:
    return max(b, default=0) < 0x80


def resynchronised(data: bytes) -> bytes:
    return data.replace(b"\xff\x00", b"\xff")


# ID3v2

_ID = {3: re.compile(rb"[A-Z0-9]{3}"), 4: re.compile(rb"[A-Z0-9]{4}")}


def frame_form(key: str) -> str:
    if key == "TXXX":
        return "described-text"
    if key in ("COMM", "USLT"):
        return "language-text"
    if key == "WXXX":
        return "described-url"
    if key in _TEXT_FRAMES or key[0] == "T":
        return "text"
    return "url" if key[0] == "W" else "binary"


class _Frames:
    """The frames of one ID3v2 tag; positions count from the body's start."""

    def __init__(self, r: Bounded, revision: int, start: int, size: int, unsync: bool, memory: bytes | None):
        self.r, self.revision, self.start, self.memory, self.unsync = r, revision, start, memory, unsync
        self.size = size if memory is None else len(memory)
        self.head, self.id = (6, 3) if revision == 2 else (10, 4)
        self.fields: list[Field] = []
        self.conditions: list[Condition] = []

    def peek(self, at: int, n: int) -> bytes | None:
        if self.memory is None:
            return self.r.read(STRUCTURE, self.start + at, n)
        return self.memory[at : at + n] if 0 <= at and at + n <= self.size else None

    def stored(self, at: int, n: int) -> Callable[[], bytes | None]:
        if self.memory is not None:
            return lambda: self.memory[at : at + n]
        return lambda: self.r.read(PAYLOAD, self.start + at, n)

    def broken(self, at: int, reason: str) -> str:
        self.conditions.append(Condition("tag-structure-broken", self.start + at, reason))
        return "broken-off"

    def length(self, header: bytes, safe: bool) -> int:
        if self.revision == 2:
            return int.from_bytes(header[3:6], "big")
        return syncsafe(header[4:8]) if safe else int.from_bytes(header[4:8], "big")

    def clean(self, at: int, safe: bool) -> bool:
        """Whether all frames from here read well with sizes of this kind."""
        begun = at
        while at + 10 <= self.size:
            header = self.peek(at, 10)
            if header is None or header[0] and not _ID[4].match(header):
                return False
            if not header[0]:
                return at > begun
            at += 10 + self.length(header, safe)
        return at == self.size

    def stepped(self, at: int, safe: bool) -> int | None:
        """Past a frame with an illegal identifier, if a frame, padding or the end follows it."""
        header = self.peek(at, 10) if at + 10 <= self.size else None
        if header is None or not all(0x20 <= b <= 0x7E for b in header[:4]):
            return None
        after = at + 10 + self.length(header, safe)
        if after == self.size:
            return after
        following = self.peek(after, min(4, self.size - after)) if after < self.size else None
        return after if following and (following[0] == 0 or _ID[4].fullmatch(following)) else None

    def padding_holds_data(self, at: int) -> bool:
        if self.memory is None and not self.r.affordable(STRUCTURE, self.start + at, self.size - at):
            return False
        step = 1 << 16
        return any((self.peek(i, min(step, self.size - i)) or b"").strip(b"\0") for i in range(at, self.size, step))

    def flags(self, header: bytes) -> dict:
        if self.revision == 2:
            return {}
        bits = header[9]
        if self.revision == 3:
            packed, secret, group = bool(bits & 0x80), bool(bits & 0x40), bool(bits & 0x20)
            return {"prefix": 4 * packed + secret + group, "encrypted": secret, "packed": packed}
        group, packed, secret, unsync, sized = (bool(bits & b) for b in (0x40, 0x08, 0x04, 0x02, 0x01))
        return {"prefix": group + secret + 4 * sized, "encrypted": secret, "packed": packed, "unsync": unsync or self.unsync}

    def walk(self, extended: bool) -> str:
        at = 0
        if extended:
            size = self.peek(0, 4)
            at = 0 if size is None else syncsafe(size) if self.revision == 4 else int.from_bytes(size, "big") + 4
            if not 6 <= at <= self.size:
                return self.broken(0, "extended-header-runs-past-tag")
        safe = self.revision == 4
        if safe and not self.clean(at, True) and self.clean(at, False):
            safe = False
            self.conditions.append(Condition("quirk-applied", self.start + at, "plain-frame-sizes"))
        while at + self.head <= self.size:
            header = self.peek(at, self.head)
            if header is None:
                return self.broken(at, "read-limit-reached")
            if not header[0]:
                return self.broken(at, "data-after-padding") if self.padding_holds_data(at) else "intact"
            if not _ID[self.id].match(header):
                after = self.stepped(at, safe) if self.revision > 2 else None
                if after is None:
                    return self.broken(at, "no-frame-identifier")
                self.conditions.append(Condition("quirk-applied", self.start + at, "illegal-frame-identifier-stepped-over"))
                at = after
                continue
            key = header[: self.id].decode()
            key = RENAMED.get(key, key)
            begin, n = at + self.head, self.length(header, safe)
            if n > self.size - begin:
                self.fields.append(Field(key, frame_form(key), self.stored(begin, self.size - begin), cut=True))
                return self.broken(at, "field-runs-past-tag")
            self.fields.append(Field(key, frame_form(key), self.stored(begin, n), **self.flags(header)))
            at = begin + n
        return "intact"


def id3v2(r: Bounded, at: int) -> Found | None:
    header = r.read(SNIFF, at, 10)
    if header is None or header[:3] != b"ID3":
        return None
    revision, bits, size = header[3], header[5], syncsafe(header[6:])
    if not 2 <= revision <= 4:
        return _unusable("id3v2", revision, at, at + 10, "unknown-version")
    if not _is_syncsafe(header[6:]):
        return _unusable("id3v2", revision, at, at + 10, "size-not-syncsafe")
    end = at + 10 + size + (10 if revision == 4 and bits & 0x10 else 0)
    if end > r.length:
        return _unusable("id3v2", revision, at, at + 10, "size-outside-file")
    if revision == 2 and bits & 0x40:
        return _unusable("id3v2", revision, at, end, "undefined-compression", True)
    memory = None
    if bits & 0x80 and revision < 4:
        raw = r.read(STRUCTURE, at + 10, size)
        if raw is None:
            return _unusable("id3v2", revision, at, end, "too-large-to-resynchronise", True)
        memory = resynchronised(raw)
    frames = _Frames(r, revision, at + 10, size, revision == 4 and bool(bits & 0x80), memory)
    state = frames.walk(bool(bits & 0x40) and revision >= 3)
    return Found(Tag("id3v2", revision, at, end, state, frames.fields), frames.conditions)


# APE

_PREAMBLE = struct.Struct("<8sIIII8x")


def _preamble(r: Bounded, at: int) -> tuple[int, int, int, int] | None:
    raw = r.read(SNIFF, at, 32)
    if raw is None or not raw.startswith(b"APETAGEX"):
        return None
    _, version, size, count, bits = _PREAMBLE.unpack(raw)
    return (2 if version >= 2000 else 1), size, count, bits


def ape_before(r: Bounded, end: int, floor: int) -> Found | None:
    """The APE tag whose footer ends at `end`."""
    foot = end - 32
    read = _preamble(r, foot) if foot >= floor else None
    if read is None or read[3] & 0x20000000:
        return None
    revision, size, count, bits = read
    items = end - size
    start = items - 32 * bool(bits & 0x80000000)
    if size < 32 or start < floor:
        return _unusable("ape", revision, foot, end, "size-outside-file")
    tag = Tag("ape", revision, start, end)
    at = items
    for _ in range(count):
        reason = None
        head = r.read(STRUCTURE, at, min(foot - at, 264)) if at + 8 <= foot else None
        stop = -1 if head is None else head.find(b"\0", 8)
        if at + 8 > foot:
            reason = "item-count-too-high"
        elif head is None:
            reason = "read-limit-reached"
        elif stop < 0:
            reason = "item-key-unterminated"
        else:
            n, item = struct.unpack_from("<II", head)
            begin = at + stop + 1
            form = "latin1" if revision == 1 else "utf8" if item >> 1 & 3 in (0, 2) else "binary"
            cut = n > foot - begin
            span = (begin, foot - begin if cut else n)
            tag.fields.append(Field(head[8:stop].decode("latin-1"), form, lambda s=span: r.read(PAYLOAD, *s), cut=cut))
            reason = "field-runs-past-tag" if cut else None
        if reason:
            tag.state = "broken-off"
            return Found(tag, [Condition("tag-structure-broken", at, reason)])
        at = begin + n
    return Found(tag)


def ape_at(r: Bounded, at: int) -> Found | None:
    """The APE tag whose header begins here."""
    read = _preamble(r, at)
    if read is None or not read[3] & 0x20000000:
        return None
    end = at + 32 + read[1]
    if end > r.length:
        return _unusable("ape", read[0], at, at + 32, "size-outside-file")
    found = ape_before(r, end, at)
    return found if found and found.tag.start == at else _unusable("ape", read[0], at, end, "no-footer", True)


# ID3v1, Lyrics3, Vorbis


def id3v1(r: Bounded, at: int) -> Found | None:
    raw = r.read(SNIFF, at, 128)
    if raw is None or not raw.startswith(b"TAG"):
        return None
    tracked = raw[125] == 0 != raw[126]
    places = [("title", 3, 30), ("artist", 33, 30), ("album", 63, 30), ("year", 93, 4), ("comment", 97, 28 if tracked else 30)]
    fields = [Field(k, "padded", lambda x=raw[a : a + n]: x) for k, a, n in places]
    fields += [Field("track", "byte", lambda: raw[126:127])] * tracked + [Field("genre", "byte", lambda: raw[127:128])]
    return Found(Tag("id3v1", int(tracked), at, at + 128, "intact", fields))


def lyrics3(r: Bounded, end: int, floor: int) -> Found | None:
    foot = r.read(SNIFF, end - 15, 15) if end - 15 >= floor else None
    if foot is None or not (m := re.fullmatch(rb"([0-9]{6})LYRICS200", foot)):
        return None
    start = end - 15 - int(m[1])
    begins = start >= floor and r.read(SNIFF, start, 11) == b"LYRICSBEGIN"
    return Found(Tag("lyrics3", 2, start, end)) if begins else None


def appended_id3v2(r: Bounded, end: int, floor: int) -> Found | None:
    foot = r.read(SNIFF, end - 10, 10) if end - 10 >= floor else None
    if foot is None or foot[:3] != b"3DI" or not _is_syncsafe(foot[6:]):
        return None
    at = end - 20 - syncsafe(foot[6:])
    found = id3v2(r, at) if at >= floor else None
    return found if found and found.sized and found.tag.end == end else None


class Comments(NamedTuple):
    """A comment list read on, whatever its block's length says."""

    vendor_end: int | None
    items: list[tuple[int, int, int, bytes | None]]  # where it is recorded, its start and end, the bytes up to "=", or None without one
    end: int | None
    broken_at: int
    refused: bool


def comment_list(r: Bounded, start: int, limit: int) -> Comments:
    items: list[tuple[int, int, int, bytes | None]] = []

    def number(at: int) -> tuple[int | None, bool]:
        raw = r.read(STRUCTURE, at, 4) if at + 4 <= limit else b""
        return (None, raw is None) if not raw else (int.from_bytes(raw, "little"), False)

    n, refused = number(start)
    if n is None:
        return Comments(None, items, None, start, refused)
    vendor_end = start + 4 + n
    count, refused = number(vendor_end)
    if count is None:
        return Comments(vendor_end, items, None, vendor_end, refused)
    at = vendor_end + 4
    for _ in range(count):
        n, refused = number(at)
        if n is None:
            return Comments(vendor_end, items, None, at, refused)
        begin, end = at + 4, at + 4 + n
        there = min(end, limit) - begin
        head = r.read(STRUCTURE, begin, min(there, 256))
        if head is not None and b"=" not in head and there > 256:
            head = r.read(STRUCTURE, begin, there)
        if head is None:
            return Comments(vendor_end, items, None, at, True)
        items.append((at, begin, end, head.partition(b"=")[0] if b"=" in head else None))
        if end > limit:
            return Comments(vendor_end, items, None, at, False)
        at = end
    return Comments(vendor_end, items, at, at, False)


def vorbis(r: Bounded, found: Comments, start: int, end: int) -> Found:
    """A comment list as the tag of the block from start to end."""
    if found.vendor_end is None or found.vendor_end > end:
        if found.refused:
            return Found(Tag("vorbis", 1, start, end, "unusable"), [Condition("read-limit-reached", start, STRUCTURE)])
        return _unusable("vorbis", 1, start, end, "vendor-runs-past-tag", True)
    tag, conditions, broken = Tag("vorbis", 1, start, end), [], None
    for at, begin, stop, name in found.items:
        try:
            key = None if name is None else name.decode()
        except UnicodeDecodeError:
            key = None
        value = begin + len(name or b"") + 1
        span = (value, stop - value)
        if stop > end:
            if key is not None:
                tag.fields.append(Field(key, "utf8-one", lambda: None, cut=True))
            broken = Condition("tag-structure-broken", at, "field-runs-past-tag")
            break
        if name is None:
            conditions.append(Condition("comment-without-name", at))
            continue
        tag.fields.append(Field(key or "", "utf8-one", lambda s=span: r.read(PAYLOAD, *s), nameless=key is None))
    if not broken and found.end is None:
        broken = Condition("tag-structure-broken", found.broken_at, "read-limit-reached" if found.refused else "field-runs-past-tag")
    elif not broken and found.end < end:
        broken = Condition("tag-structure-broken", found.end, "bytes-after-last-comment")
    if broken:
        conditions.append(broken)
        tag.state = "broken-off"
    return Found(tag, conditions)


# The edges of a file


class Edges(NamedTuple):
    head: int  # where the leading tags end
    trusted: bool  # whether that is certain
    tail: int  # where the trailing tags begin


def edges(r: Bounded, tags: list[Tag], conditions: list[Condition]) -> Edges:
    def keep(found: Found) -> Found:
        tags.append(found.tag)
        conditions.extend(found.conditions)
        return found

    head, trusted = 0, True
    while trusted and (found := id3v2(r, head) or ape_at(r, head)):
        head, trusted = keep(found).tag.end, found.sized
    tail, seen = r.length, False
    while True:
        found = id3v1(r, tail - 128) if not seen and tail - 128 >= head else None
        seen |= found is not None
        found = found or lyrics3(r, tail, head) or ape_before(r, tail, head) or appended_id3v2(r, tail, head)
        if not found:
            return Edges(head, trusted, tail)
        tail = keep(found).tag.start


def with_sources(tags: list[Tag], conditions: list[Condition]) -> list[Tag]:
    """In order of position, the first tag of each format marked as its source."""
    seen: set[str] = set()
    out = []
    for t in sorted(tags, key=lambda t: t.start):
        if t.format in seen:
            conditions.append(Condition("further-tag", t.start, t.format))
        out.append(replace(t, source=t.format not in seen))
        seen.add(t.format)
    return out


# Values of fields


class Unreadable(Exception):
    pass


def content(f: Field, limit: int) -> bytes:
    """The bytes of a field with its transformations undone, or Unreadable with the reason."""
    if f.cut:
        raise Unreadable("runs-past-tag")
    raw = f.stored()
    if raw is None:
        raise Unreadable("too-large")
    if f.prefix > len(raw):
        raise Unreadable("shorter-than-its-flags")
    raw = raw[f.prefix :]
    raw = resynchronised(raw) if f.unsync else raw
    if f.encrypted:
        raise Unreadable("encrypted")
    if not f.packed:
        return raw
    try:
        unpack = zlib.decompressobj()
        out = unpack.decompress(raw, limit + 1)
    except zlib.error:
        raise Unreadable("does-not-decompress") from None
    if len(out) > limit:
        raise Unreadable("too-large")
    return out


class _Text:
    """The text of one ID3v2 frame; a byte order mark holds for the values after it."""

    def __init__(self, raw: bytes):
        if not raw:
            raise Unreadable("no-encoding")
        if raw[0] > 3:
            raise Unreadable("unknown-encoding")
        self.code, self.wide, self.big = raw[0], raw[0] in (1, 2), raw[0] == 2

    def until(self, raw: bytes) -> int:
        if not self.wide:
            return raw.find(b"\0")
        at = raw.find(b"\0\0")
        while at > 0 and at % 2:
            at = raw.find(b"\0\0", at + 1)
        return at

    def decode(self, raw: bytes) -> str:
        if self.wide and len(raw) % 2:
            raise Unreadable("does-not-decode")
        if self.code == 1 and raw[:2] in (b"\xff\xfe", b"\xfe\xff"):
            self.big, raw = raw[0] == 0xFE, raw[2:]
        name = "latin-1" if self.code == 0 else "utf-8" if self.code == 3 else "utf-16-be" if self.big else "utf-16-le"
        try:
            return raw.decode(name)
        except UnicodeDecodeError:
            raise Unreadable("does-not-decode") from None

    def values(self, raw: bytes) -> list[str]:
        out = []
        while True:
            at = self.until(raw)
            out.append(self.decode(raw if at < 0 else raw[:at]))
            raw = raw[at + 1 + self.wide :] if at >= 0 else b""
            if not raw:
                return out


def description_and_values(f: Field, limit: int) -> tuple[str | None, list[str]]:
    """A field's description, where its kind has one, and its values; Unreadable with the reason, "not-text" among them."""
    if f.form in ("binary", "byte"):
        raise Unreadable("not-text")
    raw = content(f, limit)
    try:
        if f.form in ("url", "latin1"):
            text = raw.decode("latin-1")
            return None, [text] if f.form == "url" else text.split("\0")
        if f.form == "utf8":
            return None, raw.decode().split("\0")
        if f.form == "utf8-one":
            return None, [raw.decode()]
    except UnicodeDecodeError:
        raise Unreadable("does-not-decode") from None
    if f.form == "padded":
        return None, [raw.partition(b"\0")[0].decode("latin-1").rstrip(" ")]
    text, rest, said = _Text(raw), raw[1:], None
    if f.form != "text":
        said, rest = _described(f, text, rest)
    if f.form == "described-url":
        return said, [rest.decode("latin-1")]
    return said, text.values(rest)


def _described(f: Field, text: _Text, rest: bytes) -> tuple[str, bytes]:
    if f.form == "language-text":
        if len(rest) < 3:
            raise Unreadable("no-language")
        rest = rest[3:]
    at = text.until(rest)
    if at < 0:
        raise Unreadable("description-unterminated")
    return text.decode(rest[:at]), rest[at + 1 + text.wide :]


def description(f: Field, limit: int) -> str | None:
    if f.form not in ("described-text", "language-text", "described-url"):
        return None
    raw = content(f, limit)
    return _described(f, _Text(raw), raw[1:])[0]
