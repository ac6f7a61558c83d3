"""Builders of small audio files and tags, byte by byte."""

from __future__ import annotations

import struct
import zlib

from .window import crc8, crc16, crc16_arc

MP3_HEADER = bytes.fromhex("fffb90c0")  # MPEG 1 layer III, 128 kbit/s, 44.1 kHz, mono
MP3_FRAME = 417


def mp3_frames(n: int, fill: int = 0x55, kbps128: bool = True) -> bytes:
    return (MP3_HEADER + bytes([fill]) * (MP3_FRAME - 4)) * n


def xing_frame(frames: int, size: int, delay: int = 576, padding: int = 1000, kind: bytes = b"Info", good_crc: bool = True, lame: bool = True) -> bytes:
    b = bytearray(MP3_HEADER + b"\0" * (MP3_FRAME - 4))
    at = 4 + 17
    b[at : at + 4] = kind
    b[at + 4 : at + 16] = struct.pack(">III", 3, frames, size)
    at += 16
    if lame:
        b[at : at + 9] = b"LAME3.100"
        b[at + 21 : at + 24] = (delay << 12 | padding).to_bytes(3, "big")
        crc = crc16_arc(bytes(b[: at + 34]))
        b[at + 34 : at + 36] = (crc ^ (not good_crc)).to_bytes(2, "big")
    return bytes(b)


def safe(n: int) -> bytes:
    return bytes(n >> s & 0x7F for s in (21, 14, 7, 0))


def frame(key: str, content: bytes, version: int = 4, flags: bytes = b"\0\0") -> bytes:
    if version == 2:
        return key.encode() + len(content).to_bytes(3, "big") + content
    size = safe(len(content)) if version == 4 else len(content).to_bytes(4, "big")
    return key.encode() + size + flags + content


def text_frame(key: str, *values: str, version: int = 4, encoding: int = 3) -> bytes:
    names = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}
    end = b"\0\0" if encoding in (1, 2) else b"\0"
    return frame(key, bytes([encoding]) + end.join(v.encode(names[encoding]) for v in values), version)


def id3v2(*frames: bytes, version: int = 4, flags: int = 0, padding: int = 0) -> bytes:
    body = b"".join(frames) + b"\0" * padding
    return b"ID3" + bytes([version, 0, flags]) + safe(len(body)) + body


def ape(items: list[tuple[str, bytes, int]], version: int = 2000, header: bool = True, count: int | None = None) -> bytes:
    body = b"".join(struct.pack("<II", len(v), f) + k.encode() + b"\0" + v for k, v, f in items)
    edge = lambda bits: b"APETAGEX" + struct.pack("<IIII", version, len(body) + 32, len(items) if count is None else count, bits) + b"\0" * 8
    return (edge(0xA0000000) if header else b"") + body + edge(0x80000000 if header else 0)


def id3v1(title="", artist="", album="", year="", comment="", track=0, genre=255, pad=b"\0") -> bytes:
    put = lambda s, n: s.encode("latin-1")[:n].ljust(n, pad)
    tail = put(comment, 28) + b"\0" + bytes([track]) if track else put(comment, 30)
    return b"TAG" + put(title, 30) + put(artist, 30) + put(album, 30) + put(year, 4) + tail + bytes([genre])


def comments(*pairs: str, vendor: str = "x") -> bytes:
    out = struct.pack("<I", len(vendor)) + vendor.encode() + struct.pack("<I", len(pairs))
    for p in pairs:
        raw = p if isinstance(p, bytes) else p.encode()
        out += struct.pack("<I", len(raw)) + raw
    return out


def block(kind: int, payload: bytes, last: bool = False, length: int | None = None) -> bytes:
    return bytes([kind | 0x80 * last]) + (len(payload) if length is None else length).to_bytes(3, "big") + payload


def stream_info(total: int, rate: int = 44100, size: int = 4096, depth: int = 16, channels: int = 1) -> bytes:
    packed = rate << 44 | (channels - 1) << 41 | (depth - 1) << 36 | total
    return struct.pack(">HH", size, size) + b"\0" * 6 + packed.to_bytes(8, "big") + b"\0" * 16


def flac_frame(number: int, size: int = 4096, value: int = 0) -> bytes:
    """A mono frame of 16-bit samples, all alike."""
    block_code = {4096: 12, 192: 1}.get(size, 7)
    head = bytes([0xFF, 0xF8, block_code << 4 | 9, 0x08])
    head += bytes([number]) if number < 0x80 else bytes([0xC0 | number >> 6, 0x80 | number & 0x3F])
    head += (size - 1).to_bytes(2, "big") if block_code == 7 else b""
    head += bytes([crc8(head)])
    body = head + b"\0" + (value & 0xFFFF).to_bytes(2, "big")
    return body + crc16(body).to_bytes(2, "big")


def flac(frames: int = 5, *pairs: str, total: int | None = None, last: int = 4096, tail: bytes = b"") -> bytes:
    n = (frames - 1) * 4096 + last
    info = block(0, stream_info(n if total is None else total))
    listed = block(4, comments(*pairs))
    audio = b"".join(flac_frame(i, last if i == frames - 1 else 4096, i) for i in range(frames))
    return b"fLaC" + info + listed + block(1, b"\0" * 20, last=True) + audio + tail


def packed(data: bytes) -> bytes:
    return zlib.compress(data)
