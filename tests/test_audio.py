"""Tag readers, playing times, audio ranges: whole files, damaged files, and bounds on what is read."""

import random
from decimal import Decimal


import pytest
import tessitura.sources.samples as a
from tessitura.sources import audio, flac, mpeg
from tessitura.sources.window import Policy, in_memory

LIMIT = Policy().payload


def layout(data: bytes, format: str = "mp3", policy: Policy = Policy()):
    return audio.analysed(in_memory(data, policy), format)


def concept(data: bytes, name: str, source: str, format: str = "mp3"):
    found = layout(data, format)
    return audio.concept_values(found.source(source), name, source, LIMIT)


def field(data, source, key, said=None, format="mp3"):
    return audio.field_values(layout(data, format).source(source), key, said, LIMIT)


AUDIO = a.mp3_frames(20)


@pytest.mark.parametrize("version,key", [(2, "TP1"), (3, "TPE1"), (4, "TPE1")])
@pytest.mark.parametrize("encoding", [0, 1, 3])
def test_id3v2_text(version, key, encoding):
    data = a.id3v2(a.text_frame(key, "Café", "B", version=version, encoding=encoding), version=version, padding=10) + AUDIO
    assert concept(data, "artist", "id3v2") == ["Café", "B"]


def test_id3v2_renames_and_descriptions():
    data = a.id3v2(a.frame("TXXX", b"\3MOOD\0calm"), a.frame("TXXX", b"\3OTHER\0x"), a.frame("TXXX", b"\3unended"), a.frame("TYER", b"\0001999", 4)) + AUDIO
    assert field(data, "id3v2", "TXXX", "mood") == ["calm", None]
    assert concept(data, "year", "id3v2") == [Decimal(1999)]
    assert field(data, "id3v2", "TXXX") == ["calm", "x", None]


def test_id3v2_transformed_content():
    squeezed = a.packed(b"\3Squeezed")
    data = a.id3v2(
        a.frame("TPE1", len(b"\3Squeezed").to_bytes(4, "big") + squeezed, 3, b"\0\x80"),
        a.frame("TALB", b"\1" + squeezed, 3, b"\0\x40"),
        a.frame("TIT2", b"\3Title", 3),
        version=3,
    ) + AUDIO
    assert field(data, "id3v2", "TPE1") == ["Squeezed"]
    assert field(data, "id3v2", "TALB") == [None]
    assert field(data, "id3v2", "TIT2") == ["Title"]


def test_id3v2_unsynchronised():
    body = a.frame("TPE1", b"\0\xff\xe0x", 3).replace(b"\xff", b"\xff\0")
    data = b"ID3\3\0\x80" + a.safe(len(body)) + body + AUDIO
    assert field(data, "id3v2", "TPE1") == ["ÿàx"]


def test_id3v2_plain_sizes_in_v24():
    long = "x" * 200
    data = a.id3v2(a.frame("TPE1", b"\3" + long.encode(), 3), a.frame("TALB", b"\3y", 3)) + AUDIO
    found = layout(data)
    assert field(data, "id3v2", "TPE1") == [long] and any(c.reason == "plain-frame-sizes" for c in found.conditions)


def test_id3v2_damage():
    cut = a.id3v2(a.text_frame("TPE1", "A"), a.frame("TALB", b"\3long")[:-2])
    found = layout(cut + AUDIO)
    assert found.source("id3v2").state == "broken-off" and found.incomplete
    assert field(cut + AUDIO, "id3v2", "TPE1") == ["A"] and field(cut + AUDIO, "id3v2", "TALB") == [None]
    assert layout(b"ID3\7\0\0" + a.safe(3) + b"abc" + AUDIO).source("id3v2") is None
    assert layout(b"ID3\4\0\0\xff\0\0\0" + AUDIO).conditions[0].reason == "size-not-syncsafe"


def test_genres_by_the_frame():
    data = a.id3v2(a.text_frame("TCON", "(17)Post-Rock; (9)", "RX", "((odd")) + AUDIO
    assert concept(data, "genre", "id3v2") == ["Rock", "Post-Rock", "Metal", "Remix", "(odd"]


def test_ape():
    items = [("Artist", b"A\0B", 0), ("ARTIST", b"C", 0), ("Cover", b"\1\2", 2), ("Year", b"2001-02-03", 0), ("Track", b"3/9", 0)]
    for data in (AUDIO + a.ape(items), a.ape(items) + AUDIO, AUDIO + a.ape(items, header=False)):
        assert concept(data, "artist", "ape") == ["C"]
        assert concept(data, "year", "ape") == [Decimal(2001)] and concept(data, "track", "ape") == [Decimal(3)]
        assert field(data, "ape", "cover") == [None]
        assert audio.byte_values(layout(data).source("ape"), "cover", LIMIT) == [b"\1\2"]
    old = AUDIO + a.ape([("Title", "é".encode("latin-1"), 2)], version=1000)
    assert concept(old, "title", "ape") == ["é"]
    assert layout(AUDIO + a.ape(items, count=9)).source("ape").state == "broken-off"


def test_id3v1():
    data = AUDIO + a.id3v1("T", "A ", "", "1999", track=7, genre=17)
    assert concept(data, "title", "id3v1") == ["T"] and concept(data, "album", "id3v1") == []
    assert concept(data, "track", "id3v1") == [Decimal(7)] and concept(data, "genre", "id3v1") == ["Rock"]
    assert concept(data, "year", "id3v1") == [Decimal(1999)]
    tabs = AUDIO + a.id3v1(year="\t", genre=200)
    assert concept(tabs, "year", "id3v1") == [None] and concept(tabs, "genre", "id3v1") == [None]
    assert concept(AUDIO + a.id3v1(), "track", "id3v1") == [] and concept(AUDIO + a.id3v1(), "genre", "id3v1") == []


def test_vorbis():
    data = a.flac(5, "artist=A", "ARTIST=B", "DATE=1999-13-01", "nameless", "TITLE=", "GENRE=(17)", b"\xff\xfe=z")
    assert concept(data, "artist", "vorbis", "flac") == ["A", "B", None]
    assert concept(data, "year", "vorbis", "flac") == [None, None]
    assert concept(data, "genre", "vorbis", "flac") == ["(17)", None]
    assert field(data, "vorbis", "title", format="flac") == ["", None]
    assert any(c.kind == "comment-without-name" for c in layout(data, "flac").conditions)


def test_trailing_tags_in_any_order_and_first_of_each_format():
    data = a.id3v2(a.text_frame("TPE1", "first")) + a.id3v2(a.text_frame("TPE1", "second")) + AUDIO + a.ape([("Title", b"t", 0)]) + a.id3v1("v1")
    found = layout(data)
    assert concept(data, "artist", "id3v2") == ["first"] and concept(data, "title", "ape") == ["t"] and concept(data, "title", "id3v1") == ["v1"]
    assert any(c.kind == "further-tag" for c in found.conditions)
    assert found.audio[1] == len(data) - 128 - len(a.ape([("Title", b"t", 0)]))


# Playing times


def test_mp3_constant_bitrate():
    found = layout(a.mp3_frames(400))
    assert found.playing.basis == "steady-rate" and found.playing.samples == round(400 * 417 / (144 * 128000 / 44100)) * 1152


def test_mp3_summary():
    frames = a.mp3_frames(100)
    data = a.xing_frame(100, 101 * 417) + frames
    found = layout(data)
    assert found.playing.basis == "counted" and found.playing.samples == 100 * 1152 - 1576
    assert layout(a.xing_frame(100, 101 * 417, good_crc=False) + frames).playing.problem == "summary-damaged"
    assert layout(a.xing_frame(100, 300 * 417) + frames).playing.problem == "summary-of-another-length"
    junk = layout(data + b"\1" * 9000)
    assert junk.playing.basis == "counted-with-trailer" and any(c.kind == "bytes-after-audio" for c in junk.conditions)
    assert layout(a.xing_frame(1, 101 * 417, delay=3000, padding=3000) + frames).playing.problem == "more-trimmed-than-coded"


def test_mp3_variable_without_summary():
    other = bytes.fromhex("fffb50c0") + b"\x55" * (208 - 4)  # 64 kbit/s
    assert layout(a.mp3_frames(50) + other * 100).playing.problem == "rate-varies-uncounted"


def test_no_audio():
    found = layout(b"not audio at all" * 50)
    assert found.audio is None and found.why == "no-frame"


def test_flac_durations():
    sure = layout(a.flac(5, total=5 * 4096), "flac")
    assert sure.playing.basis == "total-reached" and sure.playing.samples == 20480 and sure.playing.seconds == 0
    assert layout(a.flac(5, total=0, last=1000), "flac").playing.basis == "last-block-short"
    assert layout(a.flac(5, total=0), "flac").playing.basis == "whole-frame-at-end"
    assert layout(a.flac(5, total=0, tail=b"\1" * 50), "flac").playing.problem == "end-unknown"
    assert layout(a.flac(5)[:-3], "flac").playing.basis == "cut-in-last-frame"
    assert any(c.kind == "bytes-after-audio" for c in layout(a.flac(5, tail=b"\1" * 50), "flac").conditions)


def test_flac_chain():
    info, frames = a.block(0, a.stream_info(4096)), a.flac_frame(0)
    unflagged = b"fLaC" + info + a.block(1, b"\0" * 10) + frames
    assert any(c.reason == "no-last-block-flag" for c in layout(unflagged, "flac").conditions)
    wrong = b"fLaC" + info + a.block(4, a.comments("TITLE=t"), last=True, length=2) + frames
    assert any(c.reason == "block-length-recovered" for c in layout(wrong, "flac").conditions)
    assert concept(wrong, "title", "vorbis", "flac") == ["t"]
    lost = layout(b"fLaC" + info + a.block(1, b"\1" * 30, length=5000) + frames, "flac")
    assert any(c.kind == "metadata-chain-lost" for c in lost.conditions) and lost.audio is not None and lost.incomplete


def test_flac_header_numbers():
    for n in (0, 5, 127, 128, 2000):
        f = flac.parsed(a.flac_frame(n))
        assert f.number == n and f.sound and f.block == 4096 and f.channels == 1
    assert flac.frame_end(a.flac_frame(3), flac.parsed(a.flac_frame(3)), 16) == ("ends", len(a.flac_frame(3)), True)


def test_flac_rice_residual():
    bits = "0" + "001000" + "0" + "00" + "0000" + "0010" + ("0001" + "10") * 16  # fixed order 0, one partition, parameter 2
    head = bytes([0xFF, 0xF8, 0x70, 0x08, 0]) + (15).to_bytes(2, "big")
    head += bytes([a.crc8(head)])
    raw = bits.ljust(-(-len(bits) // 8) * 8, "0")
    body = head + int(raw, 2).to_bytes(len(raw) // 8, "big")
    whole = body + a.crc16(body).to_bytes(2, "big")
    assert flac.frame_end(whole + b"zz", flac.parsed(whole), 16) == ("ends", len(whole), True)


# Hashes


def hashed(data: bytes, format: str) -> str:
    return audio.digest(layout(data, format), lambda at, n: data[at : at + n])


def test_hash_ignores_tags_and_sees_audio():
    plain = a.mp3_frames(30)
    same = [plain, a.id3v2(a.text_frame("TPE1", "x")) + plain, plain + a.id3v1("t"), plain + a.ape([("A", b"b", 0)]), a.xing_frame(30, 31 * 417) + plain]
    assert len({hashed(x, "mp3") for x in same}) == 1
    assert hashed(a.mp3_frames(30, fill=0x56), "mp3") != hashed(plain, "mp3")
    assert hashed(a.flac(5, "A=b"), "flac") == hashed(a.flac(5, "LONG=comment", tail=b"\1" * 9), "flac") != hashed(a.flac(4), "flac")


def test_flac_faults():
    data = bytearray(a.flac(6))
    at = data.rindex(a.flac_frame(2, 4096, 2))
    data[at + 8] ^= 1
    faults = []
    found = layout(bytes(data), "flac")
    audio.audio_bytes(found, lambda p, n: bytes(data[p : p + n]), faults)
    assert [(f.kind, f.number) for f in faults] == [("crc16-fails", 2)]


def test_free_format():
    head = bytes.fromhex("fffb00c0")
    stream = (head + b"\x11" * 300) * 12
    found = layout(stream)
    assert found.audio[0] == 0 and found.playing.problem == "free-rate-uncounted"
    assert audio.audio_bytes(found, lambda p, n: stream[p : p + n])[0] == 0


# Bounds


@pytest.mark.parametrize("format", ["mp3", "flac"])
@pytest.mark.parametrize("policy", [Policy(), Policy(300, 300, 100, 2000, 4000, 500)])
def test_damage_never_raises_and_reads_within_the_ceiling(format, policy):
    rng = random.Random(5)
    good = a.id3v2(a.text_frame("TPE1", "x" * 500), padding=900) + (a.mp3_frames(60) if format == "mp3" else a.flac(40, "ARTIST=" + "y" * 900)) + a.ape([("K", b"v" * 700, 0)]) + a.id3v1("t")
    for _ in range(60):
        data = bytearray(good)
        for _ in range(rng.randrange(1, 30)):
            data[rng.randrange(len(data))] = rng.randrange(256)
        data = bytes(data[: rng.randrange(1, len(data) + 1)])
        r = in_memory(data, policy)
        found = audio.analysed(r, format)
        assert r.pulled <= policy.ceiling
        for tag in found.tags:
            for f in tag.fields:
                audio.field_values(found.source(tag.format), f.key, None, policy.payload)
        if found.audio:
            audio.audio_bytes(found, lambda p, n, d=data: d[p : p + n], [])


def test_edges_alone_are_read():
    data = a.id3v2(a.text_frame("TPE1", "x")) + a.xing_frame(3000, 3001 * 417) + a.mp3_frames(3000) + a.id3v1("t")
    r = in_memory(data)
    assert audio.analysed(r, "mp3").playing.basis == "counted" and r.pulled <= 2 * 64 * 1024


def test_mpeg_lengths():
    assert mpeg.parsed(a.MP3_HEADER).length == 417 and mpeg.parsed(b"\xff\xfb\xf0\0") is None and mpeg.parsed(b"\xff\xeb\x90\0") is None
