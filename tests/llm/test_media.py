"""AVI motion-JPEG: exact round trips, the general decoder, indexes, shots, damaged and empty input."""

import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from assayloom.llm import media


@settings(max_examples=150, deadline=None)
@given(st.binary(max_size=3000))
def test_round_trip(data):
    payload = media.pad_payload(data)
    assert len(payload) % 576 == 0 and len(payload) >= 576 and payload.startswith(data)
    avi = media.parse_avi(media.store_payload(payload))
    assert media.measure(avi.frames)[2] == payload and (avi.fps, avi.width, avi.height) == (25, 24, 24)


def test_general_decoder_agrees_with_arrays():
    payload = bytes(range(256)) * 9
    frames = media.parse_avi(media.store_payload(payload)).frames
    want = media.unit_luma(media.read_units(frames))
    assert all((media.decode_luma(f) == w).all() for f, w in zip(frames, want, strict=True))


def flat_frame(level: int, other: int | None = None) -> bytes:
    """A 16 x 16 three-component 4:2:0 frame with one restart interval, of a flat luma."""
    quant = b"\xff\xdb" + struct.pack(">HB", 67, 0) + b"\x08" * 64
    sof = b"\xff\xc0" + struct.pack(">HBHHB", 17, 8, 16, 32 if other is not None else 16, 3) + b"\x01\x22\x00\x02\x11\x00\x03\x11\x00"
    # DC: sizes 0..11 with four bits each; AC: end of block with one bit.
    dc = b"\xff\xc4" + struct.pack(">HB", 19 + 12, 0) + bytes([0, 0, 0, 12] + [0] * 12) + bytes(range(12))
    ac = b"\xff\xc4" + struct.pack(">HB", 20, 0x10) + bytes([1] + [0] * 15) + b"\x00"
    sos = b"\xff\xda" + struct.pack(">HB", 12, 3) + b"\x01\x00\x02\x00\x03\x00\x00\x3f\x00"

    def mcu(v):
        value = v - 128
        n = abs(value).bit_length()
        bits = format(n, "04b") + (format(value if value > 0 else value + (1 << n) - 1, f"0{n}b") if n else "") + "0" + "00000" * 5
        bits += "1" * (-len(bits) % 8)
        return int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\x00")

    scan, dri = mcu(level), b""
    if other is not None:
        scan, dri = scan + b"\xff\xd0" + mcu(other), b"\xff\xdd" + struct.pack(">HH", 4, 1)
    return b"\xff\xd8\xff\xe0\x00\x04AB" + quant + dri + sof + dc + ac + sos + scan + b"\xff\xd9"


def test_colour_frames_and_restarts():
    assert (media.decode_luma(flat_frame(200)) == 200).all() and media.decode_luma(flat_frame(57)).shape == (16, 16)
    two = media.decode_luma(flat_frame(40, 220))
    assert two.shape == (16, 32) and (two[:, :16] == 40).all() and (two[:, 16:] == 220).all()


def test_shots_and_missing_index():
    frames = [flat_frame(60)] * 10 + [flat_frame(180)] * 5 + [flat_frame(250)] * 3
    data = media.write_avi(frames, 16, 16, 10)
    assert media.parse_avi(data).frames == frames
    cut = data[: data.rindex(b"idx1")]
    assert media.parse_avi(cut).frames == frames
    hist, luma, payload = media.measure(frames)
    assert payload is None and [r[:4] for r in media.clip_rows(hist, luma, 10)] == [(0, 0, 1000, 10), (1, 1000, 1500, 5), (2, 1500, 1800, 3)]


def test_tables(spark):
    good, damaged = media.write_avi([flat_frame(60)] * 4, 16, 16), media.write_avi([b"\xff\xd8\xff\xc2junk"], 16, 16)
    rows = [(1, good), (1, good), (2, damaged), (3, b"text"), (4, None), (5, b""), (None, media.write_avi([], 16, 16))]
    df = spark.createDataFrame([(a, bytearray(b) if b is not None else None) for a, b in rows], "doc_id long, media binary").selectExpr("*", "1 as clip", "2 as error")
    found = media.clips(df).collect()
    assert [(r.clip, r.n_frames) for r in found if r.doc_id == 1] == [(0, 4)] * 2
    assert sorted(r.doc_id or 0 for r in found if r.error) == [0, 2, 3, 5]
    docs = spark.createDataFrame([(1, "abc"), (2, "abc"), (3, None), (4, ""), (None, "é" * 9000)], "doc_id long, text string").selectExpr("*", "1 as n_bytes", "2 as _data")
    got = {r.doc_id: r for r in media.text_features(docs).collect()}
    assert got[1][1:] == got[2][1:] and got[3][1:] == got[4][1:] and got[3].n_bytes == 0
    assert got[1].payload_bytes == 576 and got[1].tail_crc32 == zlib.crc32(b"\xff" * 32) and got[None].n_bytes == 18000
    assert media.text_features(docs.limit(0)).count() == 0


def test_not_avi():
    with pytest.raises(ValueError, match="AVI"):
        media.parse_avi(b"RIFF\x00\x00\x00\x00WAVE")
    assert np.array_equal(np.sort(media.zigzag()), np.arange(64)) and media.zigzag()[:5].tolist() == [0, 1, 8, 16, 9]


def bare_frame(level: int) -> bytes:
    """As ``flat_frame``, but coded by the usual tables, which it leaves out."""
    words = {k: {v: format(code, f"0{n}b") for (n, code), v in t.items()} for k, t in media.standard_tables().items()}
    value = level - 128
    n = abs(value).bit_length()
    amplitude = format(value if value > 0 else value + (1 << n) - 1, f"0{n}b") if n else ""
    bits = words[0][n] + amplitude + words[0x10][0] + (words[0][0] + words[0x10][0]) * 3 + (words[1][0] + words[0x11][0]) * 2
    bits += "1" * (-len(bits) % 8)
    quant = b"\xff\xdb" + struct.pack(">HB", 67, 0) + b"\x08" * 64
    sof = b"\xff\xc0" + struct.pack(">HBHHB", 17, 8, 16, 16, 3) + b"\x01\x22\x00\x02\x11\x00\x03\x11\x00"
    sos = b"\xff\xda" + struct.pack(">HB", 12, 3) + b"\x01\x00\x02\x11\x03\x11\x00\x3f\x00"
    return b"\xff\xd8" + quant + sof + sos + int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\x00") + b"\xff\xd9"


def test_usual_tables_segments_and_damage(spark):
    assert all((media.decode_luma(bare_frame(v)) == v).all() for v in (3, 127, 128, 129, 250))
    for name, (counts, symbols) in media.STANDARD.items():
        assert sum(bytes.fromhex(counts)) == len(set(bytes.fromhex(symbols))) == (162 if name & 16 else 12)
    first, more = [bare_frame(60)] * 8, [bare_frame(200)] * 4

    def chunk(name, data):
        return name + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)

    movi = b"movi" + chunk(b"LIST", b"rec " + chunk(b"00dc", more[0]) + chunk(b"00dc", more[1])) + b"".join(chunk(b"00dc", f) for f in more[2:])
    data = media.write_avi(first, 16, 16, 10)
    large = data + b"\0" * (len(data) % 2) + chunk(b"RIFF", b"AVIX" + chunk(b"LIST", movi))
    assert media.parse_avi(large).frames == first + more
    broken = media.write_avi([*first, b"\xff\xd8junk", b"", *more], 16, 16, 10)
    df = spark.createDataFrame([(1, bytearray(large)), (2, bytearray(broken))], "doc_id long, media binary")
    found = {(r.doc_id, r.clip): (r.start_ms, r.end_ms, r.n_frames, r.error) for r in media.clips(df).collect()}
    assert found == {(1, 0): (0, 800, 8, None), (1, 1): (800, 1200, 4, None), (2, 0): (0, 1000, 10, "1 damaged frames"), (2, 1): (1000, 1400, 4, None)}
