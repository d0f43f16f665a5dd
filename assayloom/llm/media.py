"""AVI motion-JPEG columns: parse RIFF indexes, decode intra frames, and cut them into timed clips.

Reading: the RIFF tree gives the stream's rate and the ``idx1`` index, the index gives the frames (without an index the
``movi`` list is walked), each frame is decoded as baseline JPEG (Huffman, 8 bits, one or three components, any sampling
factors, restart intervals), and a shot begins where the histogram of a frame's luma differs from the one before by more
than the mean plus 2.5 standard deviations of the last ``HISTORY`` differences, and by ``LEAST_STEP`` at least.

Storing bytes: a payload becomes 24 x 24 grey frames of nine blocks. The unit of the format is the quantised coefficient,
which JPEG keeps exactly: one byte each, in zigzag order. The frames' Huffman tables give every coefficient 16 bits (code
and amplitude together), so such frames are written and read back as arrays; any baseline decoder can read them too.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayloom.llm.worker import map_arrow, parts, record

SIDE, BLOCKS = 24, 9
UNIT = 64 * BLOCKS
FPS = 25
BINS, HISTORY, LEAST_STEP = 16, 8, 0.08
#: Frames decoded at a time.
CHUNK = 2048


@lru_cache(1)
def zigzag() -> np.ndarray:
    """Place in the 8 x 8 block of each coefficient, by the diagonal rule."""
    return np.array(sorted(range(64), key=lambda p: (p // 8 + p % 8, (p // 8 if (p // 8 + p % 8) % 2 else p % 8))))


@lru_cache(1)
def cosines() -> np.ndarray:
    k, x = np.arange(8)[:, None], np.arange(8)[None, :]
    return (np.where(k == 0, np.sqrt(0.125), 0.5) * np.cos((2 * x + 1) * k * np.pi / 16)).astype(np.float32)


# --- Writing payloads -------------------------------------------------------------------------------------------------


@lru_cache(1)
def head() -> bytes:
    """All of a payload frame before its scan."""
    quant = b"\xff\xdb" + struct.pack(">HB", 67, 0) + b"\x01" * 64
    frame = b"\xff\xc0" + struct.pack(">HBHHB", 11, 8, SIDE, SIDE, 1) + b"\x01\x11\x00"
    dc = b"\xff\xc4" + struct.pack(">HB", 19 + 9, 0x00) + bytes([0] * 7 + [1] * 9) + bytes(range(8, -1, -1))
    ac = b"\xff\xc4" + struct.pack(">HB", 19 + 1, 0x10) + bytes([0] * 7 + [1] + [0] * 8) + b"\x08"
    scan = b"\xff\xda" + struct.pack(">HB", 8, 1) + b"\x01\x00\x00\x3f\x00"
    return b"\xff\xd8" + quant + frame + dc + ac + scan


@lru_cache(1)
def dc_words() -> tuple[np.ndarray, np.ndarray]:
    """16-bit word of each DC difference -255..255 (at +255), and difference of each word (-999: none)."""
    to, back = np.zeros(511, np.uint16), np.full(65536, -999, np.int16)
    code = 0
    for size in range(8, -1, -1):
        length = 16 - size
        for value in range(-255, 256):
            if abs(value).bit_length() == size:
                bits = value if value >= 0 else value + (1 << size) - 1
                to[value + 255] = (code << size) | bits
                back[(code << size) | bits] = value
        code = (code + 1) << 1
    return to, back


def payload_scans(payload: np.ndarray) -> list[bytes]:
    """Entropy-coded data of the frames of a payload whose length is a multiple of 576."""
    units = payload.reshape(-1, BLOCKS, 64)
    words = units.astype(">u2")
    dc = units[:, :, 0].astype(np.int32) - 128
    words[:, :, 0] = dc_words()[0][np.diff(dc, axis=1, prepend=0) + 255]
    data, size = words.tobytes(), 2 * UNIT
    return [data[i : i + size].replace(b"\xff", b"\xff\x00") for i in range(0, len(data), size)]


def write_avi(frames: list[bytes], width: int, height: int, fps: int = FPS) -> bytes:
    """An AVI file with one motion-JPEG stream and an index."""
    parts, index, at = [], [], 4
    for frame in frames:
        pad = b"\x00" * (len(frame) & 1)
        parts += [b"00dc", struct.pack("<I", len(frame)), frame, pad]
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(frame)))
        at += 8 + len(frame) + len(pad)
    avih = struct.pack("<14I", 1_000_000 // fps, 0, 0, 0x10, len(frames), 0, 1, 0, width, height, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIIIHHHH", b"vids", b"MJPG", 0, 0, 0, 0, 1, fps, 0, len(frames), 0, 0, 0, 0, 0, width, height)
    strf = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 24, b"MJPG", width * height * 3, 0, 0, 0, 0)
    box = lambda name, data: name + struct.pack("<I", len(data)) + data
    hdrl = box(b"LIST", b"hdrl" + box(b"avih", avih) + box(b"LIST", b"strl" + box(b"strh", strh) + box(b"strf", strf)))
    movi = b"LIST" + struct.pack("<I", at) + b"movi" + b"".join(parts)
    body = b"AVI " + hdrl + movi + box(b"idx1", b"".join(index))
    return b"RIFF" + struct.pack("<I", len(body)) + body


def pad_payload(data: bytes) -> bytes:
    """Bytes 255 up to a positive multiple of 576."""
    return data + b"\xff" * (max(1, -(-len(data) // UNIT)) * UNIT - len(data))


def store_payload(payload: bytes) -> bytes:
    top, end = head(), b"\xff\xd9"
    return write_avi([top + scan + end for scan in payload_scans(np.frombuffer(payload, np.uint8))], SIDE, SIDE)


# --- Reading ----------------------------------------------------------------------------------------------------------


@dataclass
class Avi:
    frames: list[bytes]
    fps: float
    width: int
    height: int


def parse_avi(data: bytes) -> Avi:
    """The video frames by the index; by walking the ``movi`` lists where there is no index, and in the segments (AVIX) that
    follow the first one in large files. Raises ValueError if it's no AVI."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    fps, width, height, index = float(FPS), 0, 0, None
    movis: list[tuple[int, int]] = []
    todo, start = [], 0
    while start + 12 <= len(data) and data[start : start + 4] == b"RIFF" and data[start + 8 : start + 12] in (b"AVI ", b"AVIX"):
        size = struct.unpack_from("<I", data, start + 4)[0]
        todo.append((start + 12, min(len(data), start + 8 + size)))
        start += 8 + size + (size & 1)
    while todo:
        at, end = todo.pop()
        while at + 8 <= end:
            name, size = struct.unpack_from("<4sI", data, at)
            if name == b"LIST":
                if data[at + 8 : at + 12] == b"movi":
                    movis.append((at + 8, min(end, at + 8 + size)))
                else:
                    todo.append((at + 12, at + 8 + size))
            elif name == b"idx1":
                index = (at + 8, at + 8 + size)
            elif name == b"avih":
                width, height = struct.unpack_from("<II", data, at + 40)
            elif name == b"strh" and data[at + 8 : at + 12] == b"vids":
                scale, rate = struct.unpack_from("<II", data, at + 28)
                fps = rate / scale if scale and rate else fps
            at += 8 + size + (size & 1)
    movis.sort()
    frames = []
    if index is not None and movis:
        first = movis.pop(0)
        entries = np.frombuffer(data[index[0] : index[1] - (index[1] - index[0]) % 16], np.dtype([("id", "S4"), ("flags", "<u4"), ("at", "<u4"), ("size", "<u4")]))
        # Offsets count from the list's name or, in some files, from the file's start.
        base = first[0] if len(entries) and data[first[0] + int(entries["at"][0]) :][:4] == entries["id"][0] else 0
        for name, at, size in zip(entries["id"].tolist(), (entries["at"].astype(np.int64) + base + 8).tolist(), entries["size"].tolist(), strict=True):
            if name[2:4] in (b"dc", b"db"):
                frames.append(data[at : at + size])
    for low, end in movis:
        stops, at = [end], low + 4
        while stops:
            if at + 8 > stops[-1]:
                at = stops.pop()
                continue
            name, size = struct.unpack_from("<4sI", data, at)
            if name == b"LIST" and data[at + 8 : at + 12] == b"rec ":
                stops.append(min(stops[-1], at + 8 + size + (size & 1)))
                at += 12
                continue
            if name[2:4] in (b"dc", b"db"):
                frames.append(data[at + 8 : at + 8 + size])
            at += 8 + size + (size & 1)
    return Avi(frames, fps, width, height)


def read_units(frames: list[bytes]) -> np.ndarray | None:
    """Coefficient bytes (frames x 9 x 64) of payload frames; None if a frame isn't one."""
    top, scans = head(), []
    n = len(top)
    for frame in frames:
        if frame[:n] != top or frame[-2:] != b"\xff\xd9":
            return None
        scans.append(frame[n:-2].replace(b"\xff\x00", b"\xff"))
    words = np.frombuffer(b"".join(scans), ">u2").reshape(-1, BLOCKS, 64)
    if any(len(s) != 2 * UNIT for s in scans) or (words[:, :, 1:] >> 8).any():
        return None
    units = words.astype(np.uint8)
    step = dc_words()[1][words[:, :, 0]]
    if (step == -999).any():
        return None
    units[:, :, 0] = np.cumsum(step, axis=1) + 128
    return units


def unit_luma(units: np.ndarray) -> np.ndarray:
    """Pixels (frames x 24 x 24) of payload frames: amplitudes, inverse transform, level shift, clipping."""
    n = len(units)
    value = units.astype(np.int16)
    value = np.where(value >= 128, value, value - 255)
    value[:, :, 0] = units[:, :, 0].astype(np.int16) - 128
    blocks = np.zeros((n * BLOCKS, 64), np.float32)
    blocks[:, zigzag()] = value.reshape(-1, 64)
    pixels = inverse(blocks)
    return pixels.reshape(n, 3, 3, 8, 8).swapaxes(2, 3).reshape(n, SIDE, SIDE)


def inverse(blocks: np.ndarray) -> np.ndarray:
    """Inverse cosine transform of blocks (n x 64) to 8-bit pixels (n x 8 x 8)."""
    c = cosines()
    half = (blocks.reshape(-1, 8) @ c).reshape(-1, 8, 8)
    out = (half.swapaxes(1, 2).reshape(-1, 8) @ c).reshape(-1, 8, 8).swapaxes(1, 2)
    return np.clip(np.rint(out + 128), 0, 255).astype(np.uint8)


# The usual Huffman tables: numbers of codes by length, then their symbols; DC and AC, of luma and chroma.
STANDARD = {
    0x00: ("00010501010101010100000000000000", "000102030405060708090a0b"),
    0x01: ("00030101010101010101010000000000", "000102030405060708090a0b"),
    0x10: (
        "0002010303020403050504040000017d",
        "01020300041105122131410613516107227114328191a1082342b1c11552d1f02433627282090a161718191a25262728292a3435363738393a434445464748494a535455565758595a"
        "636465666768696a737475767778797a838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aab2b3b4b5b6b7b8b9bac2c3c4c5c6c7c8c9cad2d3d4d5d6d7d8d9dae1e2e3e4e5e6e7e8e9eaf1f2f3f4f5f6f7f8f9fa",
    ),
    0x11: (
        "00020102040403040705040400010277",
        "000102031104052131061241510761711322328108144291a1b1c109233352f0156272d10a162434e125f11718191a262728292a35363738393a434445464748494a535455565758595a"
        "636465666768696a737475767778797a82838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aab2b3b4b5b6b7b8b9bac2c3c4c5c6c7c8c9cad2d3d4d5d6d7d8d9dae2e3e4e5e6e7e8e9eaf2f3f4f5f6f7f8f9fa",
    ),
}


def code_table(counts: bytes, symbols: bytes) -> dict[tuple[int, int], int]:
    """Symbols by length and code: codes of one length count up, and double at each further bit."""
    table, code, p = {}, 0, 0
    for bits, n in enumerate(counts, 1):
        for _ in range(n):
            table[bits, code] = symbols[p]
            code, p = code + 1, p + 1
        code <<= 1
    return table


@lru_cache(1)
def standard_tables() -> dict[int, dict[tuple[int, int], int]]:
    return {name: code_table(bytes.fromhex(counts), bytes.fromhex(symbols)) for name, (counts, symbols) in STANDARD.items()}


def decode_luma(frame: bytes) -> np.ndarray:
    """Luma pixels of a baseline JPEG frame (height x width). Raises ValueError for anything else."""
    if frame[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG frame")
    at, quant, huff, parts, restart, size = 2, {}, {}, [], 0, (0, 0)
    while True:
        while frame[at : at + 2] == b"\xff\xff":
            at += 1
        if at + 4 > len(frame) or frame[at] != 0xFF:
            raise ValueError("damaged JPEG frame")
        mark, length = frame[at + 1], struct.unpack_from(">H", frame, at + 2)[0]
        data = frame[at + 4 : at + 2 + length]
        at += 2 + length
        if mark == 0xDB:
            while data:
                wide = data[0] >> 4
                quant[data[0] & 15] = np.frombuffer(data[1 : 65 + 64 * wide], ">u2" if wide else "u1").astype(np.float32)
                data = data[65 + 64 * wide :]
        elif mark == 0xC4:
            while data:
                end = 17 + sum(data[1:17])
                huff[data[0]] = code_table(data[1:17], data[17:end])
                data = data[end:]
        elif mark == 0xC0:
            _, height, width, n = struct.unpack_from(">BHHB", data)
            size = (height, width)
            parts = [[data[6 + 3 * i], data[7 + 3 * i] >> 4, data[7 + 3 * i] & 15, data[8 + 3 * i]] for i in range(n)]
        elif 0xC1 <= mark <= 0xCF and mark != 0xC8 and mark != 0xCC:
            raise ValueError("only baseline JPEG frames are read")
        elif mark == 0xDD:
            restart = struct.unpack(">H", data[:2])[0]
        elif mark == 0xDA:
            tables = {data[1 + 2 * i]: data[2 + 2 * i] for i in range(data[0])}
            break
    huff = standard_tables() | huff  # motion JPEG may leave out the usual tables
    if not parts or not all(p[3] in quant and (tables[p[0]] >> 4) in huff and (0x10 | tables[p[0]] & 15) in huff for p in parts):
        raise ValueError("a JPEG frame without its tables")
    if len(parts) == 1:
        parts[0][1:3] = [1, 1]
    wide, high = max(p[1] for p in parts), max(p[2] for p in parts)
    across, down = -(-size[1] // (8 * wide)), -(-size[0] // (8 * high))
    luma = parts[0]
    rows, columns = down * luma[2], across * luma[1]
    blocks = np.zeros((rows * columns, 64), np.float32)
    scan, pieces, start = frame[at:], [], 0
    for i in range(len(scan) - 1):  # restart markers part the scan
        if scan[i] == 0xFF and scan[i + 1] != 0:
            pieces.append(scan[start:i].replace(b"\xff\x00", b"\xff"))
            start = i + 2
            if not 0xD0 <= scan[i + 1] <= 0xD7:
                break
    bits, pos = int.from_bytes(pieces[0], "big") if pieces else 0, 0
    total, piece = 8 * len(pieces[0]) if pieces else 0, 0
    before = [0] * len(parts)

    def take(n: int) -> int:
        nonlocal pos
        pos += n
        if pos > total:
            raise ValueError("damaged JPEG frame")
        return bits >> (total - pos) & ((1 << n) - 1)

    def symbol(table: dict) -> int:
        code = 0
        for n in range(1, 17):
            code = code << 1 | take(1)
            if (n, code) in table:
                return table[n, code]
        raise ValueError("damaged JPEG frame")

    def amplitude(n: int) -> int:
        v = take(n) if n else 0
        return v if not n or v >> (n - 1) else v - (1 << n) + 1

    order = zigzag()
    for unit in range(across * down):
        if restart and unit and unit % restart == 0:
            piece += 1
            bits, pos, total, before = int.from_bytes(pieces[piece], "big"), 0, 8 * len(pieces[piece]), [0] * len(parts)
        for c, (name, h, v, q) in enumerate(parts):
            dc, ac = huff[tables[name] >> 4], huff[0x10 | tables[name] & 15]
            for j in range(h * v):
                coefficients = np.zeros(64, np.float32)
                before[c] += amplitude(symbol(dc))
                coefficients[0] = before[c]
                k = 1
                while k < 64:
                    s = symbol(ac)
                    if s == 0:
                        break
                    k += s >> 4
                    if s & 15:
                        coefficients[k] = amplitude(s & 15)
                    k += 1
                if c == 0:
                    y, x = unit // across * v + j // h, unit % across * h + j % h
                    blocks[y * columns + x, order] = coefficients * quant[q]
    pixels = inverse(blocks).reshape(rows, columns, 8, 8).swapaxes(1, 2).reshape(rows * 8, columns * 8)
    return pixels[: size[0], : size[1]]


def histograms(frames: np.ndarray) -> np.ndarray:
    """Shares of the luma bins, a row for each frame."""
    n = len(frames)
    flat = (frames.reshape(n, -1) >> 4).astype(np.int64) + BINS * np.arange(n)[:, None]
    return np.bincount(flat.ravel(), minlength=BINS * n).reshape(n, BINS) / max(1, flat.shape[1])


def shots(hist: np.ndarray) -> list[int]:
    """First frames of the shots, by adaptive differences of the histograms."""
    if not len(hist):
        return []
    step = np.abs(np.diff(hist, axis=0)).sum(axis=1) / 2
    sums, squares = np.concatenate([[0], np.cumsum(step)]), np.concatenate([[0], np.cumsum(step**2)])
    at = np.arange(len(step))
    low = np.maximum(0, at - HISTORY)
    n = np.maximum(1, at - low)
    mean = (sums[at] - sums[low]) / n
    spread = np.sqrt(np.maximum(0, (squares[at] - squares[low]) / n - mean**2))
    cut = (step >= LEAST_STEP) & (step > mean + 2.5 * spread + 1e-9)
    return [0, *(np.flatnonzero(cut) + 1).tolist()]


def clip_rows(hist: np.ndarray, luma: np.ndarray, fps: float) -> list[tuple[int, int, int, int, float]]:
    """Timed clips: number, start and end in ms, frames, mean luma."""
    begins = shots(hist)
    ends = [*begins[1:], len(hist)]
    return [(i, round(1000 * b / fps), round(1000 * e / fps), e - b, float(luma[b:e].mean())) for i, (b, e) in enumerate(zip(begins, ends, strict=False)) if e > b]


def measure(frames: list[bytes], damaged: list[int] | None = None) -> tuple[np.ndarray, np.ndarray, bytes | None]:
    """Histograms and mean lumas of frames, and the payload if they are payload frames; decoded a chunk at a time.

    An empty frame repeats the one before, as AVI means it. With ``damaged``, so does one that can't be decoded, whose
    number is put there (a grey one at the start); without, it raises.
    """
    last = np.full((1, 8, 8), 128, np.uint8)
    hists, means, payload = [np.zeros((0, BINS))], [np.zeros(0)], []
    for at in range(0, len(frames), CHUNK):
        part = frames[at : at + CHUNK]
        units = read_units(part) if payload is not None else None
        if units is not None:
            pixels = unit_luma(units)
            payload.append(units.tobytes())
            hists.append(histograms(pixels))
            means.append(pixels.reshape(len(part), -1).mean(axis=1))
        else:
            payload = None
            for number, frame in enumerate(part, at):
                try:
                    pixels = decode_luma(frame)[None] if frame else last
                except (ValueError, IndexError, KeyError, struct.error):
                    if damaged is None:
                        raise
                    damaged.append(number)
                    pixels = last
                last = pixels
                hists.append(histograms(pixels))
                means.append(pixels.reshape(1, -1).mean(axis=1))
    return np.concatenate(hists), np.concatenate(means), b"".join(payload) if payload is not None else None


def clips(df: DataFrame, media_col: str = "media", id_col: str = "doc_id") -> DataFrame:
    """Timed clip rows of AVI columns: id, clip, start_ms, end_ms, n_frames, mean_luma, error.

    Null media gives no row; what can't be read gives one row with ``error`` and nulls, as does a file without frames, or
    with no frame that can be decoded; where only some can't, ``error`` says in how many of a clip's frames.
    Repeated rows are read alike; an empty table gives none; other columns aren't read.
    """
    rows = df.where(F.col(media_col).isNotNull()).select(F.col(id_col), F.col(media_col).cast("binary").alias("_media"))
    schema = rows.select(id_col).schema.add("clip", "integer").add("start_ms", "long").add("end_ms", "long").add("n_frames", "integer").add("mean_luma", "double").add("error", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches, 20):
            at, out = [], []
            for i, data in enumerate(part.column(1).to_pylist()):
                try:
                    avi = parse_avi(data)
                    bad: list[int] = []
                    hist, luma, _ = measure(avi.frames, bad)
                    if bad and len(bad) == len(avi.frames):
                        raise ValueError("no frame can be decoded")
                    found, first = [], 0
                    for row in clip_rows(hist, luma, avi.fps):
                        n = sum(first <= k < first + row[3] for k in bad)
                        found.append((*row, f"{n} damaged frames" if n else None))
                        first += row[3]
                    found = found or [(*[None] * 5, "no frames")]
                except (ValueError, IndexError, KeyError, struct.error) as e:
                    found = [(*[None] * 5, str(e) or "damaged")]
                at += [i] * len(found)
                out += found
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.string())
            ids = part.column(0).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(list(x), kind) for x, kind in zip(zip(*out, strict=True), kinds, strict=True))], schema.names)

    return map_arrow(rows, run, schema)


def text_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store every whole text (null: empty) as an AVI, read the stored bytes back and compute features.

    Returns doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32 (last 32 bytes read back), media_bytes,
    media_sha256, feature (clips as start-end:mean luma, in ms). Equal texts give equal values. An empty table gives
    none; other columns aren't read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("_data"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches, 200):
            out = []
            for data in part.column(1).to_pylist():
                media = store_payload(pad_payload(data))
                avi = parse_avi(media)
                hist, luma, payload = measure(avi.frames)
                feature = ";".join(f"{b}-{e}:{m:.2f}" for _, b, e, _, m in clip_rows(hist, luma, avi.fps))
                out.append((len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature))
            names = (("n_bytes", "int64"), ("payload_bytes", "int64"), ("payload_sha256", "string"), ("tail_crc32", "int64"), ("media_bytes", "int64"), ("media_sha256", "string"), ("feature", "string"))
            yield record(doc_id=part.column(0), **{name: (list(x), kind) for (name, kind), x in zip(names, zip(*out, strict=True), strict=True)})

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return map_arrow(rows, run, schema)
