"""Media columns: bytes kept as AVI motion-JPEG, read back through the RIFF index, cut into shots.

Payload bytes become quantised DCT coefficients, the unit in which baseline JPEG is lossless: the byte
b is the coefficient whose magnitude category is 8 and whose extra bits are b. All coefficients share
one Huffman symbol, of one bit, so a unit of 3 blocks (192 bytes) takes 216 bytes before byte stuffing;
restart markers after each unit keep the DC predictions at zero. Frames are 16x16, 4:4:4, every one an
intra frame. The stream header's data chunk holds the payload's length.

Decoding is that of baseline JPEG with integer arithmetic. ``clips`` also takes files of other writers: frames
that aren't this writer's go through a general decoder of baseline frames without subsampling (others are an
error), and their histograms are scaled to this writer's frame size. Shots are cut where the difference of two luma histograms
exceeds what the frames before it lead to expect.

Defined cases: a null or empty text is a payload of 192 spaces; long texts give many frames; equal
texts give equal bytes and features whatever batch they are in.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import slices

UNIT = 192
SIDE = 16
UNITS = (SIDE // 8) ** 2
FRAME_BYTES = UNIT * UNITS
FRAME_MS = 40
BINS = 16
#: A cut needs a difference of at least so many pixels, and so many eighths of the running mean.
LEAST_CHANGE, OVER_MEAN = 64, 10


def zigzag() -> np.ndarray:
    """Row-major position of the k-th coefficient: diagonals, walked in turns."""
    cells = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))
    return np.array([8 * r + c for r, c in cells])


ZIGZAG = zigzag()
#: 2^13 times the DCT basis, as whole numbers: products stay exact in 64-bit floats.
BASIS = np.round(8192 * np.array([[(0.5 if u else 0.5**1.5) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)]))


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _head(side: int = SIDE) -> bytes:
    one_code = bytes([1, *[0] * 15, 8])  # one code of one bit, for the symbol 8
    return b"".join([
        b"\xff\xd8",
        _segment(0xE0, b"AVI1" + bytes(10)),
        _segment(0xDB, bytes([0, *[1] * 64])),
        _segment(0xC0, struct.pack(">BHHB", 8, side, side, 3) + bytes([1, 0x11, 0, 2, 0x11, 0, 3, 0x11, 0])),
        _segment(0xC4, b"\x00" + one_code + b"\x10" + one_code),
        _segment(0xDD, struct.pack(">H", 1)),
        _segment(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0])),
    ])


HEAD = _head()
RESTARTS = [bytes([0xFF, 0xD0 + k % 8]) for k in range(UNITS - 1)]
RESTART = re.compile(rb"\xff[\xd0-\xd7]")


def coded(units: np.ndarray) -> np.ndarray:
    """(n, 192) payload bytes to (n, 216) bytes: a zero bit before every byte."""
    b = units.reshape(-1, 8)
    out = np.zeros((len(b), 9), dtype=np.uint8)
    out[:, 0] = b[:, 0] >> 1
    for j in range(1, 8):
        out[:, j] = b[:, j - 1] << (8 - j) | b[:, j] >> (j + 1)
    out[:, 8] = b[:, 7]
    return out.reshape(len(units), -1)


def uncoded(units: np.ndarray) -> np.ndarray:
    """The inverse of coded; the interleaved bits must be zero."""
    c = units.reshape(-1, 9)
    out = np.empty((len(c), 8), dtype=np.uint8)
    bad = 0
    for j in range(8):
        bad |= int((c[:, j] >> (7 - j) & 1).any())
        out[:, j] = c[:, j] << (j + 1) if j < 7 else 0
        out[:, j] |= c[:, j + 1] >> (7 - j)
    if bad:
        raise ValueError("not this writer's entropy coding")
    return out.reshape(len(units), -1)


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def _avi(frames: list[bytes], payload_bytes: int) -> bytes:
    most = max(map(len, frames))
    avih = struct.pack("<14I", 1000 * FRAME_MS, most * (1000 // FRAME_MS), 0, 0x10, len(frames), 0, 1, most, SIDE, SIDE, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIII4H", b"vids", b"MJPG", 0, 0, 0, 0, FRAME_MS, 1000, 0, len(frames), most, 0xFFFFFFFF, 0, 0, 0, SIDE, SIDE)
    strf = struct.pack("<IiiHH4sIiiII", 40, SIDE, SIDE, 1, 24, b"MJPG", SIDE * SIDE * 3, 0, 0, 0, 0)
    strl = b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf) + _chunk(b"strd", struct.pack("<Q", payload_bytes))
    hdrl = b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", strl)
    movi, index, at = [b"movi"], [], 4
    for f in frames:
        chunk = _chunk(b"00dc", f)
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        movi.append(chunk)
        at += len(chunk)
    return _chunk(b"RIFF", b"AVI " + _chunk(b"LIST", hdrl) + _chunk(b"LIST", b"".join(movi)) + _chunk(b"idx1", b"".join(index)))


def payload_of(text: str | None) -> bytes:
    """UTF-8 bytes, spaces appended up to a positive multiple of 192."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b" " * ((-len(raw)) % UNIT if raw else UNIT)


def write_avi(payloads: list[bytes]) -> list[bytes]:
    """An AVI file for each payload; one pass of array code for all of them."""
    padded = [p + b"\0" * (-len(p) % FRAME_BYTES) for p in payloads]
    units = coded(np.frombuffer(b"".join(padded), dtype=np.uint8).reshape(-1, UNIT))
    width, data = units.shape[1], units.tobytes()
    out, at = [], 0
    for payload, full in zip(payloads, padded):
        frames = []
        for _ in range(len(full) // FRAME_BYTES):
            parts = [HEAD]
            for k in range(UNITS):
                parts.append(data[at : at + width].replace(b"\xff", b"\xff\0"))
                if k < UNITS - 1:
                    parts.append(RESTARTS[k])
                at += width
            parts.append(b"\xff\xd9")
            frames.append(b"".join(parts))
        out.append(_avi(frames, len(payload)))
    return out


def read_riff(data: bytes) -> tuple[list[bytes], int | None, int]:
    """Frames by the idx1 index (by walking movi if there is none), payload length, ms per frame."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    frames, length, ms, movi, index = [], None, FRAME_MS, None, None

    def walk(at: int, stop: int) -> None:
        nonlocal length, ms, movi, index
        while at + 8 <= stop:
            name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
            body = at + 8
            if name == b"LIST" and data[body : body + 4] == b"movi":
                movi = (body, body + size)
            elif name == b"LIST":
                walk(body + 4, body + size)
            elif name == b"avih":
                ms = struct.unpack_from("<I", data, body)[0] // 1000
            elif name == b"strd" and size == 8:
                length = struct.unpack_from("<Q", data, body)[0]
            elif name == b"idx1":
                index = (body, size)
            at = body + size + size % 2

    walk(12, len(data))
    if movi and index:
        for k in range(index[1] // 16):
            name, _, at, size = struct.unpack_from("<4sIII", data, index[0] + 16 * k)
            if name[2:] in (b"dc", b"db"):
                frames.append(data[movi[0] + at + 8 : movi[0] + at + 8 + size])
    elif movi:
        at = movi[0] + 4
        while at + 8 <= movi[1]:
            size = struct.unpack_from("<I", data, at + 4)[0]
            if data[at + 2 : at + 4] in (b"dc", b"db"):
                frames.append(data[at + 8 : at + 8 + size])
            at += 8 + size + size % 2
    return frames, length, ms


def units_of(frame: bytes) -> bytes:
    """Entropy-coded units of a frame of this writer, byte stuffing and restart markers removed."""
    if not frame.startswith(HEAD) or frame[-2:] != b"\xff\xd9":
        raise ValueError("other tables than this writer's")
    units = RESTART.split(frame[len(HEAD) : -2])
    return b"".join([u.replace(b"\xff\0", b"\xff") for u in units])


def coefficients(units: np.ndarray) -> np.ndarray:
    """Extra bits of category 8 to signed coefficients, as JPEG extends them."""
    values = units.astype(np.int16)
    return np.where(values < 128, values - 255, values)


def pixels(blocks: np.ndarray, quant: np.ndarray | None = None) -> np.ndarray:
    """(n, 64) zigzag coefficients to (n, 8, 8) samples; whole-number arithmetic throughout."""
    square = np.zeros((len(blocks), 64))
    square[:, ZIGZAG] = blocks if quant is None else blocks * quant
    out = BASIS.T @ square.reshape(-1, 8, 8) @ BASIS
    return np.clip(np.floor((out + 2**25) / 2**26) + 128, 0, 255).astype(np.uint8)


def decode_general(frame: bytes) -> np.ndarray:
    """Coefficients (units, components, 64) of any baseline frame without subsampling. Slow, plain."""
    at, tables, interval, parts, n = 2, {}, 0, [], 0
    while True:
        marker, size = frame[at + 1], struct.unpack_from(">H", frame, at + 2)[0]
        body = frame[at + 4 : at + 2 + size]
        if marker == 0xC4:
            p = 0
            while p < len(body):
                key, counts = body[p], body[p + 1 : p + 17]
                code, q, table = 0, p + 17, {}
                for bits, count in enumerate(counts, 1):
                    for _ in range(count):
                        table[bits, code] = body[q]
                        code, q = code + 1, q + 1
                    code <<= 1
                tables[key], p = table, q
        elif marker == 0xC0:
            height, width, n = struct.unpack_from(">xHHB", body)
            if any(body[7 + 3 * k] != 0x11 for k in range(n)):
                raise ValueError("subsampled components")
            total = -(-height // 8) * -(-width // 8)
        elif marker == 0xDD:
            interval = struct.unpack(">H", body)[0]
        elif marker == 0xDA:
            parts = [(body[2 + 2 * k] >> 4, body[2 + 2 * k] & 15) for k in range(n)]
        elif 0xC1 <= marker <= 0xCF:
            raise ValueError("not a baseline frame")
        at += 2 + size
        if marker == 0xDA:
            break
    out = np.zeros((total, n, 64), dtype=np.int32)
    segments = iter(RESTART.split(frame[at : frame.rindex(b"\xff\xd9")]))
    for unit in range(total):
        if unit == 0 or interval and unit % interval == 0:
            data = next(segments).replace(b"\xff\0", b"\xff")
            bits, place, last = int.from_bytes(data, "big"), 8 * len(data), [0] * n

        def take(count: int) -> int:
            nonlocal place
            place -= count
            return bits >> place & (1 << count) - 1

        def symbol(table: dict) -> int:
            code = 0
            for length in range(1, 17):
                code = code << 1 | take(1)
                if (length, code) in table:
                    return table[length, code]
            raise ValueError("no such code")

        def extended(size: int) -> int:
            value = take(size) if size else 0
            return value if not size or value >> size - 1 else value - (1 << size) + 1

        for c, (dc, ac) in enumerate(parts):
            last[c] += extended(symbol(tables[dc]))
            out[unit, c, 0] = last[c]
            k = 1
            while k < 64:
                run, size = divmod(symbol(tables[16 + ac]), 16)
                if size == 0 and run != 15:
                    break
                k += run
                if size:
                    out[unit, c, k] = extended(size)
                k += 1
    return out


def histograms(units: np.ndarray, per_frame: int = UNITS) -> np.ndarray:
    """Luma histograms of frames, from their units' first blocks."""
    luma = pixels(coefficients(units[:, :64])) >> (8 - BINS.bit_length() + 1)
    frame = np.repeat(np.arange(len(units) // per_frame), per_frame * 64)
    return np.bincount(frame * BINS + luma.ravel(), minlength=len(units) // per_frame * BINS).reshape(-1, BINS)


def shots(hists: np.ndarray) -> list[int]:
    """First frames of the shots: adaptive histogram differences, in whole numbers."""
    starts, total, seen = [0], 0, 0
    for k, change in enumerate(np.abs(np.diff(hists, axis=0)).sum(axis=1).tolist(), 1):
        if seen and change >= LEAST_CHANGE and 8 * change * seen > OVER_MEAN * total:
            starts.append(k)
            total = seen = 0
        else:
            total, seen = total + change, seen + 1
    return starts


def examine(files: list[bytes]) -> list[tuple[bytes, list[tuple[int, int]], int]]:
    """For each file of this writer: payload, clips as (first, after last) frames, luma checksum."""
    parsed = [read_riff(f) for f in files]
    units = uncoded(np.frombuffer(b"".join([units_of(x) for frames, _, _ in parsed for x in frames]), dtype=np.uint8).reshape(-1, UNIT * 9 // 8))
    hists, data, out, at = histograms(units), units.tobytes(), [], 0
    for frames, length, _ in parsed:
        n = len(frames)
        own = hists[at : at + n]
        starts = shots(own)
        out.append((data[at * FRAME_BYTES : at * FRAME_BYTES + length], list(zip(starts, [*starts[1:], n])), zlib.crc32(own.astype("<i4").tobytes())))
        at += n
    return out


def luma_quantisers(frame: bytes) -> np.ndarray:
    """The quantisers of the first component, in zigzag order."""
    at, tables, wanted = 2, {}, 0
    while frame[at + 1] != 0xDA:
        marker, size = frame[at + 1], struct.unpack_from(">H", frame, at + 2)[0]
        body = frame[at + 4 : at + 2 + size]
        if marker == 0xDB:
            p = 0
            while p < len(body):
                wide = body[p] >> 4
                tables[body[p] & 15] = np.frombuffer(body, ">u2" if wide else np.uint8, 64, p + 1).astype(np.int64)
                p += 129 if wide else 65
        elif marker == 0xC0:
            wanted = body[8]
        at += 2 + size
    return tables[wanted]


def timed(file: bytes) -> tuple[list[tuple[int, int]], int]:
    """Clips of any file as (first, after last) frames, and milliseconds per frame."""
    frames, _, ms = read_riff(file)
    try:
        return examine([file])[0][1], ms
    except (ValueError, TypeError):  # another writer's frames or header
        hists = []
        for frame in frames:
            luma = pixels(decode_general(frame)[:, 0], luma_quantisers(frame)) >> (8 - BINS.bit_length() + 1)
            hists.append(np.bincount(luma.ravel(), minlength=BINS) * SIDE * SIDE // luma.size)
        starts = shots(np.array(hists)) if hists else []
        return list(zip(starts, [*starts[1:], len(frames)])), ms


def store(docs: DataFrame) -> DataFrame:
    """doc_id and the AVI file of each document's payload."""

    def write(batches):
        for batch in batches:
            for part in slices(batch):
                files = write_avi([payload_of(t) for t in part.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(files, pa.binary())], names=["doc_id", "avi"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(write, "doc_id long, avi binary")


def clips(media: DataFrame) -> DataFrame:
    """Timed clip rows of stored files: doc_id, clip, start_ms, end_ms, frames."""

    def read(batches):
        for batch in batches:
            rows = []
            for doc_id, file in zip(batch.column("doc_id").to_pylist(), batch.column("avi").to_pylist()):
                found, ms = timed(file)
                rows += [(doc_id, k, a * ms, b * ms, b - a) for k, (a, b) in enumerate(found)]
            names = ["doc_id", "clip", "start_ms", "end_ms", "frames"]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * 5)], names=names)

    return media.select("doc_id", "avi").mapInArrow(read, "doc_id long, clip long, start_ms long, end_ms long, frames long")


def features(docs: DataFrame) -> DataFrame:
    """Store every whole text, read the stored bytes back, and describe both."""

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                texts = part.column("text").to_pylist()
                files = write_avi([payload_of(t) for t in texts])
                rows = []
                for text, file, (payload, found, luma) in zip(texts, files, examine(files)):
                    spans = ",".join(f"{a * FRAME_MS}-{b * FRAME_MS}" for a, b in found)
                    rows.append((
                        len((text or "").encode("utf-8", "surrogatepass")), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]),
                        len(file), hashlib.sha256(file).hexdigest(), f"frames={found[-1][1]};shots={len(found)};luma={luma:08x};clips={spans}",
                    ))
                types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *[pa.array(c, t) for c, t in zip(zip(*rows), types)]], names=["doc_id", *names])

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)
