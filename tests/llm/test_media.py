"""AVI motion-JPEG: exact round trips, the plain decoder, shots."""

import hashlib
import random
import struct
import zlib

import numpy as np

from textloom.llm import media

from .conftest import ODD

PAYLOADS = [bytes(range(256)) * 3, b"\xff" * 192, b"\0" * 1536, random.Random(1).randbytes(192 * 33), media.payload_of(None), media.payload_of("é" * 500)]


def test_round_trip():
    files = media.write_avi(PAYLOADS)
    assert [p for p, _, _ in media.examine(files)] == PAYLOADS
    for alone, file in zip(PAYLOADS, files):
        assert media.write_avi([alone]) == [file] and media.examine([file])[0] == media.examine(files)[files.index(file)]


def test_payloads():
    assert media.payload_of("") == b" " * 192 and len(media.payload_of("x" * 192)) == 192 and len(media.payload_of("x" * 193)) == 384


def test_plain_decoder_agrees():
    for file in media.write_avi(PAYLOADS[:4]):
        frames, length, ms = media.read_riff(file)
        assert ms == 40 and length
        units = media.uncoded(np.frombuffer(b"".join(map(media.units_of, frames)), np.uint8).reshape(-1, 216))
        slow = np.concatenate([media.decode_general(f).reshape(-1, 192) for f in frames])
        assert (slow == media.coefficients(units)).all()


def test_frames_without_index():
    file = media.write_avi([PAYLOADS[3]])[0]
    cut = file[: file.index(b"idx1")]
    cut = cut[:4] + struct.pack("<I", len(cut) - 8) + cut[8:]
    assert media.read_riff(cut)[0] == media.read_riff(file)[0]


def test_pixels_are_the_inverse_cosine_transform():
    rng = np.random.default_rng(3)
    blocks = rng.integers(-40, 40, (50, 64))
    square = np.zeros((50, 64))
    square[:, media.ZIGZAG] = blocks
    basis = np.array([[(0.5 if u else 0.5**1.5) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])
    exact = np.clip(np.einsum("ux,nuv,vy->nxy", basis, square.reshape(-1, 8, 8), basis) + 128, 0, 255)
    assert np.abs(media.pixels(blocks) - exact).max() <= 0.52


def test_zigzag():
    assert media.ZIGZAG[:10].tolist() == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24] and sorted(media.ZIGZAG) == list(range(64))


def test_shots():
    calm, other = np.zeros((10, 16), dtype=int), np.zeros((10, 16), dtype=int)
    calm[:, 2], other[:, 9] = 256, 256
    calm[::2, 3] = 5
    assert media.shots(np.concatenate([calm, other])) == [0, 10]
    assert media.shots(calm[:1]) == [0]


def test_query(odd, none, small):
    docs, texts = small
    rows = {r["doc_id"]: r for r in media.features(docs).collect()}
    for doc_id, text in texts:
        payload = media.payload_of(text)
        r = rows[doc_id]
        assert (r["n_bytes"], r["payload_bytes"]) == (len(text.encode()), len(payload))
        assert (r["payload_sha256"], r["tail_crc32"]) == (hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
    assert media.features(odd).count() == len(ODD) and media.features(none).count() == 0
    stored = media.store(odd.where("doc_id = 5"))
    found = media.clips(stored).orderBy("clip").collect()
    assert found[0]["start_ms"] == 0 and all(a["end_ms"] == b["start_ms"] for a, b in zip(found, found[1:]))
    assert media.clips(media.store(none)).count() == 0


def gray_frame(levels):
    """A baseline frame of one component whose 8x8 blocks have these DC steps, with tables of its own: twelve DC codes
    of four bits, one AC code for the end of a block, quantisers of 8."""
    bits, last = "", 0
    for level in levels:
        diff, last = level - last, level
        size = abs(diff).bit_length()
        bits += f"{size:04b}" + (f"{diff if diff > 0 else diff + (1 << size) - 1:0{size}b}" if size else "") + "0"
    bits += "1" * (-len(bits) % 8)
    data = int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\0")
    part = lambda marker, body: struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body
    tables = bytes([0, 0, 0, 0, 12, *[0] * 12, *range(12), 0x10, 1, *[0] * 15, 0])
    sizes = struct.pack(">BHHB", 8, 8, 8 * len(levels), 1) + bytes([1, 0x11, 0])
    return b"\xff\xd8" + part(0xDB, bytes([0, *[8] * 64])) + part(0xC0, sizes) + part(0xC4, tables) + part(0xDA, bytes([1, 1, 0, 0, 63, 0])) + data + b"\xff\xd9"


def test_files_of_other_writers(spark):
    frames = [gray_frame([60 + k % 2] * 6) for k in range(5)] + [gray_frame([-80, -70] * 3)] * 4
    assert (media.decode_general(frames[-1])[:, 0, 0] == [-80, -70] * 3).all() and media.luma_quantisers(frames[0]).tolist() == [8] * 64
    file = media._avi(frames, 0).replace(b"strd", b"junk")
    assert media.timed(file) == ([(0, 5), (5, 9)], 40)
    rows = media.clips(spark.createDataFrame([(1, bytearray(file)), (2, bytearray(media.write_avi([PAYLOADS[3]])[0]))], "doc_id long, avi binary")).collect()
    assert [tuple(r) for r in rows if r["doc_id"] == 1] == [(1, 0, 0, 200, 5), (1, 1, 200, 360, 4)] and any(r["doc_id"] == 2 for r in rows)
