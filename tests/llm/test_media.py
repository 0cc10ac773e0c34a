"""Media: found, rejected, corrected and carved; stored text reads back."""

from __future__ import annotations

import gzip
import hashlib
import io
import struct
import zipfile
import zlib

import pytest

from skein.llm import media


def png(n=3):
    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, n, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0" * n)) + chunk(b"IEND", b"")


def gif():
    return b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0x80, 0, 0) + b"\0\0\0\xff\xff\xff" + b"\x2c" + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\x02\x02\x44\x01\x00" + b"\x3b"


def jpeg():
    return b"\xff\xd8\xff\xe0\x00\x04ab" + b"\xff\xc0\x00\x05abc" + b"\xff\xda\x00\x03a" + b"scan\xff\x00\xff\xd0data" + b"\xff\xd9"


def bmp():
    return b"BM" + struct.pack("<IIII", 58, 0, 54, 40) + bytes(40)


def zipped():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a.txt", "hello")
    return out.getvalue()


def ogg():
    page = lambda flags, n: b"OggS\0" + bytes([flags]) + bytes(20) + bytes([1, n]) + b"x" * n
    return page(2, 5) + page(4, 7)


def mp4():
    box = lambda kind, data: struct.pack(">I4s", 8 + len(data), kind) + data
    return box(b"ftyp", b"isom0000") + box(b"moov", b"1234")


KINDS = {"png": png(), "gif": gif(), "jpeg": jpeg(), "bmp": bmp(), "wav": media.wav(b"abcd"), "gzip": gzip.compress(b"text" * 50), "zip": zipped(), "pdf": b"%PDF-1.4 x startxref 9 %%EOF", "ogg": ogg(), "mp4": mp4()}


@pytest.mark.parametrize("kind", KINDS)
def test_each_format_is_found_with_its_length(kind):
    blob = KINDS[kind]
    assert (kind, 0, len(blob)) in media.find_media(blob)
    assert (kind, 7, len(blob)) in media.find_media(b"prefix:" + blob + b"some bytes after")
    assert not [x for x in media.find_media(blob[: len(blob) - 2]) if x[0] == kind]


def test_magic_without_structure_is_nothing():
    assert media.find_media(b"GIF89a is a name, BM too, %PDF- and RIFF and PK\x03\x04, \xff\xd8\xff, OggS, ftyp, \x1f\x8b\x08") == []
    broken = bytearray(png())
    broken[20] ^= 1
    assert media.find_media(bytes(broken)) == []


def test_declared_types_are_corrected_and_media_carved(spark):
    inside = b"junk" + png() + b"--" + gif()
    rows = [(1, png(), "image/jpeg"), (2, png(), " IMAGE/PNG "), (3, inside, "application/octet-stream"), (4, b"", "image/png"), (5, None, "image/png"), (6, gif(), None)]
    df = media.sniff(spark.createDataFrame(rows, "id long, blob binary, declared string"), "blob", "declared")
    got = {r["id"]: (r["media_type"], r["media_corrected"]) for r in df.collect()}
    assert got == {1: ("png", True), 2: ("png", False), 3: ("bin", False), 4: ("bin", True), 5: (None, True), 6: ("gif", True)}
    cut = {(r["id"], r["type"], r["offset"]): bytes(r["bytes"]) for r in media.carve(df, "blob", "id").collect()}
    assert cut[3, "png", 4] == png() and cut[3, "gif", 6 + len(png())] == gif()
    assert media.sniff(spark.createDataFrame([], "id long, blob binary"), "blob").count() == 0


def test_stored_text_reads_back(spark):
    texts = ["", None, "x", "é" * 40, "GIF89a", "a" * 64, "b" * 65, "long " * 50_000]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(2, "x"), (None, "x")], "doc_id long, text string")
    out = {}
    for r in media.text_features(docs).collect():
        out.setdefault(r["doc_id"], []).append(r)
    assert len(out[2]) == 2 and out[2][0] == out[2][1] and out[2][0]["feature"] == out[None][0]["feature"]
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        blob = media.wav(payload)
        r = out[i][0]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert (r["tail_crc32"], r["media_bytes"], r["media_sha256"]) == (zlib.crc32(payload[-64:]), len(blob), hashlib.sha256(blob).hexdigest())
    assert media.text_features(docs.filter("false")).count() == 0


def test_pdf_ends_at_its_last_end():
    body = b"%PDF-1.4\nxref\n0 1\ntrailer <<>>\nstartxref\n"
    plain = body + b"9\n%%EOF"
    update = b"\nmore\nxref\n0 1\ntrailer <<>>\nstartxref\n"
    updated = plain + update + str(len(plain) + 6).encode() + b"\n%%EOF"
    linear = body + b"0\n%%EOF\n1 0 obj <<>> endobj\nstartxref\n9\n%%EOF"
    for blob in (plain, updated, linear):
        found = media.find_media(b"junk" + blob + b"\nnot of it startxref\n3\n%%EOF" + blob)
        assert [x for x in found if x[0] == "pdf"] == [("pdf", 4, len(blob)), ("pdf", 4 + len(blob) + 28, len(blob))]


def test_mp4_boxes_of_64_bits_and_to_the_end():
    box = lambda kind, data: struct.pack(">I4s", 8 + len(data), kind) + data
    long_box = struct.pack(">I4sQ", 1, b"mdat", 16 + 50) + bytes(50)
    first = box(b"ftyp", b"isom0000") + long_box + box(b"moov", b"1234")
    assert ("mp4", 3, len(first)) in media.find_media(b"abc" + first + b"some bytes after")
    last = box(b"ftyp", b"isom0000") + box(b"moov", b"1234") + struct.pack(">I4s", 0, b"mdat") + bytes(70)
    assert ("mp4", 3, len(last)) in media.find_media(b"abc" + last)
