"""Media columns: finding, checking and carving media by their signatures.

``sniff`` looks through every blob of a column once: an Aho-Corasick automaton finds the magic bytes of all formats
together, and a validator for each format walks its structure, so that a hit counts only with a sound header and a
length that fits. A blob's declared type is corrected by the format found at its start, and media found further in
are carved (offset, length). ``store_text`` puts text into 8-bit PCM sound, from which the payload is read back.

Cases: a null blob has type null and no parts; an empty blob or one without a sound format at its start is ``bin``.
Overlapping finds are all reported, the outer before the inner. A null text counts as empty. Rows are independent,
so ties, repeated rows and an empty table need no rule. Other columns are passed through by ``sniff``; own columns that
bear a result's name (in any case) are kept with ``own_`` before it.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import struct
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.names import chosen, numbered, with_results

# The magic bytes of the formats and where they stand from a file's start.
MAGIC = {
    "png": (b"\x89PNG\r\n\x1a\n", 0),
    "gif87": (b"GIF87a", 0),
    "gif89": (b"GIF89a", 0),
    "jpeg": (b"\xff\xd8\xff", 0),
    "bmp": (b"BM", 0),
    "riff": (b"RIFF", 0),
    "gzip": (b"\x1f\x8b\x08", 0),
    "zip": (b"PK\x03\x04", 0),
    "pdf": (b"%PDF-", 0),
    "ogg": (b"OggS", 0),
    "mp4": (b"ftyp", 4),
}
MIME = {
    "png": "image/png",
    "gif": "image/gif",
    "jpeg": "image/jpeg",
    "bmp": "image/bmp",
    "wav": "audio/wav",
    "webp": "image/webp",
    "gzip": "application/gzip",
    "zip": "application/zip",
    "pdf": "application/pdf",
    "ogg": "audio/ogg",
    "mp4": "video/mp4",
}
PARTS = "array<struct<type:string,offset:long,length:long>>"
BLOCK = 64


def _png(b: bytes, at: int) -> tuple[str, int] | None:
    p, first = at + 8, True
    while p + 12 <= len(b):
        n, kind = struct.unpack_from(">I4s", b, p)
        if p + 12 + n > len(b) or first and (kind != b"IHDR" or n != 13):
            return None
        if zlib.crc32(b[p + 4 : p + 8 + n]) != struct.unpack_from(">I", b, p + 8 + n)[0]:
            return None
        p, first = p + 12 + n, False
        if kind == b"IEND":
            return "png", p - at
    return None


def _gif(b: bytes, at: int) -> tuple[str, int] | None:
    if at + 13 > len(b):
        return None
    p = at + 13 + (3 << (b[at + 10] & 7) + 1 if b[at + 10] & 128 else 0)

    def past(p: int) -> int:
        while p < len(b) and b[p]:
            p += b[p] + 1
        return p + 1

    while p < len(b):
        if b[p] == 0x3B:
            return "gif", p + 1 - at
        if b[p] == 0x21:
            p = past(p + 2)
        elif b[p] == 0x2C and p + 10 <= len(b):
            p = past(p + 11 + (3 << (b[p + 9] & 7) + 1 if b[p + 9] & 128 else 0))
        else:
            return None
    return None


def _jpeg(b: bytes, at: int) -> tuple[str, int] | None:
    p, frame = at + 2, False
    while p + 4 <= len(b) and b[p] == 0xFF:
        mark, n = b[p + 1], struct.unpack_from(">H", b, p + 2)[0]
        if n < 2 or mark in (0x00, 0xFF, 0xD8, 0xD9):
            return None
        frame |= mark in (0xC0, 0xC1, 0xC2)
        p += 2 + n
        if mark == 0xDA:
            while True:
                p = b.find(b"\xff", p)
                if p < 0 or p + 1 >= len(b):
                    return None
                if b[p + 1] == 0xD9:
                    return ("jpeg", p + 2 - at) if frame else None
                if b[p + 1] == 0 or 0xD0 <= b[p + 1] <= 0xD7:
                    p += 2
                else:
                    break
    return None


def _bmp(b: bytes, at: int) -> tuple[str, int] | None:
    if at + 26 > len(b):
        return None
    size, _, pixels, header = struct.unpack_from("<IIII", b, at + 2)
    good = header in (12, 40, 52, 56, 64, 108, 124) and 14 + header <= pixels <= size <= len(b) - at
    return ("bmp", size) if good else None


def chunks(b: bytes, at: int, size: int) -> dict[bytes, tuple[int, int]] | None:
    """The chunks of a RIFF file, or None if their lengths do not add up."""
    found, p, end = {}, at + 12, at + 8 + size
    while p + 8 <= end:
        kind, n = struct.unpack_from("<4sI", b, p)
        if p + 8 + n > end:
            return None
        found.setdefault(kind, (p + 8, n))
        p += 8 + n + (n & 1)
    return found if p in (end, end + 1) else None


def _riff(b: bytes, at: int) -> tuple[str, int] | None:
    if at + 12 > len(b):
        return None
    size, kind = struct.unpack_from("<I4s", b, at + 4)
    if size < 4 or at + 8 + size > len(b) or kind not in (b"WAVE", b"WEBP") or (found := chunks(b, at, size)) is None:
        return None
    if kind == b"WEBP":
        return ("webp", 8 + size) if found.keys() & {b"VP8 ", b"VP8L", b"VP8X"} else None
    if b"data" not in found or found.get(b"fmt ", (0, 0))[1] < 16:
        return None
    _, channels, _, _, align, bits = struct.unpack_from("<HHIIHH", b, found[b"fmt "][0])
    good = channels and align == channels * ((bits + 7) // 8) and found[b"data"][1] % max(align, 1) == 0
    return ("wav", 8 + size) if good else None


def _gzip(b: bytes, at: int) -> tuple[str, int] | None:
    stream = zlib.decompressobj(31)
    try:
        p = at
        while p < len(b) and not stream.eof:
            rest = b[p : p + 65536]
            while rest and not stream.eof:
                stream.decompress(rest, 1 << 20)
                rest = stream.unconsumed_tail
            p += 65536
    except zlib.error:
        return None
    return ("gzip", min(p, len(b)) - len(stream.unused_data) - at) if stream.eof else None


class Blob(bytes):
    """Bytes that remember where marks stand, so that many hits of one format cost one search."""

    def places(self, mark: bytes) -> list[int]:
        known = self.__dict__.setdefault("known", {})
        if mark not in known:
            known[mark] = [m.start() for m in re.finditer(re.escape(mark), self)]
        return known[mark]

    def after(self, mark: bytes, at: int) -> int:
        """The first place of a mark from ``at`` on, or -1."""
        places = self.places(mark)
        i = bisect.bisect_left(places, at)
        return places[i] if i < len(places) else -1

    def archives(self) -> dict[int, int]:
        """ZIP archives by their directories: from an archive's start to its end (the nearest of several)."""
        if "ends" not in self.__dict__:
            self.ends: dict[int, int] = {}
            for p in self.places(b"PK\x05\x06"):
                if p + 22 <= len(self):
                    entries, size, offset, note = struct.unpack_from("<HIIH", self, p + 10)
                    start = p - size
                    if start - offset >= 0 and p + 22 + note <= len(self) and (not entries or self[start : start + 4] == b"PK\x01\x02"):
                        self.ends.setdefault(start - offset, p + 22 + note)
        return self.ends


def _zip(b: Blob, at: int) -> tuple[str, int] | None:
    end = b.archives().get(at)
    return ("zip", end - at) if end else None


def _pdf(b: Blob, at: int) -> tuple[str, int] | None:
    if not b[at + 5 : at + 6].isdigit() or b[at + 6 : at + 7] != b".":
        return None
    end, table = b.after(b"%%EOF", at), b.after(b"startxref", at)
    if end < 0 or not 0 <= table < end:
        return None
    # Later ends before the next file's header: of updates, whose table follows the end before, or of a linearised file,
    # whose first end names table 0 and whose last names the table before it.
    first = re.search(rb"startxref\s+(\d+)\s*$", b[max(at, end - 64) : end])
    linearised, stop = bool(first) and int(first[1]) == 0, b.after(b"%PDF-", end)
    end, later = end + 5, end + 5
    while 0 <= (later := b.after(b"%%EOF", later)) < (stop if stop >= 0 else len(b)):
        said = re.search(rb"startxref\s+(\d{1,18})\s*$", b[max(end, later - 64) : later])
        table = at + int(said[1]) if said else len(b)
        if (table >= end or linearised) and at < table < later and re.compile(rb"xref|\d{1,20}\s{1,20}\d{1,20}\s{1,20}obj").match(b, table):
            end, linearised = later + 5, False
        later += 5
    return "pdf", end - at


def _ogg(b: bytes, at: int) -> tuple[str, int] | None:
    p = at
    if at + 27 > len(b) or b[at + 4] or not b[at + 5] & 2:
        return None
    while p + 27 <= len(b) and b[p : p + 4] == b"OggS":
        n = b[p + 26]
        end = p + 27 + n + sum(b[p + 27 : p + 27 + n])
        if p + 27 + n > len(b) or end > len(b):
            return None
        last, p = b[p + 5] & 4, end
        if last:
            return "ogg", p - at
    return None


def _mp4(b: bytes, at: int) -> tuple[str, int] | None:
    p, seen = at, set()
    while at >= 0 and p + 8 <= len(b):
        n, kind = struct.unpack_from(">I4s", b, p)
        if n == 1 and p + 16 <= len(b):
            n = m if (m := struct.unpack_from(">Q", b, p + 8)[0]) >= 16 else 0
        elif n == 0:
            n = len(b) - p
        if n < 8 or p + n > len(b) or not kind.isalnum():
            break
        seen.add(kind)
        p += n
    return ("mp4", p - at) if {b"ftyp", b"moov"} <= seen else None


VALIDATORS: dict[str, Callable[[bytes, int], tuple[str, int] | None]] = {
    "png": _png, "gif87": _gif, "gif89": _gif, "jpeg": _jpeg, "bmp": _bmp, "riff": _riff, "gzip": _gzip, "zip": _zip, "pdf": _pdf, "ogg": _ogg, "mp4": _mp4,
}
_automata: list = []


def _automaton():
    if not _automata:
        import ahocorasick

        built = ahocorasick.Automaton()
        for name, (magic, shift) in MAGIC.items():
            built.add_word(magic.decode("latin-1"), (name, len(magic) - 1 + shift))
        built.make_automaton()
        _automata.append(built)
    return _automata[0]


def find_media(blob: bytes) -> list[tuple[str, int, int]]:
    """(type, offset, length) of every sound medium, by offset; at one offset the longest first."""
    found, blob = set(), Blob(blob)
    for end, (name, back) in _automaton().iter(blob.decode("latin-1")):
        if end - back >= 0 and (got := VALIDATORS[name](blob, end - back)):
            found.add((got[0], end - back, got[1]))
    return sorted(found, key=lambda x: (x[1], -x[2], x[0]))


def _sniffed(blobs: pa.Array) -> pa.Array:
    rows = []
    for blob in blobs.to_pylist():
        rows.append(None if blob is None else [{"type": t, "offset": o, "length": n} for t, o, n in find_media(blob)])
    kind = pa.struct([("type", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
    return pa.array(rows, pa.list_(kind))


def sniff(df: DataFrame, blob_col: str, declared_col: str | None = None) -> DataFrame:
    """``df`` with ``media_parts``, ``media_type`` and, given a declared MIME type, ``media_corrected``."""
    plain, of = numbered(df)

    @F.arrow_udf(PARTS)
    def parts(blobs: pa.Array) -> pa.Array:
        return _sniffed(blobs)

    out = plain.withColumn("parts_", parts(F.col(of(blob_col))))
    at_start = F.filter("parts_", lambda x: x["offset"] == 0)
    names = F.create_map(*[F.lit(x) for pair in MIME.items() for x in pair])
    out = out.withColumn("type_", F.when(F.col("parts_").isNotNull(), F.coalesce(F.when(F.size(at_start) > 0, at_start[0]["type"]), F.lit("bin"))))
    last, results = ["parts_", "type_"], ["media_parts", "media_type"]
    if declared_col:
        true = F.coalesce(names[F.col("type_")], F.when(F.col("type_") == "bin", F.lit("application/octet-stream")))
        out = out.withColumn("corrected_", ~true.eqNullSafe(F.lower(F.trim(F.col(of(declared_col))))))
        last, results = [*last, "corrected_"], [*results, "media_corrected"]
    return with_results(out.toDF(*df.columns, *last), results, last)


def carve(df: DataFrame, blob_col: str, id_col: str) -> DataFrame:
    """One row for every medium inside a sniffed blob, with its bytes."""
    parts = df.select(id_col, F.col(blob_col).alias("_blob"), F.explode("media_parts").alias("_p"))
    cut = F.expr("substring(_blob, CAST(_p.offset + 1 AS INT), CAST(_p.length AS INT))")
    return parts.select(id_col, F.col("_p.type").alias("type"), F.col("_p.offset").alias("offset"), F.col("_p.length").alias("length"), cut.alias("bytes"))


def payload_of(text: bytes) -> bytes:
    return text + bytes(-len(text) % BLOCK or (0 if text else BLOCK))


def wav(samples: bytes, rate: int = 8000) -> bytes:
    """Unsigned 8-bit mono PCM."""
    fmt = struct.pack("<HHIIHH", 1, 1, rate, rate, 1, 8)
    pad = b"\0" * (len(samples) & 1)
    return b"RIFF" + struct.pack("<I", 36 + len(samples) + len(pad)) + b"WAVEfmt " + struct.pack("<I", 16) + fmt + b"data" + struct.pack("<I", len(samples)) + samples + pad


def samples_of(blob: bytes) -> bytes:
    """The samples of sound found sound; the inverse of ``wav``."""
    at, n = chunks(blob, 0, struct.unpack_from("<I", blob, 4)[0])[b"data"]
    return blob[at : at + n]


def store_text(df: DataFrame, text_col: str = "text", into: str = "media") -> DataFrame:
    """``df`` with the UTF-8 bytes of its text, filled up with zeros to whole blocks, as WAV in column ``into``."""

    @F.arrow_udf("binary")
    def stored(texts: pa.Array) -> pa.Array:
        return pa.array([wav(payload_of((t or "").encode())) for t in texts.to_pylist()], pa.binary())

    return df.withColumn(into, stored(F.col(text_col)))


FEATURES = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc_id, n, blob in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            parts = find_media(blob)
            outer = next((p for p in parts if p[1] == 0 and p[2] == len(blob)), None)
            if outer is None or outer[0] != "wav":
                raise ValueError("a stored payload does not read back as sound")
            payload = samples_of(blob)
            inner = ",".join(f"{t}@{o}+{k}" for t, o, k in parts if o)
            rows.append((doc_id, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-BLOCK:]), len(blob), hashlib.sha256(blob).hexdigest(), f"{MIME['wav']};u8;mono;samples={len(payload)};inside={inner}"))
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 8
        kinds = [pa.int64()] * 3 + [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])


def text_features(docs: DataFrame) -> DataFrame:
    """Stores every text as sound, sniffs what was stored, reads its samples back and describes them."""
    docs = chosen(docs, "doc_id", "text")
    n = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    stored = store_text(docs.select(F.col("doc_id").cast("long").alias("doc_id"), n.alias("n_bytes"), "text")).select("doc_id", "n_bytes", "media")
    return stored.mapInArrow(_features, f"doc_id long, n_bytes long, {FEATURES}")
