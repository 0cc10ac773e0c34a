"""Packing by powers of two.

Every document is tokenised, closed with an end id, and cut into pieces whose lengths are the powers of two of its
length: as many full windows as fit, then one piece for every set bit of the rest, the longest first. Each piece is a
sequence of its own, filed under its length, so no sequence crosses documents and none needs padding. The job is one
pass over the table without a shuffle; its memory is bounded by a block of text and a bounded cache of word ids. A tokenizer
that splits text in another way than the cache of words needs encodes each text as a whole.

Cases: a null text counts as empty, and an empty text is its end id alone, one piece of length 1. A null id is kept.
Repeated rows are packed once each. Other columns are not carried. An empty table gives an empty result.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.memory import release
from skein.llm.names import chosen
from skein.llm.words import blocks, text_buffers

#: Words of at most this many bytes are remembered, and so many of them in a task.
CACHED_WORD_BYTES, CACHED_WORDS = 48, 300_000
#: ASCII marks that end a word in running text; after a letter they always make a token of their own.
MARKS = b".,!?;:%&*$#"
# Fixed value: how the vocabularies that ``WordEncoder`` reads split a text.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long"


class WordEncoder:
    """Ids of a text, word by word: white space separates the tokens of the vocabularies this works with.

    A word of Latin letters and the marks after it are encoded apart, since no token of these vocabularies holds both; the
    letters alone need none of the vocabulary's normalising and splitting. Any other word is encoded as it stands.
    """

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole, self.letters = Tokenizer.from_str(spec), Tokenizer.from_str(spec)
        self.letters.normalizer = None
        self.letters.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.known: dict[bytes, bytes] = {}
        self.stems: dict[bytes, bytes] = {}

    @staticmethod
    def _fill(known: dict[bytes, bytes], words: list[bytes], texts: list[str], tokenizer) -> None:
        for at in range(0, len(words), 4096):
            found = tokenizer.encode_batch_fast(texts[at : at + 4096], add_special_tokens=False)
            for word, encoding in zip(words[at : at + 4096], found, strict=True):
                known[word] = array("I", encoding.ids).tobytes()

    def learn(self, words: set[bytes]) -> None:
        missing = [w for w in words if w not in self.known]
        if len(self.known) + len(missing) > CACHED_WORDS:
            self.known.clear()
            missing = list(words)
        if len(self.stems) + len(missing) > CACHED_WORDS:
            self.stems.clear()
        stems = [w.rstrip(MARKS) for w in missing]
        fresh, odd = {}, set()
        for stem in set(stems).difference(self.stems):
            text = stem.decode()
            if text.isalpha() and (text.isascii() or max(text) <= "\xff"):
                fresh[stem] = text.lower()
            else:
                odd.add(stem)
        self._fill(self.stems, list(fresh), list(fresh.values()), self.letters)
        tails = {w[len(s) :] for w, s in zip(missing, stems, strict=True) if s is not w and s not in odd}
        whole = list(tails.union(w for w, s in zip(missing, stems, strict=True) if s in odd).difference(self.known)) if odd else list(tails.difference(self.known))
        self._fill(self.known, whole, [w.decode() for w in whole], self.whole)
        known, of_stem = self.known, self.stems
        for word, stem in zip(missing, stems, strict=True):
            if stem is word:
                if stem not in odd:
                    known[word] = of_stem[stem]
            elif stem not in odd:
                known[word] = of_stem[stem] + known[word[len(stem) :]]

    def forget(self) -> None:
        self.known.clear()
        self.stems.clear()

    def encode(self, texts: list[bytes]) -> list[bytes]:
        # These vocabularies fold case themselves; only their special tokens, spelled <|...|>, depend on it.
        split = [(t if b"<|" in t else t.lower()).split() for t in texts]
        words = set().union(*split)
        self.learn(words)
        find = self.known.__getitem__
        out = [b"".join(map(find, own)) for own in split]
        for word in [w for w in words if len(w) > CACHED_WORD_BYTES]:
            del self.known[word]
            self.stems.pop(word.rstrip(MARKS), None)
        return out


class PlainEncoder:
    """Ids of a text by any tokenizer, each text as a whole."""

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_str(spec)

    def forget(self) -> None:
        """Nothing is remembered."""

    def encode(self, texts: list[bytes]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.whole.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]


def by_words(spec: str) -> bool:
    """Whether a tokenizer normalises and splits as ``WordEncoder`` takes for granted."""
    given = json.loads(spec)
    normalizer, splitter = given.get("normalizer") or {}, given.get("pre_tokenizer") or {}
    steps, parts = normalizer.get("normalizers", []), splitter.get("pretokenizers", [])
    if [x["type"] for x in steps] != ["NFC", "Replace", "Lowercase"] or [x["type"] for x in parts] != ["Split", "ByteLevel"]:
        return False
    spaces = steps[1]["pattern"] == {"Regex": r"\s+"} and steps[1]["content"] == " "
    words = parts[0]["pattern"] == {"Regex": WORD_PATTERN} and parts[0]["behavior"] == "Removed" and parts[0]["invert"]
    bytewise = not parts[1]["add_prefix_space"] and not parts[1]["use_regex"]
    special = all(x["content"].startswith("<|") and not x["lstrip"] and not x["rstrip"] and not x["single_word"] and not re.search(r"\s", x["content"]) for x in given.get("added_tokens", []))
    return spaces and words and bytewise and special and given.get("truncation") is None and given.get("padding") is None


def encoder_of(spec: str) -> WordEncoder | PlainEncoder:
    return WordEncoder(spec) if by_words(spec) else PlainEncoder(spec)


_encoders: dict[int, WordEncoder | PlainEncoder] = {}


def cuts(n: int, window: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids; window is a power of two."""
    out = [(at, window) for at in range(0, n - n % window, window)]
    at, bit = n - n % window, window >> 1
    while at < n:
        if (n - at) & bit:
            out.append((at, bit))
            at += bit
        bit >>= 1
    return out


def _pieces(batches: Iterator[pa.RecordBatch], spec, end: bytes, window: int) -> Iterator[pa.RecordBatch]:
    text = spec.value
    encoder = _encoders.get(hash(text)) or _encoders.setdefault(hash(text), encoder_of(text))
    try:
        yield from _packed(batches, encoder, end, window)
    finally:
        encoder.forget()
        release()


def _packed(batches: Iterator[pa.RecordBatch], encoder: WordEncoder | PlainEncoder, end: bytes, window: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        offs, raw = text_buffers(batch.column(1))
        for at, to in blocks(offs, 1 << 20):
            ids = batch.column(0).slice(at, to - at)
            encoded = encoder.encode([raw[offs[i] : offs[i + 1]].tobytes() for i in range(at, to)])
            row, start, length, cut, total = [], [], [], [], []
            for i, got in enumerate(encoded):
                got += end
                n = len(got) // 4
                for a, k in cuts(n, window):
                    row.append(i)
                    start.append(a)
                    length.append(k)
                    cut.append(got[4 * a : 4 * (a + k)])
                    total.append(n)
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(row, pa.int64())), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(cut, pa.binary()), pa.array(total, pa.int64())],
                ["doc_id", "start", "length", "ids", "doc_tokens"],
            )


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 2, window: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces with their ids (little-endian unsigned 32-bit), sequence, offset there and bucket (its length).

    The vocabulary file is read once on the driver and sent along; its size does not depend on the data.
    """
    if window & (window - 1) or window < 1:
        raise ValueError("window must be a power of two")
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())
    narrow = chosen(docs, id_col, text_col).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    pieces = narrow.mapInArrow(partial(_pieces, spec=spec, end=np.array([end_id], "<u4").tobytes(), window=window), SCHEMA)
    return pieces.withColumns({"sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("long"), "bucket": F.col("length")})


def digest(pieces: DataFrame) -> DataFrame:
    crc: Column = F.crc32("ids")
    return pieces.select("doc_id", "start", "length", crc.alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def write_buckets(pieces: DataFrame, path: str) -> None:
    """One folder for each length; every file there holds sequences of one shape."""
    pieces.write.partitionBy("bucket").option("compression", "zstd").parquet(path)
