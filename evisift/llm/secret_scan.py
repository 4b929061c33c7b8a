"""Secrets by strict patterns and by what a primed compressor finds novel.

A string in a sensitive context is measured by the bytes it adds to the compressed text around it, with a dictionary
of the corpus's own frequent words and of code words. Identifiers, paths and prose compress well against both;
a random key doesn't. Strings that add nearly as many bytes as they carry at random are reported.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evisift.llm import arrays
from evisift.llm.spans import Marks, Span, digest, listed

KINDS = ("assign", "access", "hex", "novel")
BASE_KINDS = KINDS[:3]

# The base patterns; a run is matched whole or not at all.
_ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
_ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")

# Strings that may be secrets, and words that make their surroundings sensitive.
_STRING = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{16,}={0,2}(?![A-Za-z0-9+/_=-])")
_SENSITIVE = re.compile(r"(?i)key|secret|token|passw|pwd|auth|bearer|credential|private|signature|access|session")
SENSITIVE_CHARS, AROUND_CHARS = 60, 512
# Added bytes for each character from which a string counts as incompressible: six bits a character would be 0.75.
NOVEL = 0.6
# The dictionary: frequent words of the corpus up to this many bytes, behind words of code.
DICTIONARY_BYTES, WORD_FROM, WORD_TO, SEEN = 32 << 10, 5, 40, 4
# Distinct words from which a task passes on its counts and starts again.
HELD_WORDS = 1 << 17
CODE_WORDS = (
    "import return function class public private static const string import self None true false null if else for while try except "
    "configuration environment variable api_key access_token secret_key password client_id client_secret authorization bearer https:// "
    "application/json content-type localhost example.com/api/v1/users get_ set_ is_ has_ to_string parse encode decode base64 sha256 request response"
).encode()


def base_spans(text: str) -> list[Span]:
    """Spans of the three strict patterns, leftmost and non-overlapping per kind; failing matches are dropped."""
    out: list[Span] = []
    lower = text.lower()
    if any(w in lower for w in _ASSIGN_WORDS):
        out += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[1]) >= 6]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return out + [("hex", *m.span()) for m in _HEX.finditer(text)]


class Novelty:
    """Bytes that a string adds to its surroundings, with the dictionary known to the compressor."""

    def __init__(self, dictionary: bytes) -> None:
        known = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        known.precompute_compress(level=3)
        self.compressor = zstandard.ZstdCompressor(dict_data=known, write_content_size=False, write_checksum=False, write_dict_id=False)

    def added(self, text: str, start: int, end: int) -> int:
        before = text[max(0, start - AROUND_CHARS) : start].encode()
        after = text[end : end + AROUND_CHARS].encode()
        whole = self.compressor.compress(before + after + text[start:end].encode())
        return len(whole) - len(self.compressor.compress(before + after))

    def spans(self, text: str, base: list[Span]) -> list[Span]:
        if not _SENSITIVE.search(text):
            return []
        out: list[Span] = []
        marks = Marks(len(text), base)
        for m in _STRING.finditer(text):
            a, b = m.span()
            if marks.free(("novel", a, b)) and _SENSITIVE.search(text, max(0, a - SENSITIVE_CHARS), a) and self.added(text, a, b) >= NOVEL * (b - a):
                out.append(("novel", a, b))
        return out


def word_dictionary(docs: DataFrame, *, text: str = "text") -> bytes:
    """Frequent words of all texts, most frequent last, where the compressor finds them cheapest.

    Every task passes on the counts of all its words, a bounded number at a time; the driver gets the top of the
    sums, no more words than the dictionary can hold. Batches and partitions don't matter. Words seen fewer than
    ``SEEN`` times in all are left out, as a secret must not be known from its own place.
    """

    def counts(held: dict[bytes, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}
        for _, texts in arrays.slices(batches, "body"):
            words = arrays.Words(texts, arrays.LETTERS_DIGITS_ANY_CASE)
            size = words.end - words.start
            fit = (size >= WORD_FROM) & (size <= WORD_TO)
            _, at, number = np.unique(words.hashes(lower=False)[fit], return_index=True, return_counts=True)
            raw = words.data.tobytes()
            for a, b, n in zip(words.start[fit][at].tolist(), words.end[fit][at].tolist(), number.tolist(), strict=True):
                held[raw[a:b]] = held.get(raw[a:b], 0) + n
            if len(held) >= HELD_WORDS:
                yield counts(held)
                held = {}
        yield counts(held)

    source = docs.select(F.col(text).cast("string").alias("body"))
    counted = source.mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= SEEN)
    top = counted.orderBy(F.desc(F.col("n") * F.octet_length("word")), "word").limit(DICTIONARY_BYTES // WORD_FROM).collect()
    held, size = [], 0
    for row in top:
        size += len(row["word"]) + 1
        if size > DICTIONARY_BYTES:
            break
        held.append(bytes(row["word"]))
    return b" ".join([CODE_WORDS, *reversed(held)])


def find_secrets(docs: DataFrame, dictionary: bytes, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Base counts and digest, and all spans, of every row.

    Null counts as empty; texts without spans have an empty list. Repeated rows give repeated results.
    """
    sent = docs.sparkSession.sparkContext.broadcast(dictionary)
    schema = T.StructType(
        [T.StructField("doc_id", T.LongType()), *(T.StructField(f"n_{k}", T.LongType()) for k in BASE_KINDS), T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())]
    )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty(sent.value)
        for rows, texts in arrays.slices(batches, "body"):
            out: list[list] = [[] for _ in range(5)]
            for raw in texts:
                body = raw.decode()
                base = base_spans(body)
                kinds = Counter(s[0] for s in base)
                for column, value in zip(out, (*(kinds[k] for k in BASE_KINDS), digest(base, KINDS), listed(base + novelty.spans(body, base), KINDS)), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([rows.column(0), *(pa.array(c, pa.int64()) for c in out[:3]), *(pa.array(c, pa.string()) for c in out[3:])], schema.names)

    source = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("body"))
    return source.mapInArrow(scan, schema)
