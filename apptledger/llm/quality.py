"""Quality rules: counts over words and lines, and compression bands.

Words are runs of characters other than space, tab, line feed, vertical tab, form feed and carriage
return. The base rule fails a text with fewer than ``MIN_WORDS`` words, or with more than ``MAX_REPEAT``
percent of its words inside eight-word windows that occur twice or more.

Compression bands judge what passes: Zstandard packs ordinary prose by a factor that depends on the
length only, so a text is rejected when the ratio of its bytes to its packed bytes leaves the band of
its length: above it the text repeats itself, below it there is hardly a word in it. The same holds for
chunks of ``CHUNK`` bytes, packed one by one: a text is rejected when more than ``MAX_CHUNKS`` of them
leave the chunk band, which finds a repetitive or random part that a long text hides. A last chunk
that is shorter is judged by the band of its own length.

Null text: no words, so the base rule fails. Texts are measured whole. Each row is judged on its own, so
repeated rows get the same verdict and an empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from apptledger.llm.arrow import apart, with_columns

SYMBOLS = "#*$%&|<>"
WHITE = " \t\n\x0b\x0c\r"
WINDOW = 8
MIN_WORDS, MAX_REPEAT = 20, 30
LEVEL, CHUNK = 3, 8192
MAX_CHUNKS = 0.5
#: (bytes from, least ratio, greatest ratio); a band holds up to the next one's start.
BANDS = [(0, 1.0, 2.1), (512, 1.2, 2.4), (2048, 1.4, 2.6), (8192, 1.5, 2.8), (32768, 1.6, 3.2)]

MEASURES = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("word_chars", T.LongType()),
    T.StructField("n_symbols", T.LongType()), T.StructField("n_dup_lines", T.LongType()),
    T.StructField("n_repeat_words", T.LongType()), T.StructField("n_bytes", T.LongType()),
    T.StructField("n_packed", T.LongType()), T.StructField("chunk_bytes", T.ArrayType(T.LongType())),
    T.StructField("chunk_packed", T.ArrayType(T.LongType()))])

#: One odd number per word of a window, for a first look at windows by their hash.
FACTORS = np.random.default_rng(8).integers(1, 2**63, WINDOW, dtype=np.uint64) | np.uint64(1)


def repeated_words(words: list[bytes]) -> int:
    """Words inside windows that occur twice or more, the first occurrence included."""
    count = len(words) - WINDOW + 1
    if count < 2:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.uint64, len(words))
    spread = (ids + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    spread ^= spread >> np.uint64(29)
    hashes = np.zeros(count, np.uint64)
    for k in range(WINDOW):
        hashes += spread[k:k + count] * FACTORS[k]
    ordered = np.sort(hashes)
    if not (ordered[1:] == ordered[:-1]).any():
        return 0  # equal windows have equal hashes
    # Exact: number the distinct pairs, then pairs of pairs, then whole windows.
    ranks, size = ids.astype(np.int64), len(numbers)
    for step in (1, 2, 4):
        pairs = ranks[:-step] * size + ranks[step:]
        distinct, ranks = np.unique(pairs, return_inverse=True)
        size = len(distinct)
    often = np.flatnonzero(np.bincount(ranks)[ranks] > 1)
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, often, 1)
    np.add.at(edges, often + WINDOW, -1)
    return int((np.cumsum(edges) > 0).sum())


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    seen, count = set(), 0
    for line in text.split("\n"):
        if line in seen:
            count += 1
        elif line.strip(WHITE):
            seen.add(line)
    return count


class Meter:
    """Measures of one text after another, with one compressor."""

    def __init__(self):
        self.pack = zstandard.ZstdCompressor(level=LEVEL).compress

    def measure(self, text: str | None) -> tuple:
        text = text or ""
        data = text.encode("utf-8", "surrogatepass")
        words = data.split()  # bytes split at exactly the six white space characters
        chunks = [data[i:i + CHUNK] for i in range(0, len(data), CHUNK)] if len(data) > CHUNK else []
        return (
            len(words), len(text) - sum(map(text.count, WHITE)), sum(map(text.count, SYMBOLS)),
            duplicate_lines(text), repeated_words(words), len(data), len(self.pack(data)),
            [len(c) for c in chunks], [len(self.pack(c)) for c in chunks])


def measured(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with the columns of ``MEASURES``."""

    def make():
        meter = Meter()

        def compute(texts: pa.Array) -> list[list]:
            rows = [meter.measure(t.as_py()) for t in texts]
            return [[row[i] for row in rows] for i in range(len(MEASURES))]

        return compute

    return with_columns(df, text, MEASURES, make)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))


def outside(n_bytes: Column, n_packed: Column) -> Column:
    """Whether the ratio leaves the band of its length."""
    ratio = n_bytes / n_packed
    verdict = F.lit(False)
    for start, least, greatest in BANDS:
        verdict = F.when(n_bytes >= start, (ratio < least) | (ratio > greatest)).otherwise(verdict)
    return verdict


def judged(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with its measures, ``base_failed``, ``n_bad_chunks``, ``band_failed`` and ``kept``."""
    chunks = F.arrays_zip("chunk_bytes", "chunk_packed")
    bad = F.size(F.filter(chunks, lambda c: outside(c["chunk_bytes"], c["chunk_packed"])))
    return (
        measured(df, text)
        .withColumn("base_failed", base_failed())
        .withColumn("n_bad_chunks", bad.cast("long"))
        .withColumn("band_failed", outside(F.col("n_bytes"), F.col("n_packed"))
                    | (F.col("n_bad_chunks") > MAX_CHUNKS * F.size("chunk_bytes")))
        .withColumn("kept", ~F.col("base_failed") & ~F.col("band_failed")))


def kept(df: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``df`` that the rules keep, with the columns and values they had."""
    return apart(df, [text], lambda rows: judged(rows, text).where("kept"))
