"""BPE encoding and decoding with a public tokenizer file (``tokenizers`` JSON, BPE with word ends).

A text is cut at special tokens, normalised (NFC, runs of white space to one space, lower case), cut
into words by the file's pattern, and each word is merged on its own: a priority queue of merge ranks
over a doubly linked list of symbols, where entries that no longer describe their place are skipped.
Decoding looks every id up in the vocabulary and concatenates the strings.

Words repeat, so each Python worker keeps the ids of the space-free runs it met, up to ``CACHED_WORDS``
of them; the cache is emptied when full and changes no result.

Null text: encodes as the empty text, no ids. Null ids: decode to the empty text. Ids that the
vocabulary lacks, and null ones, decode to nothing. Any length of text is taken whole. Rows are
neither dropped nor joined, so repeated rows give repeated results and an empty table an empty one.
"""

from __future__ import annotations

import array
import functools
import heapq
import itertools
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from tokenizers import Regex, normalizers, pre_tokenizers

from apptledger.llm.arrow import with_columns

CACHED_WORDS = 500_000
#: Longer words are merged each time they occur.
CACHED_LENGTH = 40
#: What the tokenizer's own regular expressions count as white space.
SPACES = r"\t\n\x0b\f\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Separators to ``str.split`` that are none to the tokenizer.
SPLIT_ONLY = "\x1c\x1d\x1e\x1f"
#: Ids and places are packed into one number, so that queue entries compare fast.
ID_BITS, PLACE_BITS = 20, 32
ID_MASK, PLACE_MASK = (1 << ID_BITS) - 1, (1 << PLACE_BITS) - 1


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in the vocabulary."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = itertools.count(0x100)
    table = {b: chr(b) for b in own}
    return [table[b] if b in table else chr(next(others)) for b in range(256)]


#: Code points that have or may get a class: beyond them lie private and unassigned planes.
POINTS = array.array("I", itertools.chain(range(0xD800), range(0xE000, 0x40000), range(0xE0000, 0xE0200)))
#: How many of them are looked at together.
POINTS_AT_ONCE = 4096


def some(points: array.array) -> Iterator[array.array]:
    """``POINTS_AT_ONCE`` of the points after the other, so that a worker never holds a string for each of them."""
    return (points[at:at + POINTS_AT_ONCE] for at in range(0, len(points), POINTS_AT_ONCE))


def ranges(points: list[int]) -> str:
    """Sorted code points as the inside of a character set."""
    found: list[list[int]] = []
    for point in points:
        if found and point == found[-1][1] + 1:
            found[-1][1] = point
        else:
            found.append([point, point])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in found)


class Unicode:
    """Where the tokenizer's tables of letters, numbers and small letters differ from those of this Python.

    The tables are those of the library's own regular expressions and normaliser, asked once per worker."""

    def __init__(self):
        own: dict[str, str] = {}
        odd: set[int] = set()
        for name in (r"\p{L}", r"\p{N}"):
            split = pre_tokenizers.Split(Regex(name + "+"), "removed")
            here = regex.compile(name).match
            more, less = [], []
            for points in some(POINTS):
                held = bytearray(b"\1" * len(points))
                for _, (start, end) in split.pre_tokenize_str("".join(map(chr, points))):
                    held[start:end] = bytes(end - start)
                more += [c for c, inside in zip(points, held, strict=True) if inside and not here(chr(c))]
                less += [c for c, inside in zip(points, held, strict=True) if not inside and here(chr(c))]
            odd.update(more, less)
            kept = f"[{name}--[{ranges(less)}]]" if less else name
            own[name] = f"[{kept}||[{ranges(more)}]]" if more else kept
        self.own = own
        self.odd = regex.compile(f"[{ranges(sorted(odd))}]").search if odd else lambda run: None
        cased = {}
        for points in some(POINTS[128:]):
            small = normalizers.Lowercase().normalize_str("\n".join(map(chr, points))).split("\n")
            # A capital sigma is taken care of where texts are lowered.
            cased |= {c: low for c, low in zip(points, small, strict=True) if c != 0x3A3 and low != chr(c).lower()}
        self.lowered = cased
        self.odd_case = regex.compile(f"[{ranges(sorted(cased))}]").search if cased else lambda text: None


@functools.lru_cache(maxsize=1)
def unicode_tables() -> Unicode:
    return Unicode()


class WordBpe:
    """One tokenizer file: words to ids and ids to vocabulary strings."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocabulary = spec["model"]["vocab"]
        self.suffix = spec["model"]["end_of_word_suffix"] or ""
        #: Packed pair of ids -> packed rank, free place and merged id.
        self.merges = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            key = vocabulary[left] << ID_BITS | vocabulary[right]
            self.merges[key] = rank << (ID_BITS + PLACE_BITS) | vocabulary[left + right]
        characters = byte_characters()
        self.inner = [vocabulary[c] for c in characters]
        self.last = [vocabulary[c + self.suffix] for c in characters]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = 1 + max([*vocabulary.values(), *self.special.values()])
        self.strings = [""] * size
        for text, number in [*vocabulary.items(), *self.special.items()]:
            self.strings[number] = text
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        pattern = pattern.replace(r"\s", SPACES)
        self.find_words = regex.compile(pattern).findall
        self.tables = unicode_tables()
        # Sets within sets, which only words with characters of another class need.
        for name, own in self.tables.own.items():
            pattern = pattern.replace(f"[{name}]", own).replace(name, own)
        self.find_odd_words = regex.compile("(?V1)" + pattern).findall
        self.cut_spaces = regex.compile(f"[{SPACES}]+").split
        self.cut_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split
        self.cache: dict[str, bytes] = {}

    def merge(self, symbols: list[int]) -> list[int]:
        """Merge by ascending rank, the leftmost first, until no pair of neighbours has a rank."""
        known, count = self.merges.get, len(symbols)
        queue = [found | at << ID_BITS for at in range(count - 1)
                 if (found := known(symbols[at] << ID_BITS | symbols[at + 1])) is not None]
        if not queue:
            return symbols
        heapq.heapify(queue)
        push, pop = heapq.heappush, heapq.heappop
        before, after = list(range(-1, count - 1)), [*range(1, count), -1]
        while queue:
            entry = pop(queue)
            at, merged = entry >> ID_BITS & PLACE_MASK, entry & ID_MASK
            to = after[at]
            # Stale: the symbol was swallowed, stands last, or its pair has become another one.
            if symbols[at] < 0 or to < 0:
                continue
            found = known(symbols[at] << ID_BITS | symbols[to])
            if found is None or found & ID_MASK != merged:
                continue
            symbols[at], symbols[to] = merged, -1
            after[at] = right = after[to]
            if right >= 0:
                before[right] = at
                if (found := known(merged << ID_BITS | symbols[right])) is not None:
                    push(queue, found | at << ID_BITS)
            left = before[at]
            if left >= 0 and (found := known(symbols[left] << ID_BITS | merged)) is not None:
                push(queue, found | left << ID_BITS)
        return [s for s in symbols if s >= 0]

    def word(self, word: str) -> bytes:
        """Ids of one word, as bytes of 32-bit integers."""
        data = word.encode("utf-8", "surrogatepass")
        symbols = [*map(self.inner.__getitem__, data[:-1]), self.last[data[-1]]]
        return self.keep(word, array.array("i", self.merge(symbols)).tobytes())

    def run(self, run: str) -> bytes:
        """Ids of a run without white space: of its words, one after the other."""
        words = self.find_words(run) if run.isascii() or not self.tables.odd(run) else self.find_odd_words(run)
        if len(words) == 1 and words[0] == run:
            return self.word(run)
        known = self.cache.get
        return self.keep(run, b"".join([known(w) or self.word(w) for w in words]))

    def keep(self, run: str, ids: bytes) -> bytes:
        if len(run) <= CACHED_LENGTH:
            if len(self.cache) >= CACHED_WORDS:
                self.cache.clear()
            self.cache[run] = ids
        return ids

    def plain(self, text: str) -> bytes:
        if text.isascii():
            text = text.lower()
        else:
            # Letters are lowered one by one, so a capital sigma never becomes a final one.
            text = unicodedata.normalize("NFC", text).replace("\u03a3", "\u03c3")
            if self.tables.odd_case(text):
                text = text.translate(self.tables.lowered)
            text = text.lower()
        runs = text.split() if not any(c in text for c in SPLIT_ONLY) else self.cut_spaces(text)
        found = list(map(self.cache.get, runs))
        if None in found:
            known, compute = self.cache.get, self.run
            found = [ids if ids is not None else known(run) or compute(run)
                     for ids, run in zip(found, runs, strict=True)]
        return b"".join(found)

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not any(token in text for token in self.special):
            return self.plain(text)
        return b"".join(
            array.array("i", [self.special[part]]).tobytes() if part in self.special else self.plain(part)
            for part in self.cut_special(text))


@functools.lru_cache(maxsize=2)
def tokenizer(path: str) -> WordBpe:
    """One per Python worker and file."""
    return WordBpe(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def as_lists(encoded: list[bytes]) -> pa.Array:
    """One list of integers per row from bytes of 32-bit integers."""
    offsets = np.cumsum([0, *(len(ids) // 4 for ids in encoded)], dtype=np.int32)
    return pa.ListArray.from_arrays(offsets, np.frombuffer(b"".join(encoded), dtype=np.int32))


def concatenated(ids: pa.Array, strings: pa.Array, joint: str) -> pa.Array:
    """The strings of each row's ids, joined. Ids out of range and nulls stand for nothing."""
    ids = ids.fill_null([])
    inside = pc.and_(pc.greater_equal(ids.flatten(), 0), pc.less(ids.flatten(), len(strings))).fill_null(False)
    if not pc.all(inside, min_count=0).as_py():
        ids = pa.array([[i for i in row if i is not None and 0 <= i < len(strings)] for row in ids.to_pylist()],
                       pa.list_(pa.int32()))
    offsets = pc.subtract(ids.offsets, ids.offsets[0])
    return pc.binary_join(pa.ListArray.from_arrays(offsets, strings.take(ids.flatten())), joint)


def encode(df: DataFrame, text: str = "text", ids: str = "ids", path: str | None = None) -> DataFrame:
    """``df`` with the ids of each whole text as an array of integers."""
    path = path or default_path()

    def make():
        bpe = tokenizer(path)
        return lambda texts: [as_lists([bpe.encode(t) for t in texts.to_pylist()])]

    return with_columns(df, text, T.StructType([T.StructField(ids, T.ArrayType(T.IntegerType()))]), make)


def decode(df: DataFrame, ids: str = "ids", text: str = "decoded", path: str | None = None,
           joint: str = " ") -> DataFrame:
    """``df`` with the vocabulary strings of its ids, joined by one space as a file without a decoder asks."""
    path = path or default_path()

    def make():
        strings = pa.array(tokenizer(path).strings)
        return lambda values: [concatenated(values, strings, joint)]

    return with_columns(df, ids, T.StructType([T.StructField(text, T.StringType())]), make)
