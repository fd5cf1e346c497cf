"""Secret scans: fixed patterns, and strings that a tokenizer needs too many tokens for.

Patterns find assignments to secret names, access keys and long hex strings. The token-efficiency test
adds strings that no pattern names: every run of at least ``MIN_LENGTH`` characters of ``PART``, base64 and its URL-safe form
included, is encoded whole with a public byte-level vocabulary. Words of any language fill a token with several
characters; random strings do not, so a run with fewer than ``characters_per_token`` characters a token is reported
whole as kind ``random``. A path, a run with a word of one token between slashes, is judged by its segments instead;
and of what passes as a whole the pieces between separators are judged.

Set aside as known digests: hex of an MD5, SHA-1, SHA-224, SHA-256, SHA-384 or SHA-512 length between separators, and
UUIDs. Set aside as identifiers: strings without a letter, or with less than three changes between letters and digits
and fewer than ``MIN_LENGTH`` letters, unless both cases and digits mix; and strings of at most ``MIN_LENGTH - 1``
characters. Letters alone are judged by their characters a token. Strings
without small letters are encoded in lower case, as names in capitals are words.

Spans are half-open ranges of code points. Null text: none. Texts are scanned whole; repeated rows give
repeated results; an empty table gives an empty one. Two spans of different kinds may cover the same
place; within a kind they never overlap. Ties in start are ordered as ``KINDS`` lists them.
"""

from __future__ import annotations

import base64
import functools
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from apptledger.llm.arrow import with_columns

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"(?ai:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ASSIGN_LENGTH = 6
# A greedy run that is too short holds no longer one, so the least length can stand in the pattern.
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")

MIN_LENGTH = 20
CHARACTERS_PER_TOKEN = 2.0
PART = re.compile(r"[A-Za-z0-9+/_-]{20,}=*")
SEGMENT = re.compile(r"[A-Za-z0-9+_-]{20,}=*")
PIECE = re.compile(r"[A-Za-z0-9+]{20,}=*")
UUID = re.compile(r"(?i:[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})")
DIGEST = re.compile(r"(?<![A-Za-z0-9+])(?:[0-9a-f]{32,}|[0-9A-F]{32,})(?![A-Za-z0-9+])")
WORD = re.compile(r"(?<![^/])[A-Za-z]{4,}(?![^/])")
DIGEST_LENGTHS = frozenset({32, 40, 56, 64, 96, 128})
CHANGE = re.compile(r"[A-Za-z](?=[0-9])|[0-9](?=[A-Za-z])")

SPAN = T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@functools.lru_cache(maxsize=2)
def encoding(path: str):
    """The vocabulary as a tiktoken encoding, one per Python worker and file."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    return tiktoken.Encoding("secrets", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def is_identifier(piece: str) -> bool:
    """A name, number or slug rather than a random string."""
    letters = sum(c.isalpha() for c in piece)
    if not letters:
        return True
    if not any(c.isdigit() for c in piece):
        return False
    mixed = any(c.islower() for c in piece) and any(c.isupper() for c in piece)
    return not mixed and len(CHANGE.findall(piece)) < 3 and letters < MIN_LENGTH


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the fixed patterns, leftmost and without overlap in each kind."""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LENGTH]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return spans


def blanked(found: re.Match) -> str:
    """Spaces in place of a known identifier or digest, its length kept."""
    return found[0] if found.re is DIGEST and len(found[0]) not in DIGEST_LENGTHS else " " * len(found[0])


def random_spans(text: str, encode, limit: float) -> list[tuple[int, int, int]]:
    """Spans that the vocabulary packs badly."""

    def is_random(value: str) -> bool:
        value = value.rstrip("=")
        # Names in capitals are words too, which the vocabulary packs in lower case.
        read = value.lower() if value.isupper() else value
        return not is_identifier(value) and len(value) < limit * len(encode(read))

    def is_path(value: str) -> bool:
        return any(len(encode(word)) == 1 for word in WORD.findall(value))

    spans = []
    for run in PART.finditer(text):
        known = DIGEST.sub(blanked, UUID.sub(blanked, run[0]))
        for part in PART.finditer(known):
            at = run.start() + part.start()
            for whole in SEGMENT.finditer(part[0]) if "/" in part[0] and is_path(part[0]) else [PART.match(part[0])]:
                found = [whole] if is_random(whole[0]) else [
                    m for m in PIECE.finditer(part[0], whole.start(), whole.end()) if is_random(m[0])]
                spans += [(at + m.start(), 3, at + m.end()) for m in found]
    return spans


def scan(df: DataFrame, text: str = "text", spans: str = "spans", path: str | None = None,
         characters_per_token: float = CHARACTERS_PER_TOKEN) -> DataFrame:
    """``df`` with an array of (kind, start, end), by start and then by kind."""
    path = path or default_path()

    def make():
        encode = encoding(path).encode_ordinary

        def find(value: str | None) -> list[dict]:
            if not value:
                return []
            found = sorted(base_spans(value) + random_spans(value, encode, characters_per_token))
            return [{"kind": KINDS[kind], "start": start, "end": end} for start, kind, end in found]

        return lambda texts: [[find(t) for t in iterate(texts)]]

    return with_columns(df, text, T.StructType([T.StructField(spans, T.ArrayType(SPAN))]), make)


def iterate(texts: pa.Array):
    """Values one by one, so that a batch is not held twice."""
    return (t.as_py() for t in texts)


def joined(spans: Column) -> Column:
    """Spans as ``kind:start:end``, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def masked(df: DataFrame, text: str = "text", spans: str = "spans", mask: str = "[SECRET]") -> DataFrame:
    """``df`` with every stretch that spans cover replaced by one ``mask``; overlapping spans count as one."""
    empty = F.struct(F.lit("").alias("done"), F.lit(0).cast("long").alias("at"))

    def step(done: Column, span: Column) -> Column:
        begins = span["start"] >= done["at"]
        passed = F.substring(df[text], done["at"] + 1, span["start"] - done["at"])
        return F.struct(
            F.when(begins & (span["start"] > 0) & (span["start"] == done["at"]) & (done["at"] > 0), done["done"])
            .when(begins, F.concat(done["done"], passed, F.lit(mask))).otherwise(done["done"]).alias("done"),
            F.greatest(done["at"], span["end"]).alias("at"))

    walked = F.aggregate(df[spans], empty, step)
    rest = F.substring(df[text], walked["at"] + 1, F.length(df[text]))
    return df.withColumn(text, F.when(F.size(spans) > 0, F.concat(walked["done"], rest)).otherwise(df[text]))
