"""Token counts: the length of the best unigram segmentation, without building it.

The vocabulary is a sentencepiece file whose pieces and scores are used as a unigram model: a text is
cut so that the scores' sum is greatest. An Aho-Corasick automaton lists all pieces that end at a place;
dynamic programming over places carries the best score and the number of pieces that reach it, and
nothing else.

Rules, as the ``tokenizers`` library's Unigram model has them: a text that is not empty gets a space in
front, if the file asks for it; a space is the sign U+2581; a character that is no piece by itself may
stand alone at 10 below the least score and counts one piece for each of its UTF-8 bytes; of two ways
with the same score the one whose last piece starts earlier wins, which is the first one found. Sums are
exact, as scores are whole numbers. Control and byte pieces of the file are never matched in a text.

No piece goes on past a space or holds a line feed, so each line is counted word by word; words repeat,
and each Python worker keeps up to ``CACHED_WORDS`` counts. Texts with several spaces in a row, or with the sign
itself, are cut by a pattern instead, with the same result.

Null and empty texts count 0. Texts are taken whole. Rows are neither dropped nor joined: repeated rows
give repeated counts and an empty table gives an empty one.
"""

from __future__ import annotations

import functools
import itertools

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from apptledger.llm.arrow import with_columns

SPACE = "▁"
UNKNOWN = 10
CACHED_WORDS = 300_000
#: Longer parts are counted each time they occur.
CACHED_LENGTH = 40
#: Piece types of the file: ordinary, and given by the user.
NORMAL, USER_DEFINED = 1, 4


class Unigram:
    """One vocabulary file: texts to numbers of pieces."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        self.prefix = model.normalizer_spec.add_dummy_prefix
        self.bytes = model.trainer_spec.byte_fallback
        pieces = {p.piece: p.score for p in model.pieces if p.type == NORMAL}
        if any(p.type == USER_DEFINED for p in model.pieces) or model.normalizer_spec.name != "identity":
            raise ValueError("pieces given by a user and rewriting normalizers are not supported")
        if model.normalizer_spec.remove_extra_whitespaces:
            raise ValueError("a file that drops spaces is not supported")
        self.scores = {piece: self.whole(score) for piece, score in pieces.items()}
        self.unknown = min(self.scores.values()) - UNKNOWN
        self.automaton = ahocorasick.Automaton()
        for piece, score in self.scores.items():
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        held = {a + b for piece in self.scores for a, b in itertools.pairwise(piece)}
        if any(a != SPACE and b == SPACE for a, b in held):
            raise ValueError("a piece goes on past a space")
        if any("\n" in piece for piece in self.scores):
            raise ValueError("a piece holds a line feed")
        alone = regex.escape("".join(sorted({c for piece in self.scores for c in piece})))
        # A part: space signs and what follows them up to the next ones, or characters that no piece holds.
        self.parts = regex.compile(f"[^{alone}]|{SPACE}*[{alone}--{SPACE}]+|{SPACE}+", regex.V1).findall
        self.line_feed = 1
        #: Counts of words that follow a space, and of those that start a line.
        self.spaced: dict[str, int] = {}
        self.unspaced: dict[str, int] = {"": 0}

    @staticmethod
    def whole(score: float) -> int:
        if score != int(score):
            raise ValueError("scores must be whole numbers")
        return int(score)

    def count_part(self, part: str) -> int:
        size = len(part)
        best: list[int | None] = [0] + [None] * size
        counts = [0] * (size + 1)
        ends: list[list[tuple[int, int]]] = [[] for _ in range(size)]
        for last, found in self.automaton.iter(part):
            ends[last].append(found)
        for last, found in enumerate(ends):
            score, count, single = None, 0, False
            # The longest piece starts first, and only a greater score replaces what is there.
            for length, value in sorted(found, reverse=True):
                single |= length == 1
                start = last + 1 - length
                if score is None or best[start] + value > score:
                    score, count = best[start] + value, counts[start] + 1
            if not single and (score is None or best[last] + self.unknown > score):
                fallback = len(part[last].encode("utf-8", "surrogatepass")) if self.bytes else 1
                score, count = best[last] + self.unknown, counts[last] + fallback
            best[last + 1], counts[last + 1] = score, count
        return counts[size]

    def count_words(self, words: list[str], cache: dict[str, int], before: str) -> int:
        found = list(map(cache.get, words))
        if None in found:
            for i, word in enumerate(words):
                if found[i] is None:
                    found[i] = self.count_part(before + word)
                    if len(word) <= CACHED_LENGTH:
                        if len(cache) >= CACHED_WORDS:
                            cache.clear()
                        cache[word] = found[i]
        return sum(found)

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if "  " in text or SPACE in text or self.prefix and text[0] == " ":
            text = (SPACE if self.prefix else "") + text.replace(" ", SPACE)
            return sum(map(self.count_part, self.parts(text)))
        first, *lines = text.split("\n")
        words = first.split(" ")
        if self.prefix:
            total = self.count_words(words, self.spaced, SPACE)
        else:
            total = self.count_words(words[:1], self.unspaced, "") + self.count_words(words[1:], self.spaced, SPACE)
        for line in lines:
            words = line.split(" ")
            total += self.line_feed + self.count_words(words[:1], self.unspaced, "")
            total += self.count_words(words[1:], self.spaced, SPACE)
        return total


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Unigram:
    """One per Python worker and file."""
    return Unigram(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def token_counts(df: DataFrame, text: str = "text", n_tokens: str = "n_tokens", path: str | None = None) -> DataFrame:
    """``df`` with the number of pieces of each whole text."""
    path = path or default_path()

    def make():
        model = vocabulary(path)

        def compute(texts: pa.Array) -> list:
            return [[model.count(t.as_py()) for t in texts]]

        return compute

    return with_columns(df, text, T.StructType([T.StructField(n_tokens, T.LongType())]), make)
