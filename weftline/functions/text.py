"""Normalised word streams: words in NFC with offsets into the source, token counts and paragraph starts."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import wire

TokenCounter = Callable[[str], int]
#: All of Python's white space, which is what lies between words; as a table by code point, the last entry for all higher ones.
BLANKS = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
_IS_BLANK = np.array([chr(c) in BLANKS for c in range(0x3002)])
#: Fixed patterns of the normaliser's protocol: a blank line between words, a word that ends a sentence.
_BLANK = re.compile(r"\n[\t\f\v ]*\n")
_CLOSERS = frozenset(".!?\"')]}")
_CLOSED = re.compile(r"[.!?](?:[\"'\)\]\}]+)?$")


@dataclass(frozen=True)
class Stream:
    """Word k lies at source[starts[k]:ends[k]]; prefix[k] tokens come before it; paragraph[k]: a blank line does."""

    source: str
    words: list[str]
    starts: np.ndarray
    ends: np.ndarray
    prefix: np.ndarray
    paragraph: np.ndarray
    tokenizer_id: str = wire.TOKENIZER

    def __len__(self) -> int:
        return len(self.words)

    @property
    def text(self) -> str:
        return self.slice(0, len(self))

    def slice(self, a: int, b: int) -> str:
        self._check(a, b)
        if not self.paragraph[a + 1 : b].any():
            return " ".join(self.words[a:b])
        parts = []
        for k in range(a, b):
            if k > a:
                parts.append("\n\n" if self.paragraph[k] else " ")
            parts.append(self.words[k])
        return "".join(parts)

    def slicer(self) -> Callable[[int, int], str]:
        """``slice`` for many slices that lie inside the stream."""
        return self.slice if self.paragraph_starts else lambda a, b: " ".join(self.words[a:b])

    def offsets(self, a: int, b: int) -> tuple[int, int]:
        self._check(a, b)
        if a < b:
            return int(self.starts[a]), int(self.ends[b - 1])
        at = int(self.starts[a]) if a < len(self) else int(self.ends[-1]) if len(self) else 0
        return at, at

    def tokens(self, a: int, b: int) -> int:
        self._check(a, b)
        return int(self.prefix[b] - self.prefix[a])

    def paragraph_break(self, p: int) -> bool:
        return p < len(self) and bool(self.paragraph[p])

    @staticmethod
    def within(places: list[int], least: int, most: int) -> list[int]:
        """Of ascending places those from ``least`` to ``most``."""
        return places[bisect_left(places, least) : bisect_left(places, most + 1)]

    def sentence_break(self, p: int) -> bool:
        if not 0 < p <= len(self):
            return False
        word = self.words[p - 1]
        return word[-1] in _CLOSERS and _CLOSED.search(word) is not None

    @cached_property
    def sentence_ends(self) -> list[int]:
        """Positions, the end of the stream among them, where a sentence ends."""
        return [p for p, w in enumerate(self.words, 1) if w[-1] in _CLOSERS and _CLOSED.search(w)]

    @cached_property
    def paragraph_starts(self) -> list[int]:
        return np.flatnonzero(self.paragraph).tolist()

    @cached_property
    def kept(self) -> dict:
        """What chunkers compute of a stream once."""
        return {}

    @cached_property
    def even(self) -> bool:
        """Whether every word is one token (none has fewer)."""
        return int(self.prefix[-1]) == len(self)

    def breaks(self) -> list[int]:
        """Positions inside the stream where a sentence ends or a paragraph starts."""
        if "breaks" not in self.kept:
            starts, n = self.paragraph_starts, len(self)
            if starts:
                self.kept["breaks"] = sorted({*self.sentence_ends, *starts} - {n})
            else:
                self.kept["breaks"] = self.sentence_ends[:-1] if self.sentence_ends and self.sentence_ends[-1] == n else self.sentence_ends
        return self.kept["breaks"]

    def items(self):  # noqa: ANN201
        """Words and paragraph marks in order: (kind, text, start, end, word number)."""
        for k, w in enumerate(self.words):
            if self.paragraph[k]:
                yield "paragraph_break", "\n\n", int(self.ends[k - 1]), int(self.starts[k]), k
            yield "word", w, int(self.starts[k]), int(self.ends[k]), k

    def end_at_limit(self, start: int, limit: int) -> int:
        """The last end of a slice from ``start`` with at most ``limit`` tokens."""
        if self.even and limit > 0 and start < len(self):
            return min(start + limit, len(self))
        end = int(self.prefix.searchsorted(self.prefix[start] + limit, "right")) - 1
        if end <= start:
            raise ValueError(f"one word has more than {limit} tokens")
        return end

    def reach(self, start: int, tokens: int) -> int:
        """The first end of a slice from ``start`` with at least so many tokens, past the stream if there is none."""
        if self.even:
            return min(max(start + tokens, 0), len(self) + 1)
        return int(self.prefix.searchsorted(self.prefix[start] + tokens, "left"))

    def _check(self, a: int, b: int) -> None:
        if not 0 <= a <= b <= len(self):
            raise IndexError(f"no slice {a}:{b} of {len(self)} words")


def tokenizer_identity(counter: TokenCounter | None, tokenizer_id: str | None) -> str:
    """A counter of one's own needs an identity of its own, the default one has the default identity."""
    if counter is None:
        if tokenizer_id not in (None, wire.TOKENIZER):
            raise ValueError("a tokenizer_id other than the default needs its counter")
        return wire.TOKENIZER
    if not tokenizer_id or tokenizer_id == wire.TOKENIZER:
        raise ValueError("a counter of one's own needs a tokenizer_id of its own")
    return tokenizer_id


def normalize(text: str, counter: TokenCounter | None = None, tokenizer_id: str = wire.TOKENIZER) -> Stream:
    words = text.split()
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    blank = _IS_BLANK[np.minimum(codes, len(_IS_BLANK) - 1)]
    edges = np.flatnonzero(np.diff(np.concatenate([[True], blank, [True]])))
    starts, ends, paragraph = edges[::2], edges[1::2], np.zeros(len(words), bool)
    for k in np.flatnonzero(starts[1:] - ends[:-1] > 1).tolist():  # wider gaps may hold a blank line
        gap = text[ends[k] : starts[k + 1]]
        paragraph[k + 1] = _BLANK.search(gap.replace("\r\n", "\n").replace("\r", "\n")) is not None
    if not text.isascii():
        words = [w if w.isascii() else unicodedata.normalize("NFC", w) for w in words]
    if counter is None:
        prefix = np.arange(len(words) + 1, dtype=np.int64)
    else:
        counts = [counter(w) for w in words]
        if any(type(c) is not int or c < 1 for c in counts):
            raise ValueError("token counts must be integers of at least 1")
        prefix = np.append(0, np.cumsum(counts)).astype(np.int64)
    return Stream(text, words, starts, ends, prefix, paragraph, tokenizer_id)


def _same(a: str, b: str, most: int) -> int:
    """How many leading characters, ``most`` at most, two texts share."""
    lo, hi = 0, most
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a.startswith(b[lo:mid], lo) else (lo, mid - 1)
    return lo


def _same_end(a: str, b: str, most: int) -> int:
    lo, hi, n, m = 0, most, len(a), len(b)
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[n - mid : n - lo] == b[m - mid : m - lo] else (lo, mid - 1)
    return lo


def renormalized(old: Stream, text: str) -> tuple[Stream, int, int]:
    """The stream of a revision of ``old``'s source, and how many words at the start and at the end they share, with the white space between
    them. Only what lies between is normalised. For streams of one token a word."""
    n, m = len(old.source), len(text)
    lead = _same(old.source, text, min(n, m))
    tail = _same_end(old.source, text, min(n, m) - lead)
    first = int(old.ends.searchsorted(lead, "left"))  # words with a shared character after them
    k = min(int(old.ends.searchsorted(n - tail, "right")) + 1, len(old))  # a word before word k ends inside the shared end
    last, at = len(old) - k, int(old.ends[first - 1]) if first else 0
    between = normalize(("x" if first else "") + text[at : int(old.starts[k]) + m - n if last else m])
    own, off = (1, at - 1) if first else (0, 0)
    words = old.words[:first] + between.words[own:] + old.words[k:]
    join = lambda a, b, c, by: np.concatenate([a[:first], b[own:] + off, c[k:] + by])
    paragraph = np.concatenate([old.paragraph[:first], between.paragraph[own:], old.paragraph[k:]])
    new = Stream(text, words, join(old.starts, between.starts, old.starts, m - n), join(old.ends, between.ends, old.ends, m - n), np.arange(len(words) + 1, dtype=np.int64), paragraph, old.tokenizer_id)
    by, ends = len(words) - len(old), old.sentence_ends
    new.__dict__["sentence_ends"] = ends[: bisect_left(ends, first + 1)] + [p + first - own for p in between.sentence_ends if p > own] + [p + by for p in ends[bisect_left(ends, k + 1) :]]
    new.kept["base"] = (old, first, last)
    return new, first, last


#: Runs of what Python calls non-space, as a Java pattern.
WORDS = r"(?U)[^\s\x1c-\x1f]+"


def words_column(text: Column) -> Column:
    """Words as they stand (NFC input stays NFC); JVM only."""
    return F.regexp_extract_all(text, F.lit(WORDS), F.lit(0))


def normalized_column(text: Column) -> Column:
    """Normalised text of NFC input: one space between words, one blank line between paragraphs; JVM only."""
    unix = F.regexp_replace(text, "\r\n?", "\n")
    parts = F.transform(F.split(unix, r"\n[\t\f\x0B ]*\n"), lambda p: F.regexp_replace(F.btrim(p, F.lit(BLANKS)), r"(?U)[\s\x1c-\x1f]+", " "))
    return F.array_join(F.filter(parts, lambda p: p != ""), "\n\n")


#: What lower-case characters fold into where that isn't themselves; the JVM lowers a last sigma by its place, folding does not.
_FOLDS = {c: c.casefold() for c in map(chr, range(0x110000)) if c == c.lower() != c.casefold()}
_LONG = {c: f for c, f in _FOLDS.items() if len(f) > 1 and c != "ß"}


def casefold_column(text: Column) -> Column:
    """Full case folding; JVM only. Letters that fold into several are replaced where a text has any, the sharp s always."""
    short = "".join(c for c, f in _FOLDS.items() if len(f) == 1)
    low = F.lower(text)
    rare = low
    for c, f in _LONG.items():
        rare = F.replace(rare, F.lit(c), F.lit(f))
    fold = lambda t: F.replace(F.translate(t, short, "".join(_FOLDS[c] for c in short)), F.lit("ß"), F.lit("ss"))
    return F.when(text.rlike(HARD_FOLDS), F.when(low.rlike("[" + "".join(_LONG) + "]"), fold(rare)).otherwise(fold(low))).otherwise(lowered(text))


def lowered(text: Column) -> Column:
    """The folding of a text without ``HARD_FOLDS``."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


_counted = lambda c: unicodedata.category(c)[0] in "LN"
#: Letters and marks whose folding is, or ends, a token where they are none, or the other way round.
ODD_FOLDS = "".join(c for c, f in _FOLDS.items() if {_counted(c)} != {_counted(x) for x in f}) + "".join(c for c in map(chr, range(0x110000)) if c != c.lower() and {_counted(c)} != {_counted(x) for x in c.lower()})


def _ranges(codes: list[int], gap: int = 48) -> str:
    """A character class of these and what lies in small gaps between them."""
    starts = [c for k, c in enumerate(codes) if not k or c - codes[k - 1] > gap]
    ends = [c for k, c in enumerate(codes) if k + 1 == len(codes) or codes[k + 1] - c > gap]
    return "[" + "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in zip(starts, ends, strict=True)) + "]"


#: A class, quick to look for, that holds all characters whose folding is more than lowering them and writing a sharp s as two.
HARD_FOLDS = _ranges(sorted({ord(c) for c in map(chr, range(0x110000)) if c.casefold() != c.lower().replace("ß", "ss")} | set(map(ord, "Σİ" + ODD_FOLDS))))


def sentence_break_column(word: Column) -> Column:
    return word.rlike(r"[.!?](?:[\"'\)\]\}]+)?$")
