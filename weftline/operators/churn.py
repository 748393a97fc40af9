"""Churn: how many chunks an edit makes new. Synthetic edits, bag differences, prices."""

from __future__ import annotations

import hashlib
import itertools
import re
import string
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterable, Mapping
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import wire
from ..functions.text import Stream, normalize, renormalized
from ..tables import written
from .chunking import Chunker, Cut, Semantic, lexical_similarity

#: Fixed texts of the synthetic edits.
SENTENCE = "The calibrated inspection marker was recorded for this benchmark."
PARAGRAPH = "Benchmark note: the operator verified the local reading twice. This inserted paragraph models a focused documentation update."
SECTION = "## Benchmark amendment\n\nThis added section records a deterministic fixture amendment. It is intentionally short enough for continuous integration."
APPENDED = "\n\n## Revision note\n\nThe deterministic benchmark revision was appended after the existing content.\n"
#: Fixed words that are no default term.
COMMON = frozenset(("after", "before", "each", "from", "into", "must", "only", "shall", "that", "their", "then", "this", "with"))

Span = tuple[int, int]


def _trimmed(text: str, a: int, b: int) -> Span:
    """The part of a span without white space in front of it."""
    return b - len(text[a:b].lstrip()), b


def sentences(text: str, most: int | None = None) -> list[Span]:
    """What ends with a mark before white space or the end, or the first ``most`` of these; a rest without a mark is one too."""

    def cuts() -> Iterable[int]:
        end = 0
        for m in re.finditer(r"[.!?](?!\S)", text):
            yield (end := m.end())
        if end < (body := len(text.rstrip())):
            yield body

    found = (_trimmed(text, a, b) for a, b in itertools.pairwise(itertools.chain([0], cuts())) if text[a:b].strip())
    return list(itertools.islice(found, most))


def paragraphs(text: str) -> list[Span]:
    """What lies between blank lines."""
    blank = re.finditer(r"\r?\n[ \t]*\r?\n", text) if "\n" in text else ()
    gaps = [(0, 0), *(m.span() for m in blank), (len(text), len(text))]
    return [(a, b) for (_, a), (b, _) in itertools.pairwise(gaps) if text[a:b].strip()]


def sections(text: str) -> list[Span]:
    """What headings begin, if there are two; else paragraphs. A title that stands over sections of a lower level is none of them."""
    heads = [(m.start(), len(m[1])) for m in re.finditer(r"^(#{1,6})[ \t]+[^\r\n]+", text, re.MULTILINE)] if "#" in text else []
    if len(heads) < 2:
        spans = paragraphs(text)
        levels = [len(m[0]) if (m := re.match(r"#{1,6}(?= )", text[a:b])) else 0 for a, b in spans]
    else:
        spans, levels = list(itertools.pairwise([*(h for h, _ in heads), len(text)])), [n for _, n in heads]
    strict = lambda k: text.startswith("#" * levels[k] + " ", spans[k][0])
    title = len(spans) > 2 and levels[0] == 1 and levels[1] == 2 and strict(0) and strict(1)
    return spans[title:]


def _nth(spans: list[Span], n: int, what: str) -> Span:
    """Span number n, counted from 1."""
    if len(spans) < n:
        raise ValueError(f"the text has {len(spans)} {what}, the edit needs {n}")
    return spans[n - 1]


def _spliced(pieces: list[str], gap: str) -> str:
    """Pieces put together: white space where they meet gives way to the gap, and an empty last one leaves none."""
    *front, last = pieces
    kept = [front[0].rstrip(), *(p.strip() for p in front[1:])]
    return gap.join([*kept, last.lstrip()] if last.strip() else kept)


def _inserted(text: str, after: Span, new: str, gap: str) -> str:
    return _spliced([text[: after[1]], new, text[after[1] :]], gap)


def _without(text: str, span: Span, gap: str) -> str:
    """The text without a span; it ends with a line feed if it did."""
    rest = [p for p in (text[: span[0]].rstrip(), text[span[1] :].strip()) if p]
    return gap.join(rest) + ("\n" if text.endswith("\n") else "")


def _bump(text: str) -> str:
    """The first ASCII letter from a third of the text on, or else from its start, becomes the next one of the alphabet."""
    letter = re.compile("[A-Za-z]")
    if not (found := letter.search(text, len(text) // 3) or letter.search(text)):
        raise ValueError("the text has no ASCII letter")
    at = found.start()
    alphabet = string.ascii_lowercase if text[at].islower() else string.ascii_uppercase
    return text[:at] + alphabet[(alphabet.index(text[at]) + 1) % 26] + text[at + 1 :]


def _reordered(text: str) -> str:
    one, two = (_nth(sections(text), n, "sections") for n in (1, 2))
    moved = [text[slice(*two)], text[slice(*one)]]
    return text[: one[0]] + "".join(p.rstrip() + "\n\n" for p in moved) + text[two[1] :].lstrip()


def default_term(text: str) -> str:
    """The most frequent repeated word, of equals the first by alphabet, in its first spelling."""
    spellings: dict[str, list[str]] = {}
    for word in re.findall(r"\b[A-Za-z][\w-]{3,}\b", text, re.ASCII):
        spellings.setdefault(word.casefold(), []).append(word)
    often = sorted((-len(found), key) for key, found in spellings.items() if len(found) > 1 and key not in COMMON)
    if not often:
        raise ValueError("no word that says something occurs twice")
    return spellings[often[0][1]][0]


def replace_all(text: str, find: str | None = None, new: str | None = None) -> str:
    term = find or default_term(text)
    new = f"{term}-revised" if new is None else new
    out, n = re.subn(rf"(?<!\w){re.escape(term)}(?!\w)", lambda _: new, text, flags=re.IGNORECASE)
    if not n or new == term:
        raise ValueError(f"{term!r} does not occur, or stays as it is")
    return out


EDITS: dict[str, Callable[[str], str]] = {
    "insert-sentence": lambda t: _inserted(t, _nth(sentences(t, 1), 1, "sentences"), SENTENCE, " "),
    "insert-paragraph": lambda t: _inserted(t, _nth(paragraphs(t)[:2][::-1], 1, "paragraphs"), PARAGRAPH, "\n\n"),
    "insert-section": lambda t: _inserted(t, _nth(sections(t), 1, "sections"), SECTION, "\n\n"),
    "delete-sentence": lambda t: _without(t, _nth(sentences(t, 2), 2, "sentences"), " "),
    "delete-paragraph": lambda t: _without(t, _nth(paragraphs(t), 2, "paragraphs"), "\n\n").lstrip(),
    "replace-same-length": _bump,
    "reorder-sections": _reordered,
    "append": lambda t: t.rstrip() + APPENDED,
    "global-replace": replace_all,
}


def edited(docs: DataFrame, operation: str, text: str = "text") -> DataFrame:
    """Documents after an edit; one that does not allow the edit (null, empty, too few parts) stays as it is."""
    edit = EDITS[operation]

    def one(t: str | None) -> str | None:
        try:
            return edit(t) if t else t
        except ValueError:
            return t

    @F.pandas_udf("string")
    def apply(found: pd.Series) -> pd.Series:
        return found.map(one)

    return docs.withColumn(text, apply(text))


def bag_churn(old: DataFrame, new: DataFrame, price_per_million: float | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """One row, or one a group of the columns ``by``, from two tables (by, chunk_hash, token_count): occurrences reused, removed, to embed, their tokens, the share of new chunks."""
    count = lambda df, p: df.groupBy(*by, "chunk_hash").agg(F.count("*").alias(p), F.min("token_count").alias(f"{p}_tokens"))
    both = count(old, "o").join(count(new, "n"), [*by, "chunk_hash"], "full").fillna(0, ["o", "n"])
    added = F.greatest(F.col("n") - F.col("o"), F.lit(0).cast("long"))
    total = F.coalesce(F.sum("n"), F.lit(0))
    out = both.groupBy(*by).agg(F.coalesce(F.sum("o"), F.lit(0)).alias("old_chunks"), total.alias("new_chunks"), F.coalesce(F.sum(F.least("o", "n")), F.lit(0)).alias("reused"), F.coalesce(F.sum(F.greatest(F.col("o") - F.col("n"), F.lit(0).cast("long"))), F.lit(0)).alias("removed"), F.coalesce(F.sum(added), F.lit(0)).alias("to_embed"), F.coalesce(F.sum(added * F.coalesce("n_tokens", F.lit(0))), F.lit(0)).alias("tokens_to_embed"))
    rate = F.lit(None if price_per_million is None else price_per_million / 1e6).cast("double")
    return out.withColumns({"reembed_fraction": F.when(F.col("new_chunks") > 0, F.col("to_embed") / F.col("new_chunks")).otherwise(0.0), "estimated_cost": F.col("tokens_to_embed") * rate})


class Cutting:
    """The chunks that a chunker makes of a stream, and of revisions of it those that differ."""

    def __init__(self, chunker: Chunker, old: Stream) -> None:
        self.chunker, self.body, self.n = chunker, old.slicer(), len(old)
        # A chunker that counts words otherwise than one by one cuts revisions whole.
        self.units = list(chunker.units(old)) if isinstance(chunker, Semantic) and chunker.similarity is lexical_similarity else None
        if self.units is None:
            self.spans = [c[:2] for c in chunker.cuts(old)]
            self.starts = [a for a, _ in self.spans]
        else:
            ends = [0, *(e for _, _, made in self.units for e in made)]
            self.spans = list(itertools.pairwise(ends))
            self.unit_starts = [a for a, _, _ in self.units]
            self.before = list(itertools.accumulate((len(made) for _, _, made in self.units), initial=0))  # spans that end before a unit

    def count(self) -> int:
        return sum(b > a for a, b in self.spans)

    def recut(self, new: Stream, first: int, last: int) -> tuple[int, int, list[Span]]:
        """(i, j, spans): in a revision that shares its first and last words with the stream, ``spans`` stand in place of the old ones from
        number i up to j; the others are the same words. Chunks that end before any cut could see the edit stay, and where a chunk
        starts as an old one did and sees shared words only, so do all after it."""
        later, by = len(new) - last, len(new) - self.n
        if self.units is not None:
            k = max(0, bisect_left(self.unit_starts, first) - 1)  # all units before end inside the first words
            at, since, _ = self.units[k]
            ends = [since]
            for a, s, made in self.chunker.units(new, at, since):
                if min(a, s) >= later:
                    j = bisect_left(self.unit_starts, a - by)
                    if j < len(self.units) and self.units[j][:2] == (a - by, s - by):
                        return self.before[k], self.before[j], list(itertools.pairwise(ends))
                ends += made
            return self.before[k], len(self.spans), list(itertools.pairwise(ends))
        if not hasattr(self.chunker, "walk"):
            return 0, len(self.spans), [c[:2] for c in self.chunker.cuts(new)]
        back, ahead = self.chunker.sight
        i = bisect_left(self.starts, first - ahead)
        out: list[Span] = []
        for a, b, *_ in self.chunker.walk(new, self.starts[i] if self.starts else 0):
            if a >= later + back:
                j = bisect_left(self.starts, a - by)
                if j < len(self.starts) and self.starts[j] == a - by:
                    return i, j, out
            out.append((a, b))
        return i, len(self.spans), out

    def changed_bodies(self, new: Stream, first: int, last: int) -> dict[str, tuple[int, int]]:
        """Text to (more occurrences than before, tokens) of the chunks that a revision makes or takes away. Chunks inside shared words are
        compared by place, so only others are put together."""
        i, j, now = self.recut(new, first, last)
        was, by, later = self.spans[i:j], len(new) - self.n, self.n - last
        # Where the spans of shared words would lie in the revision; chunkers of one's own may make a span twice, theirs are compared by text.
        alike = self.units is None and not hasattr(self.chunker, "walk")
        moved = {} if alike else {(a, b): (a, b) if b <= first else (a + by, b + by) for a, b in was if b <= first or a >= later}
        same = set(moved.values()).intersection(now)
        out: dict[str, tuple[int, int]] = {}
        gone = [s for s in was if moved.get(s) not in same]
        for body, spans, sign in ((self.body, gone, -1), (new.slicer(), [s for s in now if s not in same], 1)):
            for a, b in spans:
                if b > a:
                    text = body(a, b)
                    out[text] = (out[text][0] + sign if text in out else sign, b - a)
        return {text: found for text, found in out.items() if found[0]}


def grid(docs: DataFrame, strategies: Mapping[str, Chunker], operations: tuple[str, ...] = tuple(EDITS), text: str = "text") -> DataFrame:
    """``bag_churn`` by (strategy, operation) where each edit is made in every document: of every cell whose strategy makes chunks.

    A document is normalised and cut once by each strategy; of a version, only the words between those that it shares with the document are
    normalised, and chunks are cut anew from the first that can see the edit up to where cuts meet the old ones. Only chunks that an edit
    makes or takes away leave the task, as 128 bits of their text. What an edit leaves in a document is on both sides of the bag, so the sums over these differences are
    those over all chunks."""
    names = list(strategies)

    def differences(t: str) -> Iterable[tuple[int, int, bytes, int, int]]:
        old = normalize(t)
        before = [Cutting(strategies[s], old) for s in names]
        for k, cutting in enumerate(before):
            if n := cutting.count():
                yield k, -1, bytes(16), n, 0
        digests: dict[str, bytes] = {}
        for o, operation in enumerate(operations):
            try:
                revised = EDITS[operation](t) if t else t
            except ValueError:
                continue
            if revised == t:
                continue
            shared = renormalized(old, revised)
            for k, cutting in enumerate(before):
                for body, (more, tokens) in cutting.changed_bodies(*shared).items():
                    if (digest := digests.get(body)) is None:
                        digest = digests[body] = hashlib.blake2b(body.encode("utf-8", "surrogatepass"), digest_size=16).digest()
                    yield k, o, digest, more, tokens

    def run(batches):  # noqa: ANN001, ANN202
        for b in batches:
            found = (x for t in b.column(0) for x in differences(t.as_py() or ""))
            while rows := list(itertools.islice(found, 5000)):
                k, o, digest, more, tokens = zip(*rows, strict=True)
                keys = np.frombuffer(b"".join(digest), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(o, pa.int32()), pa.array(keys[:, 0].copy()), pa.array(keys[:, 1].copy()), pa.array(more, pa.int64()), pa.array(tokens, pa.int64())], names=["s", "o", "k1", "k2", "more", "tokens"])

    cut = docs.select(text).mapInArrow(run, "s int, o int, k1 long, k2 long, more long, tokens long")
    each = cut.groupBy("s", "o", "k1", "k2").agg(F.sum("more").alias("more"), F.min("tokens").alias("tokens"))
    up, down = F.greatest("more", F.lit(0).cast("long")), F.greatest(-F.col("more"), F.lit(0).cast("long"))
    cells = written(each.groupBy("s", "o").agg(F.sum("more").alias("more"), F.sum(up).alias("to_embed"), F.sum(down).alias("removed"), F.sum(up * F.col("tokens")).alias("tokens_to_embed")), "churn-cells")
    every = cells.where("o < 0").select("s", F.col("more").alias("old_chunks"), F.explode(F.array(*(F.lit(o) for o in range(len(operations))))).alias("o"))  # a row a cell
    out = every.join(F.broadcast(cells.where("o >= 0")), ["s", "o"], "left").fillna(0, ["more", "to_embed", "removed", "tokens_to_embed"])
    named = lambda values, at: F.element_at(F.array(*map(F.lit, values)), F.col(at) + 1)
    out = out.withColumn("new_chunks", F.col("old_chunks") + F.col("more")).select(named(names, "s").alias("strategy"), named(operations, "o").alias("operation"), "old_chunks", "new_chunks", (F.col("old_chunks") - F.col("removed")).alias("reused"), "removed", "to_embed", "tokens_to_embed")
    return out.withColumn("reembed_fraction", F.when(F.col("new_chunks") > 0, F.col("to_embed") / F.col("new_chunks")).otherwise(0.0))


def edit_cases(docs: DataFrame, corpus: str = "corpus") -> DataFrame:
    """(corpus, operation, document_id, original, revised): all edits of one document a corpus, the longest that allows every one of them,
    of two as long the one with the lower id. ``docs``: corpus, document_id, text. A corpus without such a document is an error."""

    def revisions(text: str | None) -> list[dict] | None:
        try:
            return [{"operation": name, "revised": edit(text)} for name, edit in EDITS.items()] if text else None
        except ValueError:
            return None

    @F.pandas_udf("array<struct<operation:string,revised:string>>")
    def every(found: pd.Series) -> pd.Series:
        return found.map(revisions)

    own = docs.select(F.col(corpus).alias("corpus"), "document_id", F.col("text").alias("original"), every("text").alias("e"))
    order = F.struct(F.col("e").isNull(), -F.length("original"), "document_id")
    best = own.groupBy("corpus").agg(F.min_by(F.struct("document_id", "original", "e"), order).alias("b"))
    cases = F.when(F.col("b.e").isNull(), F.raise_error(F.concat(F.lit("no document allows all edits in "), F.col("corpus").cast("string")))).otherwise(F.col("b.e"))
    return best.select("corpus", "b.document_id", "b.original", F.explode(cases).alias("c")).select("corpus", "c.operation", "document_id", "original", "c.revised")


def snapshot(chunk: Any) -> tuple[str, str, int]:  # noqa: ANN401
    """(chunk_hash, text, token_count) of what any splitter gives: a string, a mapping or an object with page_content or text. A hash or a
    count of its own holds; else they are made of the text."""
    have = (lambda k: None) if isinstance(chunk, str) else chunk.get if hasattr(chunk, "get") else lambda k: getattr(chunk, k, None)
    text = chunk if isinstance(chunk, str) else next((t for t in map(have, ("page_content", "text")) if isinstance(t, str)), None)
    if text is None:
        raise TypeError("a chunk is a text or has one as page_content or text")
    digest, count = have("chunk_hash"), have("token_count")
    if not isinstance(digest, str) or not digest:
        digest = hashlib.sha256(wire.MEASURE_CHUNK_PREFIX + text.encode()).hexdigest()
    return digest, text, count if type(count) is int and count >= 0 else len(text.split())


def split_documents(docs: DataFrame, splitter: Callable[[str], Iterable[Any]], text: str = "text") -> DataFrame:
    """Chunks by a splitter of one's own, which is sent to the tasks: the other columns of ``docs`` and chunk_index, chunk_hash, text, token_count."""

    @F.pandas_udf("array<struct<chunk_hash:string,text:string,token_count:long>>")
    def cut(found: pd.Series) -> pd.Series:
        return found.map(lambda t: [dict(zip(("chunk_hash", "text", "token_count"), snapshot(c), strict=True)) for c in splitter(t or "")])

    others = [c for c in docs.columns if c != text]
    return docs.select(*others, F.posexplode(cut(text)).alias("chunk_index", "c")).select(*others, "chunk_index", "c.*")


def corpus_churn(docs: DataFrame, chunks_of: Callable[[DataFrame], DataFrame], price_per_million: float | None = None) -> DataFrame:
    """Churn of whole corpora, by (corpus, operation): each edit is made in one document (``edit_cases``), the others count on both sides.
    ``docs``: corpus, document_id, text; ``chunks_of`` adds chunk_hash and token_count, a row a chunk, and keeps the other columns."""
    cases = written(edit_cases(docs), "churn-cases")
    before = written(chunks_of(docs.select("corpus", "document_id", "text")).select("corpus", "document_id", "chunk_hash", "token_count"), "churn-before")
    old = before.join(F.broadcast(cases.select("corpus", "operation", F.col("document_id").alias("edited"))), "corpus")  # nine rows a corpus
    new = chunks_of(cases.select("corpus", "operation", "document_id", F.col("revised").alias("text"))).select("corpus", "operation", "chunk_hash", "token_count")
    after = old.where("document_id <> edited").select("corpus", "operation", "chunk_hash", "token_count").unionByName(new)
    return bag_churn(old, after, price_per_million, ("corpus", "operation"))


def totals(churn: DataFrame, by: str = "strategy") -> DataFrame:
    """Sums over cells, and the share of new chunks weighted by their number."""
    sums = churn.groupBy(by).agg(*(F.sum(c).alias(c) for c in ("old_chunks", "new_chunks", "reused", "to_embed", "tokens_to_embed")))
    return sums.withColumn("reembed_fraction", F.when(F.col("new_chunks") > 0, F.col("to_embed") / F.col("new_chunks")).otherwise(0.0))
