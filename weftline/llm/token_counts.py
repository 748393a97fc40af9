"""Edit-aware token counts.

A document's pre-tokens (the pieces its tokenizer's pattern cuts it into before merging) are the leaves of a segment tree whose nodes sum
characters and tokens; leaves are held in blocks. An edit descends to the block that holds its start, steps back over the pre-tokens whose
match could have looked at the edit (the pattern looks at most LOOK characters past a match's end), cuts the new text from there until a
cut falls on an old one past the edit, encodes just these pre-tokens and adds the differences on the way from each touched block to the
root. Trees are kept as tables of their leaves (``trees``), so an edit costs no encoding of the whole text. Matching is left to right without look-behind, so from a shared cut on, the same text is cut the same way: counts equal those of a
full encoding.

Defined results: null text is empty; null or empty edits change nothing; edits out of range are clipped; null ids are kept; repeated rows
are counted each. Edits apply in turn, each to the text that the last one left.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
LOOK, BLOCK, MEMO, MEMO_CHARS, SLICE = 4, 64, 400_000, 48, 4 << 20
EDITS = "array<struct<start:int,stop:int,text:string>>"
#: The pattern of byte-level BPE vocabularies, fixed.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_SPACES = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def pattern(others: str) -> re.Pattern:
    """PATTERN in the standard library's syntax: its word characters less digits, other numerals and the underscore are the letters."""
    given = {r"\p{L}": rf"[^\W\d_{others}]", r"\p{N}": rf"[\d{others}]", r"[^\s\p{L}\p{N}]": rf"(?:[^\w{_SPACES}]|_)", r"\s": f"[{_SPACES}]", r"\S": f"[^{_SPACES}]"}
    return re.compile("|".join(re.sub(r"\[\^\\s\\p\{L\}\\p\{N\}\]|\\p\{[LN]\}|\\[sS]", lambda m: given[m[0]], part) for part in PATTERN.split("|")))


class Cutter:
    """Cuts as PATTERN does. The hundreds of numerals that are no digits make its classes slow, so texts without any take a pattern without them."""

    def __init__(self) -> None:
        others = "".join(chr(c) for c in range(0x110000) if unicodedata.category(chr(c)) in ("No", "Nl"))
        self.plain, self.full, self.others = pattern(""), pattern(others), frozenset(others)

    def of(self, text: str) -> re.Pattern:
        return self.plain if text.isascii() or self.others.isdisjoint(text) else self.full

    def findall(self, text: str) -> list[str]:
        return self.of(text).findall(text)

    def finditer(self, text: str, at: int):  # noqa: ANN201
        return self.of(text).finditer(text, at)


class Counter:
    """Tokens of a pre-token, remembered."""

    def __init__(self, ranks: bytes) -> None:
        import base64

        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.encoding, self.pattern, self.memo = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=table, special_tokens={}), Cutter(), {}

    def __call__(self, piece: str) -> int:
        n = self.memo.get(piece)
        if n is None:
            n = len(self.encoding.encode_ordinary(piece))
            if len(piece) <= MEMO_CHARS:
                if len(self.memo) >= MEMO:
                    self.memo.clear()
                self.memo[piece] = n
        return n


class Tree:
    """Segment tree over blocks of pre-tokens (lengths and token counts); a block's leaves stay as they were read until an edit opens it."""

    def __init__(self, lengths, tokens) -> None:  # noqa: ANN001
        lengths, tokens = np.asarray(lengths, np.int64), np.asarray(tokens, np.int64)
        n = max(1, -(-len(lengths) // BLOCK))
        self.blocks = [(lengths[i * BLOCK : (i + 1) * BLOCK], tokens[i * BLOCK : (i + 1) * BLOCK]) for i in range(n)]
        self.leaves = 1 << (n - 1).bit_length()
        level = np.zeros((self.leaves, 2), np.int64)
        if len(lengths):
            at = np.arange(0, len(lengths), BLOCK)
            level[:n, 0], level[:n, 1] = np.add.reduceat(lengths, at), np.add.reduceat(tokens, at)
        levels = [level]
        while len(levels[-1]) > 1:
            levels.append(levels[-1].reshape(-1, 2, 2).sum(axis=1))
        flat = np.concatenate([np.zeros((1, 2), np.int64), *levels[::-1]])
        self.chars, self.sums = flat[:, 0].tolist(), flat[:, 1].tolist()

    def open(self, block: int) -> tuple[list[int], list[int]]:
        """A block's lengths and token counts, as lists to be changed."""
        own = self.blocks[block]
        if not isinstance(own[0], list):
            own = self.blocks[block] = (own[0].tolist(), own[1].tolist())
        return own

    @property
    def total(self) -> int:
        return self.sums[1]

    @property
    def count(self) -> int:
        return sum(len(a) for a, _ in self.blocks)

    def block_at(self, offset: int) -> tuple[int, int]:
        """The block in which a character offset lies (the last one for the end) and the offset at which it starts."""
        node, start = 1, 0
        while node < self.leaves:
            node *= 2
            if offset >= start + self.chars[node] and self.chars[node + 1]:
                start += self.chars[node]
                node += 1
        return node - self.leaves, start

    def update(self, block: int) -> None:
        """Adds a block's differences to all sums above it."""
        node = block + self.leaves
        own = self.open(block)
        chars, tokens = sum(own[0]) - self.chars[node], sum(own[1]) - self.sums[node]
        while node:
            self.chars[node] += chars
            self.sums[node] += tokens
            node //= 2

    def flat(self) -> tuple[np.ndarray, np.ndarray]:
        """All leaves: what is kept of a tree, as its sums follow from them."""
        return tuple(np.concatenate([np.asarray(b[k], np.int64) for b in self.blocks]) for k in (0, 1))


def build(text: str, count: Counter) -> Tree:
    pieces = count.pattern.findall(text)
    get = count.memo.get
    return Tree(list(map(len, pieces)), [n if (n := get(p)) is not None else count(p) for p in pieces])


def edit(tree: Tree, text: str, start: int, stop: int, new: str, count: Counter) -> tuple[Tree, str, int]:
    """Applies one edit; the tree, the new text and how many pre-tokens were encoded."""
    start = max(0, min(start, len(text)))
    stop = max(start, min(stop, len(text)))
    after, shift = text[:start] + new + text[stop:], len(new) - (stop - start)
    block, at = tree.block_at(max(0, start - LOOK))
    i = 0
    own = tree.open(block)[0]
    while i < len(own) and at + own[i] + LOOK <= start:
        at += own[i]
        i += 1
    first, last, j, old = (block, i), block, i, at  # the old cut ``old`` lies before pre-token (last, j)
    lengths, tokens, pos, closed = [], [], at, False
    for m in count.pattern.finditer(after, at):
        lengths.append(m.end() - m.start())
        tokens.append(count(m[0]))
        pos = m.end()
        while old < pos - shift or old < stop:
            if j < len(own):
                old += own[j]
                j += 1
            elif last + 1 < len(tree.blocks):
                last, j = last + 1, 0
                own = tree.open(last)[0]
            else:
                break
        if pos >= start + len(new) and old >= stop and old == pos - shift:
            closed = True
            break
    if not closed:
        last = len(tree.blocks) - 1
        j = len(tree.blocks[last][0])
    block, i = first
    if last == block:
        put = {block: (slice(i, j), lengths, tokens)}
    else:
        put = {block: (slice(i, None), lengths, tokens), last: (slice(0, j), [], [])} | {b: (slice(0, None), [], []) for b in range(block + 1, last)}
    for b, (at, *new) in put.items():
        for own, x in zip(tree.open(b), new, strict=True):
            own[at] = x
        tree.update(b)
    if len(tree.blocks[block][0]) > 8 * BLOCK:
        tree = Tree(*tree.flat())
    return tree, after, len(lengths)


_STATE: dict = {}


def _counter(ranks: bytes) -> Counter:
    if _STATE.get("ranks") != hash(ranks):
        _STATE.update(ranks=hash(ranks), counter=Counter(ranks))
    return _STATE["counter"]


STATE = "doc_id long, text string, lengths array<int>, tokens array<int>, n_pretokens long, n_tokens long"


def _lists(rows: list[np.ndarray]) -> pa.Array:
    offsets = np.append(0, np.cumsum([len(r) for r in rows]))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *rows]), pa.int32()))


def trees(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", ranks: str = RANKS) -> DataFrame:
    """The state of every document (STATE): its text and its tree's leaves, which are the lengths and token counts of its pre-tokens.
    To be written once; ``recount`` reads it and gives the next one."""
    with open(ranks, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())  # the vocabulary, about 1 MB

    def run(batches):  # noqa: ANN001, ANN202
        count = _counter(shared.value)
        for b in slices(batches, 1, SLICE):
            made = [build(t.as_py() or "", count) for t in b.column(1)]
            leaves = [t.flat() for t in made]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(_lists([x[k] for x in leaves]) for k in (0, 1)), pa.array([t.count for t in made], pa.int64()), pa.array([t.total for t in made], pa.int64())], names=["doc_id", "text", "lengths", "tokens", "n_pretokens", "n_tokens"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, STATE)


def recount(state: DataFrame, edits: str = "edits", ranks: str = RANKS, keep_state: bool = False) -> DataFrame:
    """From STATE and a column of edits: doc_id, n_pretokens and n_tokens before them, n_edits, n_reencoded (pre-tokens encoded for them),
    pretokens_after and tokens_after; with ``keep_state`` also the new text, lengths and tokens. Only what edits touch is cut and encoded."""
    with open(ranks, "rb") as f:
        shared = state.sparkSession.sparkContext.broadcast(f.read())  # the vocabulary, about 1 MB
    schema = "doc_id long, n_pretokens long, n_tokens long, n_edits long, n_reencoded long, pretokens_after long, tokens_after long" + ", text string, lengths array<int>, tokens array<int>" * keep_state

    def run(batches):  # noqa: ANN001, ANN202
        count = _counter(shared.value)
        for b in slices(batches, 1, SLICE):
            leaves = [[x.values.to_numpy(zero_copy_only=False) if x.is_valid else np.zeros(0, np.int64) for x in b.column(k)] for k in (2, 3)]
            figures, kept = [], []
            for i, t, lengths, tokens, changes in zip(b.column(0).to_pylist(), b.column(1), *leaves, b.column(4).to_pylist(), strict=True):
                t, tree = t.as_py() or "", Tree(lengths, tokens)
                before, sums, made, seen = tree.count, tree.total, 0, 0
                for e in changes or ():
                    if e is not None:
                        tree, t, n = edit(tree, t, e["start"] or 0, e["stop"] or 0, e["text"] or "", count)
                        made, seen = made + 1, seen + n
                figures.append((i, before, sums, made, seen, tree.count, tree.total))
                kept += [(t, *tree.flat())] * keep_state
            columns = [pa.array(c, pa.int64()) for c in zip(*figures, strict=True)] + ([pa.array([k[0] for k in kept], pa.string()), *(_lists([k[n] for k in kept]) for n in (1, 2))] if keep_state else [])
            yield pa.RecordBatch.from_arrays(columns, names=[x.strip().split()[0] for x in schema.split(",")])

    return state.select("doc_id", "text", "lengths", "tokens", F.col(edits).cast(EDITS).alias("edits")).mapInArrow(run, schema)


def sample_edits(doc_id: str = "doc_id", text: str = "text"):  # noqa: ANN201
    """Three edits a document, placed by a hash of its id: a replacement, an insertion and a deletion."""
    n = F.greatest(F.length(F.coalesce(F.col(text), F.lit(""))), F.lit(1))
    at = lambda k: F.pmod(F.xxhash64(F.col(doc_id), F.lit(k)), n).cast("int")
    one = lambda k, cut, new: F.struct(at(k).alias("start"), (at(k) + cut).alias("stop"), F.lit(new).alias("text"))
    return F.array(one(1, 12, "it's 42 new words"), one(2, 0, "  \n inserted don't "), one(3, 30, ""))
