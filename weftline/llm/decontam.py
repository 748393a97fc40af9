"""Benchmark decontamination by templates.

Numbers, names and units become typed placeholders, so that a question keeps its template when its parameters change. Windows of WINDOW
template tokens are hash-joined with those of the benchmark and put on the diagonal (position in the document less position in the item)
they lie on. On a diagonal the values of slots must map one to one from the item's to the document's, for each type: a question that was
re-parameterised renames things consistently, chance does not. Windows of equal bare words in lower case count as well, whatever their
slots, so that a copy in capitals or one with few plain words is found. A document holds an item if windows of equal words and those on
consistent diagonals cover at least SHARE of the item's windows with LITERALS plain tokens, or of all its windows.

Repetitive texts make no product of their lengths: a window that an item repeats, slots and all, is one with a weight, at its first place; of
a document's windows of equal words the first of each stands for all; windows without slots are met by their words alone. Rows meet by
diagonal, at most one a window of the item there, and what diagonals cover is joined by aggregates.

64-bit hashes stand for windows. Where the benchmark has at most INDEX_ROWS words (counted), tasks know its words and window hashes and
send only windows that will meet; else they send all. The join and what follows are the same, so results don't depend on it.
Defined results: null texts have no tokens; an item without a window of LITERALS plain tokens is found by equal words only; its windows
counted are those with LITERALS plain tokens if their share suffices, else all; documents, or items, alike in id and text are judged once;
null ids are kept as null. Items shorter than WINDOW tokens are one window.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialize, row_key, slices, small

WINDOW, LITERALS, SHARE, INDEX_ROWS, SLICE = 8, 4, 0.25, 500_000, 4 << 20
#: Fixed words that are units after a number.
UNITS = frozenset("mm cm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg t lb lbs pound pounds oz ounce ounces ml cl l litre litres liter liters gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years w kw kwh v a hz mhz ghz b kb mb gb tb % percent degrees c f k euro euros dollar dollars cent cents eur usd gbp".split())
_NUMBER, _STRIP, _ENDS = r"[+-]?[$€£]?\d[\d.,:/]*(?:[%€$£]|[a-z]{1,3})?", r"^\W+|[^\w%]+$", r"[.!?][\"'\)\]\}»”]*$"
PLAIN, NUMBER, NAME, UNIT = range(4)
_HOLDERS = ("", "<number>", "<name>", "<unit>")
_IDS = np.array([0, *(xxhash.xxh64_intdigest(h) for h in _HOLDERS[1:])], np.uint64)
_DIGIT, _CAPITAL, _OTHER, _NOTHING = range(4)


@lru_cache(200_000)
def _word(word: str) -> tuple[str, int, bool]:
    """(bare word in lower case, kind, whether a sentence ends here)."""
    bare = re.sub(_STRIP, "", word)
    low = bare.lower()
    kind = _NOTHING if not bare else _DIGIT if re.fullmatch(_NUMBER, low) else _CAPITAL if bare[0].isupper() else _OTHER
    return low, kind, bool(re.search(_ENDS, word))


def _words(words: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The same of many words, as columns; Arrow's expressions know ASCII only, so other words go one by one."""
    flags = lambda a: a.to_numpy(zero_copy_only=False).astype(bool)
    bare = pc.replace_substring_regex(words, _STRIP, "")
    low, ends = pc.ascii_lower(bare), flags(pc.match_substring_regex(words, _ENDS))
    kinds = np.where(flags(pc.ascii_is_upper(pc.utf8_slice_codeunits(bare, 0, 1))), _CAPITAL, _OTHER)
    kinds[flags(pc.match_substring_regex(low, f"^(?:{_NUMBER})$"))] = _DIGIT
    kinds[pc.binary_length(bare).to_numpy(zero_copy_only=False) == 0] = _NOTHING
    odd = ~flags(pc.string_is_ascii(words))
    if odd.any():
        own = [_word(w.decode("utf-8", "replace")) for w in words.filter(pa.array(odd)).cast(pa.binary()).to_pylist()]
        low = pc.replace_with_mask(low, pa.array(odd), pa.array([w[0] for w in own], pa.string()))
        kinds[odd], ends[odd] = [w[1] for w in own], [w[2] for w in own]
    return low, kinds.astype(np.int8), ends


@dataclass(frozen=True)
class Known:
    """What a small benchmark consists of: its bare words with their ids, and the sorted hashes of its windows by (width, equal words)."""

    words: pa.Array
    ids: np.ndarray
    hashes: dict[tuple[int, bool], np.ndarray]


def word_ids(low: pa.Array) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(w) for w in low.cast(pa.binary()).to_pylist()], np.uint64)


class Tokens:
    """Template tokens of many texts in one row of columns: owner (number of the text), types, ids of bare words, whether these are known."""

    def __init__(self, texts: pa.Array, known: Known | None = None) -> None:
        lists = pc.ascii_split_whitespace(texts.fill_null(""))
        coded = lists.flatten().dictionary_encode()
        self.low, kinds, ends = _words(coded.dictionary)
        units = pc.is_in(self.low, pa.array(sorted(UNITS))).to_numpy(zero_copy_only=False)
        if known is None:
            ids, ours = word_ids(self.low), np.ones(len(self.low), bool)
        else:
            at = pc.index_in(self.low, known.words).fill_null(-1).to_numpy(zero_copy_only=False)
            ids, ours = np.append(known.ids, np.uint64(0))[at], at >= 0
        codes = coded.indices.to_numpy(zero_copy_only=False)
        owner = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        kept = kinds[codes] != _NOTHING
        self.codes, self.owner = codes[kept], owner[kept]
        kinds, types = kinds[self.codes], np.zeros(len(self.codes), np.int8)
        types[kinds == _DIGIT] = NUMBER
        later = np.flatnonzero(self.owner[1:] == self.owner[:-1]) + 1  # tokens that aren't their text's first
        types[later[(kinds[later] == _CAPITAL) & ~ends[self.codes[later - 1]]]] = NAME
        types[later[(types[later] == PLAIN) & (types[later - 1] == NUMBER) & units[self.codes[later]]]] = UNIT
        self.types, self.ids, self.ours = types, ids[self.codes], ours[self.codes]
        self.first = np.searchsorted(self.owner, np.arange(len(texts) + 1))  # where each text starts
        self.typed = np.where(types == PLAIN, self.ids, _IDS[types])

    def word(self, k: int) -> str:
        return self.low[self.codes[k].item()].as_py()

    def slots(self, start: int, width: int) -> list[dict]:
        return [{"o": k, "t": int(self.types[start + k]), "v": self.word(start + k)} for k in range(width) if self.types[start + k] != PLAIN]

    def windows(self, width: int, equal: bool) -> tuple[np.ndarray, np.ndarray]:
        """(starts, hashes) of the windows inside a text, of known words; without ``equal`` of templates with enough plain tokens."""
        ids, fits = (self.ids, self.ours) if equal else (self.typed, self.ours | (self.types != PLAIN))
        n = len(ids) - width + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        unknown, plain = np.append(0, np.cumsum(~fits)), np.append(0, np.cumsum(self.types == PLAIN))
        at = np.flatnonzero((unknown[width:] == unknown[:-width]) & (self.owner[width - 1 :] == self.owner[:n]))
        if not equal:
            at = at[plain[at + width] - plain[at] >= min(LITERALS, width)]
        h = np.zeros(len(at), np.uint64)
        for k in range(width):
            h = (h ^ ids[at + k]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        return at, h


def template(text: str | None) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Template token ids (uint64), their types and the bare words of one text."""
    own = Tokens(pa.array([text], pa.string()))
    return own.typed, own.types, [own.word(k) for k in range(len(own.types))]


_SLOTS = pa.list_(pa.struct([("o", pa.int32()), ("t", pa.int32()), ("v", pa.string())]))
_SLOTS_DDL = "slots array<struct<o:int,t:int,v:string>>"
_ITEM = pa.schema([("i1", pa.int64()), ("i2", pa.int64()), ("item", pa.int64()), ("q", pa.int64()), ("width", pa.int32()), ("words", pa.bool_()), ("h", pa.int64()), ("weight", pa.int64()), ("rich", pa.int64()), ("n_rich", pa.int64()), ("total", pa.int64()), ("slots", _SLOTS)])
_DOC = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("id", pa.int64()), ("pos", pa.int64()), ("width", pa.int32()), ("words", pa.bool_()), ("h", pa.int64()), ("slots", _SLOTS)])


def _item_windows(items: DataFrame) -> DataFrame:
    """The windows of every item (k1, k2, id, text) by template, if they have slots, and by words; windows that are alike are one, at their
    first place q, with how many they are (weight) and how many of these have enough plain tokens (rich); n_rich counts all of those, total all
    windows."""

    def run(batches):  # noqa: ANN001, ANN202
        for b in batches:
            for k1, k2, i, t in zip(*(b.column(c).to_pylist() for c in range(4)), strict=True):
                own, rows = Tokens(pa.array([t], pa.string())), {}
                width = min(WINDOW, len(own.types))
                typed, equal = (own.windows(width, False), own.windows(width, True)) if width else (((), ()), ((), ()))
                rich = set(map(int, typed[0]))
                for by, (at, h) in ((False, typed), (True, equal)):
                    for p, x in zip(map(int, at), np.asarray(h, np.uint64).view(np.int64).tolist(), strict=True):
                        slots = own.slots(p, width)
                        if not (by or slots):
                            continue
                        alike = rows.setdefault((by, x, () if by else tuple(s["v"] for s in slots)), {"i1": k1, "i2": k2, "item": i, "q": p, "width": width, "words": by, "h": x, "weight": 0, "rich": 0, "n_rich": len(rich), "total": len(equal[0]), "slots": slots})
                        alike["weight"] += 1
                        alike["rich"] += p in rich
                yield pa.RecordBatch.from_pylist(list(rows.values()), schema=_ITEM)

    return items.mapInArrow(run, f"i1 long, i2 long, item long, q long, width int, words boolean, h long, weight long, rich long, n_rich long, total long, {_SLOTS_DDL}")


def _bare_words(items: DataFrame) -> DataFrame:
    def run(batches):  # noqa: ANN001, ANN202
        for b in batches:
            yield pa.RecordBatch.from_arrays([Tokens(b.column(3)).low.unique()], names=["word"])

    return items.mapInArrow(run, "word string").filter("word <> ''").distinct()


def _document_windows(docs: DataFrame, widths: list[int], known: Known | None) -> DataFrame:
    """(k1, k2, id, pos, width, words, h, slots) of the documents' windows, by words each once; with ``known`` only of those that the benchmark
    has."""
    shared = docs.sparkSession.sparkContext.broadcast(known)  # at most INDEX_ROWS words and twice as many hashes

    def run(batches):  # noqa: ANN001, ANN202
        have = shared.value
        for b in slices(batches, 3, SLICE):
            own, rows = Tokens(b.column(3), have), []
            for width in widths:
                for by in (False, True):
                    at, h = own.windows(width, by)
                    if have is not None:
                        keys = have.hashes.get((width, by), np.zeros(0, np.uint64))
                        hit = keys[np.minimum(np.searchsorted(keys, h), len(keys) - 1)] == h if len(keys) else np.zeros(len(h), bool)
                        at, h = at[hit], h[hit]
                    if by:
                        first = np.unique(np.stack([own.owner[at].astype(np.int64), h.view(np.int64)], 1), axis=0, return_index=True)[1]
                        at, h = at[first], h[first]
                    for p, x in zip(at.tolist(), h.view(np.int64).tolist(), strict=True):
                        slots = [] if by else own.slots(p, width)
                        if not (by or slots):
                            continue
                        doc = own.owner[p].item()
                        rows.append((doc, p - own.first[doc].item(), width, by, x, slots))
                        if len(rows) == 20_000:
                            yield _batch(rows, b)
                            rows = []
            yield _batch(rows, b)

    return docs.mapInArrow(run, f"k1 long, k2 long, id long, pos long, width int, words boolean, h long, {_SLOTS_DDL}")


def _batch(rows: list[tuple], texts: pa.RecordBatch) -> pa.RecordBatch:
    own = texts.select([0, 1, 2]).take(pa.array([r[0] for r in rows], pa.int64()))
    columns = list(zip(*(r[1:] for r in rows), strict=True)) or [()] * 5
    return pa.RecordBatch.from_arrays([*own.columns, *(pa.array(c, f.type) for c, f in zip(columns, list(_DOC)[3:], strict=True))], schema=_DOC)


def consistent(pairs: list[tuple[int, str, str]]) -> bool:
    """Whether (type, item's value, document's value) map one to one, each type by itself."""
    there, back = {}, {}
    return all(there.setdefault((t, a), b) == b and back.setdefault((t, b), a) == a for t, a, b in pairs)


def covered(met: list[dict]) -> list[dict]:
    """Rows (at, weight, rich, slot, changed) of one diagonal of a document and an item, from its template windows (q, weight, rich and both
    sides' slots): the windows and slots they cover if slots are consistent, else none."""
    pairs = {(m["q"] + x["o"], x["t"], x["v"], y["v"]) for m in met for x, y in zip(m["bs"], m["ds"], strict=True)}
    if not consistent([p[1:] for p in sorted(pairs)]):
        return []
    rows = [{"at": m["q"], "weight": m["weight"], "rich": m["rich"], "slot": False, "changed": None} for m in met]
    return rows + [{"at": p, "weight": 0, "rich": 0, "slot": True, "changed": x != y} for p, _, x, y in pairs]


_COVER = pa.list_(pa.struct([("at", pa.int64()), ("weight", pa.int64()), ("rich", pa.int64()), ("slot", pa.bool_()), ("changed", pa.bool_())]))
_PAIR, _FACTS = ["k1", "k2", "i1", "i2"], ["id", "item", "n_rich", "total"]


def _held(own: DataFrame, benchmark: DataFrame, item_id: str, item_text: str, index_rows: int) -> DataFrame:
    """(k1, k2, id, item, n, of, n_slots, n_changed) of the documents (k1, k2, id, text) that hold an item, once a key and item."""
    items = benchmark.select(F.col(item_id).cast("long").alias("id"), F.col(item_text).alias("text"))
    items = items.select(*row_key(F.col("id"), F.col("text")), "id", "text").dropDuplicates(["k1", "k2"])
    size = items.agg(F.sum(F.size(F.split(F.coalesce("text", F.lit("")), r"\s+")))).first()[0] or 0
    bench = materialize(_item_windows(items), "decontam-items")
    kinds = [tuple(r) for r in bench.select("width", "words").distinct().collect()]  # at most twice WINDOW
    known = None
    if size <= index_rows:
        words = pa.array(sorted(r[0] for r in _bare_words(items).collect()), pa.string())  # at most INDEX_ROWS
        hashes = {k: [] for k in kinds}
        for w, by, h in bench.select("width", "words", "h").distinct().collect():  # at most twice as many
            hashes[w, by].append(h)
        known = Known(words, word_ids(words), {k: np.sort(np.array(h, np.int64).view(np.uint64)) for k, h in hashes.items()})
    asked = _document_windows(own, sorted({w for w, _ in kinds}), known).withColumnRenamed("slots", "ds")
    met = asked.join(small(bench.withColumnRenamed("slots", "bs")), ["width", "words", "h"])
    words = met.filter("words").select(*_PAIR, *_FACTS, F.col("q").alias("at"), "weight", "rich", F.lit(False).alias("slot"), F.lit(None).cast("boolean").alias("changed"))
    same = met.filter("words and size(bs) > 0").select(*_PAIR, *_FACTS, F.explode("bs.o").alias("o"), "q").select(*_PAIR, *_FACTS, (F.col("q") + F.col("o")).alias("at"), F.lit(0).cast("long").alias("weight"), F.lit(0).cast("long").alias("rich"), F.lit(True).alias("slot"), F.lit(False).alias("changed"))
    one = F.collect_set(F.struct("q", "weight", "rich", "ds", "bs")).alias("met")  # at most the item's windows, each once
    lines = met.filter("not words").groupBy(*_PAIR, (F.col("pos") - F.col("q")).alias("diagonal")).agg(*(F.max(c).alias(c) for c in _FACTS), one)
    keep = [*_PAIR, *_FACTS]

    def run(batches):  # noqa: ANN001, ANN202
        for b in batches:
            rows = [covered(m) for m in b.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(rows, _COVER)], names=[*keep, "rows"])

    types = "".join(f"{c} long, " for c in keep)
    typed = lines.select(*keep, "met").mapInArrow(run, f"{types}rows array<struct<at:long,weight:long,rich:long,slot:boolean,changed:boolean>>").select(*keep, F.inline("rows"))
    each = words.unionByName(same).unionByName(typed).groupBy(*_PAIR, "slot", "at").agg(*(F.max(c).alias(c) for c in (*_FACTS, "weight", "rich")), F.min("changed").alias("changed"))
    pairs = each.groupBy(*_PAIR).agg(*(F.max(c).alias(c) for c in _FACTS), F.sum("weight").alias("all"), F.sum("rich").alias("some"), F.count_if("slot").alias("n_slots"), F.count_if("changed").alias("n_changed"))
    enough = lambda n, of: F.col(n) >= F.greatest(F.lit(1.0), SHARE * F.col(of))
    pairs = pairs.filter(enough("some", "n_rich") | enough("all", "total"))
    return pairs.select("k1", "k2", "id", "item", F.when(enough("some", "n_rich"), F.col("some")).otherwise(F.col("all")).alias("n"), F.when(enough("some", "n_rich"), F.col("n_rich")).otherwise(F.col("total")).alias("of"), "n_slots", "n_changed")


def contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", index_rows: int = INDEX_ROWS) -> DataFrame:
    """One row a (document, item) that it holds: windows met and how many the item has, their share, the item's slots met and how many of these
    differ wherever they were met."""
    ids = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    found = _held(ids.select(*row_key(F.col("id"), F.col("text")), "id", "text"), benchmark, item_id, item_text, index_rows)
    return found.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), F.col("n").alias("n_windows"), F.col("of").alias("item_windows"), (F.col("n") / F.col("of")).alias("coverage"), "n_slots", "n_changed")


def clean(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no item, with their columns.

    Rows are named by 128 bits of id and text, so null and repeated ids are told apart; those that go are few and known before rows move.
    """
    key = row_key(F.col(doc_id), F.col(text))
    found = _held(docs.select(*key, F.lit(None).cast("long").alias("id"), F.col(text).alias("text")), benchmark, "item_id", "text", INDEX_ROWS)
    a, b = fresh(docs, "k1"), fresh(docs, "k2")
    gone = found.select(F.col("k1").alias(a), F.col("k2").alias(b)).distinct()
    return docs.withColumns({a: key[0], b: key[1]}).join(small(materialize(gone, "decontam-found")), [a, b], "left_anti").select(*docs.columns)
