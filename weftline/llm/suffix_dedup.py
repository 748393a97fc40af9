"""Removal of long repeated passages by merged Burrows-Wheeler transforms.

Texts are read as bytes and cut at anchors: positions whose 8-byte hash is the minimum within RADIUS positions on either side, and strictly
so on one of them (in periodic stretches it ends or begins one), which depends on the bytes around them only, so equal passages are cut alike. A suffix is the run of tokens from an anchor, led by its context.

* Each shard (a slice of texts in a task) orders its own suffixes by LF steps over its tokens: the block of a suffix is that of (its token,
  the block of the suffix that follows), refined once a token. Suffixes that are equal as far as a window can reach are one interval.
* Shards are merged by refining their interleave: all intervals begin in one block, and each round splits blocks by the next symbol of their
  intervals, one aggregate a round. No suffix is compared or sorted again. The round in which an interval is alone gives its longest
  common prefix with any other suffix of the corpus.
* From common prefixes follow the windows of WIDTH bytes that occur elsewhere: those inside a common prefix do, those whose anchors have no
  common prefix don't. What is left, windows at the ends of repeats where the bytes beside the anchors decide, is checked exactly, against
  each other and against the windows of repeats that share their anchors: first by what they hold around these anchors up to multiples of
  STEP bytes, then, if that occurs elsewhere, by 128-bit digests of the windows themselves.

Only anchors whose context occurs twice enter the merge. Tables are narrow but for the texts that may hold a repeat, which are written once.
Defined results: null texts are empty; texts shorter than WIDTH lose nothing; repeated rows are copies of each other and lose all; documents
are told apart by rows, not ids; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import Store
from .common import discard, materialize, met, scratch_path, slices

WIDTH, RADIUS, GRAM, STEP, SLICE, HOT = 400, 32, 8, 16, 4 << 20, 2000
_FAR, _MULTIPLIER = 1 << 30, np.uint64(0x9E3779B97F4A7C15)


def _gram_hashes(data: np.ndarray, block: int = 1 << 22) -> np.ndarray:
    """32-bit hashes of the GRAM bytes from each position."""
    n = max(len(data) - GRAM + 1, 0)
    out = np.empty(n, np.uint32)
    for lo in range(0, n, block):
        hi = min(n, lo + block)
        grams = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data[lo : hi + GRAM - 1], GRAM)).view("<u8").ravel()
        out[lo:hi] = (grams ^ grams >> np.uint64(29)) * _MULTIPLIER >> np.uint64(32)
    return out


class Slice:
    """Texts of a slice end to end, with their anchors: ``at`` (positions in the slice) and ``owner`` (numbers of texts)."""

    def __init__(self, texts: pa.Array, radius: int) -> None:
        own = texts.to_pylist()
        self.radius, self.right = radius, radius + GRAM
        self.octets = memoryview(b"".join(own))
        self.sizes = np.array([len(t) for t in own], np.int64)
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes
        h, g = _gram_hashes(np.frombuffer(self.octets, np.uint8)), radius
        self.hashes = h
        at = np.zeros(0, np.int64)
        if len(h) > 2 * g:
            least, width = h, 1  # minima of ``width`` hashes from each position
            while 2 * width <= g:
                least, width = np.minimum(least[:-width], least[width:]), 2 * width
            if width < g:
                least = np.minimum(least[: width - g], least[g - width :])
            mid = h[g : len(h) - g]
            left, right = least[: len(mid)], least[g + 1 : g + 1 + len(mid)]
            at = np.flatnonzero((mid <= left) & (mid <= right) & ((mid < left) | (mid < right))) + g
        owner = np.searchsorted(self.ends, at, "right")
        inside = (at - g >= self.starts[owner]) & (at + self.right <= self.ends[owner]) if len(at) else np.zeros(0, bool)
        self.at, self.owner = at[inside], owner[inside]
        self.first = np.searchsorted(self.owner, np.arange(len(own) + 1))  # a text's first anchor

    def context(self, a: int) -> int:
        return xxhash.xxh3_64_intdigest(self.octets[a - self.radius : a + self.right])

    def contexts(self) -> np.ndarray:
        return np.array([self.context(a) for a in self.at.tolist()], np.uint64)

    def tokens(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(positions, ends, owners, hashes) of all tokens; each text's first token begins where the text begins."""
        owner = np.concatenate([self.owner, np.arange(len(self.sizes))])
        at = np.concatenate([self.at, self.starts])
        order = np.lexsort((at, owner))
        at, owner = at[order], owner[order]
        ends = self.ends[owner]
        ends[:-1] = np.where(owner[1:] == owner[:-1], at[1:], ends[:-1])
        return at, ends, owner, np.array([xxhash.xxh3_64_intdigest(self.octets[a:e]) for a, e in zip(at.tolist(), ends.tolist(), strict=True)], np.uint64)


def _may_hold(before: np.ndarray, after: np.ndarray, n: int, width: int, radius: int) -> bool:
    """Whether a window fits whose anchors all lie between some pair of the anchors before and after."""
    low, high = np.maximum(before - radius + 1, 0), np.minimum(n - width, after - width + radius + GRAM - 1)
    return bool((low <= high).any())


_TOKENS = pa.list_(pa.struct([("ctx", pa.int64()), ("before", pa.int32()), ("after", pa.int32())]))


def _anchored(texts: DataFrame, width: int, radius: int) -> DataFrame:
    """(k1, k2, n, loose, tokens): the anchors of each text; loose: some window has no anchor."""
    schema = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("n", pa.int64()), ("loose", pa.bool_()), ("tokens", _TOKENS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 2, SLICE):
            own = Slice(b.column(2), radius)
            place = own.at - own.starts[own.owner]
            before, after = np.full(len(place), -_FAR), np.full(len(place), _FAR)
            same = own.owner[1:] == own.owner[:-1]
            before[1:][same], after[:-1][same] = place[:-1][same], place[1:][same]
            loose = []
            for j, n in enumerate(own.sizes.tolist()):
                lo, hi = own.first[j], own.first[j + 1]
                loose.append(_may_hold(np.append(before[lo:hi], place[hi - 1] if hi > lo else -_FAR), np.append(place[lo:hi], _FAR), n, width, radius))
            flat = pa.StructArray.from_arrays([pa.array(own.contexts().view(np.int64)), pa.array(before, pa.int32()), pa.array(after, pa.int32())], names=["ctx", "before", "after"])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(own.sizes), pa.array(loose), pa.ListArray.from_arrays(pa.array(own.first, pa.int32()), flat)], schema=schema)

    return texts.mapInArrow(run, "k1 long, k2 long, n long, loose boolean, tokens array<struct<ctx:long,before:int,after:int>>")


def _candidates(lists: DataFrame, width: int, radius: int) -> DataFrame:
    """(rid, live) of the rows that may hold a repeat: the numbers of their anchors whose context occurs elsewhere, from 1."""
    each = lists.select("rid", F.posexplode("tokens").alias("k", "t")).select("rid", (F.col("k") + 1).alias("k"), "t.ctx", "t.before", "t.after")
    twice = each.groupBy("ctx").agg(F.count("*").alias("n")).filter("n > 1")
    live = met(each, twice, ["ctx"]).groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("k", "before", "after"))).alias("live"))  # bounded by the text
    both = lists.select("rid", "n", "loose").join(live, "rid", "left").filter("loose or live is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, numbers = [], []
            for n, loose, live in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3), strict=True):
                flat = live.values.flatten() if live.is_valid else [np.zeros(0, np.int64)] * 3
                k, before, after = (np.asarray(x, np.int64) for x in flat)
                split = np.flatnonzero(np.diff(k) != 1) + 1  # runs of neighbouring anchors
                firsts, lasts = np.append(0, split)[: len(k)], np.append(split, len(k))[: len(k)] - 1
                keep.append(loose or (len(k) > 0 and _may_hold(before[firsts], after[lasts], n, width, radius)))
                numbers.append(k.tolist())
            out = pa.RecordBatch.from_arrays([b.column(0), pa.array(numbers, pa.list_(pa.int32()))], names=["rid", "live"])
            yield out.filter(pa.array(keep, pa.bool_()))

    return both.select("rid", "n", "loose", "live").mapInArrow(run, "rid long, live array<int>")


def shard_intervals(tokens: np.ndarray, last: np.ndarray, lead: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """Interval numbers of a shard's suffixes: equal for those with equal lead and equal first ``depth`` tokens. tokens: in text order;
    last: whether a token is its text's last; by LF steps, each ranking (token, block of the suffix that follows)."""
    codes = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    block, final = np.zeros(len(tokens), np.int64), np.zeros(len(tokens), np.int64)
    for step in range(1, int(depth.max(initial=0)) + 1):
        following = np.append(block[1:], 0) + 1
        if step > 1:
            following[last] = 0  # shorter than this step; nothing follows anywhere in the first
        block = np.unique(codes * (len(tokens) + 2) + following, return_inverse=True)[1].astype(np.int64)
        final[depth == step] = block[depth == step]
    keys = np.stack([lead.view(np.int64), depth.astype(np.int64), final], 1)
    return np.unique(keys, axis=0, return_inverse=True)[1].ravel()


def _suffixes(held: DataFrame, width: int, radius: int) -> DataFrame:
    """(tid, k, unit, size, copies, symbols) of the suffixes that enter the merge; the first of each of the shard's intervals (unit) carries its
    symbols, how many rows it has here and how many documents."""
    schema = pa.schema([("tid", pa.int64()), ("k", pa.int32()), ("unit", pa.int64()), ("size", pa.int64()), ("copies", pa.int64()), ("symbols", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = TaskContext.get().partitionId() << 40
        for b in slices(batches, 1, SLICE):
            own, n = Slice(b.column(1), radius), b.num_rows
            at, ends, owner, hashes = own.tokens()
            begins = np.searchsorted(owner, np.arange(n + 1))
            wanted = np.zeros(len(at), bool)
            wanted[begins[:-1]] = True
            for j, live in enumerate(b.column(2)):
                wanted[begins[j] + np.asarray(live.values, np.int64)] = True
            reach = ends + width - radius  # a window before the next anchor ends here at most
            depth = np.minimum(np.searchsorted(ends + owner * 0, reach, "left") + 1, begins[owner + 1]) - np.arange(len(at))
            depth[~wanted] = 0
            lead = np.zeros(len(at), np.uint64)
            starts = set(begins[:-1].tolist())
            for k in np.flatnonzero(wanted).tolist():
                a = int(at[k])
                lead[k] = xxhash.xxh3_64_intdigest(b"^" + bytes(own.octets[a : a + own.right])) if k in starts else own.context(a)
            k = np.flatnonzero(wanted)
            last = np.append(owner[1:] != owner[:-1], True)
            unit = shard_intervals(hashes, last, lead, depth)[k]
            _, first, unit, size = np.unique(unit, return_index=True, return_inverse=True, return_counts=True)
            copies = np.bincount(unit.ravel(), weights=b.column(3).to_numpy(zero_copy_only=False)[owner[k]].astype(float))
            signed = hashes.view(np.int64)
            heads = dict(zip(first.tolist(), range(len(first)), strict=True))
            symbols, sizes, weights = [None] * len(k), [None] * len(k), [None] * len(k)
            for p, u in heads.items():
                symbols[p] = [int(lead[k[p]].view(np.int64)), *signed[k[p] : k[p] + depth[k[p]]].tolist()]
                sizes[p], weights[p] = int(size[u]), int(copies[u])
            tids = b.column(0).to_numpy(zero_copy_only=False)[owner[k]]
            columns = [tids, (k - begins[owner[k]]).astype(np.int32), unit.ravel() + done, sizes, weights, symbols]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
            done += len(first)

    return held.select("tid", "text", "live", "copies").mapInArrow(run, "tid long, k int, unit long, size long, copies long, symbols array<long>")


def _rounds(units: DataFrame) -> DataFrame:
    """``merged`` in Spark, an aggregate a round, for contexts with very many intervals."""
    first = F.element_at("symbols", 1)
    live = units.select("unit", "copies", first.alias("block"), F.slice("symbols", 2, 1 << 20).alias("symbols"))
    done, h = [live.filter(F.size("symbols") == 0).select("unit", F.lit(1).alias("matched"), F.lit(True).alias("lead"))], 1
    live, last = live.filter(F.size("symbols") > 0), None
    while True:
        found = live.groupBy("block", first.alias("symbol")).agg(F.sum("copies").alias("occurrences"), F.min("unit").alias("into"), F.count("*").alias("n")).filter("occurrences > 1").drop("occurrences")
        step = met(live.withColumn("symbol", first), found, ["block", "symbol"], how="left")
        over, whole = F.col("into").isNull(), F.size("symbols") == 1
        step = step.select("unit", "copies", F.col("into").alias("block"), F.when(~over & ~whole, F.slice("symbols", 2, 1 << 20)).alias("symbols"), F.when(over, h).otherwise(h + 1).alias("matched"), (over | (F.col("into") == F.col("unit"))).alias("lead"), (over | whole).alias("out"))
        path = scratch_path(units.sparkSession, "repeat-step")
        step.write.partitionBy("out").parquet(path)
        read = lambda out, columns, p=path: units.sparkSession.read.schema(columns).option("ignoreMissingFiles", True).parquet(f"{p}/out={out}")
        outs = set(Store(units.sparkSession, path).names(""))
        if "out=true" in outs:
            done.append(read("true", "unit long, matched int, lead boolean"))
        if last is not None:
            Store(units.sparkSession, last).delete("out=false", True)
        if "out=false" not in outs:
            return reduce(DataFrame.unionByName, done)
        live, last, h = read("false", "unit long, copies long, block long, symbols array<long>"), path, h + 1


def refined(lead: np.ndarray, symbols: list[np.ndarray], copies: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(matched, first) of intervals in order of lead: the interleave is refined symbol by symbol until every interval is alone or at its end."""
    n, sizes = len(lead), np.array([len(x) for x in symbols])
    starts, flat = np.append(0, np.cumsum(sizes))[:-1], np.concatenate(symbols) if n else np.zeros(0, np.int64)
    block, live = np.unique(lead, return_inverse=True)[1].astype(np.int64), np.arange(n)
    matched, first = np.ones(n, np.int64), np.ones(n, bool)
    for h in range(1, int(sizes.max(initial=0))):
        live = live[sizes[live] > h]
        order = live[np.lexsort((live, flat[starts[live] + h], block[live]))]  # stable in each block
        new = np.append(True, (block[order][1:] != block[order][:-1]) | (flat[starts[order] + h][1:] != flat[starts[order] + h][:-1])) if len(order) else np.zeros(0, bool)
        group = np.cumsum(new) - 1
        together = np.bincount(group, weights=copies[order])[group] > 1 if len(order) else new
        block[order] = group
        first[order] = new | ~together
        live = order[together]
        matched[live] = h + 1
    return matched, first


def merged(units: DataFrame) -> DataFrame:
    """(unit, tid, k, matched, lead) from (unit, tid, k, copies, symbols): how many of its symbols another suffix, or another copy, begins
    with (the first counts for all); lead: whether the unit is the first of its final block, or shares not all of its symbols.

    Shards meet by context: what begins with one context is refined in a task. Contexts of more than HOT intervals are refined by Spark.
    """
    units = units.withColumn("context", F.element_at("symbols", 1))
    hot = units.groupBy("context").agg(F.count("*").alias("n")).filter(F.col("n") > HOT).select("context", "n")
    hot = F.broadcast(materialize(hot.select("context"), "repeat-hot"))  # at most one in HOT intervals
    schema = pa.schema([("unit", pa.int64()), ("tid", pa.int64()), ("k", pa.int32()), ("matched", pa.int32()), ("lead", pa.bool_())])

    def solve(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        lists = t.column("symbols").chunk(0)
        flat, at = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
        symbols = np.split(flat[at[0] : at[-1]], (at - at[0])[1:-1])
        matched, lead = refined(t.column("context").to_numpy(), symbols, t.column("copies").to_numpy())
        return pa.RecordBatch.from_arrays([*(t.column(c).chunk(0) for c in ("unit", "tid", "k")), pa.array(matched, pa.int32()), pa.array(lead)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for b in batches:
            if not b.num_rows:
                continue
            context = b.column(0).to_numpy(zero_copy_only=False)
            cut = int(np.searchsorted(context, context[-1], "left"))  # the last context may go on
            if rows + cut > 100_000 and (cut or held[-1].column(0)[-1].as_py() != context[0]):
                yield solve([*held, b.slice(0, cut)] if cut else held)
                held, rows, b = [], 0, b.slice(cut)
            held.append(b)
            rows += b.num_rows
        if held:
            yield solve(held)

    cold = units.join(hot, "context", "left_anti").select("context", "unit", "tid", "k", "copies", "symbols")
    parts = int(units.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    done = cold.repartition(parts, "context").sortWithinPartitions("context", "unit").mapInArrow(run, "unit long, tid long, k int, matched int, lead boolean")
    rest = units.join(hot, "context", "left_semi")
    if not rest.limit(1).count():
        return done
    names = rest.select("unit", "tid", "k")
    return done.unionByName(_rounds(rest.select("unit", "copies", "symbols")).join(names, "unit").select("unit", "tid", "k", "matched", "lead"))


class Judged:
    """The windows of one text: ``sure`` (occur elsewhere), ``open`` (to be checked), and the places of their first and last anchor, or, where
    a window has none, of the first of its smallest hashes."""

    def __init__(self, text: memoryview, hashes: np.ndarray, at: np.ndarray, matched: np.ndarray, width: int, radius: int) -> None:
        n, many, right = len(text), len(at), radius + GRAM
        ends, start = np.append(at[1:], n), np.arange(n - width + 1)
        reach = np.where(matched > 0, at + right, -1)
        more = matched > 1
        reach[more] = np.maximum(reach[more], ends[np.flatnonzero(more) + matched[more] - 2])
        self.before = np.searchsorted(at, start + radius - 1, "right") - 1
        self.sure = reach[self.before] >= start + width
        limit = start + width - right
        p, e = np.minimum(self.before + 1, many - 1), np.searchsorted(at, limit, "right") - 1
        has = (self.before + 1 < many) & (at[p] <= limit)
        self.first, self.last = at[p], at[e]
        loose = np.flatnonzero(~has)
        if len(loose):
            seen = np.lib.stride_tricks.sliding_window_view(hashes[radius:], width - radius - right + 1)
            least = np.concatenate([seen[loose[k : k + 4096]].argmin(1) for k in range(0, len(loose), 4096)])
            self.first[loose] = self.last[loose] = loose + radius + least
            self._periodic(text, hashes, loose, width)
        self.open = ~self.sure & ~(has & (matched[p] < 1 + e - p))

    def _periodic(self, text: memoryview, hashes: np.ndarray, loose: np.ndarray, width: int) -> None:
        """Windows of a periodic stretch occur again a period later; smallest hashes that return tell the periods."""
        place, data = self.first[loose], np.frombuffer(text, np.uint8)
        step = np.diff(place)
        again = (step > 0) & (np.diff(loose) == 1) & (hashes[place[1:]] == hashes[place[:-1]])
        low, high = int(loose[0]), int(loose[-1]) + width
        for period in np.unique(step[again]).tolist():
            stop = min(high, len(data) - period)
            differs = np.append(0, np.cumsum(data[low:stop] != data[low + period : stop + period]))
            same = low + np.flatnonzero(differs[width:] == differs[:-width]) if len(differs) > width else loose[:0]
            self.sure[same] = self.sure[same + period] = True


def _judgements(b: pa.RecordBatch, width: int, radius: int) -> Iterator[tuple[int, memoryview, Judged, np.ndarray]]:
    """(row, text, windows, whether an anchor's suffix leads its block) of texts (tid, text, marks: k, matched, lead)."""
    own = Slice(b.column(1), radius)
    for j, marks in enumerate(b.column(2)):
        lo, n = own.starts[j], int(own.sizes[j])
        at = np.append(0, own.at[own.first[j] : own.first[j + 1]] - lo)
        matched, lead = np.zeros(len(at), np.int64), np.ones(len(at), bool)
        if marks.is_valid:
            k, m, first = (np.asarray(x) for x in marks.values.flatten())
            matched[k], lead[k] = m, first.astype(bool)
        yield j, own.octets[lo : lo + n], Judged(own.octets[lo : lo + n], own.hashes[lo : lo + n - GRAM + 1], at, matched, width, radius), lead


def _pieces(own: Judged, text: memoryview, mask: np.ndarray, width: int) -> Iterator[tuple[int, int, int]]:
    """(low, high, piece): ranges of the windows in ``mask`` that agree in their anchors and in how many STEPs of bytes they hold on either
    side of them, with a hash of those bytes."""
    start = np.arange(len(mask))
    left, right = (own.first - start) // STEP * STEP, (start + width - own.last) // STEP * STEP
    for low, high in _ranges(mask, own.first, own.last, left, right):
        yield low, high, xxhash.xxh3_64_intdigest(text[own.first[low] - left[low] : own.last[low] + right[low]])


def _ranges(mask: np.ndarray, *alike: np.ndarray) -> list[tuple[int, int]]:
    """(low, high) of the runs in ``mask`` along which all of ``alike`` stay as they are."""
    new = np.diff(mask)
    for x in alike:
        new = new | (np.diff(x) != 0)
    cuts = np.flatnonzero(new) + 1
    edges = np.concatenate([[0], cuts, [len(mask)]])
    held = mask[edges[:-1]] if len(mask) else mask
    return list(zip(edges[:-1][held].tolist(), edges[1:][held].tolist(), strict=True))


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def _open_pieces(held: DataFrame, width: int, radius: int) -> DataFrame:
    """Rows of three kinds: pieces of open windows (tid, low, high, copies, piece), cores of open windows (core), and ranges of windows that
    occur elsewhere, one for all copies, with their core (tid, low, high, core)."""
    schema = pa.schema([("tid", pa.int64()), ("low", pa.int32()), ("high", pa.int32()), ("copies", pa.int64()), ("core", pa.int64()), ("piece", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1, SLICE):
            rows, asked = [], set()
            tids, copies = b.column(0).to_pylist(), b.column(3).to_pylist()
            for j, text, own, lead in _judgements(b, width, radius):
                core = lambda i, t=text, o=own: _signed(xxhash.xxh3_64_intdigest(t[o.first[i] - radius : max(o.first[i] + radius + GRAM, o.last[i])]))
                rows += [(tids[j], lo, hi, copies[j], None, _signed(x)) for lo, hi, x in _pieces(own, text, own.open, width)]
                asked.update(core(lo) for lo, _ in _ranges(own.open, own.first, own.last))
                rows += [(tids[j], lo, hi, None, core(lo), None) for lo, hi in _ranges(own.sure & lead[own.before], own.first, own.last)]
                if len(rows) > 50_000:
                    yield _batch(rows, schema)
                    rows = []
            yield _batch(rows + [(None, None, None, None, c, None) for c in asked], schema)

    return held.select("tid", "text", "marks", "copies").mapInArrow(run, "tid long, low int, high int, copies long, core long, piece long")


def _sure_pieces(held: DataFrame, width: int, radius: int) -> DataFrame:
    """(tid, low, high, piece) of the windows in ``ranges`` of the texts."""
    schema = pa.schema([("tid", pa.int64()), ("low", pa.int32()), ("high", pa.int32()), ("piece", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1, SLICE):
            tids, ranges, rows = b.column(0).to_pylist(), b.column(3).to_pylist(), []
            for j, text, own, _ in _judgements(b, width, radius):
                mask = np.zeros(len(own.sure), bool)
                for r in ranges[j]:
                    mask[r["low"] : r["high"]] = True
                rows += [(tids[j], lo, hi, _signed(x)) for lo, hi, x in _pieces(own, text, mask, width)]
            yield _batch(rows, schema)

    return held.select("tid", "text", "marks", "ranges").mapInArrow(run, "tid long, low int, high int, piece long")


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _digests(held: DataFrame, width: int) -> DataFrame:
    """(tid, low, copies, digest) of the windows in ``ranges`` of the texts; those of ranges without copies, which occur elsewhere anyway, only
    as digests, each once a slice."""
    schema = pa.schema([("tid", pa.int64()), ("low", pa.int32()), ("copies", pa.int64()), ("digest", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1, SLICE):
            rows, found = [], set()
            for tid, text, ranges in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                view = memoryview(text.as_buffer())
                for r in ranges:
                    if r["copies"] is None:
                        found.update(xxhash.xxh3_128_digest(view[i : i + width]) for i in range(r["low"], r["high"]))
                    else:
                        rows += [(tid, i, r["copies"], xxhash.xxh3_128_digest(view[i : i + width])) for i in range(r["low"], r["high"])]
                    if len(rows) + len(found) > 100_000:
                        yield _batch(rows + [(None, None, None, d) for d in found], schema)
                        rows, found = [], set()
            yield _batch(rows + [(None, None, None, d) for d in found], schema)

    return held.select("tid", "text", "ranges").mapInArrow(run, "tid long, low int, copies long, digest binary")


def cut(text: bytes | memoryview, repeated: np.ndarray, width: int) -> tuple[int, int, bytes]:
    """(bytes removed, runs removed, what is left) of a text whose windows at ``repeated`` (a flag a position) go."""
    covered = np.zeros(len(text) + 1, np.int64)
    at = np.flatnonzero(repeated)
    np.add.at(covered, at, 1)
    np.add.at(covered, at + width, -1)
    gone = np.cumsum(covered)[:-1] > 0
    spans = int(np.count_nonzero(gone[1:] & ~gone[:-1])) + int(len(gone) > 0 and gone[0])
    return int(gone.sum()), spans, np.frombuffer(text, np.uint8)[~gone].tobytes()


def _removed(held: DataFrame, width: int, radius: int) -> DataFrame:
    """(k1, k2, n_removed, n_spans, kept) of texts with their marks and the open windows that were found (low)."""
    schema = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1, SLICE):
            k1, k2, found, rows = b.column(3).to_pylist(), b.column(4).to_pylist(), b.column(5), []
            for j, text, own, _ in _judgements(b, width, radius):
                if found[j].is_valid:
                    own.sure[np.asarray(found[j].values, np.int64)] = True
                if own.sure.any():
                    rows.append((k1[j], k2[j], *cut(text, own.sure, width)))
            yield _batch(rows, schema)

    return held.select("tid", "text", "marks", "k1", "k2", "found").mapInArrow(run, "k1 long, k2 long, n_removed long, n_spans long, kept binary")


def keyed(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows with their text's bytes and its 128-bit key."""
    octets = F.coalesce(F.col(text), F.lit("")).cast("binary")
    return docs.withColumns({"__octets": octets, "k1": F.xxhash64(octets), "k2": F.xxhash64(F.lit("second"), octets)})


def repeats(docs: DataFrame, text: str = "text", width: int = WIDTH, radius: int = RADIUS) -> DataFrame:
    """(k1, k2, n, n_removed, n_spans, kept) of every distinct text that loses something; n: its rows."""
    texts = keyed(docs.select(text), text).select("k1", "k2", F.col("__octets").alias("text")).filter(F.octet_length("text") >= width)
    lists = materialize(_anchored(texts, width, radius).withColumn("rid", F.monotonically_increasing_id()), "repeat-anchors")
    names = lists.select("rid", "k1", "k2")
    copies = names.groupBy("k1", "k2").agg(F.count("*").alias("copies"))
    wanted = _candidates(lists, width, radius).join(names, "rid").groupBy("k1", "k2").agg(F.first("live").alias("live")).join(copies, ["k1", "k2"])
    rows = met(texts, wanted.withColumn("n", F.col("copies")), ["k1", "k2"])
    held = rows.groupBy("k1", "k2").agg(F.first("text").alias("text"), F.first("live").alias("live"), F.first("copies").alias("copies"))
    held = materialize(held.withColumn("tid", F.monotonically_increasing_id()), "repeat-texts", compression="zstd")
    discard(lists)
    suffixes = materialize(_suffixes(held, width, radius), "repeat-suffixes")
    heads = suffixes.filter("symbols is not null")
    ended = materialize(merged(heads.select("unit", "tid", "k", "copies", "symbols")), "repeat-merged")
    others = suffixes.filter("symbols is null").select("tid", "k", "unit")  # further rows of their shard's intervals
    again = met(others, ended.join(heads.filter("size > 1").select("unit", F.col("size").alias("n")), "unit").select("unit", "matched", "n"), ["unit"])
    every = ended.select("tid", "k", "matched", "lead").unionByName(again.select("tid", "k", "matched", F.lit(False).alias("lead")))
    marks = every.groupBy("tid").agg(F.collect_list(F.struct("k", "matched", "lead")).alias("marks"))
    marked = materialize(held.drop("live").join(marks, "tid", "left"), "repeat-marked", compression="zstd")
    discard(held, suffixes)
    pieces = materialize(_open_pieces(marked, width, radius), "repeat-pieces")
    opened, cores = pieces.filter("piece is not null").select("tid", "low", "high", "copies", "piece"), pieces.filter("tid is null").select("core").distinct()
    ranges = pieces.filter("tid is not null and piece is null").select("tid", "low", "high", "core")
    by_text = lambda df, *columns: df.groupBy("tid").agg(F.collect_list(F.struct(*columns)).alias("ranges"))  # noqa: E731  # bounded by the text
    asked = by_text(met(ranges, ranges.groupBy("core").agg(F.count("*").alias("n")).join(cores, "core"), ["core"]), "low", "high")
    sure = materialize(_sure_pieces(marked.join(asked, "tid"), width, radius), "repeat-sure")
    every = opened.unionByName(sure.withColumn("copies", F.lit(None).cast("long")))
    seen = lambda df, key: df.groupBy(key).agg(F.sum(F.coalesce("copies", F.lit(1).cast("long"))).alias("c"), F.count("copies").alias("opened"), F.count("*").alias("n")).filter("c > 1 and opened > 0").select(key, "n")
    left = by_text(met(every, seen(every, "piece"), ["piece"]), "low", "high", "copies")
    windows = materialize(_digests(marked.select("tid", "text").join(left, "tid"), width), "repeat-windows")
    opened, twice = windows.filter("copies is not null"), seen(windows, "digest")
    found = met(opened.select("tid", "low", "digest"), twice, ["digest"]).groupBy("tid").agg(F.collect_list("low").alias("found"))
    out = materialize(_removed(marked.join(found, "tid", "left"), width, radius).join(marked.select("k1", "k2", F.col("copies").alias("n")), ["k1", "k2"]), "repeat-removed")
    discard(marked, pieces, sure, windows)
    return out


def without_repeats(docs: DataFrame, text: str = "text", width: int = WIDTH, radius: int = RADIUS) -> DataFrame:
    """The rows with n_bytes, n_removed, n_spans and kept (the bytes that are left, null where nothing goes)."""
    lost = repeats(docs, text, width, radius)
    rows = keyed(docs, text)
    found = met(rows, lost, ["k1", "k2"], how="left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return found.select(*(c for c in docs.columns), F.octet_length("__octets").cast("long").alias("n_bytes"), zero("n_removed"), zero("n_spans"), "kept")


def digest(docs: DataFrame) -> DataFrame:
    """The columns of query op11."""
    lost = repeats(docs.select("text"))
    lost = lost.select("k1", "k2", "n", "n_removed", "n_spans", F.sha2("kept", 256).alias("sha"))
    rows = keyed(docs.select("doc_id", "text")).select("doc_id", "k1", "k2", F.octet_length("__octets").cast("long").alias("n_bytes"), F.sha2("__octets", 256).alias("whole"))
    found = met(rows, lost, ["k1", "k2"], how="left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return found.select("doc_id", "n_bytes", zero("n_removed"), zero("n_spans"), F.coalesce("sha", "whole").alias("kept_sha256"))


SQL = f"""with d as materialized (select doc_id, encode(coalesce(text, '')) as x, row_number() over () as r from documents),
s as (select r, i, md5(x[i + 1 : i + {WIDTH}]) as w from (select r, x, unnest(range(greatest(octet_length(x) - {WIDTH} + 1, 0))) as i from d)),
t as (select r, i from s where w in (select w from s group by 1 having count(*) > 1)),
b as (select r, i, case when i > lag(i) over (partition by r order by i) + {WIDTH} then 1 else 0 end as fresh from t),
g as (select r, i, sum(fresh) over (partition by r order by i) as run from b),
p as (select r, run, min(i) as lo, max(i) + {WIDTH} as hi from g group by 1, 2),
q as (select r, lo, hi, coalesce(lag(hi) over (partition by r order by lo), 0) as since from p),
k as (select q.r, sum(hi - lo)::bigint as n_removed, count(*)::bigint as n_spans, string_agg(hex(x[since + 1 : lo]), '' order by lo) as front, max(hi) as last from q join d using (r) group by 1)
select doc_id, octet_length(x) as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans, case when front is null then sha256(x) else sha256(unhex(front || hex(x[last + 1 :]))) end as kept_sha256 from d left join k using (r)"""
