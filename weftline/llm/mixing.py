"""Mixing sources to target weights by fitting document lengths to each source's budget.

A source whose target is ``r`` times its size and a rest gets every document ``r`` times; the rest is a subset-sum over its lengths, of
which only the counts matter. Most of it is filled in proportion (the same share of every length), what remains by bounded-knapsack
dynamic programming over sums up to REACH words. Then each length's count is met by the documents with the lowest seeded hashes.

Sizes are words; null text has none. Sources rank by code point, null last, and weigh 5, 2, 1 in turn; no document is taken more than
MOST times. Repeated rows count each; rows alike in id and text have equal hashes and the quota among them is met by counting, in the order
of all their columns. Texts of any length take memory for REACH sums only.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, numbered, small, sortable, words

WEIGHTS, MOST, SEED, REACH = (5.0, 2.0, 1.0), 3, 97, 1 << 17
#: Ranges of hashes are halved six times a step: by how many bits a hash is shifted to give its range.
RANGES = (58, 52, 46)
_FIT = "source string, size long, base int, extra long"


def subset_sum(sizes: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many of each size (at most its count) to take so that the sum comes nearest to ``budget``, of two as near the lower."""
    positive = sizes[(sizes > 0) & (counts > 0)]
    if budget <= 0 or not len(positive):
        return np.zeros(len(sizes), np.int64)
    top = budget + min(budget, int(positive.max()))  # without any of its items a nearest sum above lies below, and zero is a sum too
    take = np.zeros(len(sizes), np.int64)
    first = np.full(top + 1, -1, np.int64)
    items: list[tuple[int, int]] = []
    reach = np.zeros(top + 1, bool)
    reach[0] = True
    for k in np.argsort(sizes, kind="stable"):  # small sizes first: they close any gap
        left, part = min(int(counts[k]), top // int(sizes[k]) if sizes[k] > 0 else 0), 1
        while left > 0 and not reach[budget]:
            n = min(part, left)
            w = n * int(sizes[k])
            left, part = left - n, 2 * part
            new = np.flatnonzero(reach[: top + 1 - w] & ~reach[w:]) + w
            first[new] = len(items)
            reach[new] = True
            items.append((int(k), n))
        if reach[budget]:
            break
    sums = np.flatnonzero(reach)
    at = int(sums[np.argmin(np.abs(sums - budget))])
    while at:
        k, n = items[first[at]]
        take[k] += n
        at -= n * int(sizes[k])
    return take


def fit_source(sizes: np.ndarray, counts: np.ndarray, target: float) -> tuple[int, np.ndarray]:
    """(times every document is taken, how many of each size are taken once more)."""
    total = int((sizes * counts).sum())
    if not total:
        return 0, np.zeros(len(sizes), np.int64)
    base = min(MOST, int(target // total))
    budget = 0 if base == MOST else min(total, round(target - base * total))
    extra = np.minimum(counts, (counts * (max(0, budget - REACH // 2) / total)).astype(np.int64))
    rest = budget - int((sizes * extra).sum())
    for k in np.argsort(-sizes, kind="stable"):  # what rounding down left beyond the reach of the table: longest first
        if rest > REACH and sizes[k]:
            more = int(min(counts[k] - extra[k], (rest - REACH // 2) // sizes[k]))
            if more > 0:
                extra[k] += more
                rest -= more * int(sizes[k])
    if rest > REACH:  # only documents nearly as long as the rest, or longer, are left: one of them at most comes nearer
        left = np.flatnonzero((counts > extra) & (sizes > 0))
        k = left[np.argmin(np.abs(sizes[left] - rest))] if len(left) else None
        if k is not None and abs(int(sizes[k]) - rest) < rest:
            extra[k] += 1
            rest -= int(sizes[k])
    return base, extra + (subset_sum(sizes, counts - extra, rest) if rest <= REACH else 0)


def targets(sources: DataFrame) -> DataFrame:
    """From (source, source_size): adds target. One row a source; the level at which capped sources stop is found with running sums."""
    n = len(WEIGHTS)
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = sources.withColumn("w", F.element_at(F.array(*(F.lit(x) for x in WEIGHTS)), (rank % n + 1).cast("int")))
    cap, by = F.col("source_size") * MOST, Window.orderBy(F.col("source_size") * MOST / F.col("w"), F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    w = w.withColumns({"before": F.coalesce(F.sum(cap).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "rest": F.sum("w").over(by.rowsBetween(0, Window.unboundedFollowing)), "total": F.sum("source_size").over(whole), "nth": F.row_number().over(by)})
    w = w.withColumn("level", (F.col("total") - F.col("before")) / F.col("rest"))
    w = w.withColumn("level", F.min_by("level", F.when(F.col("level") * F.col("w") <= cap, F.col("nth"))).over(whole))
    return w.select("source", "source_size", F.least(F.coalesce(F.col("level"), F.lit(0.0)) * F.col("w"), cap.cast("double")).alias("target"))


def _order(doc_id: str, text: str):  # noqa: ANN202
    return F.xxhash64(F.lit(SEED), F.col(doc_id), F.col(text))


def plan(narrow: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From one row a document (source, size, h): the sources' targets, and per (source, size) the times all are taken (base), the hash
    up to which they are taken once more (upto) and, if rows with just that hash are too many, how many of them (ties)."""
    lengths = materialize(narrow.groupBy("source", "size").agg(F.count("*").alias("n")), "mix-lengths")
    goal = materialize(targets(lengths.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))), "mix-targets")

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        base, extra = fit_source(frame["size"].to_numpy(np.int64), frame["n"].to_numpy(np.int64), float(frame["target"].iloc[0]))
        return pd.DataFrame({"source": frame["source"], "size": frame["size"], "base": base, "extra": extra})

    same = F.col("a.source").eqNullSafe(F.col("b.source"))
    fitted = lengths.alias("a").join(small(goal).alias("b"), same).select("a.source", "a.size", "a.n", "b.target").groupBy("source").applyInPandas(lambda f: fit(f.sort_values("size")), _FIT)
    fitted = materialize(fitted, "mix-fit")
    # The extra-th lowest hash of each (source, size): by counts over ranges of hashes, 64 at a time, so that a large group is neither
    # sorted nor summed up in one task.
    sized = same & (F.col("a.size") == F.col("b.size"))
    edge = fitted.filter("extra > 0").select("source", "size", "extra", F.lit(0).cast("long").alias("before"), F.lit(None).cast("long").alias("range"))
    hashes = narrow.alias("a").join(small(edge).alias("b"), sized, "left_semi").groupBy("source", "size", "h").agg(F.count("*").alias("m"))
    hashes = materialize(hashes, "mix-hashes")
    range_of = lambda shift: F.shiftrightunsigned(F.col("a.h"), shift)
    for shift in RANGES:
        inside = F.col("b.range").isNull() | (range_of(shift + 6) == F.col("b.range")) if shift + 6 < 64 else F.lit(True)
        met = hashes.alias("a").join(small(edge).alias("b"), sized & inside).groupBy("a.source", "a.size", "b.extra", "b.before", range_of(shift).alias("range")).agg(F.sum("a.m").alias("m"))
        upto = F.col("before") + F.sum("m").over(Window.partitionBy("source", "size").orderBy("range"))
        edge = materialize(met.withColumn("upto", upto).filter("upto - m < extra and extra <= upto").select("source", "size", "extra", (F.col("upto") - F.col("m")).alias("before"), "range"), "mix-edge")
    inside = hashes.alias("a").join(small(edge).alias("b"), sized & (range_of(RANGES[-1]) == F.col("b.range"))).select("a.source", "a.size", "a.h", "a.m", "b.extra", "b.before")
    low = Window.partitionBy("source", "size").orderBy("h")
    inside = inside.withColumn("upto_n", F.col("before") + F.sum("m").over(low)).filter("upto_n - m < extra and extra <= upto_n")
    cut = inside.select("source", "size", F.col("h").alias("upto"), F.when(F.col("extra") < F.col("upto_n"), F.col("extra") - F.col("upto_n") + F.col("m")).alias("ties"))
    done = fitted.alias("a").join(cut.alias("b"), same & (F.col("a.size") == F.col("b.size")), "left").select("a.source", "a.size", "a.base", "b.upto", "b.ties")
    return goal, materialize(done, "mix-plan")


def mixed(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """All rows and columns, plus __size, __source_size, __target and __copies (how often the mix takes the row)."""
    own = docs.withColumns({"__size": F.size(words(F.col(text))).cast("long"), "__h": _order(doc_id, text)})
    narrow = materialize(own.select(F.col(source).alias("source"), F.col("__size").alias("size"), F.col("__h").alias("h")), "mix-rows")
    return with_copies(own, *plan(narrow), source=source).drop("__h")


def with_copies(own: DataFrame, goal: DataFrame, cuts: DataFrame, source: str) -> DataFrame:
    goal = goal.select(F.col("source").alias("__gs"), F.col("source_size").alias("__source_size"), F.col("target").alias("__target"))
    cut = cuts.select(F.col("source").alias("__cs"), F.col("size").alias("__cz"), "base", "upto", "ties").withColumnsRenamed({c: f"__{c}" for c in ("base", "upto", "ties")})
    s = F.col(f"`{source}`")
    out = own.join(small(goal), s.eqNullSafe(F.col("__gs")), "left").join(small(cut), s.eqNullSafe(F.col("__cs")) & (F.col("__size") == F.col("__cz")), "left").drop("__gs", "__cs", "__cz")
    # Unsigned order of hashes: the parts of plan() are the top bits, so compare with the sign bit turned.
    lower = F.coalesce(F.col("__h").bitwiseXOR(F.lit(-(1 << 63))) <= F.col("__upto").bitwiseXOR(F.lit(-(1 << 63))), F.lit(False))
    base = F.coalesce(F.col("__base"), F.lit(0))
    tied = F.coalesce((F.col("__h") == F.col("__upto")) & F.col("__ties").isNotNull(), F.lit(False))
    sure = lambda df: df.withColumn("__copies", base + lower.cast("int")).drop("__base", "__upto", "__ties")
    if not cuts.filter(F.col("ties").isNotNull()).limit(1).count():
        return sure(out)
    # Only rows alike in id and text whose quota cuts through them: they are counted through in the order of all their columns.
    some = numbered(out.filter(tied).withColumn("__group", F.xxhash64("__h", "__size", s)), ["__group"], sortable(own))
    some = some.withColumn("__copies", base + (F.col("__row") < F.col("__ties")).cast("int")).drop("__row", "__group")
    return sure(out.filter(~tied)).unionByName(some.drop("__base", "__upto", "__ties"))


def take(docs: DataFrame) -> DataFrame:
    """The mix itself: each row as often as it is taken, columns as in ``docs``."""
    out = mixed(docs).filter("__copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies"))))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns))


def digest(docs: DataFrame) -> DataFrame:
    """The columns of query op8; text is read once."""
    own = docs.select("doc_id", "source", F.size(words(F.col("text"))).cast("long").alias("__size"), _order("doc_id", "text").alias("__h"))
    own = materialize(own, "mix-rows")
    goal, cuts = plan(own.select("source", F.col("__size").alias("size"), F.col("__h").alias("h")))
    out = with_copies(own, goal, cuts, "source")
    return out.select("doc_id", F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), (F.col("__size") * F.col("__copies")).alias("taken"))
