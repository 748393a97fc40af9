"""Quality rules with risk-controlled thresholds (DataFrame functions only).

Every document gets rule features and from them a *level*: the first step of a fixed path of cutoffs, lenient to strict, at which a rule
rejects it. Labelled documents (a holdout: nothing is fitted to them but the choice of the step) tell for each stratum how many good ones
each step would reject. A step is certified if the exact binomial test refutes "it rejects more than ``alpha`` of the stratum's good
documents" at ``delta / strata`` (Bonferroni over strata; inside a stratum the steps are tested in their fixed order until the first that
fails, which needs no further correction). The strictest certified step is the stratum's cutoff: with probability 1 - ``delta`` no stratum
loses more than ``alpha`` of its good documents. A stratum with too few labels gets no cutoff and loses none.

Defined results: null text is the empty text; null and unknown strata are strata of their own; null doc_id rows are judged but never
labelled; repeated labels of a document count once, as good if one of them is; null labels don't count; repeated rows are judged each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, small, words

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: Share of a stratum's good documents that may be rejected, and the chance that this fails in any stratum.
ALPHA, DELTA = 0.03, 0.05
#: Cutoffs of each rule from the most lenient step to the strictest; a rule rejects what exceeds its cutoff.
PATH = {
    "symbol_ratio": [2.0, 1.5, 1.0, 0.7, 0.5, 0.3, 0.2, 0.1],
    "bang_ratio": [4.0, 3.0, 2.0, 1.5, 1.0, 0.7, 0.5, 0.4],
    "dup_line_ratio": [0.9, 0.8, 0.75, 0.7, 0.65, 0.6, 0.55, 0.5],
    "repeat_ratio": [0.3, 0.28, 0.26, 0.24, 0.22, 0.2, 0.18, 0.15],
}
STEPS = 8
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def let(value: Column, body) -> Column:  # noqa: ANN001
    """``body`` of a value that is computed once, in one expression."""
    return F.transform(F.array(value), body)[0]


def features(text: Column) -> Column:
    """A struct of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines and n_bangs (long).

    Windows are compared by 64-bit hashes. A repeated 8-word window makes five 4-word windows repeat, so a text with fewer of those, the
    common case, stops at a hash set; the others sort (hash, position) pairs. Work is O(n log n) in the length of the text, in its row.
    """
    t = F.coalesce(text, F.lit(""))
    head = lambda a, n: F.slice(a, F.lit(1), F.greatest(n, F.lit(0)))
    four = lambda h: head(F.transform(h, lambda x, i: F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2), F.get(h, i + 3))), F.size(h) - 3)
    eight = lambda q: F.sort_array(F.transform(head(q, F.size(q) - 4), lambda x, i: F.struct(F.xxhash64(x, F.get(q, i + 4)).alias("h"), i.alias("i"))))

    def twice(s: Column) -> Column:
        same = lambda x, i: x["h"] == F.get(s, i)["h"]
        return F.filter(F.transform(s, lambda x, i: F.when(same(x, i - 1) | same(x, i + 1), x["i"])), lambda i: i.isNotNull())

    def covered(s: Column) -> Column:
        start = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
        add = lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n"), i.alias("last"))
        return F.aggregate(F.sort_array(twice(s)), start, add, lambda a: a["n"])

    repeated = lambda q: F.when(F.size(q) - F.size(F.array_distinct(q)) >= WINDOW - 3, let(eight(q), covered)).otherwise(F.lit(0))
    own_lines = F.filter(F.split(t, "\n"), lambda s: F.btrim(s, F.lit(" \t\n\x0b\f\r")) != "")
    long = lambda name, c: c.cast("long").alias(name)
    return let(
        F.struct(words(text).alias("w"), own_lines.alias("l")),
        lambda x: F.struct(
            long("n_words", F.size(x["w"])),
            long("word_chars", F.length(F.array_join(x["w"], ""))),
            long("n_symbols", F.size(F.split(t, r"[#*$%&|<>]", -1)) - 1),
            long("n_dup_lines", F.size(x["l"]) - F.size(F.array_distinct(x["l"]))),
            long("n_repeat_words", let(F.transform(x["w"], lambda w: F.xxhash64(w)), lambda h: let(four(h), repeated))),
            long("n_lines", F.size(x["l"])),
            long("n_bangs", F.size(F.split(t, "!", -1)) - 1),
        ),
    )


def with_features(df: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """Adds the features as columns under ``prefix``."""
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_bangs")
    return df.withColumn("__q_features", features(F.col(text))).withColumns({prefix + k: F.col("__q_features")[k] for k in names}).drop("__q_features")


def base_failed(prefix: str = "") -> Column:
    n = F.col(prefix + "n_words")
    return (n < MIN_WORDS) | (100 * F.col(prefix + "n_repeat_words") > MAX_REPEAT_PERCENT * n)


def level(prefix: str = "") -> Column:
    """The first step of the path that rejects (1 to STEPS), or STEPS + 1."""
    c = lambda k: F.col(prefix + k)
    per_word = lambda k: c(k) / F.greatest(c("n_words"), F.lit(1))
    value = {"symbol_ratio": per_word("n_symbols"), "bang_ratio": per_word("n_bangs"), "dup_line_ratio": c("n_dup_lines") / F.greatest(c("n_lines"), F.lit(1)), "repeat_ratio": per_word("n_repeat_words")}
    out = F
    for j in range(STEPS):
        out = out.when(F.greatest(*((value[r] > PATH[r][j]).cast("int") for r in PATH)) == 1, F.lit(j + 1))
    return out.otherwise(F.lit(STEPS + 1))


def binomial_cdf(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X of Bin(n, p), summed in logarithms over 0..k."""
    step = lambda a, j: F.struct((a["t"] + F.log(n - j + 1) - F.log(j)).alias("t"), (a["s"] + F.exp(a["t"] + F.log(n - j + 1) - F.log(j) + j * F.log(F.lit(p / (1 - p))) + n * F.log(F.lit(1 - p)))).alias("s"))
    start = F.struct(F.lit(0.0).alias("t"), F.exp(n * F.log(F.lit(1 - p))).alias("s"))
    upto = F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(upto, start, step, lambda a: a["s"])


def calibrate(labelled: DataFrame, stratum: str, good: str, level_col: str, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """From labelled rows (stratum, good boolean, level): one row a stratum with its number of good rows and certified step (0: none).

    Only counts by (stratum, level) are kept, so size follows the number of strata. Rows whose ``good`` or level is null don't count.
    """
    goods = labelled.groupBy(F.col(stratum).alias("stratum"), F.col(level_col).alias("level")).agg(F.count_if(F.col(good)).alias("n"))
    goods = goods.filter((F.col("n") > 0) & F.col("level").isNotNull())
    at = F.explode(F.sequence(F.lit(1), F.lit(STEPS))).alias("j")
    by = goods.select("stratum", "level", "n", at).groupBy("stratum", "j").agg(F.sum("n").alias("n_good"), F.sum(F.when(F.col("level") <= F.col("j"), F.col("n")).otherwise(0)).cast("long").alias("k"))
    strata = goods.agg(F.count_distinct(F.struct("stratum")).alias("n_strata"))
    by = by.crossJoin(F.broadcast(strata))  # one row
    k, n = F.col("k"), F.col("n_good")
    fits = (k <= alpha * n) & (binomial_cdf(F.least(k, F.floor(alpha * n)), n, alpha) <= F.lit(delta) / F.col("n_strata"))
    failed = by.select("stratum", "n_good", F.when(~fits, F.col("j")).alias("failed"))
    return failed.groupBy("stratum").agg(F.max("n_good").alias("n"), (F.coalesce(F.min("failed"), F.lit(STEPS + 1)) - 1).alias("step")).withColumnRenamed("n", "n_good")


def judged(features: DataFrame, labels: DataFrame, doc_id: str = "doc_id", stratum: str = "lang", prefix: str = "", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """Cutoffs from the labelled rows of ``features`` (with_features has been applied)."""
    good = labels.filter(F.col("quality").isNotNull()).groupBy(F.col("doc_id").alias("__q_id")).agg((F.max("quality") == 1).alias("__q_good"))
    own = features.select(F.col(doc_id).alias("__q_id"), F.col(stratum).alias("__q_stratum"), F.when(~base_failed(prefix), level(prefix)).alias("__q_level"))
    return calibrate(own.join(good, "__q_id"), "__q_stratum", "__q_good", "__q_level", alpha, delta)


def with_verdict(features: DataFrame, cutoffs: DataFrame, stratum: str = "lang", prefix: str = "") -> DataFrame:
    """Adds base_failed and kept (and n_good and step, the stratum's evidence), under ``prefix``."""
    cut = small(cutoffs.select(F.col("stratum").alias("__q_stratum"), F.col("n_good").alias(prefix + "n_good"), F.col("step").alias(prefix + "step")))
    out = features.join(cut, F.col(stratum).eqNullSafe(F.col("__q_stratum")), "left").drop("__q_stratum")
    failed, step = base_failed(prefix), F.coalesce(F.col(prefix + "step"), F.lit(0))
    here = F.monotonically_increasing_id() >= 0  # always true; keeps filters on the verdict from being copied, with all features, below this step
    return out.withColumns({prefix + "base_failed": failed, prefix + "kept": ~failed & (level(prefix) > step) & here, prefix + "n_good": F.coalesce(F.col(prefix + "n_good"), F.lit(0).cast("long")), prefix + "step": step})


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with their columns as they are.

    Features are computed for the labelled rows to calibrate, then row by row for all: text never moves.
    """
    columns, p = docs.columns, "__q_f_"
    ids = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("__q_lab")).distinct()
    some = docs.select("doc_id", "lang", "text").join(small(ids), F.col("doc_id") == F.col("__q_lab"), "left_semi")
    some = materialize(with_features(some, prefix=p).drop("text"), "quality-labelled")
    cutoffs = materialize(judged(some, labels, prefix=p), "quality-cutoffs")
    return with_verdict(with_features(docs, prefix=p), cutoffs, prefix=p).filter(F.col(p + "kept")).select(*(F.col(f"`{c}`") for c in columns))


def sql(alpha: float = ALPHA, delta: float = DELTA) -> str:
    """The query op2 as DuckDB SQL."""
    space, word = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"
    fires = lambda j: " or ".join(f"{r} > {PATH[r][j]}" for r in PATH)
    cases = " ".join(f"when {fires(j)} then {j + 1}" for j in range(STEPS))
    counts = ", ".join(f"count(*) filter (level <= {j}) as k{j}" for j in range(1, STEPS + 1))
    cdf = lambda j: f"(select coalesce(sum(exp(lgamma(n_good + 1) - lgamma(i + 1) - lgamma(n_good - i + 1) + i * ln({alpha}) + (n_good - i) * ln({1 - alpha}))), 0) from range(0, k{j} + 1) r(i))"
    steps = "0"
    for j in reversed(range(1, STEPS + 1)):
        steps = f"case when k{j} <= {alpha} * n_good and {cdf(j)} <= {delta} / n_strata then greatest({j}, {steps}) else 0 end"
    return rf"""
with docs as (select row_number() over () as r, doc_id, lang, coalesce(text, '') as t from documents),
w as materialized (select r, unnest(ws) as w, generate_subscripts(ws, 1) as i from (select r, regexp_extract_all(t, '{word}+') as ws from docs)),
g as (select r, i, w, w || ' ' || lead(w, 1) over o || ' ' || lead(w, 2) over o || ' ' || lead(w, 3) over o || ' ' || lead(w, 4) over o || ' ' || lead(w, 5) over o || ' ' || lead(w, 6) over o || ' ' || lead(w, 7) over o as gram from w window o as (partition by r order by i)),
d as (select r, i, w, gram is not null and count(*) over (partition by r, gram) > 1 as twice from g),
c as (select r, w, bool_or(twice) over (partition by r order by i rows between 7 preceding and current row) as covered from d),
words as (select r, count(*) as n_words, sum(length(w))::bigint as word_chars, count(*) filter (covered) as n_repeat_words from c group by r),
l as (select r, count(*) as n_lines, count(distinct line) as n_distinct from (select r, unnest(string_split(t, chr(10))) as line from docs) where regexp_matches(line, '{word}') group by r),
f as (select doc_id, lang, coalesce(n_words, 0) as n_words, coalesce(word_chars, 0) as word_chars, length(t) - length(translate(t, '#*$%&|<>', '')) as n_symbols,
  coalesce(n_lines - n_distinct, 0) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words, coalesce(n_lines, 0) as n_lines, length(t) - length(translate(t, '!', '')) as n_bangs
  from docs left join words using (r) left join l using (r)),
x as (select *, n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words as base_failed, n_symbols / greatest(n_words, 1) as symbol_ratio, n_bangs / greatest(n_words, 1) as bang_ratio,
  n_dup_lines / greatest(n_lines, 1) as dup_line_ratio, n_repeat_words / greatest(n_words, 1) as repeat_ratio from f),
y as (select *, case {cases} else {STEPS + 1} end as level from x),
good as (select doc_id from labels where quality is not null group by doc_id having max(quality) = 1),
k as (select lang, count(*) as n_good, {counts} from y join good using (doc_id) where not base_failed group by lang),
cut as (select lang, n_good, {steps} as step from (select *, greatest(count(*) over (), 1) as n_strata from k))
select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols, n_dup_lines::bigint as n_dup_lines, n_repeat_words::bigint as n_repeat_words, base_failed,
  not base_failed and level > coalesce(step, 0) as kept, y.lang as stratum, coalesce(n_good, 0)::bigint as n_good, coalesce(step, 0)::int as step
from y left join cut on y.lang is not distinct from cut.lang"""
