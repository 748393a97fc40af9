"""Spelling variants by symmetric deletes.

Every word emits itself and each of its distinct single deletions; two words at distance one always share exactly one of these keys, so one
equi-join finds all such pairs, and the exact distance is verified on the words. A key is shared by at most its length times the alphabet
words, so no key holds an unbounded group. A word's form is its most frequent near word if that is RATIO times as frequent; roots follow
forms by joins that double the way each round (frequencies grow tenfold a step, so a few rounds end it).

Keys are 64-bit hashes, so that a long word's keys don't grow with the square of its length; words over INLINE letters are joined to their
pairs only for the verification. Defined results: null texts have no words; a null id counts as an empty one where runs are altered;
repeated rows count each; ties of frequency go to the smallest word in code-point order; an empty table gives no words.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, small

LETTERS, MODULUS, MIN_LETTERS, MIN_COUNT, RATIO, INLINE = r"[a-zÀ-ÿ]+", 31, 7, 2, 10, 64


def altered(doc_id: Column, run: Column, modulus: int = MODULUS) -> Column:
    """The run, without one letter where the hash of document and run says so."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run))
    at = (h % F.length(run)).cast("int")
    return F.when(h % modulus == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def vocabulary(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n) of the words of all whole texts; counts are taken before words move."""
    low = F.translate(F.coalesce(F.col(text), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    runs = docs.select(F.col(doc_id).alias("d"), F.explode(F.regexp_extract_all(low, F.lit(LETTERS), F.lit(0))).alias("run")).filter(F.length("run") >= min_letters)
    found = runs.select(altered(F.col("d"), F.col("run")).alias("word")).filter(F.length("word") >= min_letters)
    return found.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= min_count)


def _keys(words: DataFrame) -> DataFrame:
    """(key, id, n, short): the word itself and its distinct single deletions; the word only up to INLINE letters."""
    size = F.length("word")
    without = F.transform(F.sequence(F.lit(1), size), lambda k: F.xxhash64(F.concat(F.substring("word", F.lit(1), k - 1), F.substring("word", k + 1, size))))
    keys = F.array_union(F.array(F.xxhash64("word")), without)
    return words.select("id", "n", F.when(size <= INLINE, F.col("word")).alias("short"), F.explode(keys).alias("key"))


def near(words: DataFrame) -> DataFrame:
    """(id, n, word) of both words, as a and b, of every unordered pair at distance one; words are (id, word, n)."""
    side = lambda x: _keys(words).select("key", F.struct("id", "n", F.col("short").alias("word")).alias(x))
    pairs = side("a").join(side("b"), "key").filter("a.id < b.id").drop("key")
    short = F.col("a.word").isNotNull() & F.col("b.word").isNotNull()
    long = words.filter(F.length("word") >= INLINE)
    whole = lambda x: F.struct(F.col(f"{x}.id").alias("id"), F.col(f"{x}.n").alias("n"), F.col(f"{x}_word").alias("word")).alias(x)
    texts = lambda x: small(long.select(F.col("id").alias(f"{x}_id"), F.col("word").alias(f"{x}_word")))
    rest = pairs.filter(~short).join(texts("a"), F.col("a.id") == F.col("a_id")).join(texts("b"), F.col("b.id") == F.col("b_id")).select(whole("a"), whole("b"))
    return pairs.filter(short).unionByName(rest).filter(F.levenshtein("a.word", "b.word", 1) == 1)


def with_roots(links: DataFrame) -> DataFrame:
    """(id, root, root_word) from links (id, root, root_word) to forms: each round every row takes the root of its root."""
    now = materialize(links, "spelling-roots")
    while True:
        on = now.select(F.col("id").alias("at"), F.col("root").alias("further"), F.col("root_word").alias("further_word"))
        new = now.join(small(on), F.col("root") == F.col("at"), "left")
        new = materialize(new.select("id", F.coalesce("further", "root").alias("root"), F.coalesce("further_word", "root_word").alias("root_word"), F.col("at").isNotNull().alias("moved")), "spelling-roots")
        now = new.drop("moved")
        if not new.filter("moved").limit(1).count():
            return now


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, n, n_near, form, form_n and root of every word, from (word, n) with distinct words."""
    words = materialize(words.select(F.monotonically_increasing_id().alias("id"), "word", "n"), "spelling-words")
    ways = F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y")))).alias("way")
    each = near(words).select(ways).select("way.x.id", "way.x.n", F.struct((-F.col("way.y.n")).alias("less"), F.col("way.y.word").alias("word"), F.col("way.y.id").alias("id")).alias("other"))
    found = each.groupBy("id").agg(F.count("*").alias("n_near"), F.min("other").alias("best"), F.first("n").alias("own"))
    found = materialize(found.select("id", "n_near", F.when(-F.col("best.less") >= ratio * F.col("own"), F.col("best")).alias("best")), "spelling-near")
    links = found.filter("best is not null").select("id", F.col("best.id").alias("root"), F.col("best.word").alias("root_word"))
    out = words.join(found, "id", "left").join(with_roots(links), "id", "left")
    return out.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.col("best.word").alias("form"), (-F.col("best.less")).alias("form_n"), F.coalesce("root_word", "word").alias("root"))


def _table() -> str:
    """The 256 entries of the CRC-32 polynomial, by eight steps over all numbers."""
    out = "range(256)"
    for _ in range(8):
        out = f"list_transform({out}, lambda i: case when i & 1 = 1 then xor(i >> 1, 3988292384) else i >> 1 end)"
    return out


def crc32_sql(value: str) -> str:
    """DuckDB expression of the unsigned CRC-32 of a string's UTF-8; the query has a table ``crc(t)``."""
    octets = f"list_transform(range(strlen({value})), lambda i: ('0x' || substr(hex(encode({value})), 2 * i + 1, 2))::bigint)"
    return f"xor(list_reduce(list_concat([4294967295::bigint], {octets}), lambda c, o: xor(c >> 8, t[(xor(c, o) & 255) + 1])), 4294967295)"


CRC = f"crc as materialized (select {_table()} as t)"
SQL = f"""with recursive {CRC},
r as (select distinct coalesce(doc_id::varchar, '') as d, run, n from (select doc_id, run, count(*) over (partition by doc_id, run) as n from (select doc_id, unnest(regexp_extract_all(translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[a-zÀ-ÿ]+')) as run from documents) where length(run) >= {MIN_LETTERS})),
k as (select d || ':' || run as v, run, n from r), h as (select run, n, {crc32_sql('v')} as h from k, crc),
a as (select case when h % {MODULUS} = 0 then left(run, h % length(run)) || substr(run, h % length(run) + 2) else run end as word, n from h),
w as materialized (select word, sum(n)::bigint as n from a where length(word) >= {MIN_LETTERS} group by 1 having sum(n) >= {MIN_COUNT}),
p as materialized (select word, n, i, left(word, i) || substr(word, i + 2) as cut from (select word, n, unnest(range(length(word))) as i from w)),
near as (select distinct * from (select a.word, a.n, b.word as other, b.n as m from p a join p b on a.i = b.i and a.cut = b.cut and a.word <> b.word
  union all select p.word, p.n, w.word, w.n from p join w on p.cut = w.word union all select w.word, w.n, p.word, p.n from p join w on p.cut = w.word)),
f as (select word, count(*) as n_near, min(struct_pack(less := -m, word := other)) as best, any_value(n) as n from near group by 1),
g as (select word, n_near, case when -best.less >= {RATIO} * n then best.word end as form, case when -best.less >= {RATIO} * n then -best.less end as form_n from f),
way(word, root) as (select word, form from g where form is not null union all select way.word, g.form from way join g on g.word = way.root where g.form is not null),
ends as (select word, root from way where root not in (select word from g where form is not null))
select w.word, w.n, coalesce(n_near, 0)::bigint as n_near, form, form_n, coalesce(root, w.word) as root from w left join g using (word) left join ends using (word)"""
