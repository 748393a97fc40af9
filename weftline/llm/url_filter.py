"""URL filter: domain and path rules first, then a list of canonical URLs behind a blocked Bloom filter (DataFrame functions only).

Each canonical URL sets eight bits, two in each of the four 64-bit words of one block. The filter has at most MAX_BLOCKS blocks (2 MB), so
broadcasting it is safe at any list size; a longer list only lets more URLs pass to the exact hash join, which decides. URLs that miss the
filter never move. Defined results: a null URL or one without ``://`` has empty host and path, fits no rule and is never listed; repeated
rows are judged each; an empty list or table is fine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, host, path): fits the host and its subdomains where the path starts so; the longest wins.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Query parameters that don't tell pages apart, and host labels that a canonical URL leaves out.
TRACKING = "utm_[^=]*|ref|gclid|fbclid"
MIRRORS = "www|m"
#: Host labels of the listed sites.
LISTED_LABELS = ("casino-win", "free-bets", "ads-track", "spam-farm", "cheap-pills", "adult-x")
MAX_BLOCKS, KEYS_PER_BLOCK = 1 << 16, 16
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)(\?[^#]*)?"


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without mirror labels and default ports, path without a slash at its end, other parameters sorted; null without a host."""
    query = F.array_sort(F.filter(F.split(F.substr(F.coalesce(F.regexp_extract(url, _PARTS, 3), F.lit("")), F.lit(2)), "&"), lambda p: (p != "") & ~p.rlike(f"^({TRACKING})(=|$)")))
    bare = F.regexp_replace(F.regexp_replace(host(url), f"^({MIRRORS})\\.", ""), ":(80|443)$", "")
    return F.when(host(url) != "", F.concat(bare, F.regexp_replace(path(url), "/+$", ""), F.when(F.size(query) > 0, F.concat(F.lit("?"), F.array_join(query, "&"))).otherwise("")))


def listed_label(url: Column, labels: tuple[str, ...] = LISTED_LABELS) -> Column:
    return F.arrays_overlap(F.split(host(url), r"\."), F.array(*(F.lit(x) for x in labels)))


def rule(host_col: Column, path_col: Column, rules: tuple = RULES) -> Column:
    """The longest rule that fits as a struct (name, verdict), or null. Rules are a short list: they become one expression."""
    out = F.lit(None)
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host_col == h) | host_col.endswith("." + h)) & path_col.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("name"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def _bits(key: Column) -> list[Column]:
    h = F.xxhash64(key, F.lit(1))
    bit = lambda j: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * j).bitwiseAND(F.lit(63)).cast("int"))
    return [bit(2 * w).bitwiseOR(bit(2 * w + 1)) for w in range(4)]


def bloom(listed: DataFrame, key: str, n_listed: int) -> tuple[DataFrame, int]:
    """The filter as one row a used block (block, w0 to w3), and its number of blocks."""
    blocks = min(MAX_BLOCKS, 1 << max(4, (max(1, n_listed) // KEYS_PER_BLOCK).bit_length()))
    own = listed.select(_block(F.col(key), blocks).alias("block"), *(b.alias(f"w{i}") for i, b in enumerate(_bits(F.col(key)))))
    return own.groupBy("block").agg(*(F.bit_or(f"w{i}").alias(f"w{i}") for i in range(4))), blocks


def filter_urls(pages: DataFrame, listed: DataFrame, page_id: str = "page_id", url: str = "url", listed_url: str = "url", rules: tuple = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, maybe_listed (the filter's answer) and listed (the exact one) for every row of ``pages``."""
    known = materialize(listed.select(canonical(F.col(listed_url)).alias("key")).filter(F.col("key").isNotNull()).distinct(), "listed-urls")
    table, blocks = bloom(known, "key", known.count())
    u = F.col("__url")
    own = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("__url")).select("page_id", host(u).alias("host"), path(u).alias("path"), canonical(u).alias("__key"))
    own = own.withColumns({"__rule": rule(F.col("host"), F.col("path"), rules), "__block": _block(F.col("__key"), blocks)})
    probed = own.join(F.broadcast(table.withColumnRenamed("block", "__at")), F.col("__block") == F.col("__at"), "left")
    passes = F.lit(True)
    for i, b in enumerate(_bits(F.col("__key"))):
        passes = passes & (F.col(f"w{i}").bitwiseAND(b) == b)
    probed = probed.select("page_id", "host", "path", "__rule", "__key", (F.col("__key").isNotNull() & F.coalesce(passes, F.lit(False))).alias("maybe_listed"))
    missed = probed.filter(~F.col("maybe_listed")).withColumn("listed", F.lit(False))
    exact = known.select(F.col("key").alias("__known"))
    hit = probed.filter("maybe_listed").join(exact, F.col("__key") == F.col("__known"), "left").withColumn("listed", F.col("__known").isNotNull()).drop("__known")
    verdict = F.coalesce(F.col("__rule.verdict"), F.when(F.col("listed"), "block").otherwise("allow"))
    return missed.unionByName(hit).select("page_id", "host", "path", F.col("__rule.name").alias("rule"), verdict.alias("verdict"), "maybe_listed", "listed")


def sql(rules: tuple = RULES, labels: tuple[str, ...] = LISTED_LABELS) -> str:
    """The query op7 as DuckDB SQL (no Bloom filter: the join decides)."""
    longest = sorted(rules, key=lambda r: -len(r[1]) - len(r[2]))
    fits = lambda r: f"(host = '{r[1]}' or ends_with(host, '.{r[1]}')) and starts_with(path, '{r[2]}')"
    case = lambda f: "case " + " ".join(f"when {fits(r)} then '{f(r)}'" for r in longest) + " end"
    parts = _PARTS.replace("'", "''")
    return rf"""
with p as (select row_number() over () as r, page_id, translate(coalesce(regexp_extract(url, '{parts}', 1), ''), '{UPPER}', '{LOWER}') as host, coalesce(regexp_extract(url, '{parts}', 2), '') as path,
  coalesce(regexp_extract(url, '{parts}', 3), '') as query from pages),
q as (select *, list_sort(list_filter(string_split(substr(query, 2), '&'), lambda x: x <> '' and not regexp_matches(x, '^({TRACKING})(=|$)'))) as ps from p),
c as (select *, case when host <> '' then regexp_replace(regexp_replace(host, '^({MIRRORS})\.', ''), ':(80|443)$', '') || regexp_replace(path, '/+$', '') || case when len(ps) > 0 then '?' || array_to_string(ps, '&') else '' end end as key from q),
listed as (select distinct key from c where key is not null and list_has_any(string_split(host, '.'), [{", ".join(f"'{x}'" for x in labels)}]))
select page_id, host, path, {case(lambda r: r[1] + r[2])} as rule, coalesce({case(lambda r: r[0])}, case when listed.key is not null then 'block' else 'allow' end) as verdict, listed.key is not null as listed
from c left join listed on c.key = listed.key"""
