from pyspark.sql import functions as F

from weftline.llm import url_filter as u


def test_rules_hosts_and_lists(spark):
    urls = ["http://a.net/x", "http://NET/", "http://xnet/", "http://net", "http://www.example.net/en/1", "http://example.com/de/", "http://b.example.com/d", "ftp://q.org/fr/?a#b", "mailto:x", None, "", "x://h?p/q", "http://Bad.example.com/p?utm_source=1&z=2&a=1#f", "https://www.bad.example.com:443/p/?a=1&z=2", "http://bad.example.com/p?a=1"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumns({"host": F.lit(1), "listed": F.lit(2)})
    listed = spark.createDataFrame([("http://bad.example.com/p?z=2&a=1",), (None,), ("none",)], "url string")
    got = {r.page_id: r for r in u.filter_urls(pages, listed).collect()}
    rule = {i: r.rule for i, r in got.items() if r.rule}
    assert rule == {0: "net/", 1: "net/", 4: "example.net/en/", 5: "example.com/de/", 7: "org/fr/"}
    assert {i for i, r in got.items() if r.verdict == "block"} == {0, 1, 5, 12, 13} and {i for i, r in got.items() if r.listed} == {12, 13}
    assert (got[11].host, got[11].path) == ("h", "") and (got[8].host, got[9].host) == ("", "") and got[12].host == "bad.example.com"
    assert len(got) == len(urls) and all(r.maybe_listed or not r.listed for r in got.values())
    assert u.filter_urls(pages.limit(0), listed).count() == 0 and u.filter_urls(pages, listed.limit(0)).filter("listed").count() == 0


def test_bloom_has_no_false_negatives_and_few_positives(spark):
    known = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("key"))
    table, blocks = u.bloom(known, "key", 20_000)
    asked = spark.range(60_000).select(F.concat(F.lit("k"), "id").alias("key"), (F.col("id") < 20_000).alias("there"))
    hit = asked.join(table, u._block(F.col("key"), blocks) == F.col("block"), "left")
    passes = F.lit(True)
    for i, b in enumerate(u._bits(F.col("key"))):
        passes = passes & (F.col(f"w{i}").bitwiseAND(b) == b)
    n = {r.there: r.n for r in hit.filter(passes).groupBy("there").agg(F.count("*").alias("n")).collect()}
    assert n[True] == 20_000 and n.get(False, 0) < 800


def test_a_list_of_its_own_against_brute_force(spark):
    import random
    import re

    rng = random.Random(8)
    host = lambda: ".".join(rng.choices(["a", "b", "shop", "m", "www", "x1"], k=2)) + ".com"
    url = lambda: f"{rng.choice(['http', 'https'])}://{rng.choice(['', 'www.', 'm.'])}{host()}{rng.choice(['', ':80', ':443', ':8080'])}/{rng.randint(0, 9)}{rng.choice(['', '/'])}?{'&'.join(rng.sample(['a=1', 'b=2', 'utm_x=3', 'ref=4'], 3))}"
    urls = [url() for _ in range(3000)] + ["http://long.com/" + "p" * 200_000] * 2
    listed = [url() for _ in range(400)] + ["http://www.long.com/" + "p" * 200_000 + "/"]

    def canonical(u):
        h, p, q = re.match(r"(?s).*?://([^/?#]*)([^?#]*)(?:\?([^#]*))?", u).groups()
        keep = sorted(x for x in (q or "").split("&") if x and not re.match(r"(utm_[^=]*|ref|gclid|fbclid)(=|$)", x))
        return re.sub(r":(80|443)$", "", re.sub(r"^(www|m)\.", "", h.lower())) + p.rstrip("/") + ("?" + "&".join(keep) if keep else "")

    bad = {canonical(u) for u in listed}
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: r.listed for r in u.filter_urls(pages, spark.createDataFrame([(x,) for x in listed], "url string")).collect()}
    want = {k: canonical(x) in bad for k, x in enumerate(urls)}
    assert got == want and 10 < sum(want.values()) < len(urls)
