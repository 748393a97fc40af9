import math
import random
from collections import Counter

import duckdb
from pyspark.sql import functions as F

from weftline.llm import quality


def brute(text):
    ws = (text or "").encode("utf-8").split()
    ws = [w.decode() for w in ws]
    grams = Counter(tuple(ws[i : i + 8]) for i in range(len(ws) - 7))
    hit = {i + k for i in range(len(ws) - 7) if grams[tuple(ws[i : i + 8])] > 1 for k in range(8)}
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return (len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit))


def test_features_against_brute_force(spark):
    rng = random.Random(2)
    texts = [None, "", " \n\t", "a " * 50, "x b " * 9, "\x1c \x85 y", "é|<b>&\n\n é|<b>&", "w " * 100_000]
    for _ in range(150):
        texts.append("".join(rng.choice(["a", "b", "c", "dd", "e#"]) + rng.choice([" ", "\n", "  ", "\t"]) for _ in range(rng.randint(0, 90))))
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = quality.with_features(rows).select("doc_id", *quality.FEATURES).collect()
    assert {r.doc_id: tuple(r)[1:] for r in got} == {i: brute(t) for i, t in enumerate(texts)}


def test_binomial_and_certified_steps(spark):
    cdf = lambda k, n, p: sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
    cases = [(0, 10), (3, 50), (7, 400), (30, 1000)]
    got = spark.createDataFrame(cases, "k long, n long").select("k", "n", quality.binomial_cdf(F.col("k"), F.col("n"), 0.03).alias("p")).collect()
    assert all(math.isclose(r.p, cdf(r.k, r.n, 0.03), rel_tol=1e-9) for r in got)
    # Stratum a: 400 good rows, of which 2 are rejected from step 3 on and 40 from step 6 on. b: too few rows.
    rows = [("a", True, 9)] * 360 + [("a", True, 3)] * 2 + [("a", True, 6)] * 38 + [("a", False, 1)] * 99 + [("b", True, 9)] * 20 + [(None, True, 9)] * 500 + [("a", None, 1), ("c", False, 2)]
    cut = {r.stratum: (r.n_good, r.step) for r in quality.calibrate(spark.createDataFrame(rows, "s string, g boolean, l int"), "s", "g", "l").collect()}
    assert cut["a"] == (400, 5) and cut["b"] == (20, 0) and cut[None] == (500, 8) and "c" not in cut


def test_false_rejection_is_controlled(spark):
    """Steps that reject 4 % of good rows, above ALPHA, are certified at most as often as DELTA allows."""
    rng, wrong = random.Random(1), 0
    rows = [(str(run), True, 4 if rng.random() < 0.04 else 9) for run in range(60) for _ in range(600)]
    cut = quality.calibrate(spark.createDataFrame(rows, "s string, g boolean, l int"), "s", "g", "l", alpha=0.03, delta=0.05).collect()
    wrong = sum(r.step >= 4 for r in cut)
    assert wrong <= 3


def test_keep_good_matches_sql_and_keeps_columns(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    kept = quality.keep_good(docs.withColumn("n_words", F.lit("clash")), labels)
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"create view {t} as select * from '{d}/{t}.parquet'")
    want = {r[0] for r in con.sql(f"select doc_id from ({quality.sql()}) where kept").fetchall()}
    assert {r.doc_id for r in kept.select("doc_id").collect()} == want and kept.columns == [*docs.columns, "n_words"]


def test_nulls_and_empty(spark):
    docs = spark.createDataFrame([(None, None, None), (1, "word " * 30, None), (1, "word " * 30, None)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(1, 1), (1, None), (None, 0)], "doc_id long, quality int")
    for table in (docs, docs.limit(0)):
        assert quality.keep_good(table, labels).count() == 0
        assert quality.keep_good(table, labels.limit(0)).count() == 0
