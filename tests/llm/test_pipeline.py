from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F
from test_mixing import levelled
from test_simhash import groups

import corpus_pipeline
from weftline.llm import quality, simhash
from weftline.llm.common import materialize

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    out = [spark.read.parquet(f"{SF}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        out.append(materialize(stage(spark, out[-1], SF), name))
    return out


def test_every_stage_against_brute_force(spark, steps):
    docs, good, unique, clean, mixed, shards = ([r for r in s.collect()] for s in steps)
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    assert {r.doc_id for r in good} == {r[0] for r in con.sql(f"select doc_id from ({quality.sql()}) where kept").fetchall()}
    ordered = sorted(good, key=lambda r: r.doc_id)
    root = list(range(len(ordered)))  # groups over all views
    for view in zip(*(simhash.fingerprints(r.text, simhash.CANDIDATE_SHINGLE) for r in ordered)):
        for i, c in enumerate(groups(list(view))):
            old, new = max(root[i], root[c]), min(root[i], root[c])
            root = [new if x == old else x for x in root]
    low = lambda t: "".join(x.lower() if x.isascii() else x for x in t).encode().split()
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := low(r.text)) else set() for r in ordered]
    stays = set()
    for c in set(root):  # the first of a group stays, those like it go, the rest are a group again
        left = [i for i, x in enumerate(root) if x == c]
        while left:
            stays.add(left[0])
            alike = lambda i: len(sets[i] & sets[left[0]]) >= 0.8 * len(sets[i] | sets[left[0]])  # noqa: B023, E731
            left = [i for i in left[1:] if not alike(i)]
    assert {r.doc_id for r in unique} == {ordered[i].doc_id for i in stays} and len(unique) == len(stays) < len(ordered)
    grams = lambda t: {tuple(w[i : i + 8]) for w in [t.lower().split()] for i in range(len(w) - 7)}
    bench = [grams(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaks = {r.doc_id for r in unique if any(b and len(b & grams(r.text)) >= 0.5 * len(b) for b in bench)}
    assert {r.doc_id for r in clean} == {r.doc_id for r in unique} - leaks
    copies = Counter(r.doc_id for r in mixed)
    n = {r.doc_id: len(r.text.encode().split()) for r in clean}
    size = Counter()
    for r in clean:
        size[r.source] += n[r.doc_id]
    goal, taken = levelled(size), Counter()
    for r in clean:
        taken[r.source] += copies[r.doc_id] * n[r.doc_id]
    assert max(copies.values()) <= 3 and all(abs(taken[s] - t) <= max(60, min(n[r.doc_id] for r in clean if r.source == s)) for s, t in goal.items())
    assert Counter((r.doc_id, r.text) for r in shards) == Counter((r.doc_id, r.text) for r in mixed)
    per = Counter(r.shard for r in shards)
    assert max(per.values()) - min(per.values()) <= 1 and all(sorted(r.slot for r in shards if r.shard == s) == list(range(k)) for s, k in per.items())


def test_columns_and_rerun(spark, steps):
    assert all(s.columns == steps[0].columns for s in steps[:-1]) and steps[-1].columns == [*steps[0].columns, "shard", "slot"]
    key = ("doc_id", "shard", "slot")
    assert sorted(corpus_pipeline.run(spark, SF).select(*key).collect()) == sorted(steps[-1].select(*key).collect())


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0


def test_nulls_repeats_and_clashing_names(spark):
    base = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (7, "", "en", None, 0), (None, "w " * 50, "xx", "s", 0), (5, "word " * 100_000, "en", "s", 0)], base.schema)
    docs = base.unionByName(odd).unionByName(base.limit(20)).withColumns({"size": F.lit(1), "shard": F.lit("x"), "kept": F.lit(2), "component_id": F.lit(3)})
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, SF), name)
        assert docs.columns == columns
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert out.count() == docs.count() > 0 and {"shard_in", "shard", "slot"} <= set(out.columns)
