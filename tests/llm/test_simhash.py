import random

import numpy as np
import pytest
import xxhash

from weftline.llm import simhash
from weftline.llm.components import _met, components


def slow(text):
    ws = (text or "").encode().lower().split()
    sh = [b" ".join(ws[i : i + 3]) for i in range(max(1, len(ws) - 2))] if ws else []
    hs = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def groups(fps):
    """Class of each fingerprint by comparing all."""
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(fps):
        for j in range(i):
            if (a ^ fps[j]).bit_count() <= 3:
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return [find(i) for i in range(len(fps))]


def test_fingerprint():
    for t in (None, "", "a", "a b", "Äa B c d e f", "The quick brown fox jumps " * 9, "x\x1cy z\x0bq"):
        assert slow(t) == simhash.fingerprint(t)


def test_tree_finds_all_within_the_radius():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    values = np.unique(np.concatenate([base] + [base ^ (np.uint64(1) << rng.integers(0, 64, 60, dtype=np.uint64)) for _ in range(4)]))
    tree = simhash.BKTree(values)
    assert all(np.bitwise_count(values[c] ^ values[n]) == e for n, own in tree.children.items() for e, c in own.items())
    found = {(n, int(q)) for n, qs in tree.probe(values, 3) for q in qs}
    assert found == {(i, j) for i in range(len(values)) for j in range(len(values)) if int(values[i] ^ values[j]).bit_count() <= 3}


def test_links_make_the_same_groups_with_hot_shards(spark):
    rng = random.Random(4)
    fps = {rng.getrandbits(64) for _ in range(150)}
    for f in list(fps)[:60]:
        for _ in range(4):
            f ^= 1 << rng.randrange(64) | 1 << rng.randrange(64)
            fps.add(f)
    hot = rng.getrandbits(64)
    fps = sorted(fps | {hot ^ rng.getrandbits(9) for _ in range(120)})
    want = groups(fps)
    table = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    for shard in (20_000, 7):
        got = {r.node: r.root for r in components(simhash.links(table, shard=shard)).collect()}
        signed = [f - (1 << 64) if f >> 63 else f for f in fps]
        root = [got.get(s, s) for s in signed]
        pairs = {}
        assert len(set(root)) == len(set(want)) and all(pairs.setdefault(w, r) == r for w, r in zip(want, root))


def test_chain_of_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(900, 901), (901, 900), (5, 5)], "a long, b long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {i: 0 for i in range(1, 301)} | {901: 900}


def test_hot_nodes_and_fingerprints_meet_the_same_rows(spark):
    from pyspark.sql import functions as F

    edges = spark.createDataFrame([(1, k) for k in range(2, 40)] + [(50 + k, k) for k in range(9)] + [(7, 8)], "a long, b long")
    facts = edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    want = sorted(map(tuple, edges.join(facts.drop("n"), "a").collect()))
    assert all(sorted(map(tuple, _met(edges, facts, most).select("a", "b", "m").collect())) == want for most in (100, 3, 1))
    rows = spark.createDataFrame([(k, 5 if k < 30 else k % 7) for k in range(60)], "doc_id long, __fp long")
    named = spark.createDataFrame([(5, 34, 0), (6, 4, 33), (2, 4, 33), (3, 5, 31)], "__nfp long, __n long, __component long")
    got = [sorted(map(tuple, simhash.with_component(rows, named, "doc_id", most=most).select("doc_id", "__component").collect())) for most in (100, 3, 2)]
    by = {5: 0, 6: 33, 2: 33, 3: 31}
    assert got[0] == got[1] == got[2] == sorted((r.doc_id, by.get(r["__fp"], r.doc_id)) for r in rows.collect())


def test_groups_nulls_repeats_and_empty(spark):
    near = "one two three four five six seven eight nine ten " * 20
    rows = [(7, near), (3, near), (3, near), (None, near), (9, None), (8, ""), (None, "alone is this text here"), (5, "something else entirely"), (4, "x" * 200_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = simhash.near_duplicates(docs).collect()
    want = {"7": 3, "3": 3, "9": 8, "8": 8, "5": 5, "4": 4}
    assert len(got) == len(rows) and all(r.component_id == want[str(r.doc_id)] for r in got if r.doc_id is not None)
    assert sorted((r.component_id for r in got if r.doc_id is None), key=str) == [3, None]
    kept = simhash.keep_one(docs.withColumnRenamed("doc_id", "doc_id")).collect()
    assert sorted((r.doc_id for r in kept), key=str) == [3, 4, 5, 8, None]
    unique = docs.filter("doc_id is not null").dropDuplicates(["doc_id"])
    assert sorted(r.doc_id for r in simhash.keep_one(unique).collect()) == [3, 4, 5, 8]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize("rounds", [0, 1, 8])
def test_confirmation_is_complete_whatever_the_rounds(spark, rounds):
    rng = random.Random(5)
    kinds = [frozenset(rng.sample(range(1, 400), 20)) for _ in range(12)] + [frozenset()]
    nodes = []
    for n in range(160):
        base = kinds[rng.randrange(13)]
        nodes.append((n, rng.choice([None, rng.randrange(90)]), n % 2, sorted({*list(base)[rng.randrange(3) if base else 0 :], *rng.sample(range(400, 500), rng.randrange(2) if base else 0)})))
    members = spark.createDataFrame([x[:3] for x in nodes], "node long, id long, root long")
    sets = spark.createDataFrame([(x[0], x[3]) for x in nodes], "node long, shingles array<long>")
    want = set()
    for root in (0, 1):
        left = sorted((x for x in nodes if x[2] == root), key=lambda x: (x[1] is None, x[1] or 0, x[0]))
        while left:
            a = set(left[0][3])
            go = [x for x in left[1:] if len(a & set(x[3])) * 10 >= len(a | set(x[3])) * 8]
            want |= {x[0] for x in go}
            left = [x for x in left[1:] if x not in go]
    got = [r.node for r in simhash.confirmed(members, sets, rounds=rounds).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 40


@pytest.mark.parametrize("heads", [5, 32])
def test_rest_is_complete_and_its_pairs_grow_with_the_rows(spark, heads):
    rng = random.Random(9)
    nodes = [(n, n % 2, sorted(rng.sample(range(24), 20))) for n in range(64)]  # all share shingles, few are alike
    members = spark.createDataFrame([(n, n, root) for n, root, _ in nodes], "node long, id long, root long")
    sets = spark.createDataFrame([(n, s) for n, _, s in nodes], "node long, shingles array<long>")
    want = set()
    for root in (0, 1):
        left = [x for x in nodes if x[1] == root]
        while left:
            go = [x for x in left[1:] if len({*left[0][2]} & {*x[2]}) * 10 >= len({*left[0][2]} | {*x[2]}) * 8]
            want |= {x[0] for x in go}
            left = [x for x in left[1:] if x not in go]
    got = [r.node for df in simhash.rest(members, sets, heads=heads) for r in df.collect()]
    assert len(got) == len(set(got)) and set(got) == want and 5 < len(want) < 62
    for n in (100, 200):
        some = spark.range(n).selectExpr("0L as root", "7L as s", "id as node", "struct(false as x, id as id, id as node) as o")
        pairs, late = simhash.candidates(some, heads)
        assert pairs.count() == n * heads - heads * (heads + 1) // 2 and late.count() == n - heads


def test_views_at_once_are_the_views_one_by_one():
    rng = random.Random(8)
    for n in (0, 1, 2, 7, 255, 256, 257, 300, 4097, 9000):
        text = " ".join(f"w{rng.randrange(500)}" for _ in range(n))
        hashes = simhash._shingle_hashes(text, 2)
        want = [0] * 5 if hashes is None else [simhash._majority(simhash._mixed(hashes, v) if v else hashes) for v in range(5)]
        assert simhash.fingerprints(text, 2, 5) == want and simhash.fingerprints(text, 2, 1) == want[:1]
