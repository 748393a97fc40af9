from collections import Counter, defaultdict

import numpy as np
import pytest

from weftline.llm import mixing


def levelled(sizes):
    """Targets by resharing in rounds."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in capped]
        rest, w = total - sum(capped.values()), sum(weight[s] for s in free)
        over = [s for s in free if rest * weight[s] / w > 3 * sizes[s]]
        if not over:
            return capped | {s: rest * weight[s] / w for s in free}
        capped |= {s: 3.0 * sizes[s] for s in over}


def check(rows, docs, slack):
    sizes, least = defaultdict(int), defaultdict(lambda: 1 << 30)
    for _, source, text in docs:
        n = len((text or "").encode().split())
        sizes[source] += n
        least[source] = min(least[source], n)
    goal = levelled(sizes)
    taken = Counter()
    by_id = {d: s for d, s, _ in docs}
    assert len(rows) == len(docs)
    for r in rows:
        assert r["source_size"] == sizes[by_id[r["doc_id"]]]
        assert r["target"] == pytest.approx(goal[by_id[r["doc_id"]]], rel=1e-9, abs=1e-6)
        assert 0 <= r["taken"] <= 3 * r["size"] and (not r["size"] or r["taken"] % r["size"] == 0)
        taken[by_id[r["doc_id"]]] += r["taken"]
    for s, t in goal.items():
        assert abs(taken[s] - t) <= max(slack, least[s]), (s, taken[s], t)


def test_targets_and_taken_on_data(spark, sf):
    table = spark.read.parquet(f"{sf}/documents.parquet")
    docs = [(r.doc_id, r.source, r.text) for r in table.collect()]
    one, two = (mixing.digest(table.repartition(n)).collect() for n in (3, 7))
    check(one, docs, 60)
    assert sorted(one) == sorted(two)


def test_nulls_ties_repeats_and_empty(spark):
    docs = [(i, s, t) for i, (s, t) in enumerate([("a", "x y z")] * 40 + [("b", "w " * 7)] * 9 + [(None, "q r")] * 5 + [("é", None), ("z", ""), ("a", None)])]
    table = spark.createDataFrame(docs, "doc_id long, source string, text string")
    check(mixing.digest(table).collect(), docs, 7)
    same = spark.createDataFrame([(1, "a", "x y z")] * 30 + [(2, "b", "u v w")] * 10 + [(None, "c", "k")] * 8, "doc_id long, source string, text string")
    got = mixing.digest(same).collect()
    by = defaultdict(int)
    for r in got:
        by[r["target"]] += r["taken"]
    assert len(got) == 48 and all(abs(t - n) <= 3 for t, n in by.items())
    assert mixing.digest(table.limit(0)).count() == 0


def test_take_keeps_columns_with_clashing_names(spark):
    docs = spark.createDataFrame([(i, "s", "a b c", 1, 2) for i in range(20)], "doc_id long, source string, text string, size int, target int")
    assert mixing.take(docs).columns == docs.columns and mixing.take(docs).count() == 20


@pytest.mark.parametrize("seed", range(5))
def test_subset_sum_is_exact_where_a_sum_exists(seed):
    rng = np.random.default_rng(seed)
    sizes = np.unique(rng.integers(1, 60, 8))
    counts = rng.integers(1, 4, len(sizes))
    reach = {0}
    for s, c in zip(sizes, counts):
        reach = {r + k * s for r in reach for k in range(c + 1)}
    for budget in range(0, int((sizes * counts).sum()) + 1, 7):
        take = mixing.subset_sum(sizes, counts, budget)
        assert (take <= counts).all() and (take * sizes).sum() == min(reach, key=lambda r: (abs(r - budget), r))


def test_very_long_texts_and_ties_by_all_columns(spark):
    docs = [(i, "a", "x " * (400_000 + i)) for i in range(6)] + [(10 + i, "b", "y z") for i in range(30)]
    check(mixing.digest(spark.createDataFrame(docs, "doc_id long, source string, text string")).collect(), docs, 450_000)
    huge, counts = np.array([3, 10**9, 2 * 10**9]), np.array([5, 2, 1])
    base, extra = mixing.fit_source(huge, counts, 1.4e9)
    assert base == 0 and int((huge * extra).sum()) == 10**9 + 15  # no array of that length is made
    same = spark.createDataFrame([(1, "a", "x y z", k) for k in range(30)] + [(2, "b", "u v w", 0)] * 10, "doc_id long, source string, text string, extra int")
    one, two = (sorted(mixing.take(same.repartition(n)).collect()) for n in (2, 7))
    assert one == two
