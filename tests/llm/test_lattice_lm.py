import math
import zlib
from collections import Counter

import pytest

from weftline.llm import lattice_lm as lm


def brute(model, text):
    """Sum over all segmentations, by recursion on the first piece."""
    if not text:
        return 1.0
    total = 0.0
    for j in range(1, len(text) + 1):
        w = model.weights.get(text[:j])
        if w is None and j == 1:
            w = sum(model.bytes[b] for b in text[0].encode())
        if w is not None:
            total += math.exp(w) * brute(model, text[j:])
    return total


def toy():
    weights = {"▁": 0.1, "▁a": 0.2, "a": 0.1, "b": 0.1, "ab": 0.2, "▁ab": 0.1, "ba": 0.05}
    return lm.Lattice({k: math.log(v) for k, v in weights.items()}, [math.log(0.1 / 256)] * 256, math.log(0.05))


def test_forward_sums_all_segmentations():
    m = toy()
    for word in ("a", "ab", "abab", "baab", "xab", "aéb"):
        assert math.isclose(m.log_probability(word), math.log(brute(m, "▁" + word)), rel_tol=1e-12)
    assert math.isfinite(m.log_probability("ab" * 50_000))


def test_expected_counts_are_those_of_all_segmentations():
    import numpy as np

    m, counts, octets = toy(), {}, np.zeros(256)
    m.expected("abab", 2.0, counts, octets)
    text, want = "▁abab", Counter()

    def walk(rest, weight, pieces):
        if not rest:
            for p in pieces:
                want[p] += 2 * weight / brute(m, text)
        for j in range(1, len(rest) + 1):
            if rest[:j] in m.weights:
                walk(rest[j:], weight * math.exp(m.weights[rest[:j]]), [*pieces, rest[:j]])

    walk(text, 1.0, [])
    assert counts.keys() == want.keys() and all(math.isclose(counts[k], want[k], rel_tol=1e-9) for k in want)


def test_batches_equal_single_words():
    import numpy as np

    m = lm.vocabulary()
    words = ["the", "x", "Über", "ndtheing", "a\u0300\U0001f600q", "z" * 90, "", "tion" * 9, "\x1c"] * 2
    counts, batch = list(range(1, len(words) + 1)), lm.Batch(m)
    assert np.allclose(batch.log_probabilities(words), [m.log_probability(w) for w in words], rtol=1e-12)
    pieces, octets, found, spelled = np.zeros(len(batch.names)), np.zeros(256), {}, np.zeros(256)
    batch.expected(words, counts, pieces, octets)
    for w, c in zip(words, counts):
        m.expected(w, c, found, spelled)
    assert np.allclose(octets, spelled) and np.allclose(pieces, [found.get(p, 0.0) for p in batch.names], rtol=1e-9, atol=1e-9)


def test_vocabulary_is_a_distribution():
    m = lm.vocabulary()
    assert math.isclose(sum(map(math.exp, [*m.weights.values(), *m.bytes, m.end])), 1.0, rel_tol=1e-9)


def expected(docs):
    train = [(i, t) for i, t in docs if zlib.crc32(str("" if i is None else i).encode()) % 7 != 2]
    counts = Counter(w for _, t in train for w in (t or "").encode().lower().split())
    n, v, ends = sum(counts.values()) + len(train), len(counts) + bool(train), len(train)
    for i, t in docs:
        ws = (t or "").encode().lower().split()
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws) + math.log10((ends + 1) / (n + v + 1))
        yield i, zlib.crc32(str("" if i is None else i).encode()) % 7 == 2, len(ws) + 1, sum(counts[w] > 0 for w in ws) + (ends > 0), n, base


@pytest.mark.parametrize("head", [1_000_000, 5])
def test_base_and_counts_against_brute_force(spark, sf, head, monkeypatch):
    monkeypatch.setattr(lm, "HEAD", head)
    table = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    docs = [(r.doc_id, r.text) for r in table.collect()]
    got = {r.doc_id: r for r in lm.scored(table, rounds=1).collect()}
    assert len(got) == len(docs)
    for i, held, n, known, train, base in expected(docs):
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, train) and math.isclose(r.base_score, base, rel_tol=1e-9)


def test_scores_are_those_of_the_model_word_by_word(spark, sf, monkeypatch):
    docs = [(1, "The river runs ab ab"), (2, "the RIVER"), (3, "z" * 70 + " the"), (4, None)]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    want = lm.vocabulary()
    for head in (1_000_000, 1):
        monkeypatch.setattr(lm, "HEAD", head)
        got = {r.doc_id: r.score for r in lm.scored(table, rounds=0).collect()}
        for i, t in docs:
            assert math.isclose(got[i], (want.end + sum(map(want.log_probability, (t or "").lower().split()))) / math.log(10), rel_tol=1e-9)


def test_learning_helps_held_out_texts(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").limit(300)
    total = lambda rounds: sum(r.score for r in lm.scored(table, rounds=rounds).filter("held_out").collect())
    assert total(1) > total(0)


def test_nulls_repeats_and_empty(spark):
    docs = [(None, None), (None, None), (1, ""), (1, "A a ß"), (1, "A a ß"), (2, "é" * 3000), (9, "a\x1cb")]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in lm.scored(table, rounds=1).collect()), key=str)
    assert got == sorted(((*e[:5], round(e[5], 6)) for e in expected(docs)), key=str)
    assert lm.scored(table.limit(0)).count() == 0
