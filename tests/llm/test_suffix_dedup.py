"""Removal of repeated passages against brute force over all windows."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import suffix_dedup


def brute(texts: list[bytes], width: int) -> list[tuple[int, int, bytes]]:
    count = Counter(t[i : i + width] for t in texts for i in range(len(t) - width + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - width + 1):
            if count[t[i : i + width]] > 1:
                gone[i : i + width] = True
        runs = np.count_nonzero(np.diff(np.append(False, gone).astype(int)) == 1)
        out.append((int(gone.sum()), int(runs), bytes(np.frombuffer(t, np.uint8)[~gone])))
    return out


def corpus(seed: int) -> list[str | None]:
    rng = random.Random(seed)
    random_text = lambda n, letters="abcdefgh é ": "".join(rng.choice(letters) for _ in range(n))
    shared = [random_text(rng.choice([39, 40, 41, 60, 90, 200, 500])) for _ in range(8)]
    out = []
    for _ in range(60):
        out.append("".join(rng.choice(shared) if rng.random() < 0.4 else random_text(rng.randrange(80)) for _ in range(rng.randrange(1, 8))))
    near = random_text(900)
    for _ in range(20):
        k = rng.randrange(900)
        out.append(near[:k] + rng.choice("xyz") + near[k + rng.randrange(2) :])
    out += [near[3:200], near[100:141], near[100:140], near[100:139]]
    out += ["a" * 39, "a" * 40, "b" * 41, "ab" * 300, "abc" * 50 + random_text(50) + "abc" * 20, random_text(3000, "ab")]
    return [*out, *out[:5], out[7], out[7], "", None, shared[0], "é" * 30]


@pytest.mark.parametrize(("seed", "radius", "hot"), [(1, 4, 2000), (2, 8, 2), (3, 3, 0)])
def test_equals_brute_force(spark, seed, radius, hot, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    texts = corpus(seed)
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").withColumns({c: F.lit(7) for c in ("k1", "copies", "n", "tid")}).repartition(5)
    got = {r["doc_id"]: r for r in suffix_dedup.without_repeats(docs, width=40, radius=radius).collect()}
    assert len(got) == len(texts)
    for k, (t, want) in enumerate(zip(texts, brute([(t or "").encode() for t in texts], 40), strict=True)):
        row = got[k]
        assert (row["n_bytes"], row["n_removed"], row["n_spans"], row["copies"]) == (len((t or "").encode()), *want[:2], 7), k
        assert row["kept"] is None if not want[0] else bytes(row["kept"]) == want[2]


def test_intervals_of_a_shard():
    rng = np.random.default_rng(5)
    tokens, ends = rng.integers(0, 3, 400).astype(np.uint64), np.zeros(400, bool)
    ends[[49, 50, 120, 399]] = True
    stop = [next(j for j in range(k, 400) if ends[j]) + 1 for k in range(400)]
    depth = np.minimum(rng.integers(0, 7, 400), np.array(stop) - np.arange(400))
    lead = rng.integers(0, 2, 400).astype(np.uint64)
    unit = suffix_dedup.shard_intervals(tokens, ends, lead, depth)
    named = [(int(lead[k]), int(depth[k]), tuple(tokens[k : k + depth[k]].tolist())) for k in range(400)]
    assert len(set(zip(unit.tolist(), named, strict=True))) == len(set(named)) == len(set(unit.tolist()))


def test_digest_of_the_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rows = docs.collect()
    want = brute([r["text"].encode() for r in rows], suffix_dedup.WIDTH)
    got = {r["doc_id"]: r for r in suffix_dedup.digest(docs).collect()}
    assert any(w[0] for w in want)
    for r, (gone, runs, kept) in zip(rows, want, strict=True):
        g = got[r["doc_id"]]
        assert (g["n_bytes"], g["n_removed"], g["n_spans"], g["kept_sha256"]) == (len(r["text"].encode()), gone, runs, hashlib.sha256(kept).hexdigest())


def test_no_rows(spark):
    assert suffix_dedup.digest(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert suffix_dedup.digest(spark.createDataFrame([(1, None)], "doc_id long, text string")).first()["n_removed"] == 0
