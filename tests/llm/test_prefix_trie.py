"""The trie against a brute-force version, with the cases that the docstring names."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from weftline.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, r or "", x or ""))
    own = {c: [v[2:] for v in sorted(vs)] for c, vs in own.items()}
    convs = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        convs[c] = tuple(own.get(base, [])[:h] + mine[h:])
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    below = {}
    for p in sorted(members, key=len, reverse=True):
        own_saved = (len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0
        below[p] = (sum(below[k][0] for k in kids[p]) or 1, own_saved + sum(below[k][1] for k in kids[p]))
    out = []
    for p, cs in members.items():
        ends = ",".join(map(str, sorted(c for c in cs if convs[c] == p)))
        out.append((min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), len(kids[p]), *below[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def built(df):
    rows = prefix_trie.trie(*prefix_trie.rebuilt(prefix_trie.turns(df))).collect()
    return sorted((tuple(r[c] for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")) for r in rows), key=repr)


def made(seed):
    rng = random.Random(seed)
    rows = []
    for c in [*range(-12, 30), 10**12, 10**12 + 1, None]:
        for t in range(rng.choice([0, 1, 2, 3, 9, 12])):
            rows.append((c, rng.choice([t, t, t, 3, None]), rng.choice(["user", "assistant", None, ""]), rng.choice(["hello", "é", "", None, "a,b"])))
    rows += [(c, t, "user", f"turn {t}") for c in range(100, 160) for t in range(11)]  # copies, longer than what bases give
    rows += [(77, t, "user", "same") for t in [1] * 40] + [(3, 0, "user", "x" * 100_000)] * 2
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rows = made(seed)
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"depth": F.lit("clash"), "node": F.lit(1), "conv": F.lit(2)})
    assert built(df) == brute(rows)


def test_no_rows_and_one_conversation(spark):
    assert built(spark.createDataFrame([], SCHEMA)) == []
    assert built(spark.createDataFrame([(None, 1, "user", "x")], SCHEMA)) == []
    one = [(7, 2, "user", "b"), (7, 1, "assistant", "a")]
    assert built(spark.createDataFrame(one, SCHEMA)) == brute(one)


def test_the_driver_s_table(spark, sf):
    df = spark.read.parquet(f"{sf}/conversations.parquet")
    assert built(df) == brute([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])
