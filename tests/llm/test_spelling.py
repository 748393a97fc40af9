"""Spelling variants against brute force, and the cases that the docstring names."""

import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftline.llm import spelling


def one_apart(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(counts: dict[str, int]) -> dict[str, tuple]:
    out, forms = {}, {}
    for w, n in counts.items():
        near = [o for o in counts if one_apart(w, o)]
        best = min(near, key=lambda o: (-counts[o], o), default=None)
        forms[w] = best if best is not None and counts[best] >= spelling.RATIO * n else None
        out[w] = (n, len(near), forms[w], counts.get(forms[w]))
    for w in out:
        root = w
        while forms[root]:
            root = forms[root]
        out[w] += (root,)
    return out


def found(spark, counts):
    rows = spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long")).collect()
    assert len(rows) == len(counts)
    return {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in rows}


def test_variants_chains_ties_and_long_words(spark):
    long = "ab" * 200
    counts = {"kelenada": 9000, "kelenadas": 500, "kelenadasz": 20, "kélenadaz": 2, "aaaaaaa": 20, "aaaaaab": 2, "aaaaaac": 20, "abababab": 3, "babababa": 3, "zzzzzzzz": 5}
    counts |= {long: 40, long[:100] + "x" + long[101:]: 4, long + "b": 2, "q" * spelling.INLINE: 3, "q" * (spelling.INLINE + 1): 60, "q" * (spelling.INLINE - 1): 2}
    got = found(spark, counts)
    assert got == brute(counts)
    assert got["kelenadasz"][4] == "kelenada" and got["aaaaaab"][2] == "aaaaaaa"


@settings(max_examples=5, deadline=None)
@given(st.dictionaries(st.text("abà", min_size=1, max_size=6), st.sampled_from([2, 3, 25, 400, 5000]), min_size=1, max_size=60))
def test_variants_equal_brute_force(spark, counts):
    assert found(spark, counts) == brute(counts)


def test_vocabulary_of_altered_runs(spark):
    texts = [(i, f"Bonjour MONDEuniversel élégamment{'x' * (i % 3)}, bonjour-Étrangement 7seven×letters") for i in range(200)] + [(None, "Nullable nullable"), (3, None), (4, "")]
    counts: dict[str, int] = {}
    for i, t in texts:
        low = "".join(c.lower() if c.isascii() else c for c in t or "")
        for run in "".join(c if c in "abcdefghijklmnopqrstuvwxyz" or "À" <= c <= "ÿ" else " " for c in low).split():
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            word = run[: h % len(run)] + run[h % len(run) + 1 :] if h % spelling.MODULUS == 0 else run
            if len(word) >= spelling.MIN_LETTERS:
                counts[word] = counts.get(word, 0) + 1
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumns({"word": F.lit("clash"), "n": F.lit(1), "key": F.lit(2)})
    assert {r["word"]: r["n"] for r in spelling.vocabulary(docs).collect()} == {w: n for w, n in counts.items() if n >= spelling.MIN_COUNT}
    assert spelling.variants(spelling.vocabulary(docs.limit(0))).count() == 0


@pytest.mark.parametrize("text", ["aaaa" * 3000])
def test_a_very_long_word(spark, text):
    docs = spark.createDataFrame([(k, t) for k in range(3) for t in (text, text + "a")], "doc_id long, text string")
    rows = spelling.variants(spelling.vocabulary(docs)).collect()
    assert sum(r["n"] for r in rows) <= 6 and all(r["n_near"] >= 1 for r in rows)
