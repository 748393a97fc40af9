import random

import tiktoken
from pyspark.sql import functions as F

from weftline.llm import token_counts as tc

COUNT = tc.Counter(open(tc.RANKS, "rb").read())


def full(text):
    return len(COUNT.encoding.encode_ordinary(text))


def test_pattern_cuts_as_the_tokenizer_does():
    for text in ("it's 12 o'clock  \n\n next", "don't  stop", "x²½Ⅷ 3四 a_b __ --\t\x1c .", "Größe naïve é 　x", "   ", ""):
        assert "".join(COUNT.pattern.findall(text)) == text and sum(map(COUNT, COUNT.pattern.findall(text))) == full(text)


def test_edits_equal_full_encoding():
    rng = random.Random(5)
    parts = ["the ", "don't", " 12", "\n\n", "  ", "'", "é", "word", ",", " x", "'r", "e ", "\t"]
    for _ in range(400):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 500)))
        tree = tc.build(text, COUNT)
        for _ in range(4):
            a = rng.randint(0, len(text))
            b = min(len(text), a + rng.randint(0, 30))
            new = "".join(rng.choice(parts) for _ in range(rng.randint(0, 8)))
            tree, text, seen = tc.edit(tree, text, a, b, new, COUNT)
            lengths, tokens = tree.flat()
            assert tree.total == full(text) == sum(tokens) and lengths.tolist() == list(map(len, COUNT.pattern.findall(text)))
    long = "word " * 50_000
    tree, text, seen = tc.edit(tc.build(long, COUNT), long, 100_000, 100_010, "other", COUNT)
    assert seen < 20 and tree.total == full(text)


def test_state_is_read_back_and_only_edits_are_encoded(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(40).withColumn("tokens", F.lit("clash"))
    odd = spark.createDataFrame([(None, None), (1, ""), (1, ""), (2, "x" * 100_000)], "doc_id long, text string")
    for n, table in enumerate((docs, odd, odd.limit(0))):
        tc.trees(table).write.parquet(f"{tmp_path}/{n}")
        state, rounds = spark.read.parquet(f"{tmp_path}/{n}"), 0
        for again in range(2):  # the second call starts from what the first one left
            got = tc.recount(state.withColumn("edits", tc.sample_edits()), keep_state=True)
            got.write.parquet(f"{tmp_path}/{n}-{again}")
            state = spark.read.parquet(f"{tmp_path}/{n}-{again}")
            rows = state.collect()
            assert len(rows) == table.count() and all(r.tokens_after == full(r.text) == sum(r.tokens) and r.pretokens_after == len(r.lengths) for r in rows)
            assert all(r.n_reencoded < 60 for r in rows if r.n_pretokens > 300)
    kept = spark.read.parquet(f"{tmp_path}/0").withColumn("tokens", F.transform("tokens", lambda x: x + 1000))
    none = tc.recount(kept.withColumn("edits", F.lit(None).cast(tc.EDITS))).collect()
    assert none and all(r.n_tokens == r.tokens_after >= 1000 * r.n_pretokens and r.n_reencoded == 0 for r in none)  # kept counts are believed, not made anew


def test_edits_with_nulls_and_out_of_range(spark):
    rows = [(1, "some words here", [(2, 4, None), None, (None, None, "x"), (90, 99, " end"), (5, 1, "")])]
    state = tc.trees(spark.createDataFrame(rows, f"doc_id long, text string, edits {tc.EDITS}"))
    edits = spark.createDataFrame(rows, f"doc_id long, t string, edits {tc.EDITS}").drop("t")
    got = tc.recount(state.join(edits, "doc_id"), keep_state=True).first()
    assert got.text == "xso words here end" and got.n_edits == 4 and got.tokens_after == full(got.text)
