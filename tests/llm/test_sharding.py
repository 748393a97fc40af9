from collections import Counter

from pyspark.sql import functions as F

from weftline.llm import sharding


def test_a_permutation_that_does_not_depend_on_partitions(spark):
    docs = spark.createDataFrame([(i, f"text {i % 50} " * (i % 7)) for i in range(700)] + [(None, None), (None, None), (5, None)], "doc_id long, text string").withColumn("slot", F.lit("mine"))
    one = sharding.shuffled(docs.repartition(3), bucket_bytes=2000).collect()
    two = sharding.shuffled(docs.repartition(9), bucket_bytes=2000).collect()
    key = lambda r: (str(r.doc_id), str(r.text), r.slot_in, r.shard, r.slot)
    assert sorted(map(key, one)) == sorted(map(key, two)) and len(one) == 703
    n = Counter(r.shard for r in one)
    assert max(n.values()) - min(n.values()) <= 1 and len(n) == 16
    assert all(sorted(r.slot for r in one if r.shard == s) == list(range(n[s])) for s in n)
    other = sharding.shuffled(docs, seed=1, bucket_bytes=2000).collect()
    assert sorted(map(key, one)) != sorted(map(key, other))


def test_permutations_are_uniform():
    seen = Counter(tuple(sharding.permutation(4, (k,))) for k in range(4800))
    assert len(seen) == 24 and 120 < min(seen.values()) and max(seen.values()) < 290
    assert sharding.permutation(0, (1,)).tolist() == [] and sharding.permutation(1, (1,)).tolist() == [0]


def test_written_shards_and_empty(spark, tmp_path):
    docs = spark.createDataFrame([(i, "x" * i) for i in range(100)], "doc_id long, text string")
    path = sharding.write_shards(docs, f"{tmp_path}/s", shards=4)
    assert spark.read.parquet(path).groupBy("shard").count().count() == 4
    assert sharding.shuffled(docs.limit(0)).count() == 0 and sharding.digest(docs.limit(0)).count() == 0


def test_digest_against_brute_force(spark, sf):
    import zlib

    table = spark.read.parquet(f"{sf}/documents.parquet").unionByName(spark.createDataFrame([(None, None, None, None, None), (-1, "", "x", "s", 0), (-2, "long " * 400_000, "x", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long"))
    docs = table.collect()
    got = sharding.digest(table).collect()
    facts = lambda i, t: (str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode()))
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == sorted(facts(r.doc_id, r.text) for r in docs)
    n = Counter(r.shard for r in got)
    assert set(n) == set(range(16)) and max(n.values()) - min(n.values()) <= 1 and {(r.law, r.grown_shard) for r in got} == {("rows", None)}
    assert all(sorted(r.slot for r in got if r.shard == s) == list(range(n[s])) for s in n)
    # Not in the order of the table: neighbours land in different shards about 15 times of 16.
    at = {r.doc_id: r.shard for r in got}
    same = sum(at[a.doc_id] == at[b.doc_id] for a, b in zip(docs, docs[1:]))
    assert same < len(docs) / 8


def test_copies_are_scattered_and_placed_by_all_columns(spark):
    rows = [(7, "the same", k % 5) for k in range(600)] + [(k, f"t{k}", 0) for k in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, extra int")
    one = sharding.shuffled(docs.repartition(3), bucket_bytes=500, copies=50).collect()
    two = sharding.shuffled(docs.repartition(8), bucket_bytes=500, copies=50).collect()
    assert sorted(one) == sorted(two) and len(one) == 700
    assert len({r["__bucket"] for r in one if r.doc_id == 7}) > 10
    whole = sharding.shuffled(docs.repartition(4), bucket_bytes=500).collect()
    assert sorted(whole) == sorted(sharding.shuffled(docs.repartition(6), bucket_bytes=500).collect())
    bare = sharding.shuffled(docs.withColumn("m", F.create_map(F.lit("a"), "extra")), bucket_bytes=500)
    assert bare.count() == 700
