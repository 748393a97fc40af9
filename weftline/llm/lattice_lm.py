"""Subword lattice likelihood of documents.

An existing subword vocabulary (a SentencePiece model; its path is a parameter) fixes the pieces and, by its scores, their first weights.
Training documents re-weight the pieces by expectation maximisation over all segmentations of every distinct training word, each counted
as often as it occurs. The model draws pieces one after another, a document's end among them, so the probability of a text is the sum over
all ways to cut its words into pieces; since pieces never cross words it factors into words, each summed by forward recursion in log space.
Characters without a piece of their own are spelled in byte pieces, so every text has a probability.

Every distinct word of the corpus is one row with its training count and, once the weights are final, its log probability; documents look
both up. Words that make up at least one in HEAD tokens (so at most HEAD of them) are known to every task; the other words of a document
meet their row in a join on the word, where none is frequent enough to be a hot key. Counts, weights and joins cover all documents.

Defined results: null text is empty, so only its end is a token; a null id counts as the empty text; repeated rows are scored each; with no
training documents N = V = 0 and the vocabulary's own weights hold; octets that are not UTF-8 are scored as replacement characters.
"""

from __future__ import annotations

import math
from hashlib import md5
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, slices
from .lattice import Batch, Lattice
from .lattice import vocabulary as read_vocabulary

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Rounds of re-weighting; strength of the vocabulary's weights in tokens; the least share of tokens that makes a word common; octets up to
#: which a common word is known by itself, longer ones by their digest; octets of text that a task takes at once.
ROUNDS, PRIOR, HEAD, HEAD_BYTES, SLICE = 2, 1000.0, 1_000_000, 40, 8 << 20


def vocabulary(path: str = VOCABULARY) -> Lattice:
    return read_vocabulary(path)


_BATCH: list = [None, None]


def _batch(model: Lattice, tag: int) -> Batch:
    """The recursions of a model, kept by a worker process for its next task; ``tag`` is a digest of the weights."""
    if _BATCH[0] != tag:
        _BATCH[:] = tag, Batch(model)
    return _BATCH[1]


def _tag(model: Lattice) -> int:
    return xxhash.xxh64_intdigest(repr((list(model.weights.items()), model.bytes, model.end)))


def _texts(words: pa.Array) -> list[str]:
    return [w.decode("utf-8", "replace") for w in words.to_pylist()]


def reweighted(model: Lattice, prior: Lattice, counts: DataFrame, ends: int) -> Lattice:
    """One round of expectation maximisation over (word, c); what comes to the driver is a number a piece."""
    shared, tag = counts.sparkSession.sparkContext.broadcast(model), _tag(model)  # the vocabulary's size

    def run(batches):  # noqa: ANN001, ANN202
        batch, octets = _batch(shared.value, tag), np.zeros(256)
        pieces = np.zeros(len(batch.names))
        for b in batches:
            batch.expected(_texts(b.column(0)), b.column(1).to_pylist(), pieces, octets)
        names = [*batch.names, *(f"\n{b}" for b in range(256))]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(np.concatenate([pieces, octets]))], names=["piece", "n"])

    rows = counts.select("word", "c").mapInArrow(run, "piece string, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect()
    found = {r["piece"]: r["n"] for r in rows}
    whole = sum(found.values()) + ends + PRIOR
    new = lambda n, old: math.log((n + PRIOR * math.exp(old)) / whole)
    return Lattice({p: new(found.get(p, 0.0), w) for p, w in prior.weights.items()}, [new(found.get(f"\n{b}", 0.0), w) for b, w in enumerate(prior.bytes)], new(ends, prior.end))


def held_out(doc_id: str) -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 7 == 2


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The lower-cased words of all texts as one array, and the number of each one's text."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
    flat, owner = lists.flatten(), np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    kept = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
    return flat.filter(pa.array(kept)), owner[kept]


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c, total) over (held_out, text): how often a word occurs in training texts, and in all. A task sends a word once for every
    SLICE of texts that hold it, and Spark adds up before it shuffles."""

    def run(batches):  # noqa: ANN001, ANN202
        for b in slices(batches, 1, SLICE):
            words, owner = words_of(b.column(1))
            coded = words.dictionary_encode()
            codes, n = coded.indices.to_numpy(), len(coded.dictionary)
            training = ~b.column(0).to_numpy(zero_copy_only=False).astype(bool)[owner]
            sums = [np.bincount(codes[training], minlength=n), np.bincount(codes, minlength=n)]
            yield pa.RecordBatch.from_arrays([coded.dictionary.cast(pa.binary()), *map(pa.array, sums)], names=["word", "c", "total"])

    return docs.select("held_out", "text").mapInArrow(run, "word binary, c long, total long").groupBy("word").agg(F.sum("c").alias("c"), F.sum("total").alias("total"))


def word_scores(counts: DataFrame, model: Lattice) -> DataFrame:
    """(word, c, total, score): adds every word's natural log probability."""
    shared, tag = counts.sparkSession.sparkContext.broadcast(model), _tag(model)

    def run(batches):  # noqa: ANN001, ANN202
        for b in batches:
            yield b.append_column("score", pa.array(_batch(shared.value, tag).log_probabilities(_texts(b.column(0)))))

    return counts.select("word", "c", "total").mapInArrow(run, "word binary, c long, total long, score double")


def scored(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str = VOCABULARY, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row."""
    spark = docs.sparkSession
    own = docs.select(F.col(doc_id).alias("doc_id"), held_out(doc_id).alias("held_out"), F.col(text).alias("text"))
    counts = materialize(word_counts(own), "lm-words")
    ends = own.filter(~F.col("held_out")).count()
    n, v, whole = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0), F.coalesce(F.sum("total"), F.lit(0))).first()
    n, v = n + ends, v + (ends > 0)
    model = prior = vocabulary(path)
    for _ in range(rounds):
        model = reweighted(model, prior, counts.filter("c > 0"), ends) if n else model
    words = materialize(word_scores(counts, model), "lm-scores")
    common = F.col("total") >= max(1.0, whole / HEAD)
    short = F.octet_length("word") <= HEAD_BYTES
    head = words.filter(common).select(F.when(short, F.col("word")).otherwise(F.unhex(F.md5("word"))).alias("word"), short.alias("short"), "c", "score").collect()  # at most HEAD rows of at most HEAD_BYTES
    numbers = [{bytes(r["word"]): k for k, r in enumerate(head) if r["short"] == s} for s in (True, False)]
    shared = spark.sparkContext.broadcast((*numbers, np.array([r["c"] for r in head], np.int64), np.array([r["score"] for r in head], float)))
    each, first, last, end = math.log10(n + v + 1), int(ends > 0), math.log10(ends + 1), model.end / math.log(10)
    schema = "key binary, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, one int, word binary, n long"

    def run(batches):  # noqa: ANN001, ANN202
        short, long, c, logs = shared.value
        base, logs = np.append(np.log10(c + 1.0), 0.0), np.append(logs / math.log(10), 0.0)
        seen = np.append(c > 0, False)
        for b in slices(batches, 2, SLICE):
            found, owner = words_of(b.column(2))
            coded = found.dictionary_encode()
            codes, names, size = coded.indices.to_numpy(), coded.dictionary.cast(pa.binary()), b.num_rows
            rows = np.fromiter(map(short.get, names.to_pylist(), repeat(-1)), np.int64, len(names))
            for k in np.flatnonzero(pc.binary_length(names).to_numpy(zero_copy_only=False) > HEAD_BYTES).tolist() if long else ():
                rows[k] = long.get(md5(names[k].as_py()).digest(), -1)
            at, sums = rows[codes], lambda of: np.bincount(owner, of, size)  # noqa: B023
            tokens = np.bincount(owner, minlength=size) + 1
            keys = [xxhash.xxh3_128_digest(f"{i}\n".encode() + (t.as_buffer().to_pybytes() if t.is_valid else b"\n")) for i, t in zip(b.column(0).to_pylist(), b.column(2), strict=True)]
            sums = [tokens, sums(seen[at]).astype(np.int64) + first, sums(base[at]) + last - tokens * each, sums(logs[at]) + end]
            marks = pa.array([b"\n" + k for k in keys], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), b.column(0), b.column(1), *map(pa.array, sums), pa.array(np.ones(size, np.int32)), marks, pa.array(np.zeros(size, np.int64))], names=_NAMES)
            rare = at < 0
            pairs, times = np.unique(owner[rare] * len(names) + codes[rare], return_counts=True)
            for lo in range(0, len(pairs), 100_000):
                p, k = pairs[lo : lo + 100_000], times[lo : lo + 100_000].astype(np.int64)
                none = [pa.nulls(len(p), t) for t in (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64())]
                given = [pa.array(keys, pa.binary()).take(pa.array(p // len(names))), *none, pa.array(np.zeros(len(p), np.int32)), names.take(pa.array(p % len(names))), pa.array(k)]
                yield pa.RecordBatch.from_arrays(given, names=_NAMES)

    rows = own.mapInArrow(run, schema)
    rare = words.filter(~common).select(F.col("word").alias("w"), "c", F.col("score").alias("s"))
    got = rows.join(rare, F.col("word") == F.col("w"), "left")  # the rows of documents have words that no text has: a line feed and the key
    found = lambda x: F.sum(F.when(F.col("c").isNotNull(), F.col("n") * x).otherwise(0))
    per = got.groupBy("key").agg(
        *(F.max(x).alias(x) for x in ("doc_id", "held_out", "n_tokens", "n_known", "base", "score")), F.sum("one").alias("rows"),
        found((F.col("c") > 0).cast("int")).alias("tail_known"), found(F.log10(F.col("c") + 1)).alias("tail_base"), found(F.col("s") / math.log(10)).alias("tail_score"),
    )
    per = per.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    more = lambda x: F.col(f"tail_{x}") / F.col("rows")
    return per.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.floor(more("known"))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), (F.col("base") + more("base")).alias("base_score"), (F.col("score") + more("score")).alias("score"))


_NAMES = ["key", "doc_id", "held_out", "n_tokens", "n_known", "base", "score", "one", "word", "n"]
