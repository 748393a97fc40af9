"""Retrieval measures: TF-IDF cosine, recall and nDCG."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import HARD_FOLDS, ODD_FOLDS, casefold_column, lowered, words_column
from ..tables import written
from .embedding import cosine

#: Fixed words that scores leave out.
STOP_WORDS = ("a", "an", "and", "are", "at", "be", "by", "do", "does", "for", "how", "in", "is", "it", "of", "on", "or", "the", "to", "what", "when", "where", "which", "with")


def tokens_column(text: Column) -> Column:
    """Folded runs of letters and digits but for stop words. A text is folded once; token by token only where folding moves their ends."""
    pattern, one = F.lit(r"[\p{L}\p{N}]+"), F.lit(0)
    whole = F.regexp_extract_all(casefold_column(text), pattern, one)
    each = F.transform(F.regexp_extract_all(text, pattern, one), casefold_column)
    hard = F.when(text.rlike("[" + ODD_FOLDS + "]"), each).otherwise(whole)
    found = F.when(text.rlike(HARD_FOLDS), hard).otherwise(F.regexp_extract_all(lowered(text), pattern, one))
    return F.filter(found, lambda t: ~t.isin(*STOP_WORDS))


def _weights(queries: DataFrame, texts: DataFrame, by: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """(by, query_id, token, qw) and (by, text_id, token, w) for the tokens of the queries: weights over the norm of their text. Terms are
    counted once and weighed once, where they lie unless a vocabulary is large; norms are of all tokens of a text."""
    n = texts.groupBy(*by).agg(F.count("*").alias("n_texts"))
    terms = lambda df, i: df.select(*by, i, F.explode(tokens_column(F.col("text"))).alias("token")).groupBy(*by, i, "token").agg(F.count("*").alias("tf"))
    q, t = written(terms(queries, "query_id"), "tfidf-queries"), written(terms(texts, "text_id"), "tfidf-texts")
    df = written(t.groupBy(*by, "token").agg(F.count("*").alias("df")), "tfidf-tokens")
    meet = lambda x: x.join(F.broadcast(n), list(by)) if by else x.crossJoin(F.broadcast(n))  # noqa: E731  # a row a group
    idf = lambda x: meet(x).withColumn("w", F.col("tf") * (F.log((F.col("n_texts") + 1.0) / (F.coalesce("df", F.lit(0)) + 1.0)) + 1.0))
    some = F.broadcast(df) if df.limit(200_001).count() <= 200_000 else df
    tw, qw = written(idf(t.join(some, [*by, "token"])).select(*by, "text_id", "token", "w"), "tfidf-all"), idf(q.join(some, [*by, "token"], "left"))
    norm = lambda x, i: x.groupBy(*by, i).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    asked = q.select(*by, "token").distinct()
    few = F.broadcast(asked) if asked.limit(200_001).count() <= 200_000 else asked
    own = tw.join(few, [*by, "token"], "left_semi").join(norm(tw, "text_id"), [*by, "text_id"]).select(*by, "text_id", "token", (F.col("w") / F.col("norm")).alias("w"))
    return qw.join(norm(qw, "query_id"), [*by, "query_id"]).select(*by, "query_id", "token", (F.col("w") / F.col("norm")).alias("qw")), own


def tfidf_scores(queries: DataFrame, texts: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, query_id, text_id, score) for all pairs that share a token. idf = ln((N + 1) / (df + 1)) + 1 over the texts, in the query too;
    with columns ``by`` each group of them is a collection of its own."""
    qw, tw = _weights(queries, texts, by)
    return qw.join(tw, [*by, "token"]).groupBy(*by, "query_id", "text_id").agg(F.sum(F.col("qw") * F.col("w")).alias("score"))


#: Weights of a stated query set that goes with the tasks, cells of its matrix, frequent tokens that are broadcast, texts scored at once.
ASKED, CELLS, FREQUENT, BLOCK = 200_000, 4_000_000, 200_000, 512


def packed_terms(texts: DataFrame) -> DataFrame:
    """(text_id, tokens, tfs): the distinct tokens of each row and how often it has them, counted where the text lies."""

    def run(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK):
                ids, lists = batch.slice(lo, BLOCK).columns
                words = lists.flatten().dictionary_encode()
                many = max(1, len(words.dictionary))
                cells, tfs = np.unique(pc.list_parent_indices(lists).to_numpy().astype(np.int64) * many + words.indices.to_numpy(), return_counts=True)
                at = pa.array(np.searchsorted(cells // many, np.arange(len(ids) + 1)).astype(np.int32))
                tokens = pa.ListArray.from_arrays(at, words.dictionary.take(pa.array(cells % many)))
                yield pa.RecordBatch.from_arrays([ids, tokens, pa.ListArray.from_arrays(at, pa.array(tfs.astype(np.int32)))], names=["text_id", "tokens", "tfs"])

    kind = texts.schema["text_id"].dataType.simpleString()
    return texts.select("text_id", tokens_column(F.col("text")).alias("tokens")).mapInArrow(run, f"text_id {kind}, tokens array<string>, tfs array<int>")


def tfidf_top(queries: DataFrame, texts: DataFrame, k: int, by: tuple[str, ...] = (), margin: float = 1e-5) -> DataFrame:
    """The rows of ``tfidf_scores`` that can be among the first k of their query, all within ``margin`` of these among them; exact.

    A stated query set (ASKED) goes with the tasks: blocks of texts, as rows of weights of the tokens that are asked, meet it in a matrix
    product, and each task keeps what comes near its own k-th best. Norms need all tokens: frequent ones are weighed by broadcast, only
    others are shuffled. Groups ``by`` and larger query sets take joins by bounds."""
    if by or k < 1:
        return _joined_top(queries, texts, k, by, margin)
    spark, number = texts.sparkSession, texts.count()
    if texts.groupBy("text_id").count().where("count > 1").limit(1).count():  # rows of one id are one text
        texts = texts.groupBy("text_id").agg(F.concat_ws("\n", F.collect_list("text")).alias("text"))
    packed = written(packed_terms(texts), "tfidf-packed")
    df = written(packed.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("df")), "tfidf-tokens")
    idf = F.log((F.lit(number) + 1.0) / (F.coalesce("df", F.lit(0)) + 1.0)) + 1.0
    terms = packed_terms(queries.withColumnRenamed("query_id", "text_id")).select("text_id", F.inline(F.arrays_zip("tokens", "tfs"))).groupBy("text_id", F.col("tokens").alias("token")).agg(F.sum("tfs").alias("tf"))
    asked = terms.join(df, "token", "left").select("text_id", "token", (F.col("tf") * idf).alias("w"), F.col("df").isNotNull().alias("met"), idf.alias("idf")).where("text_id is not null").limit(ASKED + 1).collect()
    ids, tokens = sorted({r["text_id"] for r in asked}), sorted({r["token"] for r in asked if r["met"]})
    if len(asked) > ASKED or len(ids) * len(tokens) > CELLS:
        return _joined_top(queries, texts, k, by, margin)
    row, column = ({x: n for n, x in enumerate(xs)} for xs in (tokens, ids))
    weights, rare, square = np.zeros((len(tokens), len(ids))), np.zeros(len(tokens)), np.zeros(len(ids))
    for r in asked:
        square[column[r["text_id"]]] += r["w"] ** 2
        if r["met"]:
            weights[row[r["token"]], column[r["text_id"]]], rare[row[r["token"]]] = r["w"], r["idf"]
    weights /= np.sqrt(np.maximum(square, 1e-300))
    often = F.broadcast(df.orderBy(F.desc("df"), "token").limit(FREQUENT))
    each = packed.select("text_id", F.inline(F.arrays_zip("tokens", "tfs"))).select("text_id", F.col("tokens").alias("token"), F.col("tfs").alias("tf"))
    part = lambda found: found.groupBy("text_id").agg(F.sum(F.pow(F.col("tf") * idf, F.lit(2.0))).alias("n"))
    norms = part(each.join(often, "token")).unionByName(part(each.join(often.select("token"), "token", "left_anti").join(df, "token")))
    norms = norms.groupBy("text_id").agg(F.sqrt(F.sum("n")).alias("norm"))
    sent = spark.sparkContext.broadcast((tokens, rare, weights))

    def run(batches):  # noqa: ANN001, ANN202
        own, factors, matrix = sent.value
        own, best = pa.array(own, pa.string()), np.zeros((k, matrix.shape[1]))
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK):
                found, words, tfs, norm = batch.slice(lo, BLOCK).columns
                at = pc.index_in(words.flatten(), value_set=own)
                here = at.is_valid().to_numpy(zero_copy_only=False)
                codes = at.fill_null(0).to_numpy()[here]
                block = np.zeros((len(found), len(own)))
                block[pc.list_parent_indices(words).to_numpy()[here], codes] = tfs.flatten().to_numpy()[here] * factors[codes]
                scores = block @ matrix / norm.to_numpy()[:, None]
                best = np.sort(np.concatenate([best, scores]), axis=0)[-k:] if len(scores) else best
                r, q = np.nonzero((scores > 0) & (scores >= best[0] - margin))
                if len(r):
                    yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int32)), found.take(pa.array(r)), pa.array(scores[r, q])], names=["q", "text_id", "score"])

    kind = {f.name: f.dataType.simpleString() for f in [*queries.schema.fields, *texts.schema.fields]}
    near = packed.join(norms, "text_id").mapInArrow(run, f"q int, text_id {kind['text_id']}, score double")
    names = spark.createDataFrame(list(enumerate(ids)), f"q int, query_id {kind['query_id']}")
    return near.join(F.broadcast(names), "q").select("query_id", "text_id", "score")  # a row a query that was asked


def _joined_top(queries: DataFrame, texts: DataFrame, k: int, by: tuple[str, ...], margin: float) -> DataFrame:
    """``tfidf_top`` by joins.

    A token can add no more to a score than its weight in the query times its largest weight in any text. Tokens are taken by that bound,
    largest first, until the rest of them together are below half of the query; scores over these alone give the k-th best a lower bound,
    and only texts that reach it with the most that the other tokens could add are scored in full. Postings of frequent tokens, which these
    mostly are, meet only such texts; a token's postings are spread over texts, not brought to one task.
    """
    qw, tw = (written(x, "tfidf-weights") for x in _weights(queries, texts, by))
    most = tw.groupBy(*by, "token").agg(F.max("w").alias("top"))
    bound = F.col("qw") * F.col("top")
    after = Window.partitionBy(*by, "query_id").orderBy(bound.desc(), "token")  # the tokens of one query
    ranked_tokens = qw.join(most, [*by, "token"]).select("*", bound.alias("bound"), F.sum(bound).over(after).alias("until"), F.sum(bound).over(Window.partitionBy(*by, "query_id")).alias("all"))
    tokens = written(ranked_tokens.select(*by, "query_id", "token", "qw", (F.col("until") - F.col("bound") < F.col("all") / 2).alias("lead"), (F.col("all") - F.col("until")).alias("left")), "tfidf-bounds")
    query, pair = [*by, "query_id"], [*by, "query_id", "text_id"]
    few = lambda df: F.broadcast(df) if df.limit(200_001).count() <= 200_000 else df
    meet = lambda part: tw.join(few(part), [*by, "token"]).groupBy(*pair).agg(F.sum(F.col("qw") * F.col("w")).alias("part"))
    lead = tokens.where("lead")
    some = written(meet(lead.select(*query, "token", "qw")), "tfidf-lead")
    first = some.withColumn("rank", F.row_number().over(Window.partitionBy(*query).orderBy(F.desc("part")))).where(F.col("rank") <= k)  # cut to k in each task
    least = first.groupBy(*query).agg(F.when(F.count("*") == k, F.min("part")).otherwise(0.0).alias("kth"))
    rest = lead.groupBy(*query).agg(F.min("left").alias("rest")).join(least, query)
    close = F.col("part") + F.col("rest") >= F.col("kth") - margin
    good = some.join(few(rest), query).where(close)
    # Texts without any of the first tokens count where the others alone reach the bound.
    other = tokens.where("not lead")
    alone = other.join(few(rest.where(F.col("rest") >= F.col("kth") - margin).select(*query)), query, "left_semi")
    wanted = written(good.select(*pair).unionByName(tw.join(few(alone.select(*query, "token")), [*by, "token"]).select(*pair)).distinct(), "tfidf-wanted")
    full = tw.join(few(other.select(*query, "token", "qw")), [*by, "token"]).join(wanted, pair, "left_semi").groupBy(*pair).agg(F.sum(F.col("qw") * F.col("w")).alias("more"))
    out = wanted.join(some, pair, "left").join(full, pair, "left")
    return out.select(*pair, (F.coalesce("part", F.lit(0.0)) + F.coalesce("more", F.lit(0.0))).alias("score"))


def holding(texts: DataFrame, passages: DataFrame, text_id: str, passage_id: str, width: int = 3) -> DataFrame:
    """(text_id, passage_id) of every text that holds a passage, case and white space apart. The words inside a passage, all but its first and
    last, are whole words of the text, so texts meet passages by their first ``width`` inner words, in a hash join, and are then compared;
    passages that are too short for that are a stated query set against all texts."""
    asked = passages.select(passage_id, plain(F.col("text")).alias("passage")).withColumn("w", F.split("passage", " "))
    asked = asked.withColumn("key", F.when(F.size("w") >= width + 2, F.array_join(F.slice("w", 2, width), " "))).drop("w")
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.size("v") - width + 1, F.lit(1))), lambda k: F.array_join(F.slice("v", k, width), " "))
    keyed, short = asked.where("key is not null"), asked.where("key is null").drop("key")
    few = lambda df, n=10_000: F.broadcast(df) if df.limit(n + 1).count() <= n else df
    # Ids alone go with a text's keys, as a text beside each of its keys would be as many copies as it has words.
    each = texts.select(F.col(text_id).alias("__id"), F.split(plain(F.col("text")), " ").alias("v")).select("__id", F.explode(grams).alias("key"))
    may = written(each.join(few(keyed), "key").select("__id", F.col(passage_id).alias("__pid"), "passage").distinct(), "holding-candidates")
    met = texts.join(few(may, 200_000), F.col(text_id).eqNullSafe(F.col("__id"))).select(text_id, F.col("__pid").alias(passage_id), "text", "passage")
    if short.limit(1).count():
        met = met.unionByName(texts.join(few(short), F.lit(True)).select(text_id, passage_id, "text", "passage"))
    return met.where(F.contains(plain(F.col("text")), F.col("passage"))).select(text_id, passage_id)


class EmbeddingScorer(Protocol):
    """What gives vectors for retrieval scores; a Provider is one."""

    def embed(self, texts: Sequence[str]) -> list[Sequence[float]]: ...


def embedding_scores(queries: DataFrame, texts: DataFrame, scorer: EmbeddingScorer, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, query_id, text_id, score) for all pairs inside a group: cosines of vectors in double precision."""

    @F.pandas_udf("array<double>")
    def embed(found: pd.Series) -> pd.Series:
        return pd.Series([list(map(float, v)) for v in scorer.embed(found.fillna("").tolist())])

    q = queries.select(*by, "query_id", embed("text").alias("qv"))
    t = texts.select(*by, "text_id", embed("text").alias("tv"))
    few = F.broadcast(q) if q.limit(10_001).count() <= 10_000 else q  # a stated query set against all rows
    both = t.join(few, list(by)) if by else t.join(few)
    return both.select(*by, "query_id", "text_id", cosine(F.col("qv"), F.col("tv")).alias("score"))


def ranked(scores: DataFrame, by: str, ties: list[str]) -> DataFrame:
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), *ties)))


def plain(text: Column) -> Column:
    """Case folded, one space between words."""
    return F.array_join(words_column(casefold_column(text)), " ")


def evidence(text: Column, passage: Column) -> Column:
    """Whether the text holds the passage, case and white space apart."""
    return F.contains(plain(text), plain(passage))


def recall_ndcg(found: DataFrame, by: str, k: int, ndcg_k: int | None = None) -> DataFrame:
    """(by, recall, ndcg) from (by, rank, relevant, total), the first rows of each ranking and how many relevant rows it has in all: the
    share of these among the first k, and nDCG at ``ndcg_k`` (k without it)."""
    gain, depth = F.col("relevant").cast("int"), ndcg_k or k
    dcg = F.sum(F.when(F.col("rank") <= depth, gain / F.log2(F.col("rank") + 1.0)).otherwise(0.0))
    grouped = found.groupBy(by).agg(F.max("total").alias("total"), F.sum(F.when(F.col("rank") <= k, gain).otherwise(0)).alias("hits"), dcg.alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(F.col("total"), F.lit(depth)), F.lit(1)).cast("int")), F.lit(0.0), lambda s, r: s + 1.0 / F.log2(r + 1.0))
    return grouped.select(by, F.when(F.col("total") > 0, F.least(F.lit(1.0), F.col("hits") / F.col("total"))).otherwise(0.0).alias("recall"), F.when(F.col("total") > 0, F.col("dcg") / ideal).otherwise(0.0).alias("ndcg"))


def first_ranked(scores: DataFrame, by: str, ties: list[str], most: int) -> DataFrame:
    """The first ``most`` rows of each ranking, with rank and total (relevant rows in all). Spark cuts each task's rows to ``most`` before
    they move; totals are aggregated."""
    totals = scores.groupBy(by).agg(F.sum(F.col("relevant").cast("int")).alias("total"))
    return ranked(scores, by, ties).where(F.col("rank") <= most).join(totals, by)


def evaluate(chunks: DataFrame, questions: DataFrame, k: int = 5, scorer: EmbeddingScorer | None = None) -> DataFrame:
    """How well chunks answer questions whose evidence is known, a row a (strategy, question_id): corpus, query, n_relevant, recall (at k),
    ndcg (at 10) and the first max(k, 10) chunks. ``chunks``: strategy, corpus, document_id, chunk_index, text; ``questions``: question_id,
    corpus, query, evidence (an array of passages). Scores are TF-IDF cosines over a corpus's chunks or, with a ``scorer``, those of its
    vectors. A question about an unknown corpus, or whose evidence no chunk holds, is an error."""
    if k < 1:
        raise ValueError("k must be positive")
    if (lost := questions.join(chunks.select("corpus").distinct(), "corpus", "left_anti").first()) is not None:
        raise ValueError(f"question {lost['question_id']!r} asks about an unknown corpus")
    group, key, most = ["strategy", "corpus"], F.struct("strategy", "query_id"), max(k, 10)
    texts = written(chunks.withColumn("text_id", F.struct("document_id", "chunk_index")), "retrieval-chunks")
    asked = questions.join(texts.select(*group).distinct(), "corpus")
    q = asked.select(*group, F.col("question_id").alias("query_id"), F.col("query").alias("text"))
    scored = tfidf_scores(q, texts, ("strategy", "corpus")) if scorer is None else embedding_scores(q, texts, scorer, ("strategy", "corpus"))
    passages = questions.select("corpus", F.col("question_id").alias("query_id"), F.posexplode("evidence").alias("nth", "text")).withColumn("pid", F.struct("query_id", "nth"))
    held = holding(texts.select(F.struct(*group, "text_id").alias("at"), "text"), passages.select("pid", "text"), "at", "pid")
    held = held.select("at.*", "pid.query_id").join(passages.select("corpus", "query_id").distinct(), ["corpus", "query_id"]).distinct().withColumn("relevant", F.lit(True))
    # Pairs with a score or with evidence; all other chunks score 0, and where those are among the first, the lowest ids are.
    same = [*group, "query_id", "text_id"]
    pairs = written(scored.join(held, same, "full").select(*same, F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("relevant", F.lit(False)).alias("relevant")), "retrieval-scores")
    full = pairs.where("score > 0").groupBy(*group, "query_id").agg(F.count("*").alias("n")).where(F.col("n") >= most)
    short = q.select(*group, "query_id").join(full, [*group, "query_id"], "left_anti")
    lowest = texts.select(*group, "text_id").withColumn("nth", F.row_number().over(Window.partitionBy(*group).orderBy("text_id"))).where(F.col("nth") <= most).drop("nth")
    fill = short.join(F.broadcast(lowest), group).join(pairs, same, "left_anti").select(*same, F.lit(0.0).alias("score"), F.lit(False).alias("relevant"))
    every = pairs.unionByName(fill).withColumn("key", key)
    top = first_ranked(every, "key", ["text_id"], most).join(texts.select(*group, "text_id", "text"), [*group, "text_id"])
    top = written(top, "retrieval-top")
    if (none := top.where("total = 0").first()) is not None:
        raise ValueError(f"strategy {none['strategy']!r} made no chunk that holds the evidence of question {none['query_id']!r}")
    shown = F.array_sort(F.collect_list(F.struct("rank", "text_id.document_id", "text_id.chunk_index", "text", "score", "relevant")))
    facts = top.groupBy("key").agg(F.first("corpus").alias("corpus"), F.max("total").alias("n_relevant"), shown.alias("top_chunks"))
    return facts.join(recall_ndcg(top, "key", k, 10), "key").select("key.strategy", F.col("key.query_id").alias("question_id"), "corpus", "n_relevant", "recall", "ndcg", "top_chunks")


def summary(results: DataFrame) -> DataFrame:
    """Mean recall and nDCG by strategy."""
    return results.groupBy("strategy").agg(F.count("*").alias("questions"), F.avg("recall").alias("recall"), F.avg("ndcg").alias("ndcg"))
