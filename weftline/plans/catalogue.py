"""Queries over the test tables, one or more an operator, each with the SQL that must give the same rows where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashing, text
from ..functions.hashing import sql_framed
from ..operators import chunking, churn, diff, embedding, merkle, retrieval
from ..sources import cache
from ..tables import scratch, spread, written
from . import index, manifest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
FIXED, OVERLAP = chunking.Fixed(48), chunking.Fixed(48, 12)
PRICE = 0.02


def query(sql: str | None = None):  # noqa: ANN201
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents")).select(F.col("doc_id").cast("string").alias("document_id"), "text", "source", "lang")


_COS = "list_dot_product(a.embedding::double[], b.embedding::double[]) / (sqrt(list_dot_product(a.embedding::double[], a.embedding::double[])) * sqrt(list_dot_product(b.embedding::double[], b.embedding::double[])))"


# The corpus before and after an edit: a source is withdrawn, a sentence is put before German documents, one source's metadata changes.
GONE, EDITED, TOUCHED, PREFIX = "src7", "de", "src1", "A sentence came first."


def revised(docs: DataFrame) -> DataFrame:
    return docs.where(F.col("source") != GONE).withColumn("text", F.when(F.col("lang") == EDITED, F.concat(F.lit(PREFIX + " "), "text")).otherwise(F.col("text")))


def occurrences(docs: DataFrame, touched: bool = False) -> DataFrame:
    facts = F.concat(F.lit('{"source":"'), "source", F.lit('"'), F.when((F.col("source") == TOUCHED) & F.lit(touched), ',"touched":1').otherwise(""), F.lit("}"))
    own = chunking.fixed_chunks_native(docs.withColumn("document_metadata", facts), FIXED, keep=("document_metadata",))
    return own.select("document_id", F.col("chunk_index").alias("position"), "chunk_hash", "text", F.col("start_word").cast("long").alias("start_offset"), F.col("end_word").cast("long").alias("end_offset"), F.col("token_count").cast("long").alias("token_count"), F.lit("{}").alias("metadata"), "document_metadata", *manifest.IDENTITY)


def both(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = documents(spark, sf_dir)
    old, new = occurrences(docs), occurrences(revised(docs), True)
    return written(old.drop("text"), "old"), written(new.drop("text"), "new")


_HASH = sql_framed("cairn-chunk-v1", "'cairn-chunk-identity-v1'", "'cairn-normalizer-v1'", "'fixed'", "'PARAMS'", "body")
_WORDS = r"""w as (select doc_id::varchar as document_id, source, lang, regexp_extract_all(text, '\S+') as ws from documents)"""


def _chunks(name: str, words: str, chunker: chunking.Fixed) -> str:
    size, stride = chunker.chunk_size_tokens, chunker.chunk_size_tokens - chunker.overlap_tokens
    return f"""{name}_r as (select *, unnest(range(0, greatest(ceil((len(ws) - {size}) / {stride})::bigint, 0) + 1)) as i from {words} where len(ws) > 0),
{name} as (select *, {_HASH.replace('PARAMS', chunker.params_hash)} as chunk_hash from (select document_id, source, lang, i::int as position, array_to_string(list_slice(ws, i * {stride} + 1, i * {stride} + {size}), ' ') as body,
  (i * {stride})::bigint as start_word, least(i * {stride} + {size}, len(ws))::bigint as end_word from {name}_r))"""


_NEW_WORDS = rf"""nw as (select document_id, source, lang, case when lang = '{EDITED}' then list_concat(string_split('{PREFIX}', ' '), ws) else ws end as ws from w where source <> '{GONE}')"""
_OCC = """{n}_occ as (select document_id, position, chunk_hash, start_word as start_offset, end_word as end_offset, end_word - start_word as token_count, {t} as touched from {n})"""
_BOTH = f"with {_WORDS}, {_chunks('o', 'w', FIXED)}, {_NEW_WORDS}, {_chunks('n', 'nw', FIXED)}, {_OCC.format(n='o', t='false')}, {_OCC.format(n='n', t=f'''source = '{TOUCHED}' ''')}"
_OPS = f"""{_BOTH},
a as (select *, row_number() over (partition by document_id, chunk_hash, start_offset, end_offset order by position) as nth from o_occ),
b as (select *, row_number() over (partition by document_id, chunk_hash, start_offset, end_offset order by position) as nth from n_occ),
f as (select coalesce(a.document_id, b.document_id) as document_id, coalesce(a.chunk_hash, b.chunk_hash) as chunk_hash, a.position as op, b.position as np, a.token_count as ot, b.token_count as nt, coalesce(b.touched, false) as touched,
  a.start_offset as os, b.start_offset as ns from a full join b on a.document_id = b.document_id and a.chunk_hash = b.chunk_hash and a.start_offset = b.start_offset and a.end_offset = b.end_offset and a.nth = b.nth),
x as (select *, row_number() over (partition by document_id, chunk_hash order by op) as k from f where np is null), y as (select *, row_number() over (partition by document_id, chunk_hash order by np) as k from f where op is null),
ops as (select case when touched then 'move' else 'keep' end as kind, document_id, chunk_hash, op, np, nt from f where op is not null and np is not null
  union all select case when x.op is null then 'add' when y.np is null then 'delete' else 'move' end, coalesce(x.document_id, y.document_id), coalesce(x.chunk_hash, y.chunk_hash), x.op, y.np, y.nt
  from x full join y on x.document_id = y.document_id and x.chunk_hash = y.chunk_hash and x.k = y.k)"""


@query(r"select doc_id, len(regexp_extract_all(text, '\S+'))::int as n_words, md5(array_to_string(regexp_extract_all(text, '\S+'), ' ')) as digest from documents")
def normalize_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.size(text.words_column(F.col("text"))).alias("n_words"), F.md5(text.normalized_column(F.col("text"))).alias("digest"))


@query(r"""select doc_id, len(list_filter(regexp_extract_all(text, '\S+'), lambda x: regexp_matches(x, '[.!?]["''\)\]\}]*$')))::int as n from documents""")
def sentence_break_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.size(F.filter(text.words_column(F.col("text")), text.sentence_break_column)).alias("n"))


def _fixed(chunker: chunking.Fixed) -> tuple[Callable, str]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        own = chunking.fixed_chunks_native(documents(spark, sf_dir), chunker)
        return own.select("document_id", F.col("chunk_index").alias("position"), "chunk_hash", F.col("start_word").cast("long").alias("start_word"), F.col("end_word").cast("long").alias("end_word"))

    return run, f"with {_WORDS}, {_chunks('c', 'w', chunker)} select document_id, position, chunk_hash, start_word, end_word from c"


QUERIES["fixed_chunks"], SQL["fixed_chunks"] = _fixed(FIXED)
QUERIES["fixed_chunks_overlap"], SQL["fixed_chunks_overlap"] = _fixed(OVERLAP)


@query(SQL["fixed_chunks_overlap"])
def fixed_chunks_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The general kernel, which also knows paragraphs, NFC and token counters, cuts this data as the expressions in the JVM do."""
    own = chunking.chunk_documents(documents(spark, sf_dir), OVERLAP)
    return own.select("document_id", F.col("chunk_index").alias("position"), "chunk_hash", F.col("start_word").cast("long").alias("start_word"), F.col("end_word").cast("long").alias("end_word"))


@query("""with t as (select conv_id, turn, list_distinct(regexp_extract_all(replace(lower(text), 'ß', 'ss'), '\\S+')) as ws from conversations)
select a.conv_id, a.turn, round(case when len(a.ws) + len(b.ws) = 0 then 1 else len(list_intersect(a.ws, b.ws)) / len(list_distinct(list_concat(a.ws, b.ws))) end, 9) as similarity from t a join t b on a.conv_id = b.conv_id and b.turn = a.turn + 1""".replace("\\\\S", "\\S"))
def jaccard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_distinct(text.words_column(text.casefold_column(F.col("text")))).alias("ws"))
    after = t.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("ws").alias("next"))
    union = F.size(F.array_union("ws", "next"))
    return t.join(after, ["conv_id", "turn"]).select("conv_id", "turn", F.round(F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect("ws", "next")) / union), 9).alias("similarity"))


_STRATEGIES: dict[str, chunking.Chunker] = {"cdc": chunking.CDC(), "cdc_snap": chunking.CDC(chunking.CDCParams().snapping()), "recursive": chunking.Recursive(), "semantic": chunking.Semantic()}
_COVERAGE = r"""select doc_id::varchar as document_id, len(regexp_extract_all(text, '\S+'))::bigint as tokens, (length(text) - length(regexp_replace(text, '^\s+', '')))::bigint as first_offset, length(regexp_replace(text, '\s+$', ''))::bigint as last_offset, true as gapless
from documents where regexp_matches(text, '\S')"""


def _chunked(name: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return chunking.chunk_documents(documents(spark, sf_dir), _STRATEGIES[name])

    def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
        words = F.sum(F.col("end_word") - F.col("start_word"))
        return run(spark, sf_dir).groupBy("document_id").agg(F.sum("token_count").alias("tokens"), F.min("start_offset").alias("first_offset"), F.max("end_offset").alias("last_offset"), (words == F.max("end_word") - F.min("start_word")).alias("gapless"))

    QUERIES[f"{name}_chunks"], QUERIES[f"{name}_coverage"], SQL[f"{name}_coverage"] = run, coverage, _COVERAGE


for _name in _STRATEGIES:
    _chunked(_name)


_RECURSIVE = _STRATEGIES["recursive"]
_CUTS = rf"""with recursive {_WORDS}, s as (select document_id, ws, len(ws) as n, list_filter(range(1, len(ws) + 1), lambda p: regexp_matches(ws[p], '[.!?](?:["'')\]}}]+)?$')) as sb from w where len(ws) > 0),
cuts(document_id, ws, n, sb, position, a, b) as (
  select document_id, ws, n, sb, 0, 0::bigint, case when n <= {_RECURSIVE.max_tokens} then n else coalesce(list_max(list_filter(sb, lambda p: p <= {_RECURSIVE.max_tokens})), {_RECURSIVE.max_tokens}) end::bigint from s
  union all
  select document_id, ws, n, sb, position + 1, b, case when n <= b + {_RECURSIVE.max_tokens} then n else coalesce(list_max(list_filter(sb, lambda p: p > b and p <= b + {_RECURSIVE.max_tokens})), b + {_RECURSIVE.max_tokens}) end::bigint from cuts where b < n)
select document_id, position, a as start_word, b as end_word, {sql_framed("cairn-chunk-v1", "'cairn-chunk-identity-v1'", "'cairn-normalizer-v1'", "'recursive'", f"'{_RECURSIVE.params_hash}'", "array_to_string(list_slice(ws, a + 1, b), ' ')")} as chunk_hash from cuts"""


@query(_CUTS)
def recursive_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = QUERIES["recursive_chunks"](spark, sf_dir)
    return own.select("document_id", F.col("chunk_index").alias("position"), F.col("start_word").cast("long").alias("start_word"), F.col("end_word").cast("long").alias("end_word"), "chunk_hash")


@query()
def chunk_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk_stats(QUERIES["cdc_chunks"](spark, sf_dir))


def _climb(leaves: str) -> str:
    """Merkle levels over ``leaves`` (k: the tree, i: the leaf's number from 0, v: its value) as CTEs; the roots are the rows of lv with n = 1."""
    node = sql_framed("cairn-merkle-node-v1", "max(h) filter (i % 2 = 0)", "coalesce(max(h) filter (i % 2 = 1), '')")
    return f"""lv(k, n, i, h) as (select k, count(*) over (partition by k), i, {sql_framed("cairn-merkle-leaf-v1", "v")} from ({leaves})
  union all select k, max((n + 1) // 2), i // 2, {node} from lv where n > 1 group by k, i // 2)"""


_FIXED_CUTS = f"{_WORDS}, {_chunks('c', 'w', FIXED)}"


@query(f"with recursive {_FIXED_CUTS}, {_climb('select document_id as k, position::bigint as i, chunk_hash as v from c')} select k as document_id, h as root_hash, (select count(*) from c where c.document_id = k)::int as chunk_count from lv where n = 1")
def document_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.document_roots(QUERIES["fixed_chunks"](spark, sf_dir))


_ROOT_LEAVES = sql_framed("cairn-corpus-document-v1", "document_id", "root_hash")


@query(f"""with recursive r as (from ({SQL['document_roots']})), {_climb(f"select 0 as k, row_number() over (order by document_id) - 1 as i, {_ROOT_LEAVES} as v from r")} select h as corpus_root from lv where n = 1""")
def corpus_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(merkle.corpus_root(document_roots(spark, sf_dir)),)], "corpus_root string")


@query(f"{_BOTH} select coalesce(o.document_id, n.document_id) as document_id, coalesce(o.position, n.position) as position from o full join n on o.document_id = n.document_id and o.position = n.position where o.chunk_hash is distinct from n.chunk_hash")
def merkle_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.merkle_diff(*both(spark, sf_dir))


@query(f"{_OPS} select kind, document_id, chunk_hash, op as old_position, np as new_position from ops")
def occurrence_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.occurrence_diff(*both(spark, sf_dir)).select("kind", "document_id", "chunk_hash", "old_position", "new_position")


@query(f"{_OPS} select k.kind, count(ops.kind) as n from (values ('keep'), ('move'), ('add'), ('delete')) k(kind) left join ops using (kind) group by 1")
def op_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.op_counts(diff.occurrence_diff(*both(spark, sf_dir)))


_COST = """, wanted as ({wanted}), cached as (select distinct chunk_hash from o_occ where chunk_hash < '4'),
u as (select chunk_hash, arg_min(token_count, (document_id, position)) as token_count from wanted group by 1), c as (select u.*, cached.chunk_hash is not null as hit from u left join cached using (chunk_hash)),
naive as ({naive}),
r as (select (select count(*) from c where hit) as cache_hits, (select count(*) from c where not hit) as chunks_to_embed, (select coalesce(sum(token_count) filter (not hit), 0)::bigint from c) as tokens_to_embed,
  (select count(*) from naive) as naive_chunks_to_embed, (select coalesce(sum(token_count), 0)::bigint from naive) as naive_tokens_to_embed)
select *, round(tokens_to_embed * {price} / 1e6, 12) as estimated_cost, round(naive_tokens_to_embed * {price} / 1e6, 12) as naive_estimated_cost, greatest(naive_chunks_to_embed - chunks_to_embed, 0) as avoided_embeddings from r"""
_ADDS = "select chunk_hash, nt as token_count, document_id, np as position from ops where kind = 'add' and chunk_hash not in (select chunk_hash from o_occ)"


def _cost(spark: SparkSession, sf_dir: str, embed_all: bool) -> DataFrame:
    old, new = both(spark, sf_dir)
    cached = old.where("chunk_hash < '4'").select("chunk_hash")
    out = diff.plan_cost(old, new, diff.occurrence_diff(old, new), cached, PRICE, embed_all)
    return out.withColumns({c: F.round(c, 12) for c in ("estimated_cost", "naive_estimated_cost")})


@query(_OPS + _COST.format(wanted=_ADDS, naive="select n_occ.* from n_occ semi join (select document_id from ops where kind <> 'keep') using (document_id)", price=PRICE))
def plan_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cost(spark, sf_dir, False)


@query(_OPS + _COST.format(wanted="select * from n_occ", naive="select * from n_occ", price=PRICE))
def plan_cost_embed_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cost(spark, sf_dir, True)


@query(f"""{_BOTH}, d as (select distinct document_id from (select document_id, position, chunk_hash, touched from o_occ union all select document_id, position, chunk_hash, touched from n_occ) group by document_id, position, chunk_hash, touched having count(*) % 2 = 1)
select count(*) as changed, count(*) > 0 as edited, false as unchanged from d""")
def requires_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents an edit changes, and whether that and no edit need a new generation."""
    old, new = both(spark, sf_dir)
    changed = diff.changed_documents(old, new).agg(F.count("*").alias("changed"))
    return changed.withColumns({"edited": F.lit(diff.requires_apply(old, new)), "unchanged": F.lit(diff.requires_apply(old, old))})


_ID = "substr(sha256('cairn:instance:v1\\x00'::blob || encode('{scope}') || '\\x00'::blob || encode('root') || '\\x00'::blob || encode(document_id) || '\\x00'::blob || encode({pos}::varchar) || '\\x00'::blob || encode(chunk_hash) || '\\x00'::blob), 1, 32)"


@query(f"{_OPS} select document_id, np as position, chunk_hash, case when op is null then {_ID.format(scope='two', pos='np')} else {_ID.format(scope='one', pos='op')} end as instance_id, op is not null as carried from ops where kind <> 'delete'")
def identity_carryover(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = both(spark, sf_dir)
    ids = hashing.instance_id_column(F.lit("one"), F.lit("root"), F.col("document_id"), F.col("position"), F.col("chunk_hash"))
    return index.carried_ids(diff.occurrence_diff(old, new), old.withColumn("instance_id", ids), "root", "two")


def _generation(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Chunk rows of the generation after the edit: deleted occurrences are tombstones of the first day, later by their position."""
    old, new = both(spark, sf_dir)
    ops = diff.occurrence_diff(old, new)
    live = new.select("document_id", "position", "chunk_hash", F.lit(None).cast("timestamp").alias("valid_to"))
    day = F.expr("timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, old_position)")
    gone = ops.where("kind = 'delete'").select("document_id", F.col("old_position").alias("position"), "chunk_hash", day.alias("valid_to"))
    docs = new.groupBy("document_id").agg(F.count("*").cast("int").alias("chunk_count"), F.count_if(F.col("token_count") < 10).cast("int").alias("hard_cuts"))
    return live.unionByName(gone), docs


@query(f"{_OPS} select document_id, op as position, chunk_hash from ops where kind = 'delete'")
def tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _generation(spark, sf_dir)[0].where("valid_to is not null").drop("valid_to")


@query(f"""{_OPS}, d as (select document_id, count(*) as c, count(*) filter (token_count < 10) as h from n_occ group by 1)
select (select count(*) from n_occ) as active_chunks, (select count(*) from ops where kind = 'delete') as tombstones, count(*) as document_count, sum(h)::bigint as hard_cuts, sum(greatest(c - 1, 0))::bigint as boundaries, round(case when sum(greatest(c - 1, 0)) > 0 then sum(h) / sum(greatest(c - 1, 0)) else 0 end, 9) as hard_cut_rate from d""")
def index_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.status(*_generation(spark, sf_dir)).withColumn("hard_cut_rate", F.round("hard_cut_rate", 9))


@query(f"{_OPS} select document_id, op as position from ops where kind = 'delete' and op <= 2")
def compact_eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _generation(spark, sf_dir)[0].where("valid_to <= timestamp'2024-01-03 00:00:00'").select("document_id", "position")


@query(f"""{_BOTH}, act as (select document_id, position, case when position = 1 then 'x' || chunk_hash else chunk_hash end as chunk_hash, start_offset, end_offset, token_count from o_occ where position <> 3
  union all select document_id, 9999, chunk_hash, start_offset, end_offset, token_count from o_occ where position = 2)
select coalesce(e.document_id, a.document_id) as document_id, coalesce(e.position, a.position) as position, case when a.document_id is null then 'position not indexed' when e.document_id is null then 'position not in the manifest' else 'other chunk_hash' end as problem
from o_occ e full join act a on e.document_id = a.document_id and e.position = a.position where a.document_id is null or e.document_id is null or a.chunk_hash <> e.chunk_hash""")
def verify_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = both(spark, sf_dir)[0]
    bad = good.where("position <> 3").withColumn("chunk_hash", F.when(F.col("position") == 1, F.concat(F.lit("x"), "chunk_hash")).otherwise(F.col("chunk_hash")))
    return index.problems(good, bad.unionByName(good.where("position = 2").withColumn("position", F.lit(9999))))


_PROVIDER = embedding.HashProvider("catalogue", 16)


def _applied(spark: SparkSession, sf_dir: str) -> index.Index:
    """An index in the shared folder to which the corpus was applied before and after the edit."""
    ix, docs = index.Index(spark, scratch(spark, "catalogue-index")), documents(spark, sf_dir)
    for target in (occurrences(docs), occurrences(revised(docs), True)):
        ix.apply(target, _PROVIDER)
    return ix


@query(f"""{_OPS}, kept as (select document_id, np as position, chunk_hash, true as active from ops where kind <> 'delete') select * from kept union all select document_id, op, chunk_hash, false from ops where kind = 'delete'""")
def index_generation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the second generation, tombstones among them."""
    return _applied(spark, sf_dir).rows().select("document_id", "position", "chunk_hash", F.col("valid_to").isNull().alias("active"))


@query(f"""{_BOTH}, t as (select document_id, position, token_count from n_occ) select document_id, position, 'other token_count' as problem from t where position = 1 union all select document_id, position, 'position not indexed' from t where position = 9999
union all select document_id, 9999, 'position not indexed' from t where position = 2""")
def index_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index, which nobody tampered with, against sources of which one chunk has other tokens and one more is there."""
    now = occurrences(revised(documents(spark, sf_dir)), True)
    more = now.where("position = 2").withColumn("position", F.lit(9999))
    return _applied(spark, sf_dir).verify(now.withColumn("token_count", F.col("token_count") + (F.col("position") == 1).cast("int")).unionByName(more))


_LINE = """'{"document_id":"' || doc_id || '","metadata":{"source":"' || source || '"}}'"""


@query(f"""select doc_id::varchar as document_id, case when source = '{GONE}' then 'no mirror of the manifest' else 'mirror has another manifest' end as problem from documents where source in ('{GONE}', '{TOUCHED}')
union all select null, 'mirror of the manifest unreadable' where exists (select * from documents where lang = '{EDITED}' and source not in ('{GONE}', '{TOUCHED}')) union all select doc_id::varchar, 'no mirror of the manifest' from documents where lang = '{EDITED}' and source not in ('{GONE}', '{TOUCHED}')""")
def manifest_mirror(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest's mirror of which lines are lost, say something else, or are torn."""
    docs = documents(spark, sf_dir)
    line = lambda meta: F.to_json(F.struct("document_id", F.struct(meta.alias("source")).alias("metadata")))
    whole = docs.select(line(F.col("source")).alias("value"))
    kept = docs.where(F.col("source") != GONE)
    other = F.when(F.col("source") == TOUCHED, line(F.lit("x"))).when(F.col("lang") == EDITED, F.left(line(F.col("source")), F.lit(20))).otherwise(line(F.col("source")))
    return index.mirror_problems(whole, kept.select(other.alias("value")))


@query(f"""with b as (select vec_id, {_COS} as s from (select * from embeddings order by vec_id limit 1) a, embeddings b),
r as (select event_id, user_id, event_id % (select count(*) from embeddings) as vec_id from events where event_type <> 'click')
select user_id, event_id, vec_id, round(s, 6) as score from (select user_id, event_id, r.vec_id, s from r join b using (vec_id) order by s desc, user_id, event_id limit 100)""".replace("select vec_id,", "select b.vec_id,", 1))
def vector_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest rows to a vector where rows share bodies: with ties, and with bodies that no row needs."""
    bodies = table(spark, sf_dir, "embeddings")
    vector, n = bodies.orderBy("vec_id").first()["embedding"], bodies.count()
    rows = table(spark, sf_dir, "events").where("event_type <> 'click'").select("event_id", "user_id", F.pmod("event_id", F.lit(n)).cast("string").alias("chunk_hash"))
    out = embedding.late_top_k(bodies.select(F.col("vec_id").cast("string").alias("chunk_hash"), F.col("embedding").alias("vector")), rows, vector, 100, ["user_id", "event_id"])
    return out.select("user_id", "event_id", F.col("chunk_hash").cast("long").alias("vec_id"), F.round("score", 6).alias("score"))


_META, _BARE = "'{\"source\":\"' || source || '\"}'", '"metadata":{}'
_CHUNK_JSON = f"""'{{"chunk_hash":"' || chunk_hash || '","end_offset":' || end_word || ',{_BARE},"start_offset":' || start_word || ',"token_count":' || (end_word - start_word) || '}}'"""


@query(f"""with recursive {_FIXED_CUTS}, {_climb('select document_id as k, position::bigint as i, chunk_hash as v from c')}, r as (select k, h from lv where n = 1),
j as (select document_id, source, string_agg({_CHUNK_JSON}, ',' order by position) as cs from c group by 1, 2)
select document_id, md5('{{"chunker_id":"fixed","chunker_params_hash":"{FIXED.params_hash}","chunks":[' || cs || '],"document_id":"' || document_id || '","metadata":' || {_META} || ',"normalizer_version":"cairn-normalizer-v1","root_hash":"' || h || '","schema_version":1}}') as digest from j join r on r.k = document_id""")
def manifest_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = written(occurrences(documents(spark, sf_dir)).drop("text"), "manifest")
    return manifest.to_json(manifest.documents(rows), rows).select("document_id", F.md5("json").alias("digest"))


@query(f"""with d as (select doc_id::varchar as document_id, source, lang from documents where regexp_matches(text, '\\S'))
select document_id, 'document not indexed' as problem from d where source = '{GONE}' union all select document_id, 'other document metadata' from d where source = '{TOUCHED}' union all select document_id, 'other root hash' from d where lang = '{EDITED}' and source <> '{GONE}'
union all select document_id, 'other number of chunks' from d where lang = 'fr' and source <> '{GONE}' union all select document_id, 'other number of hard cuts' from d where lang = 'fr' and source <> '{GONE}' union all select 'another', 'document not in the manifest'""")
def verify_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest against documents of which some were withdrawn, changed or added."""
    docs = documents(spark, sf_dir)
    good = written(manifest.documents(occurrences(docs).drop("text")), "verify-documents").join(docs.select("document_id", "source", "lang"), "document_id")
    changed = {"root_hash": F.when(F.col("lang") == EDITED, "x").otherwise(F.col("root_hash")), "metadata": F.when(F.col("source") == TOUCHED, '{"source":"other"}').otherwise(F.col("metadata"))}
    changed |= {c: F.col(c) + (F.col("lang") == "fr").cast("int") for c in ("chunk_count", "hard_cuts")}
    bad = good.where(F.col("source") != GONE).withColumns(changed)
    more = bad.limit(1).withColumn("document_id", F.lit("another"))
    return index.document_problems(good, bad.unionByName(more))


@query(f"""{_BOTH}, t as (select document_id, position from o_occ)
select document_id, position, unnest(case when position = 0 then ['hash is not that of the text', 'other record digest'] when position = 1 then ['vector unusable'] when position = 2 then ['vector of other length', 'other record digest'] when position = 3 then ['other record digest']
  when position = 4 then ['other token_count in metadata', 'other metadata', 'other record digest'] when position = 5 then ['embedded by another model', 'other record digest'] when position = 6 then ['metadata unreadable', 'other record digest'] else [] end) as problem from t""")
def verify_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active rows of which text, vector, metadata or identity were changed, by position, against their manifest."""
    rows = occurrences(documents(spark, sf_dir)).withColumns({"instance_id": F.concat_ws(":", "document_id", "position"), "model_id": F.lit("m"), "params_hash": F.lit("p"), "vector": F.array(*(F.lit(x).cast("float") for x in (0.5, -0.25)))})
    good = written(rows.withColumn("record_digest", index.record_digest()), "verify-content")
    at = lambda n, new, c: F.when(F.col("position") == n, new).otherwise(F.col(c))
    floats = lambda *xs: F.array(*(F.lit(x).cast("float") for x in xs))
    vector = F.when(F.col("position") == 1, floats(float("nan"), 1.0)).when(F.col("position") == 2, floats(1.0)).when(F.col("position") == 3, floats(0.5, 0.25)).otherwise(F.col("vector"))
    metadata = F.when(F.col("position") == 4, '{"token_count":-1,"x":2}').when(F.col("position") == 6, "[1]").otherwise(F.col("metadata"))
    bad = good.withColumns({"text": at(0, F.concat("text", F.lit(" ")), "text"), "vector": vector, "metadata": metadata, "model_id": at(5, F.lit("other"), "model_id")})
    return index.content_problems(good, bad.drop(*manifest.IDENTITY), "m", "p", 2)


@query(f"with {_WORDS}, {_chunks('c', 'w', FIXED)} select distinct chunk_hash, chunk_hash < '8' as hit_before, true as hit_after from c")
def cache_write_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a cache holds before and after all chunks were embedded through it, half of them having been there."""
    store = cache.Cache(spark, scratch(spark, "catalogue-cache"))
    wanted = written(embedding.distinct_inputs(chunking.fixed_chunks_native(documents(spark, sf_dir), FIXED)), "catalogue-wanted")
    embedding.embed_with_cache(wanted.where("chunk_hash < '8'"), _PROVIDER, store)
    keys = wanted.select("chunk_hash", F.lit(_PROVIDER.model_id).alias("model_id"), F.lit(_PROVIDER.params_hash).alias("params_hash"))
    before = written(store.contains(keys).select("chunk_hash", F.col("hit").alias("hit_before")), "catalogue-before")
    embedding.embed_with_cache(wanted, _PROVIDER, store)
    return before.join(store.contains(keys).select("chunk_hash", F.col("hit").alias("hit_after")), "chunk_hash")


_CACHE = "c as (select sha256('v' || vec_id) as chunk_hash, case when label % 2 = 0 then 'hash:a' else 'hash:b' end as model_id, 'p' as params_hash, len(embedding)::int as dimensions, e.ts as accessed_at, label from embeddings v join events e on e.event_id = v.vec_id)"


def _cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, e = table(spark, sf_dir, "embeddings"), table(spark, sf_dir, "events").select("event_id", F.col("ts").alias("accessed_at"))
    own = v.join(e, v["vec_id"] == e["event_id"])
    return own.select(F.sha2(F.concat(F.lit("v"), "vec_id"), 256).alias("chunk_hash"), F.when(F.col("label") % 2 == 0, "hash:a").otherwise("hash:b").alias("model_id"), F.lit("p").alias("params_hash"), F.size("embedding").alias("dimensions"), F.col("embedding").alias("vector"), F.lit(1).cast("long").alias("token_count"), "accessed_at", "label")


@query(f"with {_CACHE} select count(*) as entries, count(distinct chunk_hash) as chunks, count(distinct model_id || ':' || params_hash) as models, (sum(dimensions) * 4)::bigint as bytes from c")
def cache_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cache.stats(_cache(spark, sf_dir))


@query(f"with {_CACHE}, k as (select distinct sha256('v' || event_id) as chunk_hash, 'hash:a' as model_id, 'p' as params_hash from events) select k.*, c.dimensions is not null as hit from k left join c using (chunk_hash, model_id, params_hash)")
def cache_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = table(spark, sf_dir, "events").select(F.sha2(F.concat(F.lit("v"), "event_id"), 256).alias("chunk_hash"), F.lit("hash:a").alias("model_id"), F.lit("p").alias("params_hash"))
    return cache.lookup(_cache(spark, sf_dir), keys).select(*cache.KEY, F.col("vector").isNotNull().alias("hit"))


@query(f"with {_CACHE} select chunk_hash, model_id, params_hash from c where accessed_at >= (select max(accessed_at) from c) - interval 1 day")
def cache_prune_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _cache(spark, sf_dir)
    newest = rows.agg(F.max("accessed_at").alias("m")).first()["m"]
    return cache.prune_age(rows, F.lit(newest) - F.expr("interval 1 day")).select(*cache.KEY)


@query(f"with {_CACHE} select chunk_hash, model_id, params_hash from c order by accessed_at desc, chunk_hash desc, model_id desc limit 100")
def cache_prune_lru(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cache.prune_lru(_cache(spark, sf_dir), 100).select(*cache.KEY)


@query(f"""{_OPS}, u as (select chunk_hash, count(*) as n from n_occ group by 1) select chunk_hash, n, chunk_hash in (select chunk_hash from o_occ) as reused from u""")
def embed_dedupe_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = both(spark, sf_dir)
    have = old.select("chunk_hash").distinct().withColumn("reused", F.lit(True))
    return new.groupBy("chunk_hash").agg(F.count("*").alias("n")).join(have, "chunk_hash", "left").withColumn("reused", F.coalesce("reused", F.lit(False)))




@query(f"select vec_id, round(s, 6) as score from (select b.vec_id, {_COS} as s from (select * from embeddings order by vec_id limit 1) a, embeddings b order by s desc, vec_id limit 10)")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    vector = rows.orderBy("vec_id").first()["embedding"]
    return embedding.top_k(rows, vector, 10, ["vec_id"], "embedding").select("vec_id", F.round("score", 6).alias("score"))


def _searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose id is divisible by 100 against all others: the first ten of each, with rank, relevant and total (others of the
    same label)."""
    rows = spread(table(spark, sf_dir, "embeddings"))
    asked = rows.where("vec_id % 100 = 0")
    found = embedding.nearest(rows, asked, 10, "vec_id", "label", "embedding").withColumn("relevant", F.col("qfact") == F.col("label"))
    alike = rows.where("vec_id is not null").groupBy("label").agg(F.count("*").alias("n"))
    own = asked.groupBy(F.col("vec_id").alias("q"), "label").agg(F.count("*").alias("copies"))
    # A query's own rows are none of its others; rows of one id and several labels ask for each.
    totals = own.join(alike, "label", "left").groupBy("q").agg(F.sum(F.col("copies") * (F.coalesce("n", F.col("copies")) - F.col("copies"))).alias("total"))
    return retrieval.ranked(found, "q", ["vec_id"]).where("rank <= 10").join(totals, "q")


@query(f"""with s as (select a.vec_id as q, b.vec_id, round({_COS}, 9) as score, (a.label = b.label)::int as g from embeddings a join embeddings b on a.vec_id <> b.vec_id where a.vec_id % 100 = 0),
r as (select *, row_number() over (partition by q order by score desc, vec_id) as rank from s), t as (select q, sum(g)::bigint as total, (sum(g) filter (rank <= 10))::bigint as hits, sum(g / log2(rank + 1)) filter (rank <= 10) as dcg from r group by q)
select q, round(case when total > 0 then least(1, hits / total) else 0 end, 9) as recall, round(case when total > 0 then dcg / list_sum(list_transform(range(1, (least(total, 10) + 1)::bigint), lambda i: 1 / log2(i + 1))) else 0 end, 9) as ndcg from t""")
def recall_ndcg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.recall_ndcg(_searches(spark, sf_dir), "q", 10).select("q", F.round("recall", 9).alias("recall"), F.round("ndcg", 9).alias("ndcg"))


def _hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents")).select(F.col("doc_id").cast("string").alias("chunk_hash"), "text", F.lit(1).alias("token_count"))
    return embedding.embed_texts(docs, embedding.HashProvider()).select(F.col("chunk_hash").cast("long").alias("doc_id"), "vector")


@query()
def hash_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hashed(spark, sf_dir)


@query(r"select doc_id, case when regexp_matches(text, '[\p{L}\p{N}]') then 1.0 else 0.0 end::double as norm, 256 as dimensions from documents")
def hash_embedding_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, v: s + v.cast("double") * v))
    return _hashed(spark, sf_dir).select("doc_id", F.round(norm, 4).alias("norm"), F.size("vector").alias("dimensions"))


_STOP = ", ".join(f"'{w}'" for w in retrieval.STOP_WORDS)


def _terms(name: str, key: str, source: str) -> str:
    return rf"{name} as (select {key} as k, t, count(*) as tf from (select {key}, unnest(regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\p{{L}}\p{{N}}]+')) as t from {source}) where t not in ({_STOP}) group by 1, 2)"


@query(f"""with {_terms('q', 'item_id', 'benchmark')}, {_terms('d', 'doc_id', 'documents')}, df as (select t, count(*) as df from d group by 1), n as (select count(*) as n from documents),
dw as (select k, t, tf * (ln((n + 1.0) / (df + 1.0)) + 1) as w from d join df using (t), n), qw as (select k, t, tf * (ln((n + 1.0) / (coalesce(df, 0) + 1.0)) + 1) as w from q left join df using (t), n),
dn as (select k, sqrt(sum(w * w)) as norm from dw group by 1), qn as (select k, sqrt(sum(w * w)) as norm from qw group by 1),
s as (select qw.k as item_id, dw.k as doc_id, sum(qw.w * dw.w) as dot from qw join dw using (t) group by 1, 2), r as (select item_id, doc_id, round(dot / (qn.norm * dn.norm), 6) as score from s join qn on qn.k = item_id join dn on dn.k = doc_id)
select * from (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from r) where rank <= 5""")
def tfidf_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    t = spread(table(spark, sf_dir, "documents")).select(F.col("doc_id").alias("text_id"), "text")
    scores = retrieval.tfidf_top(q, t, 5).withColumn("score", F.round("score", 6))
    return retrieval.ranked(scores, "query_id", ["text_id"]).where("rank <= 5").select(F.col("query_id").alias("item_id"), F.col("text_id").alias("doc_id"), "score", F.col("rank").cast("long").alias("rank"))


@query(r"""select item_id, count(*) as n_docs from benchmark b, documents d where contains(regexp_replace(trim(replace(lower(d.text), 'ß', 'ss')), '\s+', ' ', 'g'), regexp_replace(trim(replace(lower(b.text), 'ß', 'ss')), '\s+', ' ', 'g')) group by 1""")
def evidence_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    passages = table(spark, sf_dir, "benchmark").select("item_id", "text")
    return retrieval.holding(spread(table(spark, sf_dir, "documents")).select("doc_id", "text"), passages, "doc_id", "item_id").groupBy("item_id").agg(F.count("*").alias("n_docs"))


@query(f"""{_BOTH}, a as (select chunk_hash, count(*) as o from o_occ group by 1), b as (select chunk_hash, count(*) as n, min(token_count) as t from n_occ group by 1),
f as (select coalesce(o, 0) as o, coalesce(n, 0) as n, coalesce(t, 0) as t from a full join b using (chunk_hash)),
r as (select sum(o)::bigint as old_chunks, sum(n)::bigint as new_chunks, sum(least(o, n))::bigint as reused, sum(greatest(o - n, 0))::bigint as removed, sum(greatest(n - o, 0))::bigint as to_embed, sum(greatest(n - o, 0) * t)::bigint as tokens_to_embed from f)
select *, round(to_embed / new_chunks, 9) as reembed_fraction, round(tokens_to_embed * {PRICE} / 1e6, 12) as estimated_cost from r""")
def churn_bag(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = churn.bag_churn(*both(spark, sf_dir), PRICE)
    return out.withColumns({"reembed_fraction": F.round("reembed_fraction", 9), "estimated_cost": F.round("estimated_cost", 12)})


def _edit(name: str, sql: str | None = None, derived: Callable[[], Column] = lambda: F.col("text")) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = churn.edited(spread(table(spark, sf_dir, "documents")).select("doc_id", derived().alias("text")), name)
        return out.select("doc_id", F.md5("text").alias("digest"))

    key = f"edit_{name.replace('-', '_')}"
    QUERIES[key] = run
    if sql:
        SQL[key] = sql


_edit("append", "select doc_id, md5(regexp_replace(text, '\\s+$', '') || chr(10) || chr(10) || '## Revision note' || chr(10) || chr(10) || 'The deterministic benchmark revision was appended after the existing content.' || chr(10)) as digest from documents where text <> '' union all select doc_id, md5(text) from documents where text = ''".replace("\\\\", "\\"))
_PLAIN, _NL = "regexp_replace(text, '\\s+$', '')", "chr(10) || chr(10)"
_SOLID = "regexp_matches(text, '\\S')"  # texts of the tables are one paragraph each, without headings
_md5 = lambda new, when: f"select doc_id, md5(case when {when} then {new} else text end) as digest from documents"
_HEAD = r"regexp_extract(text, '^((?s:.*?)[.!?])(?:\s|$)', 1)"
_FIRST = f"case when {_HEAD} <> '' then {_HEAD} else {_PLAIN} end"
_REST = f"regexp_replace(substr(text, length({_FIRST}) + 1), '^\\s+', '')"
_edit("insert-sentence", _md5(f"{_FIRST} || ' {churn.SENTENCE}' || case when {_REST} <> '' then ' ' || {_REST} else '' end", _SOLID))
_edit("insert-paragraph", _md5(f"{_PLAIN} || {_NL} || '{churn.PARAGRAPH}'", _SOLID))
_edit("insert-section", _md5(f"{_PLAIN} || {_NL} || '" + churn.SECTION.replace("\n\n", f"' || {_NL} || '") + "'", _SOLID))
_SECOND = _HEAD.replace("(text,", "(rest,")
_edit("delete-sentence", rf"""with a as (select doc_id, text, {_FIRST} as one from documents), b as (select *, substr(text, length(one) + 1) as rest from a), c as (select *, case when {_SECOND} <> '' then {_SECOND} else regexp_replace(rest, '\s+$', '') end as two from b),
d as (select *, regexp_replace(regexp_replace(substr(rest, length(two) + 1), '^\s+', ''), '\s+$', '') as tail from c)
select doc_id, md5(case when regexp_matches(rest, '\S') then regexp_replace(one, '\s+$', '') || case when tail <> '' then ' ' || tail else '' end || case when text like '%' || chr(10) then chr(10) else '' end else text end) as digest from d""")
# The tables' texts are one paragraph without headings, so these two edits work on texts that are made of them.
_SECOND_ONE = "'Second paragraph of ' || doc_id || '.'"
_edit("delete-paragraph", rf"select doc_id, md5(case when {_SOLID} then regexp_replace({_PLAIN}, '^\s+', '') || {_NL} || 'Third.' else {_SECOND_ONE} end) as digest from documents", lambda: F.concat("text", F.lit("\n\nSecond paragraph of "), "doc_id", F.lit(".\n\nThird.")))
_edit("reorder-sections", rf"select doc_id, md5('# Title' || {_NL} || '## Two' || {_NL} || 'Body of ' || doc_id || '.' || {_NL} || regexp_replace('## One' || {_NL} || replace(text, '#', ''), '\s+$', '') || {_NL}) as digest from documents", lambda: F.concat(F.lit("# Title\n\n## One\n\n"), F.replace("text", F.lit("#"), F.lit("")), F.lit("\n\n## Two\n\nBody of "), "doc_id", F.lit(".\n")))
_AT = "length(text) // 3 + length(regexp_extract(substr(text, length(text) // 3 + 1), '^[^A-Za-z]*'))"
_SPOT = f"case when {_AT} < length(text) then {_AT} else length(regexp_extract(text, '^[^A-Za-z]*')) end"
_edit("replace-same-length", f"with p as (select doc_id, text, {_SPOT} as k from documents) select doc_id, md5(case when regexp_matches(text, '[A-Za-z]') then substr(text, 1, k) || case substr(text, k + 1, 1) when 'z' then 'a' when 'Z' then 'A' else chr(ascii(substr(text, k + 1, 1)) + 1) end || substr(text, k + 2) else text end) as digest from p")
_edit("global-replace")


_SMALL = chunking.CDCParams(window_words=8, min_tokens=24, max_tokens=64, primary_mask_bits=5, backup_mask_bits=3, snap_window_words=8)
#: The strategies of the benchmark, with its small sizes.
STRATEGIES: dict[str, chunking.Chunker] = {"fixed": chunking.Fixed(48), "recursive": chunking.Recursive(64, 16), "semantic": chunking.Semantic(64, 16), "cdc-rabin": chunking.CDC(_SMALL), "cdc-rabin+snap": chunking.CDC(_SMALL.snapping())}


@query()
def churn_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strategies by edits over all documents: chunks made new, their share and tokens."""
    docs, by = documents(spark, sf_dir).select("document_id", "text"), ("strategy", "operation")
    cells = spark.createDataFrame([(s, e) for s in STRATEGIES for e in churn.EDITS], "strategy string, operation string")
    out = churn.grid(docs, STRATEGIES).select(*by, "old_chunks", "new_chunks", "reused", "to_embed", "tokens_to_embed", "reembed_fraction")
    return cells.join(F.broadcast(out), list(by), "left").fillna(0)  # one row a cell, also without chunks
