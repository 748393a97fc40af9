"""The trie of conversations' turns, built level by level.

In each round the conversations that still share their node group by (node, next turn); the smallest conv_id of a group names the new node.
A conversation that is alone in its node needs no more rounds: the rest of its turns is a chain that one pass writes out. Afterwards the
levels are joined in reverse, each with its children's sums, so leaves and savings roll up to the root.

Turns are compared by SHA-256 of role and text. Groups are aggregated before rows move, and conversations meet their new node by ``met``,
so copies of one conversation are never brought to one task. Rounds end with the deepest turn that two conversations share.

``rebuilt`` makes the conversations: the first h turns of conversation c - c % 5, then c's own after its first h, h = crc32(c) % 9.

Defined results: null role and text count as empty; turns are ordered by number (null first), ties by role and text; repeated rows are turns
each; rows without conv_id belong to no conversation and are left out; an empty table gives no nodes, not even a root.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, met, numbered, small
from .spelling import CRC, crc32_sql

FAMILY, HEADS = 5, 9
_NONE = hashlib.sha256(b"").hexdigest()


def _heads(conv: Column) -> Column:
    return (F.crc32(conv.cast("string").cast("binary")) % HEADS).cast("int")


def turns(conversations: DataFrame) -> DataFrame:
    """(conv, k, turn, octets): every conversation's turns in order, k from 0, the turn as a digest, and its text's UTF-8 bytes."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    own = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").alias("at"), role.alias("role"), text.alias("text"))
    in_order = numbered(own, ["conv"], [F.col("at").asc_nulls_first(), F.col("role"), F.col("text")], "k")
    role, text = F.col("role"), F.col("text")
    digest = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    return in_order.select("conv", F.col("k").cast("int").alias("k"), digest.alias("turn"), F.octet_length(text).cast("long").alias("octets"))


def rebuilt(own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((conv, length) of every conversation, (conv, depth, turn, octets) of their rebuilt turns), from turns in order; both written."""
    own = materialize(own, "trie-own")
    sizes = materialize(own.groupBy("conv").agg(F.count("*").alias("n")), "trie-sizes")
    base = small(sizes.filter(F.col("conv") % FAMILY == 0).select(F.col("conv").alias("base"), F.col("n").alias("n_base")))
    facts = sizes.withColumn("base", F.col("conv") - F.col("conv") % FAMILY).join(base, "base", "left").withColumn("h", _heads(F.col("conv")))
    facts = materialize(facts.withColumn("lead", F.least("h", F.coalesce("n_base", F.lit(0))).cast("int")), "trie-facts")
    first = own.filter((F.col("k") < HEADS - 1) & (F.col("conv") % FAMILY == 0)).withColumnRenamed("conv", "base")
    heads = facts.filter("lead > 0").select("conv", "base", "lead").join(first, "base").filter("k < lead").select("conv", (F.col("k") + 1).alias("depth"), "turn", "octets")
    tails = met(own, facts.select("conv", "n", "h", "lead"), ["conv"]).filter("k >= h").select("conv", (F.col("lead") + F.col("k") - F.col("h") + 1).alias("depth"), "turn", "octets")
    ranges = int(own.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    every = materialize(heads.unionByName(tails).repartitionByRange(ranges, "depth", "conv").sortWithinPartitions("depth", "conv"), "trie-turns")  # a level reads its row groups only
    length = facts.select("conv", (F.col("lead") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).cast("int").alias("length"))
    return materialize(length, "trie-lengths"), every


def ends_digest(ends: DataFrame) -> DataFrame:
    """(depth, node, ends_sha256) from (depth, node, conv). Members are sorted by ranges and joined to pieces of text there; a digest then
    takes a node's few pieces one after another, as SHA-256 must, and holds one of them at a time."""
    parts = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(ends.repartitionByRange(parts, "depth", "node", "conv").withColumn("part", F.spark_partition_id()), "trie-ends")
    pieces = ranged.groupBy("depth", "node", "part").agg(F.array_join(F.array_sort(F.collect_list("conv")).cast("array<string>"), ",").alias("piece"))

    def run(batches):  # noqa: ANN001, ANN202
        at, sha = None, None
        for b in batches:
            done = []
            for depth, node, piece in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                if (depth, node) != at:
                    done += [(*at, sha.hexdigest())] if at else []
                    at, sha = (depth, node), hashlib.sha256()
                else:
                    sha.update(b",")
                sha.update(piece.as_buffer())
            yield _rows(done)
        yield _rows([(*at, sha.hexdigest())] if at else [])

    ordered = pieces.repartition("depth", "node").sortWithinPartitions("depth", "node", "part").select("depth", "node", "piece")
    return ordered.mapInArrow(run, "depth int, node long, ends_sha256 string")


def _rows(done: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*done, strict=True)) or [()] * 3
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.string()), strict=True)], names=["depth", "node", "ends_sha256"])


def levels(lengths: DataFrame, every: DataFrame) -> tuple[list[DataFrame], DataFrame, DataFrame]:
    """(nodes of each level from the root, (depth, node, conv) of the conversations that end in shared nodes, (conv, since) of those that are
    alone from a depth on). Nodes: (node, parent, n_convs, octets, alone's length)."""
    root = lengths.agg(F.min("conv").alias("node"), F.count("*").alias("n_convs"), F.first("length").alias("length"))
    root = root.filter("n_convs > 0").select("node", F.lit(None).cast("long").alias("parent"), "n_convs", F.lit(0).cast("long").alias("octets"), "length")
    nodes, ends, alone, depth = [materialize(root, "trie-level")], [], [], 0
    if not nodes[0].count():
        return [], lengths.select(F.lit(0).alias("depth"), F.col("conv").alias("node"), "conv"), lengths.select("conv", F.col("length").alias("since"))
    live = lengths.join(F.broadcast(nodes[0].select("node", "n_convs")))  # one row
    only = live.filter("n_convs = 1")
    alone.append(only.select("conv", F.lit(0).alias("since")))
    live = live.filter("n_convs > 1").drop("n_convs")
    while True:
        ends.append(live.filter(F.col("length") == depth).select(F.lit(depth).alias("depth"), "node", "conv"))
        depth += 1
        step = live.filter(F.col("length") >= depth).withColumnRenamed("node", "parent").join(every.filter(F.col("depth") == depth).drop("depth"), "conv")
        step = materialize(step, "trie-step")
        if not step.limit(1).count():
            discard(step)
            return nodes, reduce(DataFrame.unionByName, ends), reduce(DataFrame.unionByName, alone)
        found = step.groupBy("parent", "turn").agg(F.min("conv").alias("node"), F.count("*").alias("n_convs"), F.first("octets").alias("octets"), F.first("length").alias("length"))
        found = materialize(found, "trie-level")
        nodes.append(found.drop("turn"))
        alone.append(found.filter("n_convs = 1").select(F.col("node").alias("conv"), F.lit(depth).alias("since")))
        shared = found.filter("n_convs > 1").select("parent", "turn", "node", F.col("n_convs").alias("n"))
        live = materialize(met(step, shared, ["parent", "turn"]).select("conv", "length", "node"), "trie-live")


def rolled_up(nodes: list[DataFrame]) -> list[DataFrame]:
    """The levels with n_children, n_leaves and saved_tokens, each joined with the sums of the level below it."""
    out: list[DataFrame] = []
    for depth in reversed(range(len(nodes))):
        own, saved = nodes[depth], (F.col("n_convs") - 1) * F.col("octets")
        if out:
            below = out[-1].groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("c"), F.sum("n_leaves").alias("l"), F.sum("saved_tokens").alias("s"))
            own = own.join(below, "node", "left")
        else:
            own = own.withColumns({c: F.lit(None).cast("long") for c in "cls"})
        chain = (F.col("n_convs") == 1) & (F.col("length") > depth)  # its only child is in the chain
        own = own.select("node", "parent", "n_convs", F.when(chain, F.lit(1).cast("long")).otherwise(F.coalesce("c", F.lit(0).cast("long"))).alias("n_children"), F.coalesce("l", F.lit(1).cast("long")).alias("n_leaves"), (saved + F.coalesce("s", F.lit(0))).alias("saved_tokens"))
        out.append(materialize(own.withColumn("depth", F.lit(depth)), "trie-rolled"))
    return out[::-1]


def trie(lengths: DataFrame, every: DataFrame) -> DataFrame:
    """One row a node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    nodes, ends, alone = levels(lengths, every)
    if not nodes:
        return lengths.sparkSession.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    alone = materialize(alone.join(lengths, "conv"), "trie-alone")
    one = F.lit(1).cast("long")
    chain = met(every.drop("turn", "octets"), alone.select("conv", "since", F.col("length").alias("n"), "length"), ["conv"]).filter("depth > since")
    chain = chain.select(F.col("conv").alias("node"), F.col("conv").alias("parent"), one.alias("n_convs"), (F.col("depth") < F.col("length")).cast("long").alias("n_children"), one.alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"), "depth")
    rows = reduce(DataFrame.unionByName, rolled_up(nodes)).unionByName(chain)
    last = ends_digest(ends).unionByName(alone.select(F.col("length").alias("depth"), F.col("conv").alias("node"), F.sha2(F.col("conv").cast("string"), 256).alias("ends_sha256")))
    out = rows.join(last, ["depth", "node"], "left")
    return out.select(F.col("node").alias("conv_id"), F.col("depth").cast("long").alias("depth"), F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(_NONE)).alias("ends_sha256"))


SQL = f"""with recursive {CRC},
t as (select conv_id, row_number() over (partition by conv_id order by turn nulls first, role, text) - 1 as k, length(role)::varchar || ':' || role || text as turn, strlen(text)::bigint as octets from (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null)),
c as (select conv_id, any_value({crc32_sql('v')}) % {HEADS} as h from (select distinct conv_id, conv_id::varchar as v from t), crc group by 1),
b as (select c.conv_id, h, least(h, coalesce((select count(*) from t where t.conv_id = c.conv_id - c.conv_id % {FAMILY}), 0)) as lead from c),
e as (select b.conv_id, t.k + 1 as depth, turn, octets from b join t on t.conv_id = b.conv_id - b.conv_id % {FAMILY} and t.k < h union all select b.conv_id, lead + t.k - h + 1, turn, octets from b join t on t.conv_id = b.conv_id and t.k >= h),
p as materialized (select conv_id, 0 as depth, '' as key, 0 as octets from b union all select conv_id, depth, sha256(string_agg(sha256(turn), ',') over (partition by conv_id order by depth)), octets from e),
n as materialized (select depth, key, min(conv_id) as conv_id, count(*) as n_convs, any_value(octets) as octets from p group by 1, 2),
m as materialized (select p.conv_id as member, n.* from p join n on n.depth = p.depth and n.key = p.key),
s as (select b.conv_id, (select max(depth) from p where p.conv_id = b.conv_id) as len from b),
ends as (select m.depth, m.conv_id, string_agg(m.member::varchar, ',' order by m.member) as members from m join s on s.conv_id = m.member and s.len = m.depth group by 1, 2),
up as (select n.depth, n.conv_id, m.conv_id as parent from n join m on m.member = n.conv_id and m.depth = n.depth - 1),
kids as (select depth - 1 as depth, parent as conv_id, count(*) as n_children from up group by 1, 2),
below as (select m.depth, m.conv_id, sum((n.n_convs - 1) * n.octets) as saved, count(*) filter (kids.n_children is null) as leaves from n join m on m.member = n.conv_id and m.depth <= n.depth left join kids on kids.depth = n.depth and kids.conv_id = n.conv_id group by 1, 2)
select n.conv_id, n.depth::bigint as depth, up.parent as parent_conv_id, n.n_convs, coalesce(kids.n_children, 0)::bigint as n_children, leaves::bigint as n_leaves, saved::bigint as saved_tokens, sha256(coalesce(members, '')) as ends_sha256
from n join below using (depth, conv_id) left join up using (depth, conv_id) left join kids using (depth, conv_id) left join ends using (depth, conv_id)"""
