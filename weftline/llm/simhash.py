"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked where they differ in at most RADIUS bits, by sharded BK-trees.

Equal fingerprints are one node. Two fingerprints within 3 bits agree on at least 2 of 5 bit blocks, so each of the 10 pairs of blocks
makes a table of shards in which every link is found: a shard's fingerprints form a BK-tree (children keyed by the Hamming distance to
the parent) and each of them follows only the edges that its radius allows. A shard gives one edge a node, to its smallest companion, not
all pairs; components are found over those. Shards of more than SHARD fingerprints are split into blocks, and every pair of blocks gets a
tree. Shard trees travel with the shuffle instead of a broadcast: together they hold all fingerprints, which have no size bound.

``keep_one`` looks at several fingerprints of a text, by hash functions of their own, and takes those as candidates of which any two lie
within RADIUS bits; exact comparison of shingles then decides.

Defined results: null text has no shingles and fingerprint zero, which links like any other; null ids never name a component unless it
has no others (then null); repeated rows are judged each; an empty table gives none.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, fresh, materialize, met, row_key, small, sortable
from .components import components

SHINGLE, RADIUS, HASH_SEED, SHARD, VIEWS = 3, 3, 42, 20_000, 16
CONFIRM_SHINGLE, SIMILARITY, ROUNDS = 5, 0.8, 8
CANDIDATE_SHINGLE, HOT_SETS = 2, 100  # words a shingle of the views; how many groups' sets of shingles are broadcast at most
HEADS, HOT_HEADS = 32, 5_000  # first rows of a shingle that a round compares; how many shingles' are broadcast at most
_BLOCK = 255  # hashes of a text whose bits are counted in octets at once
_CUTS = (0, 13, 26, 39, 52, 64)
_BITS_OF = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)  # bits of each octet


def _shingle_hashes(text: str | None, width: int) -> np.ndarray | None:
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return None
    if len(found) < width:
        shingles = [b" ".join(found)]
    else:
        shingles = list(map(b" ".join, zip(*(found[i:] for i in range(width)), strict=False)))
    one = xxhash.xxh64_intdigest
    return np.fromiter((one(s, HASH_SEED) for s in shingles), np.uint64, len(shingles))


def _majority(hashes: np.ndarray) -> int:
    """A bit is 1 if set in over half of the hashes; octets are counted first, then their bits."""
    octets = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    ones = np.concatenate([np.bincount(octets[:, i], minlength=256) @ _BITS_OF for i in range(8)])
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """A bit is 1 if set in over half of the shingles' hashes."""
    hashes = _shingle_hashes(text, width)
    return 0 if hashes is None else _majority(hashes)


def fingerprints(text: str | None, width: int = SHINGLE, views: int = VIEWS) -> list[int]:
    """The fingerprint and those under further hash functions, each a mix of the first's hashes."""
    hashes = _shingle_hashes(text, width)
    if hashes is None:
        return [0] * views
    return _majorities(hashes, views) if views > 1 else [_majority(hashes)]


def _majorities(hashes: np.ndarray, views: int) -> list[int]:
    """``_majority`` in every view. Bits of _BLOCK hashes are octets of 0 or 1, which are added eight at a time and can't overflow."""
    ones = np.zeros(64 * views, np.int64)
    for lo in range(0, len(hashes), _BLOCK):
        part = hashes[lo : lo + _BLOCK]
        mixed = _mixed(part[:, None], np.arange(views))
        mixed[:, 0] = part
        bits = np.unpackbits(mixed.astype("<u8").view(np.uint8).ravel(), bitorder="little").reshape(len(part), 64 * views)
        ones += bits.view(np.uint64).sum(0, np.uint64).view(np.uint8)
    return np.packbits(2 * ones.reshape(views, 64) > len(hashes), axis=1, bitorder="little").view("<u8").ravel().tolist()


def _mixed(h: np.ndarray, view: int | np.ndarray) -> np.ndarray:
    h = (h ^ (np.atleast_1d(np.asarray(view, np.uint64)) * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def with_fingerprint(df: DataFrame, text: str = "text", keep: list[str] | None = None, views: int = 1, width: int = SHINGLE) -> DataFrame:
    """The columns ``keep`` and __fp (long: the fingerprint's 64 bits), then __fp1, __fp2 and so on for further views."""
    keep = keep or [c for c in df.columns if c != text]
    names = ["__fp", *(f"__fp{v}" for v in range(1, views))]
    schema = df.select(*(F.col(f"`{c}`") for c in keep)).schema
    for n in names:
        schema = schema.add(n, "long")

    def run(batches):  # noqa: ANN001, ANN202
        for b in batches:
            texts = b.column(b.schema.get_field_index("__text"))
            fps = np.array([fingerprints(t.as_py(), width, views) for t in texts], np.uint64).reshape(-1, views).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), *(pa.array(np.ascontiguousarray(fps[:, v])) for v in range(views))], names=[*keep, *names])

    return df.select(*(F.col(f"`{c}`") for c in keep), F.col(text).alias("__text")).mapInArrow(run, schema)


class BKTree:
    """Children keyed by integer Hamming distance to the parent. Nodes are numbered in the order in which they are met."""

    def __init__(self, values: np.ndarray) -> None:
        self.values, self.children = values, {}
        stack = [np.arange(len(values))] if len(values) else []
        while stack:
            group = stack.pop()
            node, rest = int(group[0]), group[1:]
            if len(rest):
                apart = np.bitwise_count(values[rest] ^ values[node])
                own = self.children[node] = {}
                for edge in np.unique(apart).tolist():
                    below = rest[apart == edge]
                    own[edge] = int(below[0])
                    stack.append(below)

    def probe(self, queries: np.ndarray, radius: int):  # noqa: ANN201
        """Yields (node, numbers of the queries within the radius of it), following only edges within the radius."""
        stack = [(0, np.arange(len(queries)))] if len(self.values) else []
        while stack:
            node, asked = stack.pop()
            apart = np.bitwise_count(queries[asked] ^ self.values[node]).astype(np.int64)
            near = asked[apart <= radius]
            if len(near):
                yield node, near
            for edge, child in self.children.get(node, {}).items():
                follow = asked[np.abs(apart - edge) <= radius]
                if len(follow):
                    stack.append((child, follow))


def shard_links(values: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For each of the distinct values the smallest number of a companion in its component inside the shard."""
    label = np.arange(len(values))
    for node, near in BKTree(values).probe(values, radius):
        joined = np.unique(label[np.append(near, node)])
        if len(joined) > 1:
            label[np.isin(label, joined)] = joined[0]
    return label


def _keys(fp: Column) -> Column:
    """For each pair of bit blocks: the number of the pair and the blocks' bits, in one number."""
    block = lambda i: F.shiftrightunsigned(fp, _CUTS[i]).bitwiseAND(F.lit((1 << (_CUTS[i + 1] - _CUTS[i])) - 1))
    return F.array(*(F.shiftleft(F.shiftleft(block(i), 13).bitwiseOR(block(j)), 4).bitwiseOR(F.lit(n)) for n, (i, j) in enumerate(combinations(range(5), 2))))


_VIEW_BITS = 40  # a shard's key below, its view above


def _hot(keyed: DataFrame, n: int, shard: int) -> DataFrame | None:
    """(hk, g): keys of more than ``shard`` of the n values, and into how many blocks each is cut; None if there is none. Keys are counted by
    hash first, a quarter of a shard a count, and one by one only where a count is that large."""
    if n <= shard:  # a value has a key but once
        return None
    keyed = keyed.withColumn("c", F.pmod(F.xxhash64("k"), F.lit(-(-40 * n // shard))))
    many = materialize(keyed.groupBy("c").agg(F.count("*").alias("n")).filter(F.col("n") > shard).select("c"), "simhash-many")
    if not many.limit(1).count():
        return None
    sizes = keyed.join(small(many), "c", "left_semi").groupBy("k").agg(F.count("*").alias("n")).filter(F.col("n") > shard)
    hot = materialize(sizes.select(F.col("k").alias("hk"), F.ceil(F.col("n") / shard).alias("g")), "simhash-hot")
    return hot if hot.limit(1).count() else None


def links(fps: DataFrame, fp: str = "fp", radius: int = RADIUS, shard: int = SHARD, view: str | None = None) -> DataFrame:
    """Edges (a, b) between distinct fingerprints that make the same components as all pairs within the radius (at most 3); with a column
    ``view`` (view, a, b), each view by itself."""
    if radius > RADIUS:
        raise ValueError(f"five blocks find links of up to {RADIUS} bits")
    of = F.col(view).cast("long") if view else F.lit(0).cast("long")
    t = F.explode(F.array(*(F.lit(n).cast("long") for n in range(10))))
    # A shard's key follows from the value and the number of its table, so only these are shuffled.
    flat = fps.select(F.col(fp).alias("v"), of.alias("w"), t.alias("t")).select("v", F.shiftleft("w", 4).bitwiseOR(F.col("t")).alias("t"))
    key = F.element_at(_keys(F.col("v")), F.col("t").bitwiseAND(F.lit(15)).cast("int") + 1).bitwiseOR(F.shiftleft(F.shiftrightunsigned("t", 4), _VIEW_BITS))
    rows, hot = flat.withColumn("pair", F.lit(0).cast("long")), _hot(flat.select("v", "t", key.alias("k")), fps.count(), shard)
    if hot is not None:  # blocks of a hot shard: each of its rows meets every block once
        marked = flat.withColumn("k", key).join(small(hot), F.col("k") == F.col("hk"), "left")
        b, o = F.pmod(F.xxhash64("v"), F.col("g")), F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("g"), F.lit(1)) - 1))
        rows = marked.withColumn("o", o).withColumn("pair", F.coalesce(F.least(b, "o") * F.col("g") + F.greatest(b, "o"), F.lit(0))).select("v", "t", "pair")

    def run(batches):  # noqa: ANN001, ANN202
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def solve(k, v, p):  # noqa: ANN001, ANN202
            a, b, views = [], [], []
            cut = np.flatnonzero((np.diff(k) != 0) | (np.diff(p) != 0)) + 1
            starts, ends = np.append(0, cut), np.append(cut, len(k))
            for lo, hi in zip(*(x[ends - starts > 1].tolist() for x in (starts, ends)), strict=True):
                own = np.unique(v[lo:hi])
                to = shard_links(own.view(np.uint64), radius)
                moved = to != np.arange(len(own))
                a.append(own[moved])
                b.append(own[to[moved]])
                views.append(np.full(len(a[-1]), k[lo] >> _VIEW_BITS))
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (views, a, b)], names=["view", "a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            k, v, p = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            same = (k == k[-1]) & (p == p[-1])
            last = len(k) if same.all() else len(k) - int(np.argmin(same[::-1]))
            if last < len(k) or not held or held[-1][0][-1] != k[0] or held[-1][2][-1] != p[0]:
                first = [np.concatenate(x) for x in zip(*held, (k[:last] if last < len(k) else k[:0], v[:last] if last < len(k) else v[:0], p[:last] if last < len(k) else p[:0]), strict=False)]
                if len(first[0]):
                    yield from solve(*first)
                held = [(k[last:], v[last:], p[last:])] if last < len(k) else []
                if last == len(k):
                    held = [(k, v, p)]
            else:
                held.append((k, v, p))
        if held:
            yield from solve(*(np.concatenate(x) for x in zip(*held, strict=True)))

    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ready = rows.select("v", "t", "pair").repartition(parts, key, F.col("pair")).select(key.alias("k"), "v", "pair").sortWithinPartitions("k", "pair")
    found = ready.mapInArrow(run, "view long, a long, b long")
    return (found if view else found.drop("view")).distinct()


def grouped(rows: DataFrame, doc_id: str = "doc_id", fp: str = "__fp", radius: int = RADIUS) -> DataFrame:
    """From one row a document (written already): (__nfp, __n, __component) for every fingerprint that several documents have or that has links;
    a document of any other fingerprint is a component by itself."""
    each = materialize(rows.groupBy(F.col(fp).alias("fp")).agg(F.min(doc_id).alias("rep"), F.count("*").alias("n")), "simhash-nodes")
    found = components(links(each, radius=radius))
    members = found.unionByName(found.select(F.col("root").alias("node"), "root").distinct())
    members = members.join(each, members["node"] == each["fp"]).select("node", "root", "rep")
    least = members.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = members.select("node", "root").join(least, "root").select("node", "component_id")
    both = each.join(named, each["fp"] == named["node"], "left").filter((F.col("n") > 1) | F.col("node").isNotNull())
    return materialize(both.select(F.col("fp").alias("__nfp"), F.col("n").alias("__n"), F.when(F.col("node").isNull(), F.col("rep")).otherwise(F.col("component_id")).alias("__component")), "simhash-named")


def with_component(rows: DataFrame, named: DataFrame, own: str, fp: str = "__fp", most: int = BROADCAST_ROWS, view: str | None = None) -> DataFrame:
    """Adds __component. Fingerprints of at least one in ``most`` rows, so at most ``most`` of them, are joined where rows lie; only rows of
    other repeated or linked fingerprints move to meet theirs, unless all of them are few."""
    at = (F.col(fp) == F.col("__nfp")) & (F.col(view) == F.col("__nview") if view else F.lit(True))
    fewer = named.drop("__n")
    fill = lambda df: df.withColumn("__component", F.when(F.col("__nfp").isNull(), F.col(own)).otherwise(F.col("__component"))).drop("__nfp", "__nview")
    if named.limit(most + 1).count() <= most:
        return fill(rows.join(F.broadcast(fewer), at, "left"))
    total = named.agg(F.sum("__n")).first()[0]
    hot = F.broadcast(named.filter(F.col("__n") >= total / most).drop("__n"))
    return fill(rows.join(hot, at)).unionByName(fill(rows.join(hot, at, "left_anti").join(fewer, at, "left")))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (the smallest id that links reach) for every row."""
    rows = materialize(with_fingerprint(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))), "simhash-rows")
    return with_component(rows, grouped(rows, radius=radius), "doc_id").select("doc_id", F.lpad(F.lower(F.hex("__fp")), 16, "0").alias("fingerprint"), F.col("__component").alias("component_id"))


def with_shingles(rows: DataFrame, text: str = "text", width: int = CONFIRM_SHINGLE) -> DataFrame:
    """(node, shingles): the distinct hashes of a text's shingles of ``width`` words, A-Z lower-cased (fewer words: one of all of them; none:
    empty)."""

    def run(batches):  # noqa: ANN001, ANN202
        for b in batches:
            found = [_shingle_hashes(t.as_py(), width) for t in b.column(1)]
            lists = [np.zeros(0, np.int64) if h is None else np.unique(h).view(np.int64) for h in found]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lists, pa.list_(pa.int64()))], names=["node", "shingles"])

    return rows.select("node", text).mapInArrow(run, "node long, shingles array<long>")


def _alike(similarity: float, a: str = "shingles", b: str = "theirs") -> Column:
    both = F.size(F.array_intersect(a, b))
    return both >= similarity * (F.size(a) + F.size(b) - both)  # two empty texts are alike


def _order() -> Column:
    return F.struct(F.col("id").isNull(), F.col("id"), F.col("node"))


def candidates(some: DataFrame, heads: int = HEADS) -> tuple[DataFrame, DataFrame]:
    """From prefixes (root, s, node, o): pairs (a, b) of each row with those before it among the first ``heads`` rows of a shingle, and (node)
    of rows that a shingle with more rows has later, for which more may come before. Pairs grow with the rows, not with a group's square."""
    at = F.row_number().over(Window.partitionBy("root", "s").orderBy("o"))
    first = some.withColumn("k", at).filter(F.col("k") <= heads).groupBy("root", "s").agg(F.array_sort(F.collect_list("o")).alias("heads"))
    facts = some.groupBy("root", "s").agg(F.count("*").alias("n")).filter("n > 1").join(first, ["root", "s"])
    seen = materialize(met(some, facts.withColumn("more", F.col("n") > heads), ["root", "s"], most=HOT_HEADS), "simhash-heads")
    before = F.transform(F.filter("heads", lambda h: h < F.col("o")), lambda h: h["node"])
    pairs = seen.select(F.explode(before).alias("a"), F.col("node").alias("b")).distinct()
    return pairs, seen.filter(F.col("more") & (F.col("o") > F.element_at("heads", -1))).select("node").distinct()


def rest(left: DataFrame, sets: DataFrame, similarity: float = SIMILARITY, heads: int = HEADS) -> list[DataFrame]:
    """Tables (node) of what goes by the rule of ``confirmed``, many that stay a round in place of one: of equal sets the first stays in the
    running, and sets that are alike share one of the first shingles that size allows to differ, rarest first. A row stays once no row before
    it that is alike is left, and all that may be are known: those are the first rows of each of its shingles (``candidates``), which at
    least the first ``heads`` rows of a group have no others than. Rows that neither stay nor go meet again in the next round."""
    own = left.join(sets, "node").select("node", "root", "shingles", _order().alias("o"), *row_key(F.col("shingles")))
    own = materialize(own.join(own.groupBy("root", "k1", "k2").agg(F.min("o").alias("least")), ["root", "k1", "k2"]), "simhash-left")
    one = own.filter("o = least")
    each = one.select("root", "node", "o", F.explode(F.when(F.size("shingles") == 0, F.array(F.lit(0).cast("long"))).otherwise(F.col("shingles"))).alias("s"))
    ranked = each.join(each.groupBy("root", "s").agg(F.count("*").alias("n")), ["root", "s"]).groupBy("root", "node", "o").agg(F.array_sort(F.collect_list(F.struct("n", "s"))).alias("r"))
    some = ranked.select("root", "node", "o", F.explode(F.expr(f"slice(r, 1, int(floor({1 - similarity} * size(r) + 1e-9)) + 1)")).alias("r")).filter("r.n > 1").select("root", "node", "o", "r.s")
    some, gone = materialize(some, "simhash-prefixes"), [own.filter("o > least").select("node")]
    while some.limit(1).count():
        pairs, late = candidates(some, heads)
        with_sets = pairs.join(one.select(F.col("node").alias("a"), "shingles"), "a").join(one.select(F.col("node").alias("b"), F.col("shingles").alias("theirs")), "b")
        edges, late = materialize(with_sets.filter(_alike(similarity)).select("a", "b"), "simhash-alike"), materialize(late, "simhash-late")
        while edges.limit(1).count():
            stay = edges.select("a").distinct().join(edges.select(F.col("b").alias("a")).distinct(), "a", "left_anti").join(late.select(F.col("node").alias("a")), "a", "left_anti")
            go = materialize(edges.join(stay, "a", "left_semi").select(F.col("b").alias("node")).distinct(), "simhash-go")
            if not go.limit(1).count():
                break  # what is left waits for rows whose own are not all known
            gone.append(go)
            edges = materialize(edges.join(go.select(F.col("node").alias("b")), "b", "left_anti").join(go.select(F.col("node").alias("a")), "a", "left_anti"), "simhash-alike")
            late = materialize(late.join(go, "node", "left_anti"), "simhash-late")
        some = materialize(some.join(late.unionByName(edges.select(F.col("b").alias("node"))).distinct(), "node", "left_semi"), "simhash-prefixes")
    return gone


def confirmed(members: DataFrame, sets: DataFrame, similarity: float = SIMILARITY, rounds: int = ROUNDS) -> DataFrame:
    """(node) of members (node, id, root) that go: in each round the one of the smallest id stays in its group, those whose shingles have at
    least ``similarity`` in common with its own go, and the rest are a group of their own in the next round. Groups of more kinds of texts
    than ``rounds`` end by the same rule over shingles that they share (``rest``)."""
    gone, left = [], members
    for _ in range(rounds):
        first = left.groupBy("root").agg(F.min_by("node", _order()).alias("stays"), F.count("*").alias("n")).filter("n > 1")
        first = first.join(sets.select(F.col("node").alias("stays"), F.col("shingles").alias("theirs")), "stays")
        pairs = met(left.join(sets, "node"), first, ["root"], most=HOT_SETS).filter("node <> stays")
        judged = materialize(pairs.select("node", "id", "root", _alike(similarity).alias("alike")), "simhash-judged")
        gone.append(judged.filter("alike").select("node"))
        left = judged.filter("not alike").drop("alike")
        if not left.limit(1).count():
            break
    else:
        gone += rest(left, sets, similarity)
    return reduce(DataFrame.unionByName, gone)


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", views: int = VIEWS) -> DataFrame:
    """One row of each group, that of the smallest id, with the columns of ``docs``.

    Rows link if their fingerprints, of CANDIDATE_SHINGLE words, lie within RADIUS bits in any of ``views`` views, as one view alone, or longer
    shingles, miss near copies;
    components over all views are candidates, of which only those go that share CONFIRM_SHINGLE-word shingles by SIMILARITY with the row that
    stays (``confirmed``). Rows that go are named by 128 bits of id and text and the others don't move; of rows alike in both the first in
    the order of all columns stays.
    """
    key = row_key(F.col(doc_id), F.col(text))
    narrow = materialize(with_fingerprint(docs.select(*key, F.col(doc_id).alias("__id"), F.col(text).alias("text")), views=views, width=CANDIDATE_SHINGLE), "simhash-rows")
    columns = [c for c in narrow.columns if c.startswith("__fp")]
    one = narrow.groupBy("k1", "k2").agg(F.count("*").alias("__copies"), *(F.first(c).alias(c) for c in ("__id", *columns)))
    one = materialize(one.withColumn("__key", F.monotonically_increasing_id()), "simhash-keys")
    each = one.select("__key", F.posexplode(F.array(*columns)).alias("view", "fp"))
    per = materialize(each.groupBy("view", "fp").agg(F.min("__key").alias("rep"), F.count("*").alias("n")), "simhash-nodes")
    near = materialize(links(per, view="view"), "simhash-links")
    asked = materialize(near.select("view", F.explode(F.array("a", "b")).alias("fp")).distinct(), "simhash-ends")
    reps = small(materialize(per.join(small(asked), ["view", "fp"]).select("view", "fp", "rep"), "simhash-reps"))
    ends = lambda e, k: e.join(reps.select("view", F.col("fp").alias(k), F.col("rep").alias(f"r{k}")), ["view", k])
    linked = ends(ends(near, "a"), "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
    same = per.filter("n > 1").select(F.col("view").alias("__nview"), F.col("fp").alias("__nfp"), F.col("n").alias("__n"), F.col("rep").alias("__component"))
    equal = with_component(each, materialize(same, "simhash-same"), "__key", "fp", view="view").filter("__key <> __component")
    stars = equal.groupBy("__key").agg(F.array_sort(F.collect_set("__component")).alias("reps"))  # at most one a view
    equal = stars.select(F.explode(F.concat(F.array("__key"), F.slice("reps", 2, views))).alias("a"), F.col("reps")[0].alias("b")).distinct()
    found = components(linked.unionByName(equal))
    members = found.unionByName(found.select(F.col("root").alias("node"), "root").distinct())
    members = materialize(one.select("k1", "k2", F.col("__key").alias("node"), F.col("__id").alias("id"), "__copies").join(small(members), "node"), "simhash-members")
    texts = met(docs.select(*key, F.col(text).alias("text")), members.select("k1", "k2", "node", "__copies", F.col("__copies").alias("n")), ["k1", "k2"])
    once = texts.filter("__copies > 1").groupBy("node").agg(F.first("text").alias("text"))  # texts of other rows stay where they lie
    sets = materialize(with_shingles(texts.filter("__copies = 1").select("node", "text").unionByName(once)), "simhash-shingles")
    left = members.select("node", "id", "root")
    gone = confirmed(left, sets).join(members.select("node", "k1", "k2"), "node").drop("node")
    a, b = fresh(docs, "k1"), fresh(docs, "k2")
    mine = lambda df: small(materialize(df.select(F.col("k1").alias(a), F.col("k2").alias(b)), "simhash-named"))
    kept = docs.withColumns({a: key[0], b: key[1]}).join(mine(gone), [a, b], "left_anti")
    repeated = one.filter("__copies > 1")
    if not repeated.limit(1).count():
        return kept.select(*docs.columns)
    twice = mine(repeated)
    every = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    first = kept.join(twice, [a, b], "left_semi").groupBy(a, b).agg(F.min_by(every, F.to_json(F.struct(*sortable(docs)))).alias("__row")).select("__row.*")
    return kept.join(twice, [a, b], "left_anti").select(*docs.columns).unionByName(first)
