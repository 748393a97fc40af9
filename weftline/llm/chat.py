"""Chat formatting: a hidden Markov model recovers the speakers of raw transcripts, then turns are rendered in one form.

States are a role's first or a further line. A line shows its speaker marker (one of a few classes), its length and whether it asks;
start, transition and emission weights are counted over all labelled training conversations (add-one smoothing) and are a few hundred
numbers. Decoding is Viterbi's. A conversation is cut into blocks of BLOCK rows, by their numbers in it: one block is decoded where it
lies; of longer ones each block is first reduced to a max-plus matrix (states to states), the matrices are combined in levels of FAN, which
finds the states at the blocks' borders, and each block is then decoded between its borders; turns that cross borders are put together
before they are rendered. The result is that of decoding conversations whole, and no task holds more than a block, FAN matrices or a turn.

Defined results: null text is one empty line; null turns come first; rows alike in turn keep the order of their texts; a null conv_id is a
conversation of its own; an empty table gives no turns; unlabelled or unknown roles don't count in training, and ``raw`` writes them as a
user's.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, numbered, small

ROLES = ("system", "user", "assistant")
S, BLOCK, MARKERS = 2 * len(ROLES), 64, 5
LENGTHS = (20, 60, 120, 240, 480)
_WORDS = {"system": "system|context|instructions?|setup", "user": "user|human|customer|question|q|me|person", "assistant": "assistant|ai|bot|model|agent|answer|a"}
_MARKER = re.compile(r"\s*(?:#+\s*|\*\*|[\[<(])?\s*(\w+)\s*(?:\*\*|[\]>)])?\s*[:>\]\-]\s*", re.IGNORECASE)
_FORMS = [re.compile(w, re.IGNORECASE) for w in _WORDS.values()]


def observe(line: str) -> tuple[int, int, int, int]:
    """(marker class: 0 none, 1 to 3 a role's word, 4 another word; length class; whether it asks; where the text starts)."""
    m = _MARKER.match(line[:60])
    known = next((k + 1 for k, f in enumerate(_FORMS) if m and f.fullmatch(m[1])), 0)
    kind = known or (4 if m and line.lstrip()[:1] in "[<(#*" else 0)
    rest = line[m.end() :] if kind else line
    return kind, int(np.searchsorted(LENGTHS, len(rest), "right")), int(rest.rstrip().endswith("?")), m.end() if kind else 0


def lines_of(text: str | None) -> list[str]:
    return (text or "").split("\n")


class Model:
    """Log weights."""

    def __init__(self, start: np.ndarray, move: np.ndarray, marker: np.ndarray, length: np.ndarray, asks: np.ndarray) -> None:
        even = lambda a: np.log((a + 1) / (a + 1).sum(axis=-1, keepdims=True))
        self.start, self.move, self.marker, self.length, self.asks = map(even, (start, move, marker, length, asks))

    def emits(self, seen: list[tuple]) -> np.ndarray:
        k = np.array([s[:3] for s in seen], np.int64).reshape(-1, 3)
        return (self.marker[:, k[:, 0]] + self.length[:, k[:, 1]] + self.asks[:, k[:, 2]]).T

    def matrix(self, emits: np.ndarray, product: np.ndarray | None = None) -> np.ndarray:
        """Best weight from each state before the lines to each state at the last of them, after ``product``."""
        for e in emits:
            step = self.move + e
            product = step if product is None else (product[:, :, None] + step[None]).max(axis=1)
        return product

    def path(self, emits: np.ndarray, entry: int | None = None, last: int | None = None) -> list[int]:
        """Viterbi's states; entry: the state before the first line (None: the start), last: that of the last line if known."""
        best, back = (self.start if entry is None else self.move[entry]) + emits[0], []
        for e in emits[1:]:
            through = best[:, None] + self.move
            back.append(through.argmax(axis=0))
            best = through.max(axis=0) + e
        out = [int(best.argmax()) if last is None else last]
        for b in reversed(back):
            out.append(int(b[out[-1]]))
        return out[::-1]


def train(labelled: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> Model:
    """Counts over labelled turns. Moves inside a turn follow from its number of lines, moves between turns from a join on the next number."""
    own = labelled.select(F.col(conv).alias("c"), F.col(turn).alias("t"), F.col(role).alias("role"), F.col(text).alias("text")).filter(F.col("role").isin(*ROLES) & F.col("t").isNotNull())

    def run(batches):  # noqa: ANN001, ANN202
        marks, lengths, asks = np.zeros((S, MARKERS), np.int64), np.zeros((S, len(LENGTHS) + 1), np.int64), np.zeros((S, 2), np.int64)
        for b in batches:
            for r, t in zip(*(b.column(i).to_pylist() for i in range(2)), strict=True):
                for k, line in enumerate(lines_of(t)):
                    s, (m, n, q, _) = 2 * ROLES.index(r) + (k > 0), observe(line)
                    marks[s, m] += 1
                    lengths[s, n] += 1
                    asks[s, q] += 1
        rows = [{"what": w, "s": int(s), "o": int(o), "n": int(a[s, o])} for w, a in (("marker", marks), ("length", lengths), ("asks", asks)) for s, o in zip(*np.nonzero(a), strict=True)]
        yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("what", pa.string()), ("s", pa.int32()), ("o", pa.int32()), ("n", pa.int64())]))

    found = own.select("role", "text").mapInArrow(run, "what string, s int, o int, n long").groupBy("what", "s", "o").agg(F.sum("n").alias("n"))
    state = F.array_position(F.array(*(F.lit(r) for r in ROLES)), F.col("role")).cast("int") * 2 - 2
    n = F.size(F.split(F.coalesce("text", F.lit("")), "\n"))
    turns = own.groupBy("c", "t").agg(F.min(F.struct(state.alias("s"), n.alias("n"))).alias("x")).select("c", "t", "x.s", "x.n")
    after = turns.select("c", (F.col("t") - 1).alias("t"), F.col("s").alias("to"))
    move = lambda a, b, k: F.struct(F.lit("move").alias("what"), a.alias("s"), b.alias("o"), k.cast("long").alias("n"))
    last = F.col("s") + (F.col("n") > 1).cast("int")
    inner = F.inline(F.array(move(F.col("s"), F.col("s") + 1, (F.col("n") > 1).cast("int")), move(F.col("s") + 1, F.col("s") + 1, F.greatest(F.col("n") - 2, F.lit(0)))))
    between = turns.join(after, ["c", "t"]).select(F.inline(F.array(move(last, F.col("to"), F.lit(1)))))
    starts = turns.groupBy("c").agg(F.min_by("s", "t").alias("s")).select(F.inline(F.array(F.struct(F.lit("start").alias("what"), F.lit(0).alias("s"), F.col("s").alias("o"), F.lit(1).cast("long").alias("n")))))
    moves = turns.select(inner).unionByName(between).unionByName(starts).groupBy("what", "s", "o").agg(F.sum("n").alias("n"))
    shapes = {"start": (1, S), "move": (S, S), "marker": (S, MARKERS), "length": (S, len(LENGTHS) + 1), "asks": (S, 2)}
    tables = {k: np.zeros(v) for k, v in shapes.items()}
    for r in found.unionByName(moves).collect():  # a few hundred numbers
        tables[r["what"]][r["s"], r["o"]] += r["n"]
    return Model(tables["start"][0], *(tables[k] for k in ("move", "marker", "length", "asks")))


_TURNS = "conv_id long, seq long, first_turn long, role string, n_lines long, text string, rendered string"
_PIECES = "conv_id long, block long, k long, border boolean, continues boolean, turn long, role string, n_lines long, text string, rendered string"
#: Blocks whose matrices one task multiplies; more are combined in levels.
FAN = 1024


def render(role: str, text: str) -> str:
    return f"<|{role}|>\n{text.strip()}\n<|end|>"


def _groups(batches, keys: int):  # noqa: ANN001, ANN202
    """(key, rows) of each run of rows alike in the first ``keys`` columns, across batches."""
    now, held = None, []
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if row[:keys] != now:
                if held:
                    yield now, held
                now, held = row[:keys], []
            held.append(row)
    if held:
        yield now, held


def _arrow(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "array<double>": pa.list_(pa.float64())}
    fields = [x.strip().split() for x in schema.split(",")]
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, (_, t) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def _decoded(model: Model, key: tuple, rows: list[tuple], entry: int | None, last: int | None, open_end: bool):  # noqa: ANN202
    """The turns of one block in the form of _PIECES; a turn at a border of blocks may go on in the next."""
    flat = [(turn, line) for _, _, turn, text, *_ in rows for line in lines_of(text)]
    seen = [observe(line) for _, line in flat]
    states = model.path(model.emits(seen), entry, last)
    turns: list[list] = []
    for (turn, line), s, o in zip(flat, states, seen, strict=True):
        if s % 2 == 0 or not turns or turns[-1][1] != s // 2:
            turns.append([turn, s // 2, s % 2 == 1 and not turns and entry is not None and entry // 2 == s // 2, []])
        turns[-1][3].append(line[o[3] :] if s % 2 == 0 else line)
    for k, (turn, role, continues, own) in enumerate(turns):
        text, border = "\n".join(own), continues or open_end and k == len(turns) - 1
        yield (*key, k, border, continues, turn, ROLES[role], len(own), text, None if border else render(ROLES[role], text))


def _borders(matrices: DataFrame, fan: int) -> DataFrame:
    """From (conv_id, block, m), the best weights from each state before a block to each at its end, blocks numbered from 0 and block 0
    weighed from the start: (sc, sb, entry, last), the best path's states there. Matrices of ``fan`` blocks are multiplied first, the path over
    the products is found alike, then the path inside each."""
    parts = int(matrices.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = "sc long, sb long, entry int, last int"

    def product(batches):  # noqa: ANN001, ANN202
        out = []
        for key, rows in _groups(batches, 2):
            whole = None
            for r in rows:
                m = np.array(r[3]).reshape(S, S)
                whole = m if whole is None else (whole[:, :, None] + m[None]).max(axis=1)
            out.append((*key, whole.ravel().tolist()))
        yield _arrow(out, "conv_id long, block long, m array<double>")

    def chain(batches):  # noqa: ANN001, ANN202
        """Rows (conv_id, group, block, m, entry, last) in order: Viterbi over the group's matrices between its known ends."""
        out = []
        for key, rows in _groups(batches, 2):
            entry, last = rows[0][4:6]
            best, back = None, []
            for r in rows:
                m = np.array(r[3]).reshape(S, S)
                through = (m[0 if entry is None else entry])[None] if best is None else best[:, None] + m
                best, pick = through.max(axis=0), through.argmax(axis=0)
                back.append(pick)
            states = [int(best.argmax()) if last is None else last]
            for pick in reversed(back[1:]):
                states.append(int(pick[states[-1]]))
            states.reverse()
            out += [(key[0], r[2], entry if k == 0 else states[k - 1], states[k]) for k, r in enumerate(rows)]
        yield _arrow(out, schema)

    group = F.floor(F.col("block") / fan).cast("long")
    if (matrices.agg(F.max("block")).first()[0] or 0) < fan:
        ends = matrices.select("conv_id", F.lit(0).cast("long").alias("g"), "block", "m", F.lit(None).cast("int").alias("entry"), F.lit(None).cast("int").alias("last"))
    else:
        ready = matrices.select("conv_id", group.alias("g"), "block", "m").repartition(parts, "conv_id", "g").sortWithinPartitions("conv_id", "g", "block")
        above = _borders(materialize(ready.mapInArrow(product, "conv_id long, block long, m array<double>"), "chat-level"), fan)
        ends = matrices.withColumn("g", group).join(small(above), F.col("conv_id").eqNullSafe(F.col("sc")) & (F.col("g") == F.col("sb"))).select("conv_id", "g", "block", "m", "entry", "last")
    return materialize(ends.repartition(parts, "conv_id", "g").sortWithinPartitions("conv_id", "g", "block").mapInArrow(chain, schema), "chat-borders")


def parse(transcripts: DataFrame, model: Model, conv: str = "conv_id", turn: str = "turn", text: str = "text", block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """Recovered turns of raw transcripts given as numbered pieces (roles unknown): conv_id, seq (the turn's number in its conversation),
    first_turn (number of the piece it starts in), role, n_lines, text without marker, rendered. ``block`` and ``fan`` only say how work is cut."""
    own = transcripts.select(F.col(conv).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("block"), F.col(turn).cast("long").alias("turn"), F.col(text).alias("text"))
    longer = materialize(own.groupBy("conv_id").agg(F.count("*").alias("rows")).filter(F.col("rows") > block).select(F.col("conv_id").alias("lc"), F.floor((F.col("rows") - 1) / block).alias("most")), "chat-long")
    shared = own.sparkSession.sparkContext.broadcast(model)  # a few hundred numbers
    parts = int(own.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("turn").asc_nulls_first(), F.col("text").asc_nulls_first()]
    ordered = lambda df, *more: df.repartition(parts, "conv_id", "block").sortWithinPartitions("conv_id", "block", *order).select("conv_id", "block", "turn", "text", *more)

    def decode(batches):  # noqa: ANN001, ANN202
        out: list[tuple] = []
        for key, found in _groups(batches, 2):
            entry, last, open_end = found[0][4:7] if len(found[0]) > 4 else (None, None, False)
            out += _decoded(shared.value, key, found, entry, last, open_end)
            if len(out) > 2000:
                yield _arrow(out, _PIECES)
                out = []
        yield _arrow(out, _PIECES)

    def reduce(batches):  # noqa: ANN001, ANN202
        out = []
        for key, found in _groups(batches, 2):
            product = None
            for r in found:
                emits = shared.value.emits([observe(x) for x in lines_of(r[3])])
                if product is None and key[1] == 0:  # a conversation's first block: all rows hold the weights from the start
                    product, emits = np.tile(shared.value.start + emits[0], (S, 1)), emits[1:]
                product = shared.value.matrix(emits, product)
            out.append((*key, product.ravel().tolist()))
        yield _arrow(out, "conv_id long, block long, m array<double>")

    same = F.col("conv_id").eqNullSafe(F.col("lc"))
    turns = lambda df: df.select("conv_id", F.col("seq").cast("long").alias("seq"), F.col("turn").alias("first_turn"), "role", "n_lines", "text", "rendered")
    if not longer.limit(1).count():
        return turns(ordered(own).mapInArrow(decode, _PIECES).withColumn("seq", F.col("k")))
    one = own.join(small(longer), same, "left_anti")
    many = materialize(numbered(own.drop("block").join(small(longer), same, "left_semi"), ["conv_id"], order).withColumn("block", F.floor(F.col("__row") / block).cast("long")), "chat-numbered")
    states = _borders(materialize(ordered(many).mapInArrow(reduce, "conv_id long, block long, m array<double>"), "chat-matrices"), fan)
    bound = many.join(small(states), F.col("conv_id").eqNullSafe(F.col("sc")) & (F.col("block") == F.col("sb"))).join(small(longer), same)
    bound = bound.select("conv_id", "block", "turn", "text", "entry", "last", (F.col("block") < F.col("most")).alias("open_end"))
    pieces = materialize(ordered(bound, "entry", "last", "open_end").mapInArrow(decode, _PIECES), "chat-pieces")
    begun = _before(pieces.groupBy("conv_id", "block").agg(F.count_if(~F.col("continues")).alias("n")), fan)
    # A turn's number: turns begun in blocks before, and before it in its own; a continuing piece belongs to the last turn begun.
    seq = F.col("k") + F.col("before") - F.when(F.col("first_continues"), 1).otherwise(0)
    first = pieces.filter("k = 0").select(F.col("conv_id").alias("fc"), F.col("block").alias("fb"), F.col("continues").alias("first_continues"))
    facts = materialize(first.join(begun, F.col("fc").eqNullSafe(F.col("bc")) & (F.col("fb") == F.col("bb"))).drop("bc", "bb"), "chat-begun")
    found = pieces.join(small(facts), F.col("conv_id").eqNullSafe(F.col("fc")) & (F.col("block") == F.col("fb"))).withColumn("seq", seq)
    parts_of = F.array_sort(F.collect_list(F.struct("block", "text", "turn")))  # a turn is one row, so its pieces meet
    joined = found.filter("border").groupBy("conv_id", "seq").agg(F.first("role").alias("role"), F.sum("n_lines").alias("n_lines"), parts_of.alias("p"))
    joined = joined.select("conv_id", "seq", F.col("p")[0]["turn"].alias("turn"), "role", "n_lines", F.array_join(F.transform("p", lambda x: x["text"]), "\n").alias("text"))

    def finish(batches):  # noqa: ANN001, ANN202
        for b in batches:
            yield b.append_column("rendered", pa.array([render(r, t) for r, t in zip(b.column(3).to_pylist(), b.column(5).to_pylist(), strict=True)], pa.string()))

    joined = joined.mapInArrow(finish, "conv_id long, seq long, turn long, role string, n_lines long, text string, rendered string")
    whole = ordered(one).mapInArrow(decode, _PIECES).withColumn("seq", F.col("k"))
    return turns(whole).unionByName(turns(found.filter(~F.col("border")))).unionByName(turns(joined))


def _before(counts: DataFrame, fan: int) -> DataFrame:
    """From (conv_id, block, n): (bc, bb, before), the sum over the blocks before; sums of ``fan`` blocks are added first."""
    by = F.floor(F.col("block") / fan).cast("long")
    each = counts.withColumn("g", by)
    sums = each.groupBy("conv_id", "g").agg(F.sum("n").alias("n"))
    above = sums.select(F.col("conv_id").alias("gc"), F.col("g").alias("gg"), (F.sum("n").over(Window.partitionBy("conv_id").orderBy("g")) - F.col("n")).alias("up"))
    inside = F.sum("n").over(Window.partitionBy("conv_id", "g").orderBy("block")) - F.col("n")
    return each.withColumn("inside", inside).join(small(materialize(above, "chat-sums")), F.col("conv_id").eqNullSafe(F.col("gc")) & (F.col("g") == F.col("gg"))).select(F.col("conv_id").alias("bc"), F.col("block").alias("bb"), (F.col("up") + F.col("inside")).alias("before"))


def raw(conversations: DataFrame) -> DataFrame:
    """Transcripts as scrapers leave them: each conversation writes its markers in one of four styles, a fifth of turns has none, and the
    role column is gone. conv_id, turn, text (and role, for training and scoring only)."""
    role = F.when(F.col("role").isin(*ROLES), F.col("role")).otherwise("user")
    names = lambda *x: F.element_at(F.array(*(F.lit(v) for v in x)), F.greatest(F.array_position(F.array(*(F.lit(r) for r in ROLES)), role), F.lit(1)).cast("int"))
    style = F.pmod(F.xxhash64("conv_id"), F.lit(4))
    mark: Column = F.when(style == 0, names("System: ", "User: ", "Assistant: ")).when(style == 1, names("### Context: ", "### Human: ", "### AI: ")).when(style == 2, names("Setup: ", "Q: ", "A: ")).otherwise(names("[note] - ", "[one] - ", "[two] - "))
    bare = F.pmod(F.xxhash64("conv_id", "turn", F.lit(5)), F.lit(5)) == 0
    return conversations.select("conv_id", "turn", "role", F.concat(F.when(bare, "").otherwise(mark), F.coalesce("text", F.lit(""))).alias("text"))


def held_out(conv: str = "conv_id") -> Column:
    return F.crc32(F.coalesce(F.col(conv).cast("string"), F.lit("")).cast("binary")) % 5 == 0
