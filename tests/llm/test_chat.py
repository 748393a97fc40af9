import numpy as np
from pyspark.sql import functions as F

from weftline.llm import chat


def brute(model, emits):
    """Best path by trying all."""
    from itertools import product

    def weight(path):
        return model.start[path[0]] + emits[0][path[0]] + sum(model.move[a, b] + e[b] for a, b, e in zip(path, path[1:], emits[1:]))

    return max(product(range(chat.S), repeat=len(emits)), key=weight)


def model(seed=0):
    rng = np.random.default_rng(seed)
    shape = [(chat.S,), (chat.S, chat.S), (chat.S, chat.MARKERS), (chat.S, len(chat.LENGTHS) + 1), (chat.S, 2)]
    return chat.Model(*(rng.integers(0, 50, s).astype(float) for s in shape))


def test_viterbi_is_the_best_path():
    for seed in range(4):
        m = model(seed)
        emits = m.emits([chat.observe(x) for x in ("User: hi?", "", "### AI: yes", "long " * 50)])
        assert tuple(m.path(emits)) == brute(m, emits)


def sticky():
    """A model in which turns have many lines and begin with markers."""
    first, roles = np.arange(chat.S) % 2 == 0, np.arange(chat.S) // 2
    move = np.where(~first[None] & (roles[:, None] == roles[None]), 60.0, 1.0)
    marker = np.where(first[:, None], 3.0, 0.0) + np.eye(chat.MARKERS)[np.where(first, roles + 1, 0)] * 40
    return chat.Model(np.ones(chat.S), move, marker, np.arange(1.0, 1 + chat.S * 6).reshape(chat.S, 6) % 7, np.ones((chat.S, 2)))


def whole_by_hand(rows, m):
    """Turns of each conversation, decoded whole: (conv, seq, first turn, role, lines, text, rendered)."""
    from itertools import groupby

    key = lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "")
    for conv, own in groupby(sorted(rows, key=key), key=lambda r: r[0]):
        flat = [(t, line) for _, t, text in own for line in (text or "").split("\n")]
        seen = [chat.observe(line) for _, line in flat]
        turns = []
        for (t, line), s, o in zip(flat, m.path(m.emits(seen)), seen):
            if s % 2 == 0 or not turns or turns[-1][1] != s // 2:
                turns.append((t, s // 2, []))
            turns[-1][2].append(line[o[3] :] if s % 2 == 0 else line)
        for k, (t, role, lines) in enumerate(turns):
            text = "\n".join(lines)
            yield conv, k, t, chat.ROLES[role], len(lines), text, f"<|{chat.ROLES[role]}|>\n{text.strip()}\n<|end|>"


def test_every_way_to_cut_work_gives_the_turns_of_the_whole(spark):
    rows = [(c, t, f"{'User: ' if (t + c) % 3 else '### AI: '}{'word ' * ((t * 7 + c) % 40)}\nmore") for c in range(4) for t in range(23)]
    rows += [(4, t, "  a line that goes on \n\n") for t in range(40)] + [(None, None, f"x{t % 3}") for t in range(50)] + [(6, 1, "the same")] * 30 + [(7, 0, None)]
    table, m = spark.createDataFrame(rows, "conv_id long, turn long, text string").withColumn("block", F.lit("clash")), sticky()
    want = sorted(whole_by_hand(rows, m), key=str)
    assert max(r[4] for r in want) > 20 and len({r[3] for r in want}) > 1
    for block, fan in ((1000, 1024), (5, 1024), (5, 2), (1, 3)):
        assert sorted((tuple(r) for r in chat.parse(table, m, block=block, fan=fan).collect()), key=str) == want
    m = model(3)
    assert sorted((tuple(r) for r in chat.parse(table, m, block=4).collect()), key=str) == sorted(whole_by_hand(rows, m), key=str)


def test_held_out_roles(spark):
    raw = chat.raw(spark.read.parquet("/root/testdata/sf0.01/conversations.parquet"))
    m = chat.train(raw.filter(~chat.held_out()))
    test = raw.filter(chat.held_out())
    got = chat.parse(test.drop("role"), m).select("conv_id", F.col("first_turn").alias("turn"), F.col("role").alias("found")).dropDuplicates(["conv_id", "turn"])
    both = test.join(got, ["conv_id", "turn"], "left")
    n, right = both.count(), both.filter("role = found").count()
    assert right >= 0.8 * n, (right, n)


def test_nulls_and_empty(spark):
    table = spark.createDataFrame([(None, None, None), (None, 0, "User: a"), (1, None, ""), (1, 0, "x"), (1, 0, "x"), (2, 5, "A: " + "long " * 30000)], "conv_id long, turn long, text string")
    got = chat.parse(table, model()).collect()
    assert {r.conv_id for r in got} == {None, 1, 2} and all(r.rendered.startswith("<|") for r in got)
    assert chat.parse(table.limit(0), model()).count() == 0
    assert np.isfinite(chat.train(table.withColumn("role", F.lit(None).cast("string"))).move).all()
