import pyarrow as pa
from pyspark.sql import functions as F

from weftline.llm import decontam

TEXT = "We know that {0} drives the old car for {1} km in {2} hours and then that {3} walks along the path for {4} miles to meet {5} at noon, so how far is it."
ITEM = TEXT.format("Maria", 60, 2, "Maria", 3, "Tom")
SAME = TEXT.format("Anna", 75, 5, "Anna", 9, "Luis")
OFF = TEXT.format("Anna", 75, 5, "Berta", 9, "Luis")


def found(spark, docs, items, **more):
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    b = spark.createDataFrame(items, "item_id long, text string")
    return decontam.contaminated(d, b, **more)


def test_templates():
    ids, types, low = decontam.template("He saw Maria drive 60 km. The 3 dogs, 1,5 kg!")
    assert [decontam._HOLDERS[t] or w for t, w in zip(types, [low[k] for k in range(len(low))])] == ["he", "saw", "<name>", "drive", "<number>", "<unit>", "the", "<number>", "dogs", "<number>", "<unit>"]


def test_reparameterised_items_and_slots(spark):
    docs = [(1, f"noise before this. {ITEM} noise after"), (2, f"other words here. {SAME}"), (3, OFF), (4, "nothing of the kind is written here at all, not one bit"), (5, None), (6, ""), (None, ITEM), (2, "x"), (7, " ".join(["filler"] * 50_000) + " " + ITEM)]
    items = [(10, ITEM), (11, None), (12, "short"), (13, "a b c d")]
    for rows in (decontam.INDEX_ROWS, 0):
        got = {(r.doc_id, r.item_id): (r.n_windows, r.item_windows, r.n_slots, r.n_changed) for r in found(spark, docs, items, index_rows=rows).collect()}
        assert set(got) == {(1, 10), (2, 10), (None, 10), (7, 10)}
        assert got[1, 10][0] == got[1, 10][1] and got[1, 10][3] == 0 and got[2, 10][3] > 0
    clean = decontam.clean(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted((r.doc_id, r.text) for r in clean.collect() if r.text is not None) == sorted((i, t) for i, t in docs if t is not None and ITEM not in t and SAME not in t)


def test_paths_agree_on_data_and_find_what_shared_windows_find(spark):
    d = "/root/testdata/sf0.01"
    docs, items = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/benchmark.parquet")
    one = sorted((r.doc_id, r.item_id, r.n_windows) for r in decontam.contaminated(docs, items).collect())
    assert one == sorted((r.doc_id, r.item_id, r.n_windows) for r in decontam.contaminated(docs, items, index_rows=0).collect())
    grams = lambda t: {tuple(w[i : i + 8]) for w in [t.lower().split()] for i in range(len(w) - 7)}
    bench = {r.item_id: grams(r.text) for r in items.collect()}
    want = {(r.doc_id, k) for r in docs.collect() for g in [grams(r.text)] for k, b in bench.items() if b and len(b & g) >= 0.5 * len(b)}
    assert want and want == {x[:2] for x in one}


def test_empty(spark):
    assert found(spark, [(1, ITEM)], []).count() == 0 and found(spark, [], [(1, ITEM)]).count() == 0 and found(spark, [], [(1, ITEM)], index_rows=0).count() == 0


def test_a_clean_row_stays_when_another_row_of_its_id_goes(spark):
    docs = spark.createDataFrame([(2, ITEM), (2, "x"), (2, "y"), (None, "z"), (3, None)], "doc_id long, text string")
    clean = decontam.clean(docs, spark.createDataFrame([(10, ITEM)], "item_id long, text string"))
    assert clean.columns == docs.columns and sorted(((r.doc_id, r.text) for r in clean.collect()), key=str) == sorted([(2, "x"), (2, "y"), (None, "z"), (3, None)], key=str)


def test_copies_in_capitals_and_items_of_few_plain_words(spark):
    plain = "the river runs past the old mill and then turns north between two low hills before it meets the sea"
    dense = "Anna 3 Berta 4 Carla 5 Dora 6 Emma 7"
    twins = "the first train takes 2 hours from the coast to the hills and the second train takes 2 hours from the hills to the valley below"
    altered = twins.replace("2 hours from the hills", "9 hours from the hills")
    docs = [(1, f"Before. {plain.upper()} AFTER"), (2, f"It was {plain.title()} again"), (3, f"so {dense} then"), (4, "so Anna 3 Berta 4 Carla 5 Dora 6 Emma 8 then"), (5, plain[:30]), (6, altered), (7, "so Zoe 9 Ypsilon 8 Xaver 7 Walter 6 Vera 5 then")]
    items = [(10, plain), (11, dense), (12, twins)]
    rows = [sorted(tuple(r) for r in found(spark, docs, items, index_rows=n).collect()) for n in (decontam.INDEX_ROWS, 0)]
    assert rows[0] == rows[1] and {r[:2] for r in rows[0]} == {(1, 10), (2, 10), (3, 11), (4, 11), (6, 12)}


def test_verbatim_copies_on_more_data(spark):
    d = "/root/testdata/sf0.1"
    docs, items = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/benchmark.parquet")
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, items).collect()}
    grams = lambda t: {tuple(w[i : i + 8]) for w in [t.lower().split()] for i in range(len(w) - 7)}
    bench, having = {r.item_id: grams(r.text) for r in items.collect()}, {}
    for k, b in bench.items():
        for g in b:
            having.setdefault(g, []).append(k)
    want = set()
    for r in docs.collect():
        n = {}
        for g in grams(r.text):
            for k in having.get(g, ()):
                n[k] = n.get(k, 0) + 1
        want |= {(r.doc_id, k) for k, c in n.items() if c >= 0.5 * len(bench[k])}
    assert {(1699, 130), (6420, 37), (8376, 101)} <= want <= got


def altered(text, seed):
    """The text with other numbers and, away from starts of sentences, other names, each renamed alike throughout."""
    import random
    import re

    rng, named = random.Random(seed), {}
    words = text.split()
    for k, w in enumerate(words):
        bare = re.sub(r"^\W+|\W+$", "", w)
        if re.fullmatch(r"\d+", bare):
            words[k] = w.replace(bare, named.setdefault(bare, str(rng.randint(10**5, 10**6))))
        elif bare[:1].isupper() and k and not re.search(r"[.!?]\W*$", words[k - 1]):
            words[k] = w.replace(bare, named.setdefault(bare, "Q" + "".join(rng.choices("abcdefgh", k=9))))
    return " ".join(words), len(named)


def test_recall_of_reparameterised_items(spark):
    items = spark.read.parquet("/root/testdata/sf0.1/benchmark.parquet").collect()
    # Questions as the benchmark has few numbers and names: each gets two of both in front.
    full = [(r.item_id, f"it is known that Maria has {r.item_id + 3} of them and that Tom took {2 * r.item_id + 7} from Maria before {r.text}") for r in items if r.text]
    planted = [(i, *altered(t, i)) for i, t in full]
    docs = [(i, f"some words before it stand here {t} and some more after") for i, t, n in planted if n >= 4]
    assert len(docs) > 150
    got = {(r.doc_id, r.item_id): r.n_changed for r in found(spark, docs, full).collect()}
    met = [i for i, _ in docs if got.get((i, i), 0) > 0]
    assert len(met) >= 0.98 * len(docs), (len(met), len(docs))


def test_rows_alike_are_judged_once_and_others_each(spark):
    docs, items = [(1, ITEM), (1, ITEM), (1, SAME), (2, ITEM)], [(10, ITEM), (10, ITEM), (11, ITEM)]
    rows = [sorted((r.doc_id, r.item_id, r.n_changed > 0) for r in found(spark, docs, items, index_rows=n).collect()) for n in (decontam.INDEX_ROWS, 0)]
    assert rows[0] == rows[1] == sorted((d, i, c) for d, c in ((1, False), (1, True), (2, False)) for i in (10, 11))


def naive(docs, items):
    """Pairs that the rule of the module's docstring finds, stated plainly over all windows and all diagonals."""
    def cut(text):
        own = decontam.Tokens(pa.array([text], pa.string()))
        return [own.word(k) for k in range(len(own.types))], own.types.tolist()

    def windows(words, types, width):
        """(template or None, bare words, slots) of each window."""
        for p in range(len(words) - width + 1 if width else 0):
            w, t = words[p : p + width], types[p : p + width]
            plain = sum(x == decontam.PLAIN for x in t)
            yield p, tuple((a if x == decontam.PLAIN else x) for a, x in zip(w, t)) if plain >= min(decontam.LITERALS, width) else None, tuple(w), [(k, x, w[k]) for k, x in enumerate(t) if x != decontam.PLAIN]

    out = set()
    cuts = {i: cut(t) for i, t in docs}
    for item, text in items:
        words, types = cut(text)
        width = min(decontam.WINDOW, len(words))
        own = list(windows(words, types, width))
        first, weight = {}, {}
        for q, tem, ws, slots in own:  # windows that are alike count at their first place
            for kind, name in (("words", ws), ("typed", (tem, tuple(s[2] for s in slots)))):
                first.setdefault((kind, name), q)
            weight[q] = first["words", ws]
        rich = {q for q, tem, _, _ in own if tem is not None}
        for d, (dw, dt) in cuts.items():
            met, lines = set(), {}
            by_words, by_type = {}, {}
            for p, tem, ws, slots in windows(dw, dt, width):
                by_words.setdefault(ws, p)
                if tem is not None and slots:
                    by_type.setdefault(tem, []).append((p, slots))
            for q, tem, ws, slots in own:
                if ws in by_words:
                    met.add(q)
                if tem is not None and slots and first["typed", (tem, tuple(s[2] for s in slots))] == q:
                    for p, ds in by_type.get(tem, ()):
                        lines.setdefault(p - q, []).append((q, slots, ds))
            alike = {}
            for q, tem, _, slots in own:
                if tem is not None and slots:
                    alike.setdefault(first["typed", (tem, tuple(s[2] for s in slots))], []).append(q)
            for line in lines.values():
                pairs = {(t, a, b) for _, s, ds in line for (_, t, a), (_, _, b) in zip(s, ds)}
                if decontam.consistent(sorted(pairs)):
                    met |= {x for q, _, _ in line for x in alike[q]}
            n = len(met & rich)
            if n >= max(1, decontam.SHARE * len(rich)) or len(met) >= max(1, decontam.SHARE * len(own)):
                out.add((d, item))
    return out


def test_equals_the_rule_stated_plainly(spark):
    d = "/root/testdata/sf0.01"
    docs, items = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/benchmark.parquet")
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, items).collect()}
    assert got and got == naive([tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in items.select("item_id", "text").collect()])
    odd = [(1, ITEM), (2, SAME), (3, OFF), (4, "a " * 60), (5, "b a " * 40), (6, f"{ITEM} {SAME}"), (7, ITEM.upper()), (8, "It has 3 km and " * 30), (9, "it has 4 km and " * 9)]
    assert {(r.doc_id, r.item_id) for r in found(spark, odd, odd).collect()} == naive(odd, odd)


def test_repetitive_texts_cost_no_product(spark):
    import time

    took = {}
    for n in (500, 100_000):
        docs, items = [(1, "same " * n), (2, f"The {n} km and 3 kg of it " * (n // 8))], [(10, "same " * min(n, 5000)), (11, "The 7 km and 3 kg of it " * min(n // 8, 600)), (12, ITEM)]
        began = time.time()
        rows = {(r.doc_id, r.item_id): r.coverage for r in found(spark, docs, items).collect()}
        took[n] = time.time() - began
        assert set(rows) == {(1, 10), (2, 11)} and rows[1, 10] == 1.0
    assert took[100_000] < took[500] + 30, took
