"""Each operator against brute force on small data with nulls, ties, repeats, empty tables and clashing columns."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cinegrain.llm import baskets, byte_bpe, clusters, leaks, nearest, runs, set_join, shells, tables, top_items, vector_rows, words

rng = random.Random(5)


def test_top_items_equals_sorting(spark):
    rows = [(rng.choice(["a", "b", "c", None]), rng.choice([None, -1, 0, 3, 3, 9]), rng.choice([None, 1, 2, 3]), "x") for _ in range(400)]
    df = spark.createDataFrame(rows, "g string, s int, t int, _run string").repartition(7)
    got = [tuple(r) for r in top_items.top_items(df, "g", "s", ["t"], 4).collect()]
    assert sorted(got, key=str) == sorted(map(tuple, top_items.top_items(df, "g", "s", ["t"], 4, lot=1).collect()), key=str)
    want = []
    for g in "abc":
        own = sorted(((r[0], r[1], r[2]) for r in rows if r[0] == g and r[1] is not None), key=lambda r: (-r[1], -1 if r[2] is None else r[2]))
        want += own[:4]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert top_items.top_items(df.limit(0), "g", "s", ["t"], 4).count() == 0


def test_loser_tree_merges_runs():
    runs_ = [sorted(rng.randrange(50) for _ in range(rng.randrange(6))) for _ in range(9)]
    flat = np.array([x for r in runs_ for x in r], dtype=int)
    starts = np.cumsum([0, *map(len, runs_)])
    keep = top_items.merge_runs(flat, [flat], starts, 10**6)
    assert flat[keep].tolist() == sorted(flat.tolist())


@pytest.mark.parametrize("frequent", [2, 200])
def test_set_join_equals_brute_force(spark, frequent):
    sets = {i: set(rng.sample(range(14), rng.randrange(0, 12))) for i in range(150)} | {1000 + i: set(range(i % 3 + 4)) for i in range(20)}
    rows = [(k, [*v, None, *list(v)[:2]], 1) for k, v in sets.items()] + [(5000, None, 1), (5001, [], 1)]
    df = spark.createDataFrame(rows, "id long, m array<long>, rep int")
    want = {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if min(len(sets[a]), len(sets[b])) >= 4 and len(sets[a] & sets[b]) * 5 >= 4 * len(sets[a] | sets[b])}
    got = {tuple(r) for r in set_join.similar_records(df, "id", "m", 0.8, 4).collect()}
    assert got == want and want
    reps = set_join.distinct_sets(df, "id", "m", 4)
    pairs = {(r.rep_a, r.rep_b) for r in set_join.similar_sets(reps, 0.8, frequent=frequent).collect()}
    first = {min(k for k in sets if sets[k] == sets[i]) for i in sets}
    assert pairs == {(a, b) for a, b in want if a in first and b in first and sets[a] != sets[b]}
    assert set_join.similar_records(df.limit(0), "id", "m").count() == 0
    star = {tuple(r) for r in set_join.similar_records(df, "id", "m", 0.8, 4, copies=1).collect()}
    assert star <= want


@pytest.mark.parametrize("n", [64, 65])
def test_many_equal_sets_come_out_as_all_pairs(spark, n):
    sets = {i: [1, 2, 3, 4, 5] for i in range(n)} | {n: [1, 2, 3, 4]}
    got = [tuple(r) for r in set_join.similar_records(spark.createDataFrame(list(sets.items()), "id long, m array<long>"), "id", "m", 0.8, 4).collect()]
    assert sorted(got) == list(itertools.combinations(range(n + 1), 2))


def test_runs_over_chunks_and_dirt(spark):
    base = np.zeros(40)
    base[0] = 1
    rows, truth = [], []
    for e in range(3):
        v, t = base, 0.0
        frames = []
        for i in range(60):
            if rng.random() < 0.25:
                v = np.array([rng.gauss(0, 1) for _ in range(40)])
            t += 20 if rng.random() < 0.05 else 1
            vec = [float(x) for x in v] if rng.random() > 0.1 else rng.choice([None, [], [0.0] * 40, [float("nan")] * 40, [1.0] * 24])
            frames.append((e, i, t, vec, 2))
        rows += frames + [(e, 5, 0.0, [9.0] * 40, 1), frames[7]]
        good = [f for f in frames if f[3] is not None and len(f[3]) == 40 and np.isfinite(f[3]).all() and any(f[3])]
        run = [good[0]]
        for a, b in itertools.pairwise(good):
            x, y = np.array(a[3]), np.array(b[3])
            if x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.95 and b[2] - a[2] <= 10:
                run.append(b)
            else:
                truth.append((e, run[0][1], run[-1][1], len(run)))
                run = [b]
        truth.append((e, run[0][1], run[-1][1], len(run)))
    df = spark.createDataFrame([(*r, 1) for r in rows] + [(None, 1, 1.0, [1.0] * 40, 1, 1)], "e long, i int, t double, v array<float>, ver int, chunk int")
    far = df.withColumn("i", F.col("i") * 5000)
    for ranges in (None, 23):
        got = [(r.e, r.first, r.last, r.n) for r in runs.find_runs(df, ["e"], "i", "t", "v", "ver", 0.95, 10.0, ranges=ranges).collect()]
        assert sorted(got) == sorted(truth)
        got = [(r.e, r.first // 5000, r.last // 5000, r.n) for r in runs.find_runs(far, ["e"], "i", "t", "v", "ver", 0.95, 10.0, ranges=ranges).collect()]
        assert sorted(got) == sorted(truth)
    first = runs.find_runs(df, ["e"], "i", "t", "v", "ver", 0.95, 10.0, anchor="first").collect()
    assert sum(r.n for r in first) == sum(x[3] for x in truth)
    assert runs.find_runs(df.limit(0), ["e"], "i", "t", "v", "ver", 0.95, 10.0).count() == 0


def test_item_pairs(spark):
    rows = [([rng.choice("abcdef") for _ in range(rng.randrange(5))] + [None], "x") for _ in range(200)] + [(None, "x")]
    df = spark.createDataFrame(rows, "items array<string>, weight string")
    records = [{x for x in r[0] if x} for r in rows if r[0] and any(r[0])]
    got = {(r.item_a, r.item_b): (r.n, r.n_a, r.n_b, r.total) for r in baskets.item_pairs(df, "items").collect()}
    for a, b in itertools.combinations("abcdef", 2):
        n = sum(a in r and b in r for r in records)
        assert got.get((a, b), (0,))[0] == n
        assert not n or got[a, b][1:] == (sum(a in r for r in records), sum(b in r for r in records), len(records))
    some = {(r.item_a, r.item_b) for r in baskets.item_pairs(df, "items", 5, 1.0).collect()}
    assert some == {k for k, (n, x, y, t) in got.items() if n >= 5 and n * t >= x * y}
    assert baskets.item_pairs(df.limit(0), "items").count() == 0
    long = spark.createDataFrame([([f"{i:03d}" for i in range(150)],), (["000", "149"],)], "items array<string>")
    counts = {(r.item_a, r.item_b): r.n for r in baskets.item_pairs(long, "items").collect()}
    assert len(counts) == 150 * 149 // 2 and counts["000", "149"] == 2


def _vectors(n=300):
    g = np.random.default_rng(3)
    centres = g.normal(size=(40, 40))
    x = np.vstack([centres[i % 40] + g.normal(size=40) * 0.12 for i in range(n // 2)] + [g.normal(size=40) for _ in range(n // 2)])
    return np.float32(np.vstack([x, x[:20]]))


def test_groups_and_neighbours_equal_brute_force(spark):
    x = _vectors()
    u = tables.unit(x)
    cos = u @ u.T
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<float>")
    near = [frozenset(np.flatnonzero(r >= 0.9).tolist()) for r in cos]
    want = {(min(s), i) for i, s in enumerate(near) if len(s) >= 3 and all(near[j] == s for j in s)}
    got = {tuple(r) for r in clusters.similar_groups(df, 0.9, 3, leaf=40, margin=float(np.sqrt(0.05)), block=16).collect()}
    assert got == want and want
    assert {r.cluster_id for r in clusters.describe(clusters.similar_groups(df, leaf=40), df).collect()} <= {a for a, _ in want}
    assert clusters.similar_groups(df.limit(0)).count() == 0
    rows = df.withColumn("g", F.lit("m")).withColumn("b", F.lit(-1)).unionByName(spark.createDataFrame([(None, [1.0] * 40, "m", 0), (7000, [0.0] * 40, "m", 0), (7001, None, None, 0)], "id long, v array<float>, g string, b int"))
    found = {(r.a, r.ca) for r in nearest.nearest(rows, "g", "id", "b", "v", 5, 0.9, occupancy=20, block=8).collect()}
    np.fill_diagonal(cos, -1)
    exact = {(i, int(j)) for i, r in enumerate(np.round(cos, 6)) for j in sorted(np.flatnonzero(r >= 0.9), key=lambda j: (-r[j], j))[:5]}
    assert len(found & exact) >= 0.9 * len(exact) and len(found - exact) <= 0.05 * len(found)
    assert nearest.nearest(rows.limit(0), "g", "id", "b", "v").count() == 0


def _groups(x, least=0.9, smallest=3):
    u = tables.unit(x)
    near = (u @ u.T >= least - 1e-12)
    _, kind, n = np.unique(np.packbits(near, axis=1), axis=0, return_inverse=True, return_counts=True)
    kind = kind.ravel()
    return {(int(r.argmax()), i) for i, r in enumerate(near) if r.sum() >= smallest and n[kind[i]] == r.sum()}


def test_a_group_larger_than_a_leaf_stays_whole(spark):
    g = np.random.default_rng(4)
    lobes = np.eye(3, 40, 1) * np.sqrt(0.095)  # cosine 0.905 to each other
    lobes[:, 0] = np.sqrt(0.905)
    x = np.float32(np.vstack([lobes[np.arange(5000) % 3] + g.normal(size=(5000, 40)) * 0.001, g.normal(size=(600, 40))]))
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "id long, v array<float>")
    want = _groups(x)
    assert len(want) == 5000
    for leaf in (1024, clusters.LEAF):
        assert {tuple(r) for r in clusters.similar_groups(df, leaf=leaf).collect()} == want


def test_groups_shuffle_each_row_once_however_many_leaves(spark):
    g = np.random.default_rng(6)
    x = np.float32(np.vstack([g.normal(size=(2000, 40)), np.repeat(g.normal(size=(300, 40)), 3, axis=0) + g.normal(size=(900, 40)) * 0.02]))
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "id long, v array<float>")
    # The tree of 40 rows a leaf is given: its own steps aren't what is measured.
    tree = clusters.bisect(df, 0.9, 40)
    written = lambda: sum(e.totalShuffleWrite() for e in (lambda l: [l.apply(i) for i in range(l.size())])(spark.sparkContext._jsc.sc().statusStore().executorList(False)))  # noqa: E731, E741
    before = written()
    got = {tuple(r) for r in clusters.similar_groups(df, tree=tree, block=200).collect()}
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    assert got == _groups(x) and len(got) == 900
    assert written() - before < 2 * x.nbytes


def test_a_hot_group_and_its_neighbours_in_many_blocks(spark):
    g = np.random.default_rng(8)
    at = lambda cos, n, k: np.eye(1, 40) * cos + np.eye(1, 40, k) * np.sqrt(1 - cos * cos) + g.normal(size=(n, 40)) * 0.002
    hot = [at(1, 900, 1), at(0.96, 60, 1), at(0.96, 60, 2)]
    for more in ([], [at(0.92, 5, 3)]):  # a whole group, and one that others reach
        x = np.float32(np.vstack([*hot, *more, g.normal(size=(300, 40))]))
        df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "id long, v array<float>")
        want = _groups(x)
        assert len(want) == (0 if more else 1020)
        assert {tuple(r) for r in clusters.similar_groups(df, leaf=200, block=100).collect()} == want


def test_a_pair_that_two_planes_part_is_found(spark):
    x = np.zeros((4, 40))
    x[:3, 0], x[:3, 1] = (-0.05, 0.25, 0.25), (-0.25, 0.08, 0.08)
    x[:, 39] = np.sqrt(1 - (x**2).sum(axis=1))
    x[3, :3] = 0, 0, 0.9
    tree = clusters.Tree()
    tree.plane, tree.offset, tree.count, tree.mean = np.zeros((5, 40)), np.zeros(5), np.ones(5, dtype=np.int64), np.zeros((5, 40))
    tree.child = np.array([[1, 2], [-1, -1], [3, 4], [-1, -1], [-1, -1]])
    tree.plane[0, 0] = tree.plane[2, 1] = 1
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "id long, v array<float>")
    assert {tuple(r) for r in clusters.similar_groups(df, tree=tree).collect()} == _groups(x) == {(0, 0), (0, 1), (0, 2)}


def test_usable(spark):
    bad = [None, [], [1.0] * 39, [None] * 40, [float("inf")] * 40, [0.0] * 40]
    df = spark.createDataFrame([(i, v) for i, v in enumerate([*bad, [1.0] * 40])], "id long, v array<float>")
    assert [r.id for r in vector_rows.usable(df, "v").collect()] == [len(bad)]


def test_tokens_equal_the_reference_tokenizer(spark):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    t.encode_special_tokens = True
    texts = ["", None, " ", "a" * 5000, "<|endoftext|> don't", "naïve 漢字 \n\n x  ", "1234567 --- ===", *["".join(rng.choice("abcdefghij .,'ü漢") for _ in range(60)) for _ in range(200)]]
    df = spark.createDataFrame([(i, x, [1]) for i, x in enumerate(texts)], "id long, text string, ids array<int>")
    got = {r.id: r.ids for r in byte_bpe.token_ids(df, "id", "text").collect()}
    assert all(got[i] == (t.encode(x, add_special_tokens=False).ids if x else []) for i, x in enumerate(texts))
    assert byte_bpe.token_ids(df.limit(0), "id", "text").count() == 0


def test_leaks(spark):
    vocabulary = [a + b for a in "bcdfgklm" for b in ("an", "ir", "ot", "ut", "es", "al")]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(text(50))) for i in range(12)] + [(50, None), (51, "")]
    passage = items[3][1].split()[10:40]
    altered = [w if k % 8 != 4 else "zzz" for k, w in enumerate(items[4][1].split())]
    phrases = " ".join(" ".join(i[1].split()[p : p + 4] + text(3)) for i in items[:12] for p in (0, 20))
    docs = [(0, " ".join(text(60) + passage + text(60))), (1, " ".join(altered).upper()), (2, "<p>" + items[5][1].replace(" ", "​ </b>") + "</p>"), (3, phrases), (4, None), (5, ""), (6, " ".join(text(3000)))]
    d = spark.createDataFrame(docs, "item_id long, text string")
    i = spark.createDataFrame(items, "item_id long, text string")
    for limit in (leaks.INDEX_WORDS, 400):
        got = {(r[0], r[1]) for r in leaks.find_leaks(d.withColumnRenamed("item_id", "doc_id"), "doc_id", "text", i, "item_id", "text", limit).collect()}
        assert got == {(0, 3), (1, 4), (2, 5)}
    assert leaks.find_leaks(d.limit(0).withColumnRenamed("item_id", "doc_id"), "doc_id", "text", i, "item_id", "text").count() == 0
    assert words.words("Café d’été [00:12] &amp; pаge") == ["cafe", "d", "ete", "page"]


def test_shells(spark):
    shell = ["Hello {{name}}, welcome to the garden of delights", "Dear ${First_Name},", "Error 404: Not Found. Reference 77.", "Please enable JavaScript to view this page.", "Lorem ipsum dolor sit amet dolor sit", "Starring null and undefined, length NaN min.", "HTTP/1.1 503 Service Unavailable\nDate: day 3"]
    fine = ["In the docs `{{name}}` is a field and every reader knows it by heart", "A name such as ${rating} stands for a value", "The robot says 'page not found' and the crew laughs until the evening comes", "We asked what NaN means in the column; it was a division by zero", "A long walk along the river with the dog", None, "", "  \n"]
    df = spark.createDataFrame(list(enumerate([*shell, *fine, shell[2]])), "doc_id long, text string").withColumn("what", F.lit(1))
    got = {r.doc_id for r in shells.find_shells(df, "doc_id", "text").collect()}
    assert got == {*range(len(shell)), len(shell) + len(fine)}
    assert shells.find_shells(df.limit(0), "doc_id", "text").count() == 0


def test_repeated_pages_of_any_length(spark):
    notice = " ".join(f"Our keepers {v} the {n} so that every visitor may walk on later." for v in ("mend", "sweep", "paint", "oil") for n in ("gate", "bridge", "lantern", "stair"))
    prose = "The ferry left at noon. The server could not carry the tray. " + notice
    page = "<h1>503 Service Unavailable</h1>\n" + notice
    assert len(notice) > 600 and not shells.page(shells.fold(page))[0]
    texts = [page] * 3 + [prose] * 3 + [page.replace("503", "502").replace("gate", "well")]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id for r in shells.find_shells(df, "doc_id", "text").collect()} == {0, 1, 2}


def test_variants_short_items_and_unspaced_scripts_leak(spark):
    vocabulary = [a + b for a in "bcdfgklm" for b in ("an", "ir", "ot", "ut", "es", "al")]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    one = text(60)
    variants = [(100 + k, " ".join([*one[: 9 * k], "zz", *one[9 * k + 1 :]])) for k in range(6)] + [(200 + k, " ".join(one)) for k in range(12)]
    many = [(300 + k, " ".join([*one[:30], *text(30)])) for k in range(12)]  # the first half is common to more than RARE items
    short, han = text(15), "山川草木天地人和春夏秋冬東西南北上下左右"
    items = variants + many + [(1, " ".join(short)), (2, han), (3, "too short to tell"), *[(10 + k, " ".join(text(50))) for k in range(40)]]
    docs = [(0, " ".join(text(20) + one + text(20))), (1, " ".join(text(9) + short + text(9))), (2, "前文" + han + "後文"), (3, "this is too short to tell from a phrase")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame(items, "item_id long, text string")
    want = {(0, k) for k, _ in variants + many} | {(1, 1), (2, 2)}
    for limit in (leaks.INDEX_WORDS, 700):
        assert {(r[0], r[1]) for r in leaks.find_leaks(d, "doc_id", "text", i, "item_id", "text", limit).collect()} == want


def test_alignments_of_long_rows():
    a = np.array([rng.randrange(50) for _ in range(40)])
    b = np.concatenate([np.full(33_000, -2), a])
    assert [int(x[0]) for x in leaks.alignments(a[None], b[None])] == [40, 40]


def test_leaves_are_compact_and_not_cut_for_nothing():
    x = tables.unit(_vectors())
    leaf = clusters.compact_leaves(x, 0.9)
    sizes = np.bincount(leaf)
    for i in np.flatnonzero(sizes > 1):
        assert (x[leaf == i] @ x[leaf == i].T).min() >= 0.9
    assert (sizes > 2).sum() > 20
    assert len(set(clusters.compact_leaves(np.repeat(x[:1], 50, axis=0), 0.9).tolist())) == 1


def test_templates_are_induced_from_the_records(spark):
    filled = [f"Starring {a} Berg and {b} Fox, length {n} min." for a, b, n in (("Anna", "Tom", 3), ("Eve", "Kai", 44), ("Lea", "Jan", 7), ("Mia", "Ole", 5))]
    left = ["Starring None and Tom Fox, length 9 min.", "Starring  and , length  min.", "Starring person_name and Kai Fox, length 12 min.", "Starring ____ and Lea Dahl, length 3 min."]
    talk = [f"The undefined shape behind {x} is only a reflection." for x in ("Anna", "Tom", "Eve", "Kai")] + ["The crew walks  home, and the  evening comes.", "Starring in a play is hard."]
    talk += ["The film is named after a key called {{title}} in the manual."]
    df = spark.createDataFrame(list(enumerate([*left, *filled, *talk, "The film is called {{title}} and runs long."])), "id long, text string")
    got = {r.id: r.reasons for r in shells.find_shells(df, "id", "text").collect()}
    assert got == {**{i: ["default value"] for i in range(3)}, 3: ["default value"], len(left + filled + talk): ["placeholder"]}


def test_repeated_status_pages_of_an_unlisted_language(spark):
    texts = ["404 Stran ni bila najdena\nObrnite se na pomoc."] * 3 + ["404 frames were kept of the long walk along the river and the bridge"] * 3 + ["502 Stran"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    assert {r.id for r in shells.find_shells(df, "id", "text").collect()} == {0, 1, 2}


def test_word_salad_is_filler():
    assert shells.page(shells.fold("Dolam ferra dolam mirab ferra quast. " * 4))[0]
    assert not shells.page(shells.fold("Jede runde Weberin misst diesen Pfahl, bevor jede leichte Lehrerin jenen Brunnen findet. " * 3))[0]
    assert not shells.page(shells.fold("Kettle ladder raft goat " * 3))[0]  # too few words
    assert not shells.page("雨のあとで橋を磨く。" * 20)[0]
