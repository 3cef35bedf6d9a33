"""What the vector tools hold and send on grows neither with the pairs nor with the labels; results are those of a brute force."""

import time
import tracemalloc

import numpy as np
import pyarrow as pa

from cinegrain.operators import kernels
from cinegrain.tools import similar
from test_tools import cat  # noqa: F401


def _unit(n, seed=0, width=40):
    x = np.random.default_rng(seed).standard_normal((n, width))
    return x / np.linalg.norm(x, axis=1)[:, None]


def _peak_mb(run):
    tracemalloc.start()
    out = run()
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    return out, peak


def _pairs(spark):
    x, y = _unit(60, 1), _unit(60, 2)
    y = (x + 0.5 * y) / np.linalg.norm(x + 0.5 * y, axis=1)[:, None]
    return spark.createDataFrame([(i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(x, y))], "id long, v array<double>, t array<double>"), np.round(x @ y.T, 6)


def test_a_product_is_made_in_pieces(spark):
    """with many labels a batch's product isn't held as one."""
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(_unit(1500, width=4))], "id long, v array<double>").coalesce(1)
    size = lambda keys, s, labels: [pa.array([s.size])]
    got = [r.n for r in kernels.scored(rows, ["id"], "v", rows.selectExpr("id AS other", "v AS w"), "other", "w", size, "n long").collect()]
    assert sum(got) == 1500 * 1500 and max(got) <= kernels.CELLS


def test_loss_in_one_pass(spark):
    """F2."""
    pairs, s = _pairs(spark)
    want = np.mean((np.log(np.exp(10 * (s - 1)).sum(axis=1)) + np.log(np.exp(10 * (s - 1)).sum(axis=0))) / 2 + 10 - 10 * np.diag(s))
    assert abs(similar.contrastive_loss(pairs, "id", "v", "t", 10.0).first().loss - want) < 2e-6
    state = similar._BothWays(lambda s, *_: (s, s)).begin(pa.array(np.arange(20_000)), _unit(20_000), [])
    assert _peak_mb(lambda: state.add([pa.array(np.arange(2048))], _unit(2048, 1)))[1] < 100


def _frames_of(n=3000, items=300):
    x, t = _unit(n, 3), _unit(50, 4)
    return x, t, np.arange(n) % items, np.arange(n) // items


def test_a_task_keeps_a_few_frames_of_each_query():
    """the best frame of an item counts, and no more than k items of a query leave a task."""
    x, t, item, frame = _frames_of()
    state = kernels.TopRows(4, 0.1, nth=True).begin(pa.array(np.arange(50)), t, [])
    for s in range(0, len(x), 700):
        assert state.add([pa.array(item[s : s + 700]), pa.array(frame[s : s + 700])], x[s : s + 700]) is None
    got = sorted(zip(*[c.to_pylist() for c in state.end()]))
    s, want = np.round(x @ t.T, 6), []
    for q in range(50):
        best = {}
        for i in np.lexsort((frame, -s[:, q])):
            if s[i, q] >= 0.1 and item[i] != q:
                best.setdefault(int(item[i]), (-s[i, q], int(item[i]), int(frame[i])))
        want += [(q, i, f, -m) for m, i, f in sorted(best.values())[:4]]
    assert got == sorted(want)


def test_coverage_of_many_frames():
    """stretches of like frames are counted by their centres; the counts are those of all pairs."""
    r = np.random.default_rng(9)
    runs = np.repeat(_unit(300, 10), 7, axis=0) + 0.05 * r.standard_normal((2100, 40))
    for x in (_unit(700, 11), runs, np.ones((900, 40)) + 0.02 * r.standard_normal((900, 40)), np.ones((900, 40)) + 0.5 * r.standard_normal((900, 40)), np.cumsum(0.1 * r.standard_normal((900, 40)), axis=0) + 1):
        x = x / np.linalg.norm(x, axis=1)[:, None]
        for least in (0.95, 0.8, 0.4, -0.5):
            for others in (x, x[::3], x[:1]):
                assert (similar._reached(x, others, least) == (np.round(x @ others.T, 6) >= least).sum(axis=1)).all()
    x = np.repeat(_unit(700, 12), 40, axis=0)
    began = time.process_time()
    assert similar.spread_frames(x, 8, "coverage", 0.2).tolist() == [40 * i for i in range(8)]
    assert time.process_time() - began < 4  # all pairs: 28,000 * 28,000


def test_top_labels_of_each_row():
    """each row's nearest labels come from one task, whatever the number of labels."""
    x, t = _unit(200, 5), np.vstack([_unit(5000, 6), _unit(200, 5)])
    ids, names = np.arange(200), np.append(np.arange(1000, 6000), np.arange(200))
    for k, least, itself in ((5, 0.2, False), (1, -2.0, True), (3, -2.0, False)):
        state = kernels.TopLabels(k, least, itself).begin(pa.array(names), t, [])
        got = list(zip(*[c.to_pylist() for c in state.add([pa.array(ids)], x)]))
        s = np.round(x @ t.T, 6)
        want = [(r, int(n), -m) for r in range(200) for m, n in sorted((-s[r, j], names[j]) for j in range(len(t)) if s[r, j] >= least and (itself or names[j] != r))[:k]]
        assert got == want
    state = kernels.TopLabels(5, 0.2, False).begin(pa.array(np.arange(30_000)), _unit(30_000, 7), [])
    assert _peak_mb(lambda: state.add([pa.array(np.arange(2048))], _unit(2048, 8)))[1] < 150


def _reads_frames(df):
    return any("frame_embeddings" in f for f in df.inputFiles())


def test_report_reads_the_best_tags_from_a_table(cat):
    """frames are compared with the tags once, not once for each use."""
    df = similar.coverage_report(cat)
    assert not _reads_frames(df) and df.count() == 0


def test_uncovered_frames_come_with_their_vectors(cat):
    """F7."""
    df = similar.similar_uncovered(cat, query_item=1)
    assert not _reads_frames(df) and df.count() == 0


def test_recall_reads_its_pairs_once(spark, tmp_path):
    """F8: both ways are counted in one pass over stored pairs."""
    pairs, s = _pairs(spark)
    pairs.write.parquet(f"{tmp_path}/pairs")
    df = similar.retrieval_metrics(spark.read.parquet(f"{tmp_path}/pairs"), "id", "v", "t")
    own = np.diag(s)
    across, down = 1 + (s > own[:, None]).sum(axis=1), 1 + (s > own[None, :]).sum(axis=0)
    want = [(k, round(float((across <= k).mean()), 6), round(float((down <= k).mean()), 6)) for k in (1, 5, 10)]
    assert sorted(tuple(r) for r in df.collect()) == want
    assert not any(str(tmp_path) in f for f in df.inputFiles())


def test_pairs_that_share_a_person_leave_where_they_are_made():
    """neither near pairs nor pairs of a person's items are sent on."""
    x, t, item, _ = _frames_of(items=3000)
    own = [[int(i) % 3] if i % 5 else None for i in range(3000)]
    state = kernels.TopRows(6, 0.1, apart=True).begin(pa.array(np.arange(50)), t, [pa.array(own[:50], pa.list_(pa.int64()))])
    for s in range(0, len(x), 700):
        state.add([pa.array(item[s : s + 700]), pa.array(own[s : s + 700], pa.list_(pa.int64()))], x[s : s + 700])
    got = sorted(zip(*[c.to_pylist() for c in state.end()]))
    s, want = np.round(x @ t.T, 6), []
    for q in range(50):
        near = [(-s[i, q], i) for i in range(3000) if s[i, q] >= 0.1 and i != q and not set(own[i] or []) & set(own[q] or [])]
        want += [(q, i, -m) for m, i in sorted(near)[:6]]
    assert got == sorted(want)


def test_a_tag_is_held_against_the_uncovered_frames_alone(cat):
    """F10."""
    df = similar.what_if_tag(cat, tag_id=1)
    assert not _reads_frames(df)
