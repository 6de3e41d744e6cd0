"""Near duplicates of texts and vectors against all pairs."""

import random

import numpy as np
import pytest

from pathloom.llm import metric, neardup
from pathloom.llm.common import connected_components


def roots(nodes, links):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rng = random.Random(seed)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100, k) for k in range(101, 140)] + [(k, k + 1) for k in range(200, 230)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    nodes = {x for a, b in links if a != b for x in (a, b)}
    assert got == roots(nodes, links)
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def shingle_set(text, width):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = low.encode().split()
    return {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def texts(rng):
    vocabulary = [f"w{k}" for k in range(300)]
    base = [[rng.choice(vocabulary) for _ in range(rng.choice([3, 5, 12, 60, 120]))] for _ in range(12)]
    out = [" ".join(b) for b in base]
    hub = base[0] if len(base[0]) > 50 else [rng.choice(vocabulary) for _ in range(120)]
    for _ in range(60):  # copies of one text that differ from each other more than from the text
        c = list(hub)
        for _ in range(rng.choice([0, 1, 2, 3, 4])):
            c[rng.randrange(len(c))] = rng.choice(vocabulary)
        out.append(" ".join(c))
    for b in base:
        c = list(b)
        c[rng.randrange(len(c))] = "changed"
        out += [" ".join(c), " ".join(b).upper()]
    return [*out, None, "", "  \n", "one", "one", "ONE two"]


@pytest.mark.parametrize("seed,width", [(1, 4), (2, 5)])
def test_minhash_against_all_pairs(spark, seed, width):
    rows = list(enumerate(texts(random.Random(seed))))
    frame = spark.createDataFrame([(i, t, i) for i, t in rows], "doc_id long, text string, component_id long")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.components(frame, width=width, block_shingles=2000, block_rows=9).collect()}
    sets = {i: shingle_set(t, width) for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = roots(list(sets), links)
    assert got == {i: (len(sets[i]), want[i], want[i] == i) for i in sets}
    kept = neardup.keep_one(frame, width=width)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i in sets if want[i] == i) and kept.columns == frame.columns


def test_minhash_edges(spark):
    frame = spark.createDataFrame([(1, "a b c d e"), (1, "a b c d e"), (None, "a b c d e")], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["component_id"]) for r in neardup.components(frame).collect()) == [(0, 1), (1, 1), (1, 1)]
    assert neardup.components(frame.limit(0)).count() == 0
    one = neardup.signature(neardup.shingles("only"), 8, 2)
    assert (one == neardup.signature(neardup.shingles("ONLY"), 8, 2)).all()


def test_overlaps_are_exact():
    rng = np.random.default_rng(4)
    for _ in range(20):
        many = [[np.unique(rng.integers(0, 150, rng.integers(1, 50)).astype(np.uint64)) for _ in range(rng.integers(1, 30))] for _ in range(2)]
        got = neardup.overlaps(*many)
        assert all(got[i, j] == len(np.intersect1d(a, b)) for i, a in enumerate(many[0]) for j, b in enumerate(many[1]))


def test_cells_never_lose_a_link():
    """Vectors of tight and loose groups: every linked pair meets, few other cells are copied to, a shorter radius fails."""
    rng = np.random.default_rng(9)
    centre = rng.normal(size=(40, 16))
    v = np.concatenate([c + rng.normal(size=(60, 16)) * s for c, s in zip(centre, np.linspace(0.01, 0.35, 40), strict=True)])
    v = metric.unit([x.tobytes() for x in v[rng.permutation(len(v))]], 16)
    a, b = np.nonzero((v @ v.T >= 0.95) & ~np.eye(len(v), dtype=bool))
    radius = np.sqrt(0.1) + 1e-9
    lost = {}
    for r in (radius, radius / 4):
        cells = metric.Cells(metric.means(v[:600], 48), r)
        home, far = cells.home(v)
        cells.bound({int(j): float(far[home == j].max()) for j in np.unique(home)})
        same, near = cells.near(v)
        assert (same == home).all()
        lost[r] = int((~near[a, home[b]]).sum())
        assert near.sum(1).mean() < len(cells.pivots) / 4
    assert lost[radius] == 0 < lost[radius / 4]


def test_plan_follows_the_size_of_the_table():
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(200, 32))
    v = metric.unit([x.tobytes() for x in centre[rng.integers(0, 200, 4000)] + rng.normal(size=(4000, 32)) * 0.05], 32)
    plans = {n: metric.plan(v, n, 0.3162277670) for n in (4, 500, 2_000, 200_000)}
    counts = [len(c.pivots) for c, _, _ in plans.values()]
    assert counts[0] == 1 and counts[1] > 10 and counts == sorted(counts) and counts[-1] > 100
    work = [n * n * share for n, (_, _, share) in plans.items()]
    assert work[3] / work[2] < 0.6 * (100 * 100)  # grows below the square


def test_plan_counts_copies_of_vectors_that_are_no_pivots():
    """Vectors without groups: cells save nothing, however many vectors there are; pivots themselves look as if they did."""
    rng = np.random.default_rng(8)
    v = metric.unit([x.tobytes() for x in rng.normal(size=(9000, 64))], 64)
    cells, copies, share = metric.plan(v[:8192], 205_128, 0.3162277670)
    really = cells.near(v[8192:])[1]
    assert copies > 0.9 * really.sum(1).mean() and share > 0.9 * really.mean()
    assert really.sum(1).mean() < 40


def test_any_two_blocks_that_may_link_meet_once():
    rng = np.random.default_rng(2)
    v = metric.unit([x.tobytes() for x in rng.normal(size=(400, 3))], 3)
    cells = metric.Cells(metric.means(v, 12), 0.3162277670)
    home, far = cells.home(v)
    cells.bound({int(j): float(far[home == j].max()) for j in np.unique(home)})
    blocks = [(int(c), s, "f", 0, 9 + s) for c in np.unique(home) for s in range(3)]
    meetings = metric.Meetings(cells, blocks, 25)
    met = [(k, int(m)) for u in range(len(meetings)) for k, others in [meetings.unit(u)] for m in others]
    assert len(met) == len(set(met)) and all(k <= m for k, m in met) and len(met) < len(blocks) * (len(blocks) + 1) // 2
    near = {(int(home[i]), int(home[j])) for i, j in zip(*np.nonzero(v @ v.T >= 0.95), strict=True)}
    assert all(((blocks[k][0], blocks[m][0]) not in near) or (k, m) in set(met) for k in range(len(blocks)) for m in range(k, len(blocks)))


@pytest.mark.parametrize("block", [16, 4096])
def test_metric_join_against_all_pairs(spark, block):
    rng = np.random.default_rng(5)
    centre = rng.normal(size=(6, 8))
    v = np.concatenate([c + rng.normal(size=(25, 8)) * s for c, s in zip(centre, (0.02, 0.1, 0.2, 0.3, 0.5, 1.0), strict=True)]).astype(np.float32)
    v = np.concatenate((v, v[:5], v[:3] * 2))
    rows = [(i, [float(x) for x in r], 1) for i, r in enumerate(v)]
    n = len(rows)
    rows += [(n, None, 1), (n + 1, [0.0] * 8, 1), (n + 2, [float("nan")] * 8, 1), (n + 3, [1.0, None], 1), (n + 4, [], 1), (n + 5, [1.0, 0.0], 1), (n + 6, [1.0, 0.01], 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, n_links int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in metric.components(frame, block=block, pivots=7 if block > 16 else 16).collect()}
    a = v.astype(np.float64)
    norm = np.sqrt((a * a).sum(1))
    linked = (a @ a.T) / np.outer(norm, norm) >= 0.95
    np.fill_diagonal(linked, False)
    links = [(int(i), int(j)) for i, j in zip(*np.nonzero(linked), strict=True)] + [(n + 5, n + 6)]
    want = roots([r[0] for r in rows], links)
    degree = {i: int(linked[i].sum()) for i in range(n)} | {n + 5: 1, n + 6: 1}
    assert got == {r[0]: (degree.get(r[0], 0), want[r[0]], want[r[0]] == r[0]) for r in rows}
    assert metric.components(frame.limit(0)).count() == 0


def test_rows_that_share_a_vector_id(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.01]), (3, [0.01, 1.0]), (3, [0.01, 1.0]), (None, [1.0, 0.0]), (4, [-1.0, 0.0])]
    got = metric.components(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted(((r["vec_id"] or 0, r["n_links"], r["component_id"]) for r in got)) == [(0, 1, 1), (1, 1, 1), (1, 2, 1), (2, 1, 1), (3, 2, 1), (3, 2, 1), (4, 0, 4)]


def test_forest_spans():
    rng = np.random.default_rng(6)
    for _ in range(30):
        m = rng.random((rng.integers(1, 9), rng.integers(1, 9))) < 0.25
        all_edges = [(int(i), len(m) + int(j)) for i, j in zip(*np.nonzero(m), strict=True)]
        nodes = range(sum(m.shape))
        assert roots(nodes, metric.forest(m)) == roots(nodes, all_edges)
