"""Nearest vectors against brute force; copies, ties, odd rows."""

import numpy as np

from codelode.llm import neighbours as N


def brute(keys, m, k):
    m = m / np.linalg.norm(m, axis=1, keepdims=True)
    s = np.round(m @ m.T, 6)
    np.fill_diagonal(s, -9)
    return {keys[i]: [keys[j] for j in np.lexsort((keys, -s[i]))[:k]] for i in range(len(keys))}


def test_recall(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(150, 16))
    m = (centres[rng.integers(150, size=3000)] + 0.15 * rng.normal(size=(3000, 16))).astype(np.float32)
    df = spark.createDataFrame([(i, "m", v.tolist()) for i, v in enumerate(m)], "k long, c string, v array<float>")
    got = {}
    for r in N.most_similar(df, "k", "c", "v", dim=16, reach=250, block=400, sample=1000).collect():
        got.setdefault(r.k, []).append((r["rank"], r.neighbour, r.score))
    true = brute(np.arange(3000), m.astype(float), 5)
    assert all([x[0] for x in sorted(v)] == [1, 2, 3, 4, 5] for v in got.values()) and len(got) == 3000
    recall = np.mean([len({x[1] for x in got[k]} & set(true[k])) / 5 for k in true])
    assert recall >= 0.9
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    assert max(abs(s - unit[k] @ unit[n]) for k in range(50) for _, n, s in got[k]) < 1e-4


def test_copies_and_collections(spark):
    v = [1.0, 0.0, 0.0, 0.0]
    rows = [(i, "a", v) for i in range(40)] + [(100, "a", [0.9, 0.1, 0.0, 0.0]), (101, "b", v), (102, "b", [0.0, 1.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "k long, c string, v array<float>")
    got = {}
    for r in N.most_similar(df, "k", "c", "v", dim=4, salts=3).orderBy("k", "rank").collect():
        got.setdefault(r.k, []).append(r.neighbour)
    assert got[0] == [1, 2, 3, 4, 5] and got[3] == [0, 1, 2, 4, 5] and got[39] == [0, 1, 2, 3, 4] and got[100] == [0, 1, 2, 3, 4] and got[101] == [102]


def test_unusable(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, "a", [1.0, 2.0]), (2, "a", None), (3, "a", [1.0]), (4, "a", [0.0, 0.0]), (5, "a", [nan, 1.0]), (6, "a", [inf, 1.0]), (7, None, [1.0, 1.0]), (None, "a", [1.0, 1.0]), (8, "a", [2.0, 1.0]), (9, "a", [None, 1.0])]
    df = spark.createDataFrame(rows, "k long, c string, v array<float>")
    assert sorted((r.k, r.neighbour) for r in N.most_similar(df, "k", "c", "v", dim=2).collect()) == [(1, 8), (8, 1)]
    assert N.most_similar(df.limit(0), "k", "c", "v", dim=2).count() == 0


def test_repeated_keys(spark):
    df = spark.createDataFrame([(1, "a", [1.0, 0.0], 1), (1, "a", [0.0, 1.0], 2), (2, "a", [0.0, 1.0], 1)], "k long, c string, v array<float>, t int")
    got = N.most_similar(df, "k", "c", "v", dim=2, order="t")
    assert {(r.k, r.neighbour, r.score) for r in got.collect()} == {(1, 2, 1.0), (2, 1, 1.0)}
    assert [(r.a, r.b) for r in N.linked_pairs(got, "k").collect()] == [(1, 2)]


def built(m, n, per_cell, block, hot=1e18):
    ix = N.MultiIndex(*(lambda a, b: (a, b, np.zeros(len(a) * len(b), np.uint8)))(*N.codebooks(m[:500], n, per_cell, hot)))
    cells, counts = np.unique(ix.cells(m), return_counts=True)
    ix.codes.reshape(-1)[cells] = N.coded(counts)
    return ix.lay_out(block), cells, counts


def test_traversal_is_the_sorted_order():
    m = np.random.default_rng(2).normal(size=(4000, 8)).astype(np.float32)
    ix, cells, counts = built(m, 4000, 4.0, 500)
    count = dict(zip(cells.tolist(), counts.tolist()))
    for c in cells[::40].tolist():
        for reach, pops in ((1, 9999), (100, 9999), (3000, 9999), (1e9, 9999), (1e9, 50)):
            got = ix.traverse(c, reach, pops)
            far = lambda x: ((ix.a[x // ix.kb] - ix.a[c // ix.kb]) ** 2).sum(1) + ((ix.b[x % ix.kb] - ix.b[c % ix.kb]) ** 2).sum(1)  # noqa: B023, E731
            d = far(got)
            assert len(set(got.tolist())) == len(got) and set(got.tolist()) <= set(cells.tolist()) and (np.diff(d) >= -1e-5).all()
            assert d[-1] <= np.sort(far(cells))[len(got) - 1] + 1e-5
            if pops > 50:
                assert sum(count[x] for x in got.tolist()) >= 0.9 * reach or len(got) == len(cells)


def test_counts_as_bytes():
    n = np.unique(np.logspace(0, 10, 200).astype(np.int64))
    assert (np.abs(N.SIZES[N.coded(n)] / n - 1) < 0.06).all() and N.coded(np.array([0]))[0] == 0


def test_near_copies_in_one_place_are_cut_and_merged(spark):
    """Near copies share a place that is dealt out over many blocks."""
    rng = np.random.default_rng(4)
    far = rng.normal(size=(300, 8))
    near = np.array([1.0] * 8) + 1e-3 * rng.normal(size=(900, 8))
    m = np.vstack([far, near]).astype(np.float32)
    keys = 8 * rng.permutation(len(m))
    df = spark.createDataFrame([(int(k), "m", v.tolist()) for k, v in zip(keys, m)], "k long, c string, v array<float>")
    for reach, least in ((5000, 1.0), (500, 0.9)):  # one cell; many
        got = {}
        for r in N.most_similar(df, "k", "c", "v", dim=8, reach=reach, block=100, asking=150, pops=9999).orderBy("k", "rank").collect():
            got.setdefault(r.k, []).append((r["rank"], r.neighbour))
        assert len(got) == len(m) and all([x[0] for x in v] == [1, 2, 3, 4, 5] for v in got.values())
        u = m.astype(float)
        u /= np.linalg.norm(u, axis=1, keepdims=True)
        s = np.round(u @ u.T, 9)
        np.fill_diagonal(s, -9)
        true = {keys[i]: {keys[j] for j in np.lexsort((keys, -s[i]))[:5]} for i in range(len(keys))}
        assert np.mean([len({x[1] for x in got[k]} & true[k]) / 5 for k in keys]) >= least


def test_equal_directions_of_other_lengths_are_copies(spark):
    v = np.array([0.3, -0.2, 0.9, 0.1])
    df = spark.createDataFrame([(i, "a", (v * (1 + i)).tolist()) for i in range(60)], "k long, c string, v array<float>")
    got = {}
    for r in N.most_similar(df, "k", "c", "v", dim=4, salts=3).orderBy("k", "rank").collect():
        got.setdefault(r.k, []).append((r.neighbour, r.score))
    assert len(got) == 60 and all(len(x) == 5 and all(s == 1.0 for _, s in x) for x in got.values())


def test_a_dense_place_gets_centroids_of_its_own_and_no_block_is_large():
    rng = np.random.default_rng(6)
    m = np.vstack([rng.normal(size=(2000, 8)), np.ones((6000, 8)) + 1e-3 * rng.normal(size=(6000, 8))]).astype(np.float32)
    m = m[rng.permutation(len(m))]
    for hot, most in ((1e18, None), (200, 1500)):
        ix, cells, counts = built(m, len(m), 16.0, 500, hot)
        at = ix.cells(m)
        z = ix.bins(at)
        block = ix.first[z] + N.part_of(np.arange(len(m)) * 12, ix.parts[z])
        assert np.bincount(block).max() <= 700
        assert most is None or counts.max() <= most
        # every vector of a reached cell is met exactly once, in a block of its own or of the one that asks
        for hottest in (int(cells[np.argmax(counts)]), int(cells[0]), int(cells[-1])):
            lists, visits = ix.routes(hottest, 3000, 9999)
            reached = set(ix.traverse(hottest, 3000, 9999).tolist())
            for asker in np.unique(block[at == hottest]).tolist():
                met = []
                for b, kind, x in lists:
                    here = asker == b if kind in (N.OWN, N.FROM) else (b, hottest) in visits and asker != b
                    if here and kind == N.FROM:
                        assert all((b, c) in visits for c in x.tolist())
                        met += [i for i in np.flatnonzero(np.isin(at, x)).tolist() if block[i] != b]
                    elif here:
                        met += np.flatnonzero(np.isin(at, x) & (block == b)).tolist()
                assert sorted(met) == np.flatnonzero(np.isin(at, sorted(reached))).tolist()


def test_small_families_among_many_vectors(spark):
    """Families of a few vectors, whose cells are a small part of all."""
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(2000, 48))
    m = (np.repeat(centres, 6, axis=0) + 0.3 * rng.normal(size=(12000, 48))).astype(np.float32)
    m = m[rng.permutation(len(m))]
    df = spark.createDataFrame([(i, "m", v.tolist()) for i, v in enumerate(m)], "k long, c string, v array<float>")
    got = {}
    for r in N.most_similar(df, "k", "c", "v", dim=48, reach=250, pops=16, block=3000).collect():
        got.setdefault(r.k, set()).add(r.neighbour)
    u = m.astype(float) / np.linalg.norm(m.astype(float), axis=1, keepdims=True)
    recall = []
    for i in range(0, len(u), 20):
        s = u @ u[i]
        s[i] = -9
        recall.append(len(got[i] & set(np.argsort(-s)[:5].tolist())) / 5)
    assert all(len(x) == 5 for x in got.values()) and np.mean(recall) >= 0.97, np.mean(recall)
