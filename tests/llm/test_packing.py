"""Containers: nothing lost, nothing over, little room left."""

import itertools
import random

from codelode.llm import packing


def packed(spark, sizes, capacity):
    df = spark.createDataFrame(list(enumerate(sizes)), "k long, n long")
    return packing.pack(df, "k", "n", capacity, salts=4).collect()


def check(rows, sizes, capacity):
    by, parts = {}, {}
    for r in rows:
        by[r.container] = by.get(r.container, 0) + r.length
        parts.setdefault(r.k, []).append((r.piece_no, r.start, r.length))
    assert all(n <= capacity for n in by.values())
    for k, n in enumerate(sizes):
        p = sorted(parts[k])
        assert [x[0] for x in p] == list(range(len(p))) and [x[1] for x in p] == [i * capacity for i in range(len(p))] and sum(x[2] for x in p) == max(0, n or 0)
        assert len(p) == 1 or (n or 0) > capacity
    return len([c for c, n in by.items() if n])


def test_random(spark):
    rng = random.Random(1)
    sizes = [rng.choice([rng.randint(1, 64), rng.randint(1, 400), 50, 50]) for _ in range(1500)]
    n = check(packed(spark, sizes, 64), sizes, 64)
    least = max(-(-sum(sizes) // 64), sum(n // 64 + (n % 64 > 32) for n in sizes))  # items over half a container need one each
    assert n <= least * 1.05 + 1


def test_against_brute_force():
    rng = random.Random(2)
    for _ in range(40):
        lengths = sorted({rng.randint(1, 20) for _ in range(5)}, reverse=True)
        left = {n: rng.randint(1, 3) for n in lengths}
        target = rng.randint(5, 40)
        used = packing.best_fill(target, lengths, left)
        assert all(used[n] <= left[n] for n in used)
        best = max(s for s in (sum(a * b for a, b in zip(lengths, c)) for c in itertools.product(*[range(left[n] + 1) for n in lengths])) if s <= target)
        assert sum(n * k for n, k in used.items()) == best


def test_hot_length_and_odd_rows(spark):
    sizes = [7] * 900 + [None, 0, -3, 64, 65, 128, 129]
    rows = packed(spark, sizes, 64)
    check(rows, sizes, 64)
    assert [r for r in rows if r.length == 0 and r.container != 0] == []
    assert packed(spark, [], 64) == []
    df = spark.createDataFrame([(None, 5), (1, 5)], "k long, n long")
    assert [r.k for r in packing.pack(df, "k", "n", 64).collect()] == [1]


def test_same_result_again(spark):
    sizes = [(i * 37) % 90 for i in range(300)]
    a, b = (sorted(map(tuple, packed(spark, sizes, 64))) for _ in range(2))
    assert a == b


def test_report(spark):
    df = spark.createDataFrame([(i, 32) for i in range(4)], "k long, n long")
    r = packing.fill_report(packing.pack(df, "k", "n", 64), 64).first()
    assert (r.containers, r.unused, r.least_containers, r.fill) == (2, 0, 2, 1.0)
    assert packing.fill_report(packing.pack(df.limit(0), "k", "n", 64), 64).first().containers == 0
