"""Pieces of texts: limits, overlaps, byte ranges, exact round trip."""

import random
import re

import pytest

from codelode.llm import splitting

COLUMNS = "k long, t string, m int, o int"


def pieces(spark, rows, range_bytes=1 << 20):
    df = spark.createDataFrame(rows, COLUMNS)
    got = splitting.split_texts(df, "k", "t", "m", "o", range_bytes=range_bytes).collect()
    out = {}
    for r in sorted(got, key=lambda r: (r.key, r.piece_no)):
        out.setdefault(r.key, []).append(r)
    return out


def text(rng, n):
    return "".join(rng.choice(["a", "bc", "é", "😀", " ", "\n", ". ", "\n\n", "word ", "xx"]) for _ in range(n))


def test_round_trip_and_ranges(spark):
    rng = random.Random(4)
    rows = [(i, text(rng, rng.randint(1, 900)) + ("z" * rng.randint(5, 90) if i % 3 == 0 else ""), rng.choice([7, 20, 40]), rng.choice([0, 3, 9])) for i in range(60)]
    whole, ranged = pieces(spark, rows), pieces(spark, rows, range_bytes=1)  # one byte is raised to four times the limit
    for k, t, m, _ in rows:
        assert [(p.start_char, p.end_char, p.piece) for p in whole[k]] == [(p.start_char, p.end_char, p.piece) for p in ranged[k]]
        long = max(map(len, re.findall(r"\S+", t)), default=0) > m
        assert any(p.forced for p in whole[k]) == any(p.forced for p in ranged[k]) == long
        at = 0
        for p in whole[k]:
            assert p.piece == t[p.start_char : p.end_char] and len(p.piece) <= m and p.start_char <= at < p.end_char
            at = p.end_char
        assert at == len(t)


def test_boundaries_and_overlap(spark):
    t = "alpha beta gamma. delta epsilon zeta.\n\neta theta iota kappa lambda mu nu xi omicron pi rho sigma."
    got = pieces(spark, [(1, t, 50, 12)])[1]
    assert got[0].piece.endswith("\n\n")
    for a, b in zip(got, got[1:]):
        assert 0 <= a.end_char - b.start_char <= 12 and (b.start_char == 0 or t[b.start_char - 1].isspace())
    forced = pieces(spark, [(1, "q" * 100, 30, 5)])[1]
    assert [(p.start_char, p.end_char) for p in forced] == [(0, 30), (25, 55), (50, 80), (75, 100)] and [p.forced for p in forced] == [True, True, True, False]


def test_a_run_of_just_the_limit_is_no_forced_cut(spark):
    got = pieces(spark, [(1, "ab " + "q" * 30 + " cd " + "r" * 30 + "\n", 30, 5), (2, "x " + "q" * 31 + " y", 30, 5)])
    assert not any(p.forced for p in got[1]) and any(p.forced for p in got[2])


def test_odd_rows(spark):
    got = pieces(spark, [(1, "", 10, 2), (2, None, 10, 2), (None, "abc", 10, 2), (3, "abc", None, 2), (4, "abc", 0, 2), (5, "abc def", 10, None), (6, "abc def ghi", 5, 50)])
    assert set(got) == {1, 5, 6} and [p.piece for p in got[1]] == [""] and [p.piece for p in got[5]] == ["abc def"] and got[6][-1].end_char == 11
    assert pieces(spark, []) == {}


def test_extra_columns(spark):
    df = spark.createDataFrame([(1, "a b c d e", 3, 0, "x", "y")], COLUMNS + ", key string, text string")
    assert splitting.split_texts(df, "k", "t", "m", "o").columns == splitting.PIECES.names and splitting.split_texts(df, "k", "t", "m", "o").count() >= 3


@pytest.mark.parametrize("with_text", [True, False])
def test_very_long(spark, with_text):
    df = spark.createDataFrame([(1, "lorem ipsum " * 40_000, 100, 10)], COLUMNS)
    got = splitting.split_texts(df, "k", "t", "m", "o", range_bytes=1 << 14, with_text=with_text)
    assert got.agg({"end_char": "max"}).first()[0] == 480_000 and got.count() > 4800


def test_files(spark, tmp_path):
    rng = random.Random(8)
    t = text(rng, 5000)
    (tmp_path / "a.txt").write_text(t, encoding="utf-8")
    n = len(t.encode())
    files = spark.createDataFrame([(1, str(tmp_path / "a.txt"), n, 40, 9), (2, None, 5, 40, 9), (3, str(tmp_path / "a.txt"), 0, 40, 9)], "k long, p string, n long, m int, o int")
    want = [(p.start_char, p.end_char, p.piece) for p in pieces(spark, [(1, t, 40, 9)])[1]]
    for size in (1, 1 << 20):
        got = splitting.split_files(files, "k", "p", "n", "m", "o", range_bytes=size).orderBy("piece_no").collect()
        assert [(p.start_char, p.end_char, p.piece) for p in got] == want
