"""Shares, caps, soft memberships, odd rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from codelode.llm import mixing

WORDS = {"docs": "guide section install option value", "code": "def return import class self", "mail": "dear regards meeting thanks monday"}


def corpus(spark, n=600, unlabelled=0.1):
    rng = random.Random(3)
    rows = []
    for i in range(n):
        s = rng.choice(["docs", "docs", "docs", "code", "mail"])
        rows.append((i, " ".join(rng.choice(WORDS[s].split()) for _ in range(rng.randint(5, 60))), None if rng.random() < unlabelled else s))
    return spark.createDataFrame(rows, "id long, text string, source string")


def targets(spark, rows):
    return spark.createDataFrame(rows, "source string, target_share double, max_repeats int")


def run(spark, docs, goal, **more):
    sel, rep = mixing.mix(docs, "id", F.col("source"), "text", goal, **more)
    return sel, {r.source: r for r in rep.collect()}


@pytest.mark.parametrize("weight", [1.0, 0.7])
def test_shares_are_met(spark, weight):
    docs, goal = corpus(spark), targets(spark, [("docs", 0.5, 2), ("code", 0.25, 4), ("mail", 0.25, 4)])
    sel, rep = run(spark, docs, goal, label_weight=weight)
    for r in rep.values():
        assert r.can_reach and r.share_of_total == pytest.approx(r.target_share, abs=0.02 if weight == 1 else 0.06)
    caps = {"docs": 2, "code": 4, "mail": 4}
    assert all(1 <= r.copies <= caps[r.source] for r in sel.collect())


def test_unreachable_and_missing(spark):
    docs, goal = corpus(spark), targets(spark, [("docs", 0.3, 2), ("code", 0.6, 1), ("none", 0.1, 5)])
    _, rep = run(spark, docs, goal)
    assert not rep["code"].can_reach and not rep["none"].can_reach and rep["docs"].can_reach
    assert rep["none"].residual == 1.0 and rep["code"].at_caps > 0.9 and abs(rep["docs"].residual) < 0.01
    assert rep["none"].size == 0 and rep["code"].most_copies == 1 and rep["code"].labelled_tokens == rep["code"].size


def test_classifier_held_out(spark):
    docs = corpus(spark, 900, 0.0)
    names = sorted(WORDS)
    rows = docs.select("id", (F.col("id") % mixing.FOLDS).cast("int").alias("fold"), F.col("source").alias("label"), "text", F.lit(1).cast("long").alias("n"))
    got = mixing.posteriors(rows, mixing.train_counts(rows, names)).collect()  # each row by the other folds' counts
    assert len(got) == 900 and np.mean([names[int(np.argmax(r.p))] == r.label for r in got]) > 0.95
    assert all(abs(sum(r.p) - 1) < 1e-4 for r in got)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "docs"), (2, "", "docs"), (3, "x" * 50, "docs"), (3 + 1, "y" * 50, "other"), (None, "z", "docs"), (5, None, None)], "id long, text string, source string")
    sel, rep = run(spark, docs, targets(spark, [("docs", 1.0, 3), (None, 0.5, 1)]))
    assert set(rep) == {"docs"} and rep["docs"].size == 50 and 4 not in {r.id for r in sel.collect()}
    sel, rep = run(spark, docs.limit(0), targets(spark, [("docs", 1.0, 3)]))
    assert sel.count() == 0 and rep["docs"].size == 0
    sel, rep = run(spark, docs, targets(spark, []))
    assert sel.count() == 0 and rep == {}
