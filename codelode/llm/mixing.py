"""Problem 7: a selection in which each source has its target share of the total size.

Every document has a soft membership in the sources: the posterior of a naive Bayes classifier, mixed
with its label where it has one (``label_weight`` is the trust in labels). Counts are taken from all
labelled documents in FOLDS folds, and a document is judged by the counts of the other folds. Memberships
are rounded to TICKS steps, and documents of equal membership and cap are summed before the fit.
Nonnegative rates (how often a document is used, at most its cap) are fitted by projected-gradient least
squares so that the expected tokens of each source meet the target. A step changes rates by the
membership-weighted relative shortfall of the sources,

    r <- clip(r + sum_s p[s] * (target[s] - reached[s]) / weight[s], 0, cap),   weight[s] = sum_d n[d] p[d, s]

which is the gradient step in the metric that weighs a document by its size; its curvature is at most
one, so the step of one never overshoots. A document's rate follows from its membership, its cap and
the shortfalls so far, so workers replay the short list of shortfalls instead of carrying a table of
rates from job to job. What is still missing at the end is reported as the source's ``residual``. A source
that can't reach its share shows in the fit: its own documents stand at their caps, or it has a residual;
for those the sizes by label are compared exactly.

Rates become whole copies by systematic rounding: with C the running sum of rates within a source, in
order of size, a document is used floor(C + r) - floor(C) times. That is never more than the cap, and
the number of copies is right to one for any run of similar sizes.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codelode.llm.words import blocks, joined, words_of
from codelode.session import written

BUCKETS = 4096  # of hashed words: the model has FOLDS x sources x BUCKETS numbers
FOLDS = 4
TICKS = 100
STEPS = 200  # at most; the residual is in the report
REPORT = "source string, target_share double, max_repeats int, size long, total long, all_tokens long, labelled_tokens long, most_copies long, share_of_selected double, share_of_total double, residual double, at_caps double, can_reach boolean"
UNIT = 1_000_000  # rates are whole numbers of millionths, so that sums don't depend on their order


def _features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, root of the count) of the distinct hashed words of each text, by row."""
    b, starts = joined(texts)
    h, at = words_of(b)
    row = np.searchsorted(starts, at, side="right") - 1
    key, n = np.unique(row * BUCKETS + (h % np.uint64(BUCKETS)).astype(np.int64), return_counts=True)
    return key // BUCKETS, key % BUCKETS, np.sqrt(n)


def train_counts(docs: DataFrame, sources: list[str]) -> np.ndarray:
    """Naive Bayes counts [fold, source, bucket] of all labelled rows of (fold, label, text); summed on Spark,
    the driver gets at most FOLDS x sources x BUCKETS numbers."""
    index = {s: i for i, s in enumerate(sources)}

    def count(batches):
        total = np.zeros((FOLDS, len(sources), BUCKETS))
        for rb in batches:
            label = np.array([index[x] for x in rb.column("label").to_pylist()], np.int64)
            fold = rb.column("fold").to_numpy().astype(np.int64)
            for i, texts in blocks(rb.column("text")):
                row, bucket, w = _features(texts)
                np.add.at(total, (fold[i + row], label[i + row], bucket), w)
        f, s, b = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(f.astype(np.int32)), pa.array(s.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(np.round(total[f, s, b] * 1000).astype(np.int64))], names=["f", "s", "b", "w"])

    rows = docs.where(F.col("label").isin(sources) & F.col("text").isNotNull()).select("fold", "label", "text").mapInArrow(count, "f int, s int, b int, w long")
    out = np.zeros((FOLDS, len(sources), BUCKETS))
    r = rows.groupBy("f", "s", "b").agg(F.sum("w").alias("w")).toPandas()
    out[r["f"], r["s"], r["b"]] = r["w"] / 1000
    return out


def posteriors(docs: DataFrame, counts: np.ndarray) -> DataFrame:
    """(id, fold, label, text, n) plus ``p ARRAY<FLOAT>`` in place of the text, by the counts of the other folds. The
    evidence is divided by the root of the number of distinct words, since words aren't independent; null
    and empty texts get the prior."""

    def model(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        total = c.sum(1, keepdims=True)
        return np.log(total[:, 0] + 1) - np.log(c.sum() + len(c)), np.where(total > 0, np.log(c + 0.1) - np.log(total + 0.1 * BUCKETS), -20.0).T

    models = docs.sparkSession.sparkContext.broadcast([model(counts.sum(0) - counts[f]) for f in range(FOLDS)])

    def predict(batches):
        for rb in batches:
            fold = rb.column("fold").to_numpy()
            p = np.zeros((rb.num_rows, counts.shape[1]), np.float32)
            for i, texts in blocks(rb.column("text").fill_null("")):
                row, bucket, w = _features(texts)
                distinct = np.bincount(row, minlength=len(texts))
                for f in range(FOLDS):
                    own = np.flatnonzero(fold[i : i + len(texts)] == f)
                    prior, like = models.value[f]
                    z = np.tile(prior, (len(own), 1))
                    some = np.flatnonzero(distinct[own])
                    use = np.flatnonzero(np.isin(row, own[some]))
                    if len(use):
                        cuts = np.searchsorted(row[use], own[some])
                        z[some] += np.add.reduceat(like[bucket[use]] * w[use, None], cuts, axis=0) / np.sqrt(distinct[own[some]])[:, None]
                    e = np.exp(z - z.max(1, keepdims=True))
                    p[i + own] = e / e.sum(1, keepdims=True)
            flat = pa.array(p.ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1, dtype=np.int32) * p.shape[1]), flat)
            yield pa.RecordBatch.from_arrays([rb.column("id"), rb.column("label"), lists, rb.column("n")], names=["id", "label", "p", "n"])

    kind = dict(docs.dtypes)["id"]
    return docs.select("id", "fold", "label", "text", "n").mapInArrow(predict, f"id {kind}, label string, p array<float>, n long")


def fit_shortfalls(groups: DataFrame, goal: np.ndarray, steps: int = STEPS, tolerance: float = 2e-4) -> tuple[list[tuple[list[float], float]], np.ndarray]:
    """Projected gradient over (p ARRAY<FLOAT>, cap INT, n LONG), with momentum that starts anew where the misfit
    grows: each step's relative shortfalls and momentum, and the tokens reached. Ends when no shortfall at
    the rates themselves changes by more than the tolerance."""
    k = len(goal)

    def reached(history):
        def run(batches):
            y, z, w = np.zeros(k), np.zeros(k), np.zeros(k)
            for pdf in batches:
                if len(pdf):
                    p, n = np.stack(pdf["p"].to_numpy()).astype(float), pdf["n"].to_numpy(dtype=float)
                    r, ahead = replay(p, pdf["cap"].to_numpy(dtype=float), history)
                    y, z, w = y + (r * n) @ p, z + (ahead * n) @ p, w + n @ p
            yield pd.DataFrame({"s": np.arange(k), "y": y, "z": z, "w": w})

        out = np.zeros((3, k))
        for r in groups.mapInPandas(run, "s int, y double, z double, w double").groupBy("s").agg(*[F.sum(c).alias(c) for c in "yzw"]).collect():
            out[:, r.s] = r.y, r.z, r.w
        return out

    history: list[tuple[list[float], float]] = []
    y, z, w = reached(history)
    short = lambda x: np.where(w > 0, (goal - x) / np.maximum(w, 1e-9), 0.0)
    last, misfit, t = np.full(k, np.inf), np.inf, 1.0
    for _ in range(steps):
        now = short(y)
        if np.abs(now - last).max() < tolerance:
            break
        new = float((w * now * now).sum())
        t, before = ((1 + np.sqrt(1 + 4 * t * t)) / 2, t) if new <= misfit else (1.0, 1.0)
        last, misfit = now, new
        history.append(([float(x) for x in short(z)], (before - 1) / t))
        y, z, _ = reached(history)
    return history, y


def replay(p: np.ndarray, cap: np.ndarray, history) -> tuple[np.ndarray, np.ndarray]:
    """Rates after the steps so far, and the point ahead at which the next gradient is taken."""
    r = ahead = np.zeros(len(p))
    for short, momentum in history:
        new = np.clip(ahead + p @ np.asarray(short), 0.0, cap)
        r, ahead = new, new + momentum * (new - r)
    return r, ahead


def memberships(docs: DataFrame, key: str, label: Column, text: str, targets: list[tuple[str, float, int]], label_weight: float = 0.98) -> DataFrame:
    """``id, label, p, top, cap, n``: membership, most probable source (its label, if it has one) and its cap,
    tokens (UTF-8 bytes).

    ``label_weight`` is the trust in a label: p = weight x label + (1 - weight) x posterior. A document whose label
    isn't a target's name belongs to a source that isn't mixed; it is left out."""
    names = [t[0] for t in targets]
    base = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), label.alias("label"), F.col(text).alias("text"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n"))
    base = base.where(F.col("label").isNull() | F.col("label").isin(names)).withColumn("fold", F.pmod(F.xxhash64("id"), F.lit(FOLDS)).cast("int"))
    q = posteriors(base, train_counts(base, names))
    one_hot = F.array(*[F.when(F.col("label") == s, 1.0).otherwise(0.0) for s in names])
    both = F.when(F.col("label").isNull(), F.col("p").cast("array<double>")).otherwise(F.zip_with("p", one_hot, lambda a, b: a * (1 - label_weight) + b * label_weight))
    ticks = F.transform(both, lambda x: F.floor(x * TICKS + 0.5))
    total = F.aggregate(ticks, F.lit(0).cast("long"), lambda a, x: a + x)
    caps = F.array(*[F.lit(int(t[2])) for t in targets])
    of_label = F.coalesce(*[F.when(F.col("label") == s, F.lit(i + 1)) for i, s in enumerate(names)])
    top = F.coalesce(of_label, F.array_position("both", F.array_max("both")).cast("int"))
    soft = q.withColumn("both", both).withColumn("ticks", ticks).withColumn("total", total)
    p = F.when(F.col("total") > 0, F.transform("ticks", lambda x: (x / F.col("total")).cast("float"))).otherwise(F.transform("both", lambda x: x.cast("float")))
    return soft.withColumn("top", top).withColumn("p", p).withColumn("cap", F.element_at(caps, F.col("top"))).select("id", "label", "p", (F.col("top") - 1).alias("top"), "cap", "n")


def mix(docs: DataFrame, key: str, label: Column, text: str, targets: DataFrame, label_weight: float = 0.98, salts: int = 64) -> tuple[DataFrame, DataFrame]:
    """(selection, report). ``key`` must be unique; ``targets`` has source, target_share, max_repeats.

    selection: ``key, source, labelled, tokens, copies`` with copies >= 1; the source of an unlabelled
    document is its most probable one. report, one row per target in the targets' order of names:
    size of its labelled documents, the tokens selected (labelled and in all), the shares reached of
    all that is selected and of the sources' total, the fit's residual (expected tokens still missing, as a
    share of the target), how near its own documents are to their caps (1: all at them) and whether the target
    can be reached. Targets
    that have no documents are reported with size 0; a null share or cap counts as 0."""
    rows = targets.where("source IS NOT NULL").select("source", F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0)).alias("max_repeats")).dropDuplicates(["source"]).orderBy("source").collect()  # a row for each source to mix
    goals = [(r.source, r.target_share, r.max_repeats) for r in rows]
    if not goals:
        none = docs.sparkSession.createDataFrame([], REPORT)
        return docs.where("false").select(F.col(key), F.lit("").alias("source"), F.lit(True).alias("labelled"), F.lit(0).cast("long").alias("tokens"), F.lit(0).alias("copies")), none
    members = written(memberships(docs, key, label, text, goals, label_weight), "mix-members")
    sizes = {r.label: r.n for r in members.where("label IS NOT NULL").groupBy("label").agg(F.sum("n").alias("n")).collect()}
    total = sum(sizes.values())
    groups = written(members.groupBy("p", "cap").agg(F.sum("n").alias("n")), "mix-groups")
    goal_tokens = np.array([t[1] * total for t in goals])
    history, reached = fit_shortfalls(groups, goal_tokens)
    residual = np.where(goal_tokens > 0, (goal_tokens - reached) / np.maximum(goal_tokens, 1e-9), 0.0)

    @F.pandas_udf("long")
    def rate(p: pd.Series, cap: pd.Series) -> pd.Series:
        if not len(p):
            return pd.Series([], dtype="int64")
        return pd.Series(np.round(replay(np.stack(p.to_numpy()).astype(float), cap.to_numpy(dtype=float), history)[0] * UNIT).astype("int64"))

    rated = members.select("id", "label", "top", "n", rate("p", "cap").alias("r"), F.floor(F.log2(F.col("n") + 1) * 4).cast("int").alias("band"), F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int").alias("salt"))
    part = ["top", "band", "salt"]
    sums = rated.groupBy(*part).agg(F.sum("r").alias("rs"))
    before = sums.select(*part, F.coalesce(F.sum("rs").over(Window.partitionBy("top").orderBy("band", "salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("c0"))
    inside = F.coalesce(F.sum("r").over(Window.partitionBy(*part).orderBy("id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    c = F.col("c0") + F.col("inside")
    whole = lambda x: F.floor((x + UNIT // 2) / UNIT)
    names = F.array(*[F.lit(t[0]) for t in goals])
    picked = rated.withColumn("inside", inside).join(before, part).withColumn("copies", (whole(c + F.col("r")) - whole(c)).cast("int")).where("copies > 0")
    selection = written(picked.select(F.col("id").alias(key), F.element_at(names, F.col("top") + 1).alias("source"), F.col("label").isNotNull().alias("labelled"), F.col("n").alias("tokens"), "copies"), "mix-selection")
    used = selection.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("all_tokens"), F.sum(F.when(F.col("labelled"), F.col("tokens") * F.col("copies"))).alias("labelled_tokens"), F.max("copies").alias("most_copies"))
    # rates of a source's own documents against their caps, weighed by size
    rates = rated.where("label IS NOT NULL").groupBy(F.col("label").alias("source")).agg((F.sum(F.col("r").cast("double") * F.col("n")) / F.greatest(F.lit(1.0), F.sum(F.col("n").cast("double")) * UNIT)).alias("mean_rate"))
    spark = docs.sparkSession
    goal_rows = [(s, float(share), int(cap), int(sizes.get(s, 0)), int(total), float(x)) for (s, share, cap), x in zip(goals, residual)]
    goal = spark.createDataFrame(goal_rows, "source string, target_share double, max_repeats int, size long, total long, residual double")
    zero = lambda x: F.coalesce(F.col(x), F.lit(0)).cast("long")
    report = goal.join(used, "source", "left").join(rates, "source", "left").select("source", "target_share", "max_repeats", "size", "total", "residual", (F.coalesce("mean_rate", F.lit(0.0)) / F.greatest("max_repeats", F.lit(1))).alias("at_caps"), zero("all_tokens").alias("all_tokens"), zero("labelled_tokens").alias("labelled_tokens"), zero("most_copies").alias("most_copies"))
    every = F.sum("all_tokens").over(Window.partitionBy(F.lit(1)))
    report = report.withColumn("share_of_selected", F.col("all_tokens") / F.greatest(every, F.lit(1))).withColumn("share_of_total", F.col("all_tokens") / F.greatest("total", F.lit(1)))
    # the fit tells where a share may be out of reach, the sizes confirm it
    doubtful = (F.abs("residual") > 0.001) | (F.col("at_caps") > 0.5)
    report = report.withColumn("can_reach", ~(doubtful & (F.col("max_repeats") * F.col("size") < F.col("target_share") * F.col("total"))))
    return selection, report.select(*[c.split(" ")[0] for c in REPORT.split(", ")])
