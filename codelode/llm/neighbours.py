"""Problem 4: the k most similar vectors of every vector, by an inverted multi-index.

Each half of the vectors (at unit length) is quantised by its own k-means codebook; a cell is a pair of
centroids. From each vector the pairs of centroids are traversed in order of their summed distance to it
with a heap; the vector lies in every cell that is nearly as close as the first (within the index's
``slack``, at most ``pops`` cells). All vectors of a cell are compared with each other, the best are
reranked by the exact cosine of the stored vectors. Two similar vectors so meet where any of the one's
cells is one of the other's. That is done in ``views`` independent indices, of vectors turned differently,
since what one misses another one finds.

* **Codebooks** are fitted on a bounded sample (``sample`` vectors a collection), one task a collection;
  every vector is indexed. The number of centroids grows with the root of the number of vectors, so a cell is
  the closest one of about ``reach`` vectors at any size. ``slack`` is fitted on the sample, so that a vector lies
  in about ``places`` cells whatever the distances are. Where a cell would hold more than four times ``reach``, its
  part of the sample gets centroids of its own. Collections of at most twice ``reach`` vectors are one cell.
* **The index** that is broadcast has the codebooks and one byte a cell (the logarithm of its count);
  ``reach`` rises where there would be more than 2^27 cells.
* **Search.** Cells lie in an order that keeps near ones together (recursive bisection of the codebooks,
  interleaved) and are packed in it into blocks of about ``block`` vectors; a denser place is dealt out over
  several blocks. The vectors of the earlier of these visit the later, in slices of about ``asking`` vectors, and
  either side's questions are answered there. So a pair of blocks meets once, no group holds more than a fixed
  number of rows, and each group has a partition of its own. The best of all blocks and views are merged.
  Views run one after the other, and the shuffles of one are removed before the next.

Of vectors that are equal (to a millionth in each number at unit length) only the first k + 1 by key are
indexed, which is enough for any answer; the other copies get their neighbours from that class. Cosines
are rounded to nine places, ties go to the smaller key.
"""

from __future__ import annotations

import functools
import heapq
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codelode.llm import tables
from codelode.session import written

MOST_CELLS = 1 << 27  # bytes of the index; beyond that, cells hold more vectors
SALT_ROWS = 1 << 16  # vectors of a cell that are joined with its routes in one task
MOST_LANES = 100_000  # partitions of the search; beyond that, several groups share one, one after the other
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
MARGIN = 2e-6  # of single precision; what is within it of the k-th best is reranked


def matrix(column, dim: int) -> np.ndarray:
    """A column of binary rows of ``dim`` 32-bit floats."""
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(a):
        return np.zeros((0, dim), np.float32)
    return np.frombuffer(b"".join(a.to_pylist()), np.float32).reshape(-1, dim)


def unit(m: np.ndarray) -> np.ndarray:
    """Rows at unit length, in double precision."""
    d = m.astype(float)
    d /= np.abs(d).max(1, initial=1e-300, keepdims=True)
    return d / np.linalg.norm(d, axis=1, keepdims=True)


def usable_vectors(df: DataFrame, dim: int) -> DataFrame:
    """(key, collection, vec, order) -> ``key, collection, order, h1, h2, v``: the vector as 32-bit floats
    and two hashes of its direction; null where it isn't usable."""
    order = dict(df.dtypes)["order"]

    def run(batches):
        for rb in batches:
            n, lists = rb.num_rows, rb.column("vec")
            at = np.flatnonzero(pc.fill_null(pc.list_value_length(lists), -1).to_numpy(zero_copy_only=False) == dim)
            m = pc.fill_null(lists.take(pa.array(at)).flatten(), float("nan")).to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dim)
            good = np.isfinite(m).all(1) & (m != 0).any(1)
            at, m = at[good], m[good]
            v, h1, h2 = [None] * n, [None] * n, [None] * n
            for i, row, grid in zip(at, m, np.rint(unit(m) * (1 << 20)).astype(np.int32)):
                h = xxhash.xxh3_128_intdigest(grid.tobytes())
                v[i], h1[i], h2[i] = row.tobytes(), (h >> 64) - (1 << 63), (h & (1 << 64) - 1) - (1 << 63)
            yield pa.RecordBatch.from_arrays([rb.column("key"), rb.column("collection"), rb.column("order"), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(v, pa.binary())], names=["key", "collection", "order", "h1", "h2", "v"])

    return df.where("key IS NOT NULL AND collection IS NOT NULL").mapInArrow(run, f"key long, collection string, order {order}, h1 long, h2 long, v binary")


def codebook(y: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    rng = np.random.default_rng(7)
    c = y[rng.choice(len(y), min(k, len(y)), replace=False)].copy()
    for _ in range(rounds):
        a = nearest(y, c)
        n = np.bincount(a, minlength=len(c))
        order = np.argsort(a, kind="stable")
        at = np.flatnonzero(n)
        c[at] = np.add.reduceat(y[order], np.concatenate([[0], np.cumsum(n[at])[:-1]]), axis=0) / n[at, None]
        empty = np.flatnonzero(n == 0)
        c[empty] = y[rng.integers(len(y), size=len(empty))]
    return c


def nearest(y: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Nearest centroid of each row, a few thousand rows at a time."""
    half = (c * c).sum(1) / 2
    return np.concatenate([np.argmax(y[i : i + 4096] @ c.T - half, axis=1) for i in range(0, len(y), 4096)] or [np.zeros(0, np.int64)])


def codebooks(sample: np.ndarray, n: int, per_cell: float, hot: float) -> tuple[np.ndarray, np.ndarray]:
    """A codebook for either half. Cells that hold more than ``hot`` of the ``n`` vectors, going by the
    sample, add centroids fitted on their own part of it, at most as many as there are."""
    h, k = sample.shape[1] // 2, max(1, min(int(np.ceil(np.sqrt(n / per_cell))), len(sample)))
    a, b = codebook(sample[:, :h], k), codebook(sample[:, h:], k)
    for _ in range(2):
        cells, of, count = np.unique(nearest(sample[:, :h], a) * len(b) + nearest(sample[:, h:], b), return_inverse=True, return_counts=True)
        scale, room = n / len(sample), 2 * k - max(len(a), len(b))
        for c in np.argsort(-count, kind="stable"):
            if count[c] * scale <= hot or count[c] < 8 or room <= 0:
                break
            own = sample[of == c]
            extra = min(room, int(np.ceil(np.sqrt(count[c] * scale / per_cell))), len(own) // 2)
            a, b, room = np.vstack([a, codebook(own[:, :h], extra)]), np.vstack([b, codebook(own[:, h:], extra)]), room - extra
    return a, b


def bisection(c: np.ndarray) -> np.ndarray:
    """Place of each centroid in an order that keeps near ones together."""
    place, todo, at = np.zeros(len(c), np.int64), [np.arange(len(c))], 0
    while todo:
        ids = todo.pop()
        if len(ids) <= 2:
            place[ids] = at + np.arange(len(ids))
            at += len(ids)
            continue
        m = c[ids] - c[ids].mean(0)
        o = np.argsort(m @ np.linalg.svd(m, full_matrices=False)[2][0], kind="stable")
        todo += [ids[o[len(ids) // 2 :]], ids[o[: len(ids) // 2]]]
    return place


def coded(n: np.ndarray) -> np.ndarray:
    """Counts as one byte each: 0 for none, else their logarithm in sevenths of an octave."""
    return np.where(n > 0, 1 + np.rint(7 * np.log2(np.maximum(n, 1))), 0).astype(np.uint8)


SIZES = np.concatenate([[0.0], 2 ** (np.arange(255) / 7)])  # what the bytes stand for


def turned(m: np.ndarray, view: int) -> np.ndarray:
    """The vectors in the axes of an index: as they are in the first, turned at random in the others."""
    if not view:
        return m
    return m @ np.linalg.qr(np.random.default_rng(view).normal(size=(m.shape[1], m.shape[1])))[0].astype(m.dtype)


def walk(da: list[float], db: list[float]) -> Iterator[tuple[float, int, int]]:
    """(sum, i, j) of the pairs of two sorted lists in order of their sums, from a heap."""
    heap, na, nb = [(da[0] + db[0], 0, 0)], len(da), len(db)
    while heap:
        pair = heapq.heappop(heap)
        yield pair
        _, i, j = pair
        if j + 1 < nb:
            heapq.heappush(heap, (da[i] + db[j + 1], i, j + 1))
        if j == 0 and i + 1 < na:
            heapq.heappush(heap, (da[i + 1] + db[0], i + 1, 0))


class MultiIndex:
    """Codebooks, each cell's count and, after ``lay_out``, its block. Without codebooks there is one cell."""

    def __init__(self, a: np.ndarray, b: np.ndarray, codes: np.ndarray, slack: float = 1.0):
        self.a, self.b, self.h, self.ka, self.kb, self.slack = a, b, a.shape[1], len(a), len(b), slack
        self.codes = codes.reshape(self.ka, self.kb)

    def cells(self, m: np.ndarray) -> np.ndarray:
        return nearest(m[:, : self.h], self.a) * self.kb + nearest(m[:, self.h :], self.b)

    def around(self, m: np.ndarray, pops: int) -> Iterator[tuple[list[int], list[float]]]:
        """For each vector its cells and their summed distances, in order, from a heap: all within ``slack``
        times the first one's, at most ``pops``."""
        for p in range(0, len(m), 4096):
            near = []
            for y, c in ((m[p : p + 4096, : self.h], self.a), (m[p : p + 4096, self.h :], self.b)):
                d = np.maximum((y * y).sum(1)[:, None] - 2 * y @ c.T + (c * c).sum(1), 0)
                o = np.argpartition(d, pops - 1, axis=1)[:, :pops] if pops < len(c) else np.broadcast_to(np.arange(len(c)), d.shape)
                at = np.argsort(np.take_along_axis(d, o, 1), axis=1, kind="stable")
                o = np.take_along_axis(o, at, 1)
                near += [np.take_along_axis(d, o, 1).tolist(), o.tolist()]
            for da, oa, db, ob in zip(*near):
                most, cells, far = (da[0] + db[0]) * self.slack, [], []
                for x, i, j in walk(da, db):
                    if x > most or len(cells) == pops:
                        break
                    cells.append(oa[i] * self.kb + ob[j])
                    far.append(x)
                yield cells, far

    def with_slack(self, sample: np.ndarray, places: float, pops: int) -> MultiIndex:
        """The slack with which a vector of the sample lies in ``places`` cells on average."""
        self.slack = np.inf
        ratio = np.sort(np.concatenate([np.array(d) / max(d[0], 1e-30) for _, d in self.around(sample, pops)]))
        self.slack = float(ratio[min(len(ratio) - 1, int(places * len(sample)))])
        return self

    def lay_out(self, block: int) -> MultiIndex:
        """Bins of neighbouring cells in interleaved order, packed into blocks; a bin with more vectors than
        a block is dealt out over several. Bins number some sixty to a block, however many cells there are."""
        n = SIZES[self.codes].sum(1).sum()
        bits = int(np.clip(np.ceil(np.log2(8 * np.sqrt(max(n, 1) / block))), 2, 11))
        self.za, self.zb = (bisection(c) * (1 << bits) // len(c) for c in (self.a, self.b))
        self.za, self.zb = (sum(((z >> i) & 1) << (2 * i + s) for i in range(bits)) for z, s in ((self.za, 1), (self.zb, 0)))
        weight = np.zeros(1 << 2 * bits)
        for i in range(self.ka):
            np.add.at(weight, self.za[i] + self.zb, SIZES[self.codes[i]])
        self.first, self.parts = np.zeros(len(weight), np.int32), np.ones(len(weight), np.int32)
        at, room = 0, float(block)
        for z in np.flatnonzero(weight):
            w = weight[z]
            if w > room and room < block:
                at, room = at + 1, float(block)
            self.first[z] = at
            if w > block:
                self.parts[z] = int(np.ceil(w / block))
                at, room = at + int(self.parts[z]), float(block)
            else:
                room -= w
        return self

    def bins(self, cells: np.ndarray) -> np.ndarray:
        return self.za[cells // self.kb] + self.zb[cells % self.kb]

    def salts(self, cells: np.ndarray) -> np.ndarray:
        return 1 + (SIZES[self.codes.ravel()[cells]] // SALT_ROWS).astype(np.int64)

    def traverse(self, cell: int, reach: float, pops: int) -> np.ndarray:
        """Occupied cells by summed distance of their centroids, from a heap, until they hold ``reach``
        vectors or ``pops`` pairs of centroids were taken. The cell itself is always one of them."""
        i0, j0 = divmod(cell, self.kb)
        da, db = ((self.a - self.a[i0]) ** 2).sum(1), ((self.b - self.b[j0]) ** 2).sum(1)
        oa, ob = np.argsort(da, kind="stable"), np.argsort(db, kind="stable")
        out, got, codes, sizes = [], 0.0, self.codes, _SIZE_LIST
        for _, i, j in itertools.islice(walk(da[oa].tolist(), db[ob].tolist()), pops):
            code = codes[oa[i], ob[j]]
            if code:
                out.append(int(oa[i]) * self.kb + int(ob[j]))
                got += sizes[code]
                if got >= reach:
                    break
        return np.array(out if cell in out else [cell, *out], np.int64)

    def routes(self, cell: int, reach: float, pops: int) -> tuple[list[tuple[int, int, np.ndarray]], set[tuple[int, int]]]:
        """What the vectors of ``cell`` are compared with: (block, kind, cells) where residents of the block
        ask residents (OWN), visitors ask residents (TO) or residents ask visitors (FROM); and who visits:
        (block, cell). Of two blocks the vectors in the earlier one visit the later, whoever asks."""
        found = self.traverse(cell, reach, pops)
        z, own = self.bins(found), self.bins(np.array([cell]))[0]
        first, parts, f0, p0 = self.first[z], self.parts[z], int(self.first[own]), int(self.parts[own])
        lists, visits = [], set()
        for f, p in sorted(set(zip(first[first >= f0].tolist(), parts[first >= f0].tolist()))):
            cells = found[(first == f) & (parts == p)]
            for block in range(f, f + p):
                if f == f0:
                    lists.append((block, OWN, cells))
                if f != f0 or p > 1:  # the parts of a dense bin visit each other
                    lists.append((block, TO, cells))
                    visits.add((block, cell))
        before = found[first < f0]
        if len(before):
            for block in range(f0, f0 + p0):
                lists.append((block, FROM, before))
                visits.update((block, c) for c in before.tolist())
        return lists, visits


OWN, TO, FROM = 2, 3, 4
_SIZE_LIST = SIZES.tolist()
_ONE_CELL = np.zeros(1, np.int64)


def part_of(key: np.ndarray, parts: np.ndarray) -> np.ndarray:
    """The part of several that a key belongs to, even where keys have a common factor."""
    with np.errstate(over="ignore"):
        return (((key.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % parts.astype(np.uint64)).astype(np.int64)


def best(asks: np.ndarray, keys: np.ndarray, theirs: np.ndarray, near: np.ndarray, their_keys: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, cosine, key) of the k best of each row of ``asks`` among ``theirs``, by row, cosine and key.

    ``near`` are the unit vectors of ``theirs`` in single precision; all that is within its error of the
    k-th best, however much that is, is reranked exactly. A row isn't its own neighbour (equal keys)."""
    own = unit(asks)
    score = own.astype(np.float32) @ near.T
    order = np.argsort(their_keys)
    at = order[np.minimum(np.searchsorted(their_keys, keys, sorter=order), len(order) - 1)]
    self_ = np.flatnonzero(their_keys[at] == keys)
    score[self_, at[self_]] = -9
    k = min(k, score.shape[1])
    w = score.shape[1] // 256
    if w > 1 and k <= 32:  # k of the 256 parts' maxima are k scores, so the k-th best is no lower than the least of them
        part = np.maximum.reduce(score[:, : w * 256].reshape(len(score), w, 256), axis=1)
        kth = np.partition(part, -k, axis=1)[:, -k]
    else:
        kth = np.partition(score, -k, axis=1)[:, -k]
    r, c = np.nonzero(score >= np.maximum(kth - MARGIN, -2)[:, None])
    exact = np.round(np.einsum("ij,ij->i", own[r], unit(theirs[c])), 9)
    o = np.lexsort((their_keys[c], -exact, r))
    r, c, exact = r[o], c[o], exact[o]
    keep = np.arange(len(r)) - np.searchsorted(r, r) < k
    return r[keep], exact[keep], their_keys[c[keep]]


class Pool:
    """Vectors and, sorted by cell, which of them lie in it."""

    def __init__(self, t: pa.Table, dim: int):
        self.key, self.v = t["key"].to_numpy(), matrix(t["v"], dim)
        self.near = unit(self.v).astype(np.float32)
        cell = pc.list_flatten(t["cells"]).to_numpy()
        order = np.argsort(cell, kind="stable")
        self.row = pc.list_parent_indices(t["cells"].combine_chunks()).to_numpy()[order]
        self.cells, self.starts = np.unique(cell[order], return_index=True)
        self.ends = np.append(self.starts[1:], len(cell))

    def rows(self, cells: np.ndarray) -> np.ndarray:
        if not len(self.cells):
            return np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.cells, cells), len(self.cells) - 1)
        return np.concatenate([np.zeros(0, np.int64), *[self.row[self.starts[i] : self.ends[i]] for i in at[self.cells[at] == cells]]])


def search(t: pa.Table, dim: int, k: int) -> pa.Table:
    """One slice of one block: rows of kind 0 are its residents, of kind 1 its visitors, the others what a
    cell's vectors are compared with (``routes``). -> ``key, far,
    near``, the best k of each vector and their cosines in billionths, negated."""
    kind = t["kind"].to_numpy()
    residents, visitors = (Pool(t.take(pa.array(np.flatnonzero(kind == i))), dim) for i in range(2))
    lists = t.take(pa.array(np.flatnonzero(kind > 1)))
    rows, scores, found = [], [], []
    for which, cell, reached in zip(lists["kind"].to_pylist(), lists["cells"].to_pylist(), lists["v"].to_pylist()):
        asks, theirs = visitors if which == TO else residents, visitors if which == FROM else residents
        own = asks.rows(np.array(cell))
        i = theirs.rows(np.frombuffer(reached, np.int64)) if len(own) else own
        if not len(i):
            continue
        near, v, key = theirs.near[i], theirs.v[i], theirs.key[i]
        step = max(1, (1 << 22) // len(i))
        for p in range(0, len(own), step):
            part = own[p : p + step]
            r, x, y = best(asks.v[part], asks.key[part], v, near, key, k)
            rows.append(part[r] + (len(residents.key) if which == TO else 0))
            scores.append(np.rint(-1e9 * x).astype(np.int32))
            found.append(y)
    schema = pa.schema([("key", pa.int64()), ("far", pa.list_(pa.int32())), ("near", pa.list_(pa.int64()))])
    if not rows:
        return schema.empty_table()
    keys, of = np.unique(np.concatenate([residents.key, visitors.key]), return_inverse=True)  # a vector may lie in several cells
    rows, scores, found = of[np.concatenate(rows)], np.concatenate(scores), np.concatenate(found)
    order = np.lexsort((scores, found, rows))
    rows, scores, found = rows[order], scores[order], found[order]
    new = np.append(True, (rows[1:] != rows[:-1]) | (found[1:] != found[:-1]))
    rows, scores, found = rows[new], scores[new], found[new]
    order = np.lexsort((found, scores, rows))
    rows = rows[order]
    few = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
    order = order[few]
    rows, starts = np.unique(rows[few], return_index=True)
    offsets = pa.array(np.append(starts, len(order)).astype(np.int32))
    return pa.table([pa.array(keys[rows]), pa.ListArray.from_arrays(offsets, pa.array(scores[order])), pa.ListArray.from_arrays(offsets, pa.array(found[order]))], schema=schema)


def most_similar(df: DataFrame, key: str, collection: str, vector: str, dim: int = 96, k: int = 5, order: str | None = None, reach: int = 1000, places: float = 3.5, pops: int = 16, views: int = 2, sample: int = 40_000, block: int = 8192, asking: int = 8192, salts: int = 32) -> DataFrame:
    """``key, neighbour, score, rank``: for each usable vector the k others of its collection with the
    largest cosine (fewer if there are fewer); rank is from 1, ties go to the smaller neighbour.

    Usable is a vector of ``dim`` finite numbers that aren't all zero; others, and rows whose key or
    collection is null, have no rows and are no neighbours. Of rows that repeat a ``key`` (BIGINT) the one
    with the largest ``order`` counts."""
    spark = df.sparkSession
    base = df.select(F.col(key).cast("long").alias("key"), F.col(collection).cast("string").alias("collection"), F.col(vector).cast("array<float>").alias("vec"), (F.col(order) if order else F.lit(0)).alias("order"))
    once = tables.latest(usable_vectors(base, dim), "key", "order", ["collection", "h1", "h2", "v"])
    units = written(once.where("v IS NOT NULL"), "knn-units")

    # classes of equal vectors, by two hashes; ranks by key in two steps, so a class of a third of all rows is no task
    ids = units.select("key", "collection", "h1", "h2", F.pmod(F.xxhash64("key"), F.lit(salts)).alias("salt"))
    cls = ["collection", "h1", "h2"]
    some = ids.withColumn("r", F.row_number().over(Window.partitionBy(*cls, "salt").orderBy("key"))).where(F.col("r") <= k + 1)
    heads = written(some.withColumn("r", F.row_number().over(Window.partitionBy(*cls).orderBy("key"))).where(F.col("r") <= k + 1).select("key", *cls, "r"), "knn-heads")
    full = heads.where(F.col("r") == k + 1).select(*cls)
    copies = written(ids.join(full, cls).join(heads.select("key"), "key", "left_anti"), "knn-copies")
    of_copies = copies.join(heads.where(F.col("r") <= k).select(*cls, F.col("key").alias("neighbour"), F.col("r").alias("rank")), cls).select("key", "neighbour", F.lit(1.0).alias("score"), "rank")
    entries = units.select("collection", "key", "v").join(copies.select("key"), "key", "left_anti")

    total = heads.count()
    large = heads.groupBy("collection").agg(F.count("*").alias("n")).where(F.col("n") > max(2 * reach, total >> 14))  # at most 2^14 rows
    # a view's shuffles are as large as all its copies of the vectors, so they are removed as soon as it is written
    done, kept = [], spark.conf.get(CLEAN_UP, "false")
    spark.conf.set(CLEAN_UP, "true")
    try:
        for view in range(views if large.count() else 1):
            own = entries.join(F.broadcast(large.select("collection")), "collection") if view else entries
            done.append(written(one_view(own, large, view, dim, k, reach, places, pops, max(reach, total / MOST_CELLS), sample, block, asking), "knn-near"))
    finally:
        spark.conf.set(CLEAN_UP, kept)
    # a pair may have met in several places, its score then differs by one billionth at most
    merged = functools.reduce(DataFrame.unionByName, done).groupBy("key").agg(F.flatten(F.collect_list("far")).alias("far"), F.flatten(F.collect_list("near")).alias("neighbour"))
    merged = merged.select("key", F.slice(F.array_distinct(F.sort_array(F.arrays_zip("far", "neighbour"))), 1, 2 * k).alias("met"))
    best_ = F.slice(F.filter("met", lambda x, i: F.array_position(F.col("met.neighbour"), x["neighbour"]) == i + 1), 1, k)
    near = merged.select("key", F.posexplode(best_).alias("at", "x"))
    near = near.select("key", "x.neighbour", (F.col("x.far") / -1e9).alias("score"), (F.col("at") + 1).alias("rank"))
    return near.unionByName(of_copies).withColumnRenamed("key", key)


def one_view(entries: DataFrame, large: DataFrame, view: int, dim: int, k: int, reach: int, places: float, pops: int, per_cell: float, sample: int, block: int, asking: int) -> DataFrame:
    """``key, far, near``: the best k of each vector in one index (``search``), a row for each block that it lies in."""
    spark = entries.sparkSession
    chance = F.pmod(F.xxhash64("key", F.lit(1 + view)), F.lit(1 << 30)) < F.floor(F.lit(float(1 << 30)) * sample / F.col("n"))
    spread = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def fit(t: pa.Table) -> pa.Table:
        m = turned(unit(matrix(t["v"], dim)).astype(np.float32), view)
        a, b = codebooks(m, t["n"][0].as_py(), per_cell, 4.0 * reach)
        ix = MultiIndex(a, b, np.zeros(len(a) * len(b), np.uint8)).with_slack(m[:4000], places, pops)
        return pa.table({"collection": t["collection"].slice(0, 1), "ka": [len(a)], "kb": [len(b)], "slack": [ix.slack], "books": [a.tobytes() + b.tobytes()]}, schema=pa.schema([("collection", pa.string()), ("ka", pa.int32()), ("kb", pa.int32()), ("slack", pa.float64()), ("books", pa.binary())]))

    index: dict[str, MultiIndex] = {}
    for r in entries.join(F.broadcast(large), "collection").where(chance).groupBy("collection").applyInArrow(fit, "collection string, ka int, kb int, slack double, books binary").collect():
        h, c = dim // 2, np.frombuffer(r.books, np.float32)
        index[r.collection] = MultiIndex(c[: r.ka * h].reshape(r.ka, h), c[r.ka * h :].reshape(r.kb, dim - h), np.zeros(r.ka * r.kb, np.uint8), r.slack)
    books = spark.sparkContext.broadcast(index)

    def cells_of(rb: pa.RecordBatch, index: dict[str, MultiIndex]) -> tuple[np.ndarray, np.ndarray]:
        """The rows' cells as pairs of row and cell, by row."""
        names, m = np.array(rb.column("collection").to_pylist(), dtype=object), None
        row, cell = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for x in dict.fromkeys(names.tolist()):
            at = np.flatnonzero(names == x)
            if x in index:
                m = turned(unit(matrix(rb.column("v"), dim)).astype(np.float32), view) if m is None else m
                lists = [c for c, _ in index[x].around(m[at], pops)]
                row.append(np.repeat(at, [len(c) for c in lists]))
                cell.append(np.array(list(itertools.chain.from_iterable(lists)), np.int64))
            else:
                row.append(at)
                cell.append(np.zeros(len(at), np.int64))
        return np.concatenate(row), np.concatenate(cell)

    def cells(batches):
        for rb in batches:
            row, cell = cells_of(rb, books.value)
            yield pa.RecordBatch.from_arrays([rb.column("collection").take(pa.array(row)), pa.array(cell)], names=["collection", "cell"])

    # the cells are found again where they are needed; that costs less than to keep them with the vectors
    occupied = written(entries.select("collection", "v").mapInArrow(cells, "collection string, cell long").groupBy("collection", "cell").agg(F.count("*").alias("n")), "knn-cells")

    def packed(t: pa.Table) -> pa.Table:
        at = t["cell"].to_numpy() & 0xFFFF
        codes = np.zeros(int(at.max()) + 1, np.uint8)
        codes[at] = coded(t["n"].to_numpy())
        return pa.table({"collection": t["collection"].slice(0, 1), "chunk": [t["cell"][0].as_py() >> 16], "codes": [codes.tobytes()]}, schema=pa.schema([("collection", pa.string()), ("chunk", pa.int64()), ("codes", pa.binary())]))

    some_cells = occupied.join(F.broadcast(large.select("collection")), "collection")
    for r in some_cells.groupBy("collection", (F.col("cell") / 65536).cast("long").alias("chunk")).applyInArrow(packed, "collection string, chunk long, codes binary").collect():
        index[r.collection].codes.reshape(-1)[r.chunk << 16 : (r.chunk << 16) + len(r.codes)] = np.frombuffer(r.codes, np.uint8)
    for x in index.values():
        x.lay_out(block)
    whole = spark.sparkContext.broadcast(index)

    def probes(batches):
        for rb in batches:
            out: list[tuple] = []
            for name, cell in zip(rb.column("collection").to_pylist(), rb.column("cell").to_pylist()):
                ix = whole.value.get(name)
                lists, visits = ([(0, OWN, _ONE_CELL)], set()) if ix is None else ix.routes(cell, 1, 1)
                out += [(name, block_, kind, cell, 0, 0, cells.tobytes()) for block_, kind, cells in lists]
                if visits:
                    who = np.array([c for _, c in visits])
                    sizes, salts_ = np.ceil(SIZES[ix.codes.ravel()[who]]).astype(np.int64).tolist(), ix.salts(who).tolist()
                    out += [(name, block_, 1, c, n, s, b"") for (block_, c), n, s in zip(visits, sizes, salts_)]
            columns = zip(*out) if out else [[]] * 7
            types = (pa.string(), pa.int32(), pa.int8(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names=["collection", "block", "kind", "cell", "n", "salts", "v"])

    routes = written(occupied.repartition(spread).select("collection", "cell").mapInArrow(probes, "collection string, block int, kind tinyint, cell long, n long, salts int, v binary"), "knn-routes")
    visits = routes.where("kind = 1").select("collection", "block", "cell", "n", "salts").distinct()
    blocks = routes.where("kind > 1").select("collection", "block").distinct().join(visits.groupBy("collection", "block").agg(F.sum("n").alias("n")), ["collection", "block"], "left")
    blocks = blocks.select("collection", "block", F.greatest(F.lit(1), F.ceil(F.coalesce("n", F.lit(0)) / asking)).cast("long").alias("slices"))  # a row a block
    numbered = blocks.withColumn("end", F.sum("slices").over(Window.orderBy("collection", "block").rowsBetween(Window.unboundedPreceding, 0)))
    numbered = written(numbered.select("collection", "block", F.explode(F.sequence(F.col("end") - F.col("slices"), F.col("end") - 1)).alias("group")), "knn-groups")
    lanes = max(1, min(MOST_LANES, numbered.count()))
    # numbers that hash to different partitions, so that each of these has one group
    apart = spark.range(20 * lanes).groupBy(F.pmod(F.hash("id"), F.lit(lanes)).cast("long").alias("at")).agg(F.min("id").alias("apart"))
    lane = F.coalesce("apart", F.lit(0)) + F.floor(F.col("group") / lanes) * F.lit(20 * lanes)
    slices = written(numbered.withColumn("at", F.col("group") % lanes).join(apart, "at", "left").groupBy("collection", "block").agg(F.collect_list(F.struct(lane.cast("long").alias("lane"), "group")).alias("lanes")), "knn-slices")

    def assigned(batches):
        for rb in batches:
            row, cell = cells_of(rb, whole.value)
            names, key_ = np.array(rb.column("collection").to_pylist(), dtype=object)[row], rb.column("key").to_numpy()[row]
            block_, salt = np.zeros(len(cell), np.int32), np.zeros(len(cell), np.int32)
            for name in set(names.tolist()) & set(whole.value):
                ix, at = whole.value[name], np.flatnonzero(names == name)
                z = ix.bins(cell[at])
                block_[at] = ix.first[z] + part_of(key_[at], ix.parts[z])
                salt[at] = part_of(key_[at], ix.salts(cell[at]))
            # a vector with several cells in a block is sent there once
            order = np.lexsort((block_, row))
            row, cell, block_, salt = row[order], cell[order], block_[order], salt[order]
            starts = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (block_[1:] != block_[:-1])) if len(row) else row)
            rb, ends = rb.take(pa.array(row[starts])), pa.array(np.append(starts, len(row)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (cell, salt)]
            yield pa.RecordBatch.from_arrays([rb.column("collection"), *lists, rb.column("key"), rb.column("v"), pa.array(block_[starts])], names=["collection", "cells", "salts", "key", "v", "own"])

    placed = entries.select("collection", "key", "v").mapInArrow(assigned, "collection string, cells array<long>, salts array<int>, key long, v binary, own int")
    each = F.explode("lanes").alias("to")
    columns = ["to", F.col("kind").cast("tinyint").alias("kind"), "cells", "key", "v"]
    residents = placed.withColumnRenamed("own", "block").join(slices, ["collection", "block"]).select("*", F.lit(0).alias("kind"), each).select(*columns)
    to = visits.select("collection", "cell", "block", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    one = F.element_at("lanes", (F.pmod(F.xxhash64("key"), F.size("lanes")) + 1).cast("int")).alias("to")
    each_cell = placed.select("collection", "key", "v", "own", F.explode(F.arrays_zip(F.col("cells").alias("cell"), F.col("salts").alias("salt"))).alias("x")).select("*", "x.*").drop("x")
    visitors = each_cell.join(to, ["collection", "cell", "salt"]).where("own <> block").join(slices, ["collection", "block"]).select("*", F.lit(1).alias("kind"), F.array("cell").alias("cells"), one).select(*columns)
    lists = routes.where("kind > 1").select("collection", "block", "kind", F.array("cell").alias("cells"), F.lit(0).cast("long").alias("key"), "v").join(slices, ["collection", "block"])
    # residents ask each other once, in the first slice
    lists = lists.where(f"kind = {OWN}").withColumn("to", F.element_at("lanes", 1)).select(*columns).unionByName(lists.where(f"kind > {OWN}").select("*", each).select(*columns))
    every = residents.unionByName(lists)
    if not visits.isEmpty():  # only dense places have any
        every = every.unionByName(visitors)
    every = every.select(F.col("to.lane").alias("lane"), F.col("to.group").alias("group"), "kind", "cells", "key", "v")
    return every.repartition(lanes, "lane").groupBy("lane", "group").applyInArrow(lambda t: search(t, dim, k), "key long, far array<int>, near array<long>")


def linked_pairs(near: DataFrame, key: str) -> DataFrame:
    """``a, b`` with a < b: pairs of which at least one is among the other's neighbours."""
    return near.select(F.least(key, "neighbour").alias("a"), F.greatest(key, "neighbour").alias("b")).distinct()
