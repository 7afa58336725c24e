"""Problem 8: pages of repeated keywords, links or tags, found by the coherence of neighbouring words.

Neighbouring words of a line are a pair. The pointwise mutual information (PMI) of a pair is taken from
exact counts over all pages, without the page's own: a pair that no other page shows says nothing, so it
counts 0. Exact copies (up to outer white space) are one page for the counts. What the corpus's pairs have
on average (their mutual information, the ``level``) is the measure of coherence. A line is

* ``salad``: at least fifteen words without sentences whose mean PMI is below ``loose`` times the level;
* ``links`` or ``tags``: it looks like a list of addresses, of tags or of goods, and the page's lines of
  that kind have a mean PMI below ``listed`` times the level, or collocations repeated in excess;
* ``stuffed``: at least half of its words are in collocations that the page repeats excessively, that is
  at a rate far above the corpus's (lines with brackets, as code and logs have, are left out);
* ordinary text otherwise. What a line looks like never decides alone.

A page is flagged if those four make up the greater part of its characters.

Counting: batches of pages send the hashes of their distinct words and pairs with their counts to slices
of the hash space; a slice adds them up and answers every batch with the corpus's counts of just the
hashes it asked for. Nothing that grows with the data is broadcast or reaches the driver, and only two
equal 64-bit hashes could make a count inexact. Text is tokenised and scored as arrays of bytes.
"""

from __future__ import annotations

import re
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelode.llm.words import blocks, joined, mixed, words_of
from codelode.session import written

BATCH = 1 << 24  # bytes of the pages that ask together
SLICE = 1 << 25  # bytes of the corpus whose hashes make one slice of the counts
_WORD = re.compile(r"[^\W\d_]+")
_URL = re.compile(r"(?:https?://|www\.)[^\s<>()\"'\]]*", re.I)
_TAG = re.compile(r"</?[a-z][^<>]*>", re.I)
_END = re.compile(r"[.!?](?:\s|$)|[。！？]")
_PRICE = re.compile(r"[$€£]\s?\d|\d\s?(?:[$€£]|(?:USD|EUR|GBP)\b)")
_SEPARATOR = re.compile(r"\s*[;,|•·/]\s+|\s+[-–|•·]\s+")
_CODE = re.compile(r"[(){}=\[\]`<>]|::|->|\w/\w")


def _of_kind(h: np.ndarray, kind: int) -> np.ndarray:
    """The lowest bit tells pairs (1) from words (0)."""
    return (h & ~np.uint64(1)) | np.uint64(kind)


def pairs_of(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _of_kind(mixed((h[:-1] * np.uint64(0xD6E8FEB86659FD93)) ^ (h[1:] + np.uint64(0x165667B19E3779F9))), 1)


class Block:
    """Some pages as arrays: words, their lines and pages, and the pairs inside lines."""

    def __init__(self, texts: pa.Array):
        self.bytes, starts = joined(texts)
        h, at = words_of(self.bytes)
        self.hash = _of_kind(h, 0)
        self.breaks = np.flatnonzero(self.bytes == 10)
        self.line = np.searchsorted(self.breaks, at)
        n = np.diff(np.searchsorted(self.breaks, starts - 1))  # a page's line ends, and the one before it
        n[0] += 1
        self.n_lines = int(n.sum())
        self.page_of_line = np.repeat(np.arange(len(texts)), n)
        self.pair = pairs_of(self.hash) if len(self.hash) > 1 else np.zeros(0, np.uint64)
        inside = np.flatnonzero(self.line[:-1] == self.line[1:])
        self.pair, self.pair_line, self.left = self.pair[inside], self.line[:-1][inside], inside
        self.pair_page = self.page_of_line[self.pair_line]


def in_batches(pages: DataFrame) -> DataFrame:
    """``batch, bytes, pages`` for rows of ``k, t, first``: packed batches of at most BATCH bytes (a longer
    page is one by itself), written so that a batch is the same one whenever it is read."""

    def pack(batches):
        schema, held, size = None, [], 0

        def row():
            out = pa.BufferOutputStream()
            with pa.ipc.new_stream(out, schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                for x in held:
                    w.write_batch(x)
            return pa.RecordBatch.from_pydict({"batch": pa.array([uuid.uuid4().int >> 65], pa.int64()), "bytes": pa.array([size], pa.int64()), "pages": pa.array([out.getvalue().to_pybytes()], pa.binary())})

        for rb in batches:
            schema = rb.schema
            sizes = pc.binary_length(rb.column("t")).to_numpy(zero_copy_only=False)
            first = 0
            for i, n in enumerate(sizes):
                if size and size + int(n) > BATCH:
                    if i > first:
                        held.append(rb.slice(first, i - first))
                    yield row()
                    first, held, size = i, [], 0
                size += int(n)
            if first < len(sizes):
                held.append(rb.slice(first))
        if held:
            yield row()

    kind = dict(pages.dtypes)
    assert list(kind) == ["k", "t", "first"]
    return written(pages.mapInArrow(pack, "batch long, bytes long, pages binary"), "page-batches")


def _unpacked(pages: bytes) -> pa.Table:
    return pa.ipc.open_stream(pages).read_all()


def _texts(rows: pa.Table) -> pa.Array:
    texts = rows.column("t").combine_chunks()
    return texts.chunk(0) if isinstance(texts, pa.ChunkedArray) else texts


def _sums(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ids, sorted, and the sums of their counts."""
    ids, at = np.unique(np.concatenate([np.zeros(0, np.uint64), *[x for x, _ in parts]]), return_inverse=True)
    return ids, np.bincount(at, weights=np.concatenate([np.zeros(0), *[n for _, n in parts]]), minlength=len(ids)).astype(np.int64)


def batch_counts(packed: DataFrame) -> DataFrame:
    """``batch, ids, n, words, pairs, words_log, pairs_log``: for each batch, from each slice of the hashes, the
    corpus's counts of what the batch has there; the number n of words and of pairs of the whole slice, and
    the sums of n log n."""
    slices = 1 + (packed.agg(F.sum("bytes")).first()[0] or 0) // SLICE

    def ask(batches):
        for pdf in batches:
            for batch, pages in zip(pdf["batch"], pdf["pages"]):
                rows, parts = _unpacked(pages), []
                first = rows.column("first").to_numpy()
                for i, texts in blocks(_texts(rows)):
                    b = Block(texts)
                    counted = first[i : i + len(texts)]
                    for h, page in ((b.hash, b.page_of_line[b.line]), (b.pair, b.pair_page)):
                        got, at = np.unique(h, return_inverse=True)
                        parts.append((got, np.bincount(at, weights=counted[page], minlength=len(got))))
                ids, n = _sums(parts)
                ends = np.searchsorted((ids >> np.uint64(32)).astype(np.int64) * slices >> 32, np.arange(slices + 1))
                # a batch asks every slice, as it needs the totals of all
                yield pd.DataFrame([(batch, i, ids[s:e].tobytes(), n[s:e].tobytes()) for i, (s, e) in enumerate(zip(ends, ends[1:]))], columns=["batch", "slice", "ids", "n"])

    def answer(pdf):
        asked = [np.frombuffer(x, np.uint64) for x in pdf["ids"]]
        got, n = _sums([(x, np.frombuffer(y, np.int64)) for x, y in zip(asked, pdf["n"])])
        of_pairs = (got & np.uint64(1)).astype(bool)
        log = n * np.log(np.maximum(n, 1))
        totals = {"words": int(n[~of_pairs].sum()), "pairs": int(n[of_pairs].sum()), "words_log": float(log[~of_pairs].sum()), "pairs_log": float(log[of_pairs].sum())}
        return pd.DataFrame({"batch": pdf["batch"], "ids": pdf["ids"], "n": [n[np.searchsorted(got, x)].tobytes() for x in asked], **totals})

    asked = packed.select("batch", "pages").mapInPandas(ask, "batch long, slice long, ids binary, n binary")
    return asked.groupBy("slice").applyInPandas(answer, "batch long, ids binary, n binary, words long, pairs long, words_log double, pairs_log double")


class Counts:
    """The corpus's counts of those words and pairs that a batch of pages has (``ids`` are sorted), and
    ``level``, the mutual information of neighbours: what pairs have on average."""

    def __init__(self, parts: pd.DataFrame):
        ids, n = (np.frombuffer(b"".join(parts[c]), t) for c, t in (("ids", np.uint64), ("n", np.int64)))
        order = np.argsort(ids)
        self.ids, self.n = ids[order], n[order]
        self.words, self.pairs = (max(1, int(parts[c].sum())) for c in ("words", "pairs"))
        # entropies from the sums of n log n
        of_words, of_pairs = (np.log(total) - parts[c].sum() / total for c, total in (("words_log", self.words), ("pairs_log", self.pairs)))
        self.level = max(0.0, float(2 * of_words - of_pairs))

    def of(self, h: np.ndarray) -> np.ndarray:
        return self.n[np.searchsorted(self.ids, h)] if len(h) else np.zeros(0, np.int64)


def line_kind(line: str) -> str | None:
    """``links`` or ``tags`` where a line looks like a list of them."""
    if "://" in line or "www." in line.lower():
        urls = _URL.findall(line)
        rest = _TAG.sub(" ", _URL.sub(" ", line))
        words = len(_WORD.findall(rest))
        if urls and words <= 6 * len(urls) and not (words > 4 and _END.search(rest)):
            return "links"
    if line.count("#") >= 3:
        parts = line.split()
        if sum(p[0] == "#" and len(p) > 1 for p in parts) >= 0.6 * len(parts):
            return "tags"
    if ("$" in line or "€" in line or "£" in line or "USD" in line or "EUR" in line or "GBP" in line) and _PRICE.search(line) and len(_WORD.findall(line)) <= 6 and not _END.search(line):
        return "tags"
    if sum(map(line.count, ";,|•·/-–")) < 7:
        return None
    items = [x for x in _SEPARATOR.split(line) if x.strip(" .:;,|")]
    if len(items) >= 8 and not _END.search(line.rstrip(" .")):
        sizes = [len(_WORD.findall(x)) for x in items]
        if sum(0 < n <= 4 for n in sizes) >= 0.85 * len(items) and len(_CODE.findall(line)) <= len(items) // 4:
            return "tags"
    return None


def list_like(b: Block) -> np.ndarray:
    """Lines that ``line_kind`` should look at: with an address, hash signs, a price or many separators."""
    x, n = b.bytes, b.n_lines
    per_line = lambda at: np.bincount(np.searchsorted(b.breaks, at), minlength=n)

    def has(word: bytes) -> np.ndarray:
        ok = np.ones(max(0, len(x) - len(word) + 1), bool)
        for i, c in enumerate(word):
            ok &= x[i : i + len(ok)] == c
        return per_line(np.flatnonzero(ok)) > 0

    separators = np.zeros(256, bool)
    separators[list(b";,|/-\xc2\xe2")] = True
    price = np.zeros(256, bool)
    price[list(b"$\xc2\xe2")] = True
    some = has(b"://") | has(b"www.") | (per_line(np.flatnonzero(x == ord("#"))) >= 3) | (per_line(np.flatnonzero(separators[x])) >= 7) | (per_line(np.flatnonzero(price[x])) > 0)
    for word in (b"usd", b"eur", b"gbp"):
        some |= has(word)
    return np.flatnonzero(some)


COLUMNS = ("links", "tags", "salad", "stuffed", "chars", "pmi", "words")


def score_block(texts: pa.Array, c: Counts, rate: float, burst: float, listed: float, loose: float) -> dict[str, np.ndarray]:
    """The columns of each page."""
    b = Block(texts)
    lines = [s.strip() for t in texts.to_pylist() for s in t.split("\n")]
    size = np.fromiter(map(len, lines), np.int64, count=len(lines))
    pages, n_pages = b.page_of_line, len(texts)
    cw, cp = c.of(b.hash), c.of(b.pair)
    own = own_counts(b)
    others = cp - own
    pmi = np.where(others > 0, np.log(np.maximum(others, 1) / c.pairs) - np.log(np.maximum(cw[b.left], 1) / c.words) - np.log(np.maximum(cw[b.left + 1], 1) / c.words), 0.0)
    n_pairs = np.bincount(b.pair_page, minlength=n_pages)
    all_ = n_pairs[b.pair_page]
    # far above the corpus's rate, or (in a small corpus) a pair that is almost only this page's own
    hot = (own >= np.maximum(4, rate * all_)) & ((own / np.maximum(all_, 1) >= burst * cp / c.pairs) | (own >= 0.5 * cp))
    covered = np.zeros(len(b.hash), bool)
    covered[b.left[hot]] = True
    covered[b.left[hot] + 1] = True
    n_words = np.bincount(b.line, minlength=b.n_lines)
    share = np.bincount(b.line, weights=covered, minlength=b.n_lines) / np.maximum(n_words, 1)
    in_line = np.bincount(b.pair_line, minlength=b.n_lines)
    total = np.bincount(b.pair_line, weights=pmi, minlength=b.n_lines)
    out = {x: np.zeros(n_pages) for x in COLUMNS}
    kind = np.zeros(b.n_lines, np.int8)
    for i in list_like(b):
        kind[i] = {"links": 1, "tags": 2, None: 0}[line_kind(lines[i])]
    for k, name in ((1, "links"), (2, "tags")):
        at = np.flatnonzero(kind == k)
        of = lambda v: np.bincount(pages[at], weights=v[at], minlength=n_pages)  # noqa: B023, E731
        pmi_sum, pmi_n, cover, words = of(total), of(in_line), of(share * n_words), of(n_words)
        good = (pmi_sum < listed * c.level * pmi_n) | (cover >= 0.5 * np.maximum(words, 1)) | (words == 0)
        kind[at[~good[pages[at]]]] = 0
        out[name] = np.where(good, of(size), 0.0)
    low = total < loose * c.level * in_line
    for i in np.flatnonzero((kind == 0) & ((n_words >= 15) & low | (share >= 0.5) & (n_words > 0))):
        n, code = int(n_words[i]), len(_CODE.findall(lines[i]))
        if code * 10 >= n:
            continue
        if n >= 15 and low[i] and len(_END.findall(lines[i])) * 40 < n + 39:
            out["salad"][pages[i]] += size[i]
        elif share[i] >= 0.5:
            out["stuffed"][pages[i]] += size[i]
    out["chars"] = np.bincount(pages, weights=size, minlength=n_pages)
    out["pmi"] = np.bincount(b.pair_page, weights=pmi, minlength=n_pages) / np.maximum(n_pairs, 1)
    out["words"] = np.bincount(pages[b.line], minlength=n_pages).astype(float)
    return out


def own_counts(b: Block) -> np.ndarray:
    """How often each pair comes in its own page."""
    with np.errstate(over="ignore"):
        key = mixed(b.pair ^ (b.pair_page.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
    _, where, count = np.unique(key, return_inverse=True, return_counts=True)
    return count[where]


def score_pages(docs: DataFrame, key: str, text: str, listed: float = 0.9, loose: float = 0.4, rate: float = 0.01, burst: float = 50.0, least_chars: int = 120) -> DataFrame:
    """``key, links, tags, salad, stuffed, chars, pmi, words, flagged`` for every row with a text.

    ``listed`` and ``loose`` are shares of the corpus's mean PMI below which neighbours in lists and in running
    lines count as unrelated; a collocation is excessive if it makes at least ``rate`` of the page's pairs
    (and four) and ``burst`` times its rate in the corpus, or half of it. Null texts have no row; texts of fewer
    than ``least_chars`` characters (empty ones too) are never flagged. Each row is scored by itself, so
    repeated rows have equal results; without pairs in the corpus nothing is incoherent."""
    kind = dict(docs.dtypes)[key]
    rows = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t"))
    # all but one of equal texts, by their hashes; few in most corpora, so that they are joined without a shuffle of the texts
    hashes = written(docs.where(F.col(text).isNotNull()).select(F.col(key).alias("k"), F.xxhash64(F.trim(text), F.length(F.trim(text))).alias("h")), "page-hashes")
    again = hashes.groupBy("h").agg(F.min("k").alias("least"), F.count("*").alias("n")).where("n > 1").select("h", "least")
    copies = written(hashes.join(again, "h").where("k <> least").select("k", F.lit(False).alias("first")).distinct(), "page-copies")
    packed = in_batches(rows.join(copies, "k", "left").select("k", "t", F.coalesce("first", F.lit(True)).alias("first")))

    def run(mine, theirs):
        c = Counts(theirs)
        for pages in mine["pages"]:
            table = _unpacked(pages)
            parts = [score_block(texts, c, rate, burst, listed, loose) for _, texts in blocks(_texts(table))]
            return table.select(["k"]).to_pandas().assign(**{x: np.concatenate([p[x] for p in parts]) for x in COLUMNS})

    scored = packed.select("batch", "pages").groupBy("batch").cogroup(batch_counts(packed).groupBy("batch")).applyInPandas(run, f"k {kind}, " + ", ".join(f"{c} double" for c in COLUMNS))
    flagged = (F.col("chars") >= least_chars) & (F.col("links") + F.col("tags") + F.col("salad") + F.col("stuffed") > 0.5 * F.col("chars"))
    return scored.select(F.col("k").alias(key), *COLUMNS, flagged.alias("flagged"))
