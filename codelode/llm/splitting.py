"""Problem 5: cut oversized texts at natural boundaries, with overlap, by byte ranges.

A text is read as byte ranges of ``range_bytes``. Each worker sees one range, a few bytes before it
and a halo behind it of as many bytes as two pieces can hold; nobody holds a whole file. For every text

1. every range makes a boundary table: for each character at which a piece can enter the range, the
   place where the chain of pieces that begins there leaves it and how many pieces begin inside. It
   is kept run-length coded (chains merge fast), so it has about a thousandth of the text's size; a text's
   first range has one entry;
2. the ranges' lengths in characters are prefix-summed and the tables stitched in order per text;
3. each range is read again with its entry point and first piece number and emits its pieces by offset.

Boundaries from strong to weak: after a blank line, after a line end, after the end of a sentence,
after white space. A piece ends at the last boundary of the strongest kind found in the second half
of its window; failing that at the last white space of the window, or at the limit if white space follows;
failing that it is cut at the limit (forced). So a text has forced cuts exactly if it has a run without white
space that is longer than the limit. The next piece begins at the first boundary within the last ``overlap`` characters,
or exactly ``overlap`` characters back if the cut was forced; where a piece from such a boundary
would have to be forced before it gets beyond the last cut, a later boundary is taken.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codelode.session import written

BEFORE = 8  # bytes before a range: two characters
_KINDS = (re.compile(r"\n[ \t\r]*\n"), re.compile(r"\n"), re.compile(r"[.!?;:][\"')\]]?\s"), re.compile(r"\s"))


class Window:
    """Characters of one range with its surroundings; positions are relative to the range's first character."""

    def __init__(self, before: bytes, body: bytes, after: bytes, limit: int, overlap: int, ends: bool):
        lead = _whole_start(body)
        own_end = _whole_end(body, after)
        left = (before + body[:lead]).decode("utf-8", "ignore")
        own = (body[lead:] + after[:own_end]).decode("utf-8", "replace")
        rest = after[own_end:].decode("utf-8", "ignore") if after[own_end:] else ""
        self.shift, self.n, self.text = len(left), len(own), left + own + rest
        self.limit, self.overlap = limit, min(overlap, max(0, limit // 2 - 1))
        self.end = self.shift + self.n + len(rest) if ends else None  # end of the text, if it is in sight
        self.cuts = [[m.end() for m in kind.finditer(self.text)] for kind in _KINDS]
        self.any = self.cuts[3]

    def step(self, s: int) -> tuple[int, int | None, bool]:
        """(end of the piece that begins at ``s``, start of the next piece or None at the end of the text, forced)."""
        if self.end is not None and self.end - s <= self.limit:
            return self.end, None, False
        top = s + self.limit
        for cuts in self.cuts:
            i = bisect_right(cuts, top) - 1
            if i >= 0 and cuts[i] >= s + (self.limit + 1) // 2:
                e, forced = cuts[i], False
                break
        else:
            i = bisect_right(self.any, top) - 1
            e, forced = (self.any[i], False) if i >= 0 and self.any[i] > s else (top, not self.text[top : top + 1].isspace())
        back = max(e - self.overlap, s + 1)
        if forced:
            return e, min(back, e), True
        i = bisect_right(self.any, e)
        ahead = self.any[i] if i < len(self.any) else self.end
        for b in self.any[bisect_left(self.any, back) : i]:  # the piece from b must get beyond e
            if ahead is not None and b + self.limit >= ahead:
                return e, b, False
        return e, e, False

    def chain(self, entry: int) -> Iterator[tuple[int, int, bool]]:
        """(start, end, forced) of the pieces that begin in the range, from the entry on."""
        s: int | None = entry + self.shift
        while s is not None and s < self.shift + self.n:
            e, nxt, forced = self.step(s)
            yield s, e, forced
            s = nxt


def _whole_start(body: bytes) -> int:
    """Bytes at the front that continue a character of the range before."""
    i = 0
    while i < min(4, len(body)) and body[i] & 0xC0 == 0x80:
        i += 1
    return i


def _whole_end(body: bytes, after: bytes) -> int:
    """Bytes of ``after`` that finish the last character of ``body``."""
    return _whole_start(after[:4])


PIECES = T.StructType([
    T.StructField("key", T.LongType()), T.StructField("piece_no", T.LongType()), T.StructField("start_char", T.LongType()),
    T.StructField("end_char", T.LongType()), T.StructField("forced", T.BooleanType()), T.StructField("piece", T.StringType()),
])
TABLE = "key long, range_no long, chars long, from_char array<int>, exit_char array<int>, n_pieces array<int>"


RANGES = "key long, max_chars int, overlap int, range_no long, before binary, body binary, after binary, ends boolean"
FLUSH = 1 << 24  # bytes of ranges that a task hands on at once


def _size(limit: int, range_bytes: int) -> int:
    return max(range_bytes, 4 * limit)


def _batches(rows: Iterator[tuple]) -> Iterator[pd.DataFrame]:
    names, held, size = [c.split(" ")[0] for c in RANGES.split(", ")], [], 0
    for r in rows:
        held.append(r)
        size += len(r[5]) + len(r[6])
        if size >= FLUSH:
            yield pd.DataFrame(held, columns=names)
            held, size = [], 0
    yield pd.DataFrame(held, columns=names)


def byte_ranges(df: DataFrame, range_bytes: int) -> DataFrame:
    """(key, text, max_chars, overlap) -> one row per byte range with its surroundings. A row's text is
    there when it is read; from then on only ranges travel."""

    def cut(batches):
        def rows():
            for pdf in batches:
                for key, text, limit, overlap in zip(pdf["key"], pdf["text"], pdf["max_chars"], pdf["overlap"]):
                    b = text.encode("utf-8", "replace")
                    size, halo = _size(limit, range_bytes), limit * 8 + 16
                    for no, off in enumerate(range(0, len(b), size)):
                        yield key, limit, overlap, no, b[max(0, off - BEFORE) : off], b[off : off + size], b[off + size : off + size + halo], off + size + halo >= len(b)

        yield from _batches(rows())

    sized = df.select("key", "text", F.col("max_chars").cast("int").alias("max_chars"), F.coalesce(F.col("overlap").cast("int"), F.lit(0)).alias("overlap"))
    return sized.mapInPandas(cut, RANGES)


def file_ranges(files: DataFrame, range_bytes: int) -> DataFrame:
    """The same for files on storage that all executors reach: (key, path, n, max_chars, overlap), ``n``
    the size in bytes. Each task seeks to its ranges and reads no more than them and their halos."""
    sized = files.select("key", "path", F.col("n").cast("long").alias("n"), F.col("max_chars").cast("int").alias("max_chars"), F.coalesce(F.col("overlap").cast("int"), F.lit(0)).alias("overlap")).where("n > 0 AND max_chars >= 1")
    sized = sized.withColumn("size", F.greatest(F.lit(range_bytes), F.col("max_chars") * 4).cast("long"))
    cut = sized.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / F.col("size")).cast("long"))).alias("range_no"))

    def read(batches):
        def rows():
            for pdf in batches:
                for r in pdf.itertuples(index=False):
                    off, halo, lead = r.range_no * r.size, r.max_chars * 8 + 16, min(r.range_no * r.size, BEFORE)
                    where, path = pa.fs.FileSystem.from_uri(r.path if ":" in r.path else f"file://{r.path}")
                    with where.open_input_file(path) as f:
                        f.seek(off - lead)
                        got = f.read(lead + r.size + halo)
                    yield r.key, r.max_chars, r.overlap, r.range_no, got[:lead], got[lead : lead + r.size], got[lead + r.size :], off + r.size + halo >= r.n

        yield from _batches(rows())

    spread = max(2, int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return cut.repartition(spread, "key", "range_no").mapInPandas(read, RANGES)


def _window(r) -> Window:
    return Window(bytes(r.before), bytes(r.body), bytes(r.after), int(r.max_chars), int(r.overlap), bool(r.ends))


def _emit(with_text: bool):
    def run(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                w, no, base = _window(r), int(r.first_piece), int(r.base)
                for s, e, forced in w.chain(int(r.entry)):
                    out.append((r.key, no, base + s - w.shift, base + e - w.shift, forced, w.text[s:e] if with_text else None))
                    no += 1
            yield pd.DataFrame(out, columns=PIECES.names)

    return run


def _tables(batches):
    """The boundary table of each range, run-length coded over the entry characters."""
    for pdf in batches:
        out = []
        for r in pdf.itertuples(index=False):
            w = _window(r)
            lo, hi = w.shift, w.shift + w.n
            reach = min(w.n, w.limit if r.range_no else 1)
            leave: dict[int, tuple[int, int]] = {}
            spans: list[tuple[int, int, int]] = []
            for entry in range(lo, lo + reach):
                path, s = [], entry
                while s is not None and s < hi and s not in leave:
                    path.append(s)
                    s = w.step(s)[1]
                at, k = leave[s] if s is not None and s < hi else (-1 if s is None else s - hi, 0)
                for p in reversed(path):
                    k += 1
                    leave[p] = (at, k)
                got = leave[entry]
                if not spans or spans[-1][1:] != got:
                    spans.append((entry - lo, *got))
            out.append((r.key, r.range_no, w.n, *([x[i] for x in spans] for i in range(3))))
        yield pd.DataFrame(out, columns=["key", "range_no", "chars", "from_char", "exit_char", "n_pieces"])


def _stitch(batches):
    """Entry, first piece number and first character of every range; the tables come by text and range."""
    key, entry, no, base = None, 0, 0, 0
    for pdf in batches:
        out = []
        for r in pdf.itertuples(index=False):
            if r.key != key:
                key, entry, no, base = r.key, 0, 0, 0
            if 0 <= entry < r.chars:
                out.append((r.key, r.range_no, entry, no, base))
                i = bisect_right(list(r.from_char), entry) - 1
                no += int(r.n_pieces[i])
                entry = int(r.exit_char[i])
            elif entry >= 0:
                entry -= r.chars
            base += r.chars
        yield pd.DataFrame(out, columns=["key", "range_no", "entry", "first_piece", "base"])


def split_texts(df: DataFrame, key: str, text: str, max_chars: str, overlap: str, range_bytes: int = 1 << 20, with_text: bool = True) -> DataFrame:
    """Pieces of every text: ``key, piece_no, start_char, end_char, forced, piece``.

    Pieces have at most ``max_chars`` characters (code points); removing the overlaps gives the text
    back. A text within the limit is one piece, an empty text is one empty piece; rows with a null
    key, text or limit, or a limit below 1, have no pieces. ``key`` (BIGINT) must be unique: rows that
    repeat one must be removed before. An overlap of half the limit or more is cut down below half.
    ``forced`` tells that the piece ends inside a run without white space that is longer than the limit.
    A row's ``range_bytes`` is raised to four times its limit if it is less."""
    base = df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"), F.col(max_chars).alias("max_chars"), F.col(overlap).alias("overlap"))
    base = base.where("key IS NOT NULL AND text IS NOT NULL AND max_chars >= 1")
    empty = base.where("text = ''").select("key", F.lit(0).cast("long").alias("piece_no"), F.lit(0).cast("long").alias("start_char"), F.lit(0).cast("long").alias("end_char"), F.lit(False).alias("forced"), F.lit("").alias("piece"))
    return _pieces(written(byte_ranges(base.where("text <> ''"), range_bytes), "text-ranges"), with_text).unionByName(empty)


def split_files(files: DataFrame, key: str, path: str, size: str, max_chars: str, overlap: str, range_bytes: int = 1 << 24, with_text: bool = True) -> DataFrame:
    """As ``split_texts`` for UTF-8 files of any size, of which no task holds more than a range; empty
    files have no pieces, bytes that aren't UTF-8 are read as replacement characters. A path may have any
    scheme that all executors reach."""
    base = files.select(F.col(key).cast("long").alias("key"), F.col(path).alias("path"), F.col(size).alias("n"), F.col(max_chars).alias("max_chars"), F.col(overlap).alias("overlap"))
    return _pieces(file_ranges(base.where("key IS NOT NULL AND path IS NOT NULL"), range_bytes), with_text)


def _pieces(ranges: DataFrame, with_text: bool) -> DataFrame:
    """Pieces of the texts whose byte ranges are given. A text's tables are stitched in one task, one after the
    other; they are about a thousandth of it."""
    spread = int(ranges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tables_ = ranges.mapInPandas(_tables, TABLE).repartition(spread, "key").sortWithinPartitions("key", "range_no")
    chained = tables_.mapInPandas(_stitch, "key long, range_no long, entry long, first_piece long, base long")
    return ranges.join(chained, ["key", "range_no"]).mapInPandas(_emit(with_text), PIECES)
