"""Problem 1: files that nobody wrote by hand: vendored, generated, minified, or data saved as code.

Vendored copies are found by winnowing. A file's tokens are normalised: comments and white space are left
out, and names, strings and numbers each stand for their class, so that renaming or other texts hide no
copy. They are hashed in runs of ``K``; of every ``W`` neighbouring runs the smallest hash is kept, so any
common passage of K + W - 1 tokens shares a fingerprint. A fingerprint recurs if it comes in files of at least ``owners``
unrelated owners of repositories; a file is a vendored copy if at least ``share`` of its fingerprints
recur. Fingerprints are counted over all files: distinct (fingerprint, repository) pairs are formed
before the shuffle, and only recurring fingerprints go back to the files.

The other kinds show in the file itself: a tool's notice in the comment it begins with or one line
pattern repeated throughout (generated), long lines almost without blanks (minified), and literals that
make up nearly the whole file (data).
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelode.llm import tables
from codelode.session import written

K, W = 80, 40  # of normalised tokens; shorter runs of them recur in unrelated code too
# Words of the six languages that stand for themselves.
KEYWORDS = frozenset(
    "abstract and as assert async await boolean break byte case catch chan char class const continue def default defer del do double elif else enum except export extends fallthrough False final finally float for from func function go goto if implements import in instanceof int interface is lambda let long map "
    "new None nonlocal not null of or package pass private protected public raise range return select self short static string struct super switch this throw throws True try type typeof undefined var void while with yield".split()
)
NOTICE = re.compile(
    r"(?i)@generated\b|\bauto-?(?:matically )?[ -]?generated\b|\b(?:code|file|source) (?:was |is |has been )?generated\b|\bgenerated (?:by|from|with|using)\b"
    r"|\bproduced by (?:the )?[\w\- ]*(?:compiler|generator|tool)\b|\bdo not (?:edit|modify|change)\b|\b(?:manual )?(?:edits|changes|modifications) (?:are|will be) (?:lost|overwritten)\b"
)
DENIAL = re.compile(r"(?i)\b(?:not|never|isn't|wasn't)\b[^.;:]*\bgenerated\b|\bby hand\b|\bhand-?written\b")
_TOKEN = {c: re.compile((r"#[^\n]*" if c else r"//[^\n]*|/\*(?:[^*]|\*(?!/))*\*/") + r"|[^\W\d]\w*|\d[\w.]*|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`[^`]*`|[^\s]") for c in (False, True)}
_WORD, _NUMBER = re.compile(r"(?<!\w)[^\W\d]\w*"), re.compile(r"(?<![\w.])(?:0[xX][\da-fA-F]+|\d+(?:\.\d+)?)(?![\w.])")
_BLOB = re.compile(r"[\"'`]((?:[A-Za-z0-9+/=_\-]|\\x[\da-fA-F]{2}|\\u[\da-fA-F]{4}){60,})[\"'`]")
_STRING = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`[^`\n]*`")


def normal(t: str) -> str:
    """A token's class: strings, numbers and names are alike, words of the language and signs are themselves."""
    c = t[0]
    if c in "\"'`":
        return "S"
    if c.isdigit():
        return "9"
    return "w" if (c == "_" or c.isalpha()) and t not in KEYWORDS else t


class _Hash(dict):
    def __missing__(self, t: str) -> int:
        if len(self) > 500_000:
            self.clear()
        self[t] = h = zlib.crc32(normal(t).encode("utf-8", "replace"))
        return h


def fingerprints(text: str, hash_comments: bool, memo: _Hash) -> np.ndarray:
    """Distinct winnowed hashes; none for fewer than K tokens."""
    tokens = _TOKEN[hash_comments].findall(text)
    comment = ("#",) if hash_comments else ("//", "/*")
    h = np.fromiter([memo[t] for t in tokens if not t.startswith(comment)], dtype=np.uint64)
    n = len(h) - K + 1
    if n < 1:
        return np.zeros(0, np.int64)
    a = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(K):
            a = a * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n]
        a ^= a >> np.uint64(29)
        a *= np.uint64(0xBF58476D1CE4E5B9)
    step, left = a, W  # minima of W neighbours by doubling
    size = 1
    while size * 2 <= min(left, len(a)):
        step = np.minimum(step[:-size], step[size:])
        size *= 2
    if size < min(W, len(a)):
        step = np.minimum(step[: len(a) - min(W, len(a)) + 1], step[min(W, len(a)) - size :])
    return np.unique(step).view(np.int64)


def opening(text: str) -> list[str]:
    """Lines of the comments that a file begins with."""
    out, inside = [], None
    for line in text.split("\n"):
        s = line.strip()
        if inside:
            out.append(s)
            if inside in s:
                inside = None
        elif s.startswith("/*"):
            out.append(s)
            inside = None if "*/" in s[2:] else "*/"
        elif s[:3] in ('"""', "'''"):
            out.append(s)
            inside = None if s[:3] in s[3:] else s[:3]
        elif s.startswith(("//", "#", "*")) or not s or s in ('"use strict";', "'use strict';"):
            out.append(s)
        else:
            break
    return out


def notice(text: str) -> bool:
    return any(NOTICE.search(x) and not DENIAL.search(x) for x in opening(text))


def _shape(line: str) -> str:
    return _NUMBER.sub("9", _WORD.sub("w", _STRING.sub("S", line)).replace("w9", "w"))


def structure(text: str) -> str | None:
    """``generated``, ``minified`` or ``data``, or None where nothing speaks against a human author."""
    if notice(text):
        return "generated"
    lines = [s for s in (x.strip() for x in text.split("\n")) if s]
    code = [s for s in lines if not s.startswith(("//", "#", "/*", "*"))]
    chars = sum(map(len, code))
    if not chars:
        return None
    if chars >= 400:
        blobs = sum(len(x) for x in _BLOB.findall(text))
        if blobs >= 0.85 * chars:
            return "data"
        numbers = sum(len(x) + 1 for x in _NUMBER.findall(text))
        if numbers >= 0.6 * chars and len(_NUMBER.findall(text)) >= 0.85 * (len(_NUMBER.findall(text)) + len(_WORD.findall(text))):
            return "data"
        long = [s for s in code if len(s) >= 400]
        packed = sum(len(s) for s in long)
        if packed >= 0.75 * chars and sum(s.count(" ") for s in long) <= 0.08 * packed and sum(s.count(";") + s.count("{") + s.count(",") for s in long) >= 0.02 * packed:
            return "minified"
    if code[0][0] in "{[<":  # a document under a wrong name, not source text of these languages
        return None
    body = [s for s in code if len(s) > 3 and not s.startswith(("import ", "from ", "package ", "use "))]
    if len(body) >= 10:
        shapes = Counter(map(_shape, body))
        top = shapes.most_common(3)
        if top[0][1] >= 0.75 * len(body) or (len(body) >= 14 and sum(n for _, n in top) >= 0.85 * len(body) and top[0][1] >= 0.4 * len(body)):
            return "generated"
    return None


def examine(files: DataFrame, key: str, repo: str, path: str, content: str) -> DataFrame:
    """``key, repo, kind, prints``: what the file's own text tells, and its fingerprints."""

    def run(batches):
        memo = _Hash()
        for pdf in batches:
            text = [t.replace("\r\n", "\n") for t in pdf["content"]]
            prints = [fingerprints(t, lang == "python", memo) for t, lang in zip(text, pdf["language"])]
            yield pd.DataFrame({"key": pdf["key"], "repo": pdf["repo"], "kind": [structure(t) for t in text], "prints": prints})

    rows = files.select(F.col(key).cast("long").alias("key"), F.col(repo).cast("long").alias("repo"), tables.path_language(path).alias("language"), F.col(content).alias("content"))
    return rows.where("key IS NOT NULL AND language IS NOT NULL AND content <> ''").mapInPandas(run, "key long, repo long, kind string, prints array<long>")


def file_kinds(files: DataFrame, repos: DataFrame, key: str, repo: str, path: str, content: str, owners: int = 3, share: float = 0.8, least: int = 5) -> DataFrame:
    """``key, kind, n_prints, recurring`` for every file of the six languages with a content.

    ``kind`` is ``generated``, ``minified``, ``data``, ``vendored`` or null (hand-written); what the file
    itself shows goes before ``vendored``. ``repos`` has the repository's key (of the same name) and
    ``owner``; a repository without an owner there stands for itself, files without a repository are
    counted as one. ``key`` must be unique. Fewer than ``least`` fingerprints are too few to tell a copy;
    empty files, null contents and other extensions have no row."""
    seen = written(examine(files, key, repo, path, content), "file-prints")
    prints = seen.select("key", F.coalesce("repo", F.lit(-1)).alias("repo"), F.explode("prints").alias("print"))
    by_owner = repos.where(F.col(repo).isNotNull()).groupBy(F.col(repo).cast("long").alias("repo")).agg(F.max("owner").alias("owner"))
    pairs = prints.select("print", "repo").distinct().join(by_owner, "repo", "left")
    one = F.coalesce(F.xxhash64("owner"), F.col("repo"))
    one = F.when(F.col("owner").isNull(), F.col("repo")).otherwise(one)
    recurring = pairs.select("print", one.alias("one")).distinct().groupBy("print").agg(F.count("*").alias("n")).where(F.col("n") >= owners).select("print")
    hits = prints.select("key", "print").join(recurring, "print", "left_semi").groupBy("key").agg(F.count("*").alias("hits"))
    both = seen.select("key", "kind", F.size("prints").alias("n_prints")).join(hits, "key", "left")
    recur = F.coalesce(F.col("hits"), F.lit(0)) / F.greatest(F.col("n_prints"), F.lit(1))
    kind = F.coalesce("kind", F.when((F.col("n_prints") >= least) & (recur >= share), F.lit("vendored")))
    return both.select(F.col("key").alias(key), kind.alias("kind"), "n_prints", recur.alias("recurring"))
