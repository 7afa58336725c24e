"""Problem 2: credentials in code and configuration, found by a trained score and redacted in place.

1. Candidates are literals: quoted strings, values of configuration lines, long bare words, passwords in
   addresses and blocks of private keys, each with the identifiers around it.
2. A character Markov model (pairs of bytes) is counted over all texts; a value's mean log-likelihood
   under it tells random strings from words.
3. Families of patterns label a part of the candidates weakly: formats of known issuers, private keys,
   addresses with a password and secret-sounding names with mixed values against placeholders, references,
   checksums and code. What they can't tell stays without a label.
4. A logistic regression is fitted on at most ``sample`` weakly labelled candidates of each family. It sees
   the likelihood and how the value's characters are made up, and hashed words of the surrounding
   identifiers, of the value and of the path; none of the labelling patterns is a feature. It is calibrated
   (Platt) on a held-out fifth, and its score decides every candidate, labelled or not: values with a score
   of at least ``threshold`` are redacted.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, bisect_right
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelode.session import written

# Formats of keys as their issuers publish them, a family each.
ISSUERS = {
    "aws": re.compile(r"^(?:AKIA|ASIA)[0-9A-Z]{16}$"),
    "github": re.compile(r"^(?:gh[pousr]_[A-Za-z0-9]{36,}|github_pat_\w{22,})$"),
    "gitlab": re.compile(r"^glpat-[\w\-]{20,}$"),
    "stripe": re.compile(r"^[sr]k_(?:live|test)_[A-Za-z0-9]{16,}$"),
    "slack": re.compile(r"^xox[abeoprs]-[A-Za-z0-9\-]{10,}$"),
    "google": re.compile(r"^(?:AIza[\w\-]{35}|ya29\.[\w\-]{20,})$"),
    "jwt": re.compile(r"^eyJ[\w\-]{8,}\.eyJ[\w\-]{8,}\.[\w\-]{8,}$"),
    "packages": re.compile(r"^(?:npm_[A-Za-z0-9]{36}|pypi-[\w\-]{16,})$"),
    "sendgrid": re.compile(r"^SG\.[\w\-]{16,}\.[\w\-]{16,}$"),
}
PLACEHOLDER = re.compile(
    r"(?i)^(?:[x*.•#_\-]{3,}|<.*>?|\{.*\}?|\[.*\]|\$.*|%.*%?|your[_\-].*|.*[_\-]here|change[_\-]?me.*|replace[_\-]?me.*|insert[_\-].*|tbd|fixme|(?:example|sample|dummy|placeholder|fake|todo|none|null|nil|undefined|true|false|redacted|removed|hidden|secret|password|passwd|token|test|default|string|empty)[\W_\d]*)$"
    r"|\*{3,}|x{6,}|\$\{|\{\{|\}\}|<[A-Za-z_\- ]+>|\.{3,}|process\.env|os\.environ|getenv|^env[.:(]|^ENC\[|^vault:|^@@?\w+@@?$|^!(?:vault|ref|env)"
)
# Plain words, numbers, paths, addresses without a password, embedded media, checksums.
PLAIN = re.compile(r"^(?:[A-Za-z]+|[a-z]+(?:[_\-. ][a-z]+)*|\d+(?:\.\d+)*)$|^[\w.\-/]*/[\w\-]+\.\w{1,5}$|^[A-Za-z][A-Za-z0-9+.\-]*://|^data:|^sha\d+[-:]|^[A-Za-z_]\w*(?:\.[a-z]+(?:[A-Z][a-z]+)+\d*)+$")
NOUNS = frozenset("password passwd pwd pass passphrase secret token key apikey apitoken credential credentials cred auth authorization jwt dsn bearer accesskeyid secretaccesskey".split())
OTHER = frozenset("sha sha1 sha256 sha512 md5 hash checksum digest integrity uuid guid id icon image img data font public label field name path size count width depth kind type status stamp total owner limit offset phase weight url uri version license commit etag revision fingerprint signature file dir header".split())
CONFIG = re.compile(r"(?i)\.(?:env|ya?ml|toml|ini|cfg|conf|config|properties|json|tmpl|template|example|tf|tfvars|netrc|npmrc|pypirc|xml|txt|md|sh)(?:\.\w+)?$|(?:^|/)\.env")
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
_IDENT = re.compile(r"[A-Za-z_$][\w$]*(?:[.\-][A-Za-z_]\w*)*")
_PRIVATE = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_END = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_PUBLIC = re.compile(r"-----BEGIN (?!(?:[A-Z0-9]+ )*PRIVATE)[A-Z0-9 ]+-----")
_USERINFO = re.compile(r"[A-Za-z][A-Za-z0-9+.\-]*://[^\s/:@\"'`<>]*:([^\s/@\"'`<>]+)@")
_QUOTED = re.compile(r"\"((?:[^\"\\\n]|\\.){6,})\"|'((?:[^'\\\n]|\\.){6,})'|`([^`\n]{6,})`")
_CONFIG_LINE = re.compile(r"^[ \t]*(?:export[ \t]+|set[ \t]+|-[ \t]+)?[\"']?([A-Za-z_][\w.\-]*)[\"']?[ \t]*(?::=|[:=])[ \t]*([^\s\"'`#;,(){}\[\]][^\n]*?)[ \t]*,?$", re.M)
_COMMENT = re.compile(r"[ \t]+(?:#|;|//)[^\n]*$")  # after a value
_KEY_VALUE = re.compile(r"(?<![\w.\-])[A-Za-z_][\w.\-]*[ \t]*=[ \t]*([^\s;,&\"'`<>]+)")
_SCHEME = re.compile(r"(?i)^(?:bearer|basic|token|digest)[ \t]+")
_LOOKUP = re.compile(r"(?i)(?:\w\[|(?:getenv|environ\.get|env|secrets?|config|settings|vault|params?|property|getproperty|header|get)\s*\()\s*[\"'`]$")
_FILLER = frozenset("bearer basic is here are was be the a an this that of for now value todo remove temp".split())  # fixed values
_BARE = re.compile(r"(?<![\w+/.\-])[A-Za-z0-9_+/.\-]{16,}={0,2}(?![\w+/=\-])")
_LOOSE = re.compile(r"(?m)(?:^[ \t]*(?://|#|\*|/\*|--|;)[^\n]*?[:=][ \t]+|\bis[ \t]+)(?:(?:[Bb]earer|[Bb]asic)[ \t]+)?([^\s\"'`<>{}()\[\],;]{6,})(?=[.,;]?(?:[ \t]*\*/)?[ \t]*$)")
_MIXED = re.compile(r"\d.*[A-Za-z]|[A-Za-z].*\d")
_LETTERS = re.compile(r"[A-Za-z]+")
_WORDS = re.compile(r"[A-Z]{3,}|[A-Z]?[a-z]{3,}")
_SAME, _CHANGE, _MARKUP = re.compile(r"(.)\1+", re.S), re.compile(r"(?=(.)(?!\1).)", re.S), re.compile(r"[<>{}$%*()\[\];=,]")
_CLASS = str.maketrans({**{c: "a" for c in "abcdefghijklmnopqrstuvwxyz"}, **{c: "A" for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}, **{c: "0" for c in "0123456789"}})
KINDS = ("bare", "config")  # the others have none of these features
LIKE_BINS, LENGTH_BINS, LAST, EARLIER, INSIDE, PLACE = 12, 8, 256, 128, 192, 32  # one-hot features: bins, and buckets of hashed words
DENSE = 22
FEATURES = DENSE + LIKE_BINS + LENGTH_BINS + len(KINDS) + LAST + EARLIER + INSIDE + PLACE
FAMILIES = ("private", "userinfo", "named", *ISSUERS)  # of credentials; "placeholder", "lookalike" and "harmless" are none


@dataclass
class Candidate:
    line: int
    start: int  # of the value in the text
    end: int
    value: str
    names: str  # the identifiers before it, nearest last
    kind: str  # quoted, config, bare, userinfo, private


class _Taken:
    """Places of a text that belong to something, as sorted intervals that don't touch."""

    def __init__(self):
        self.starts: list[int] = []
        self.ends: list[int] = []

    def free(self, s: int, e: int) -> bool:
        i = bisect_right(self.ends, s)
        return i == len(self.starts) or self.starts[i] >= e

    def append(self, span: tuple[int, int]) -> None:
        s, e = span
        i, j = bisect_left(self.ends, s), bisect_right(self.starts, e)
        if i < j:
            s, e = min(s, self.starts[i]), max(e, self.ends[j - 1])
        self.starts[i:j], self.ends[i:j] = [s], [e]


def candidates(text: str, path: str | None) -> list[Candidate]:
    """Literals of a text that could be credentials. Each character belongs to one candidate at most;
    the lines inside a block of a key or certificate have none but the private key's own."""
    found: list[tuple[int, int, str]] = []
    taken = _Taken()
    free = taken.free
    for m in _PRIVATE.finditer(text):
        end = _END.search(text, m.end())
        body_end = end.start() if end else _key_body(text, m.end())
        if re.search(r"[A-Za-z0-9+/=]{16,}", text[m.end() : body_end]):
            found.append((m.end(), body_end, "private"))
        taken.append((m.start(), end.end() if end else body_end))
    for m in _PUBLIC.finditer(text):
        end = text.find("-----END", m.end())
        taken.append((m.start(), end if end >= 0 else _key_body(text, m.end())))

    def add(s: int, e: int, kind: str) -> None:
        if e - s >= 4 and free(s, e):
            found.append((s, e, kind))
            taken.append((s, e))

    if "://" in text:
        for m in _USERINFO.finditer(text):
            add(*m.span(1), "userinfo")
    for m in _QUOTED.finditer(text):
        g = m.lastindex
        s, e = m.span(g)
        if (scheme := _SCHEME.match(text[s:e])):
            s += scheme.end()
        v = text[s:e]
        if _LOOKUP.search(text, max(0, m.start() - 24), m.start() + 1):  # a subscript or a lookup by name
            taken.append(m.span())
        elif " " not in v and "\t" not in v and free(m.start(g), e):
            add(s, e, "quoted")
            taken.append(m.span())
        elif (" " in v or "\t" in v) and free(m.start(g), e):
            # a keyword string's parts, or the whole under a secret's name
            parts = [p.span(1) for p in _KEY_VALUE.finditer(text, s, e)]
            for a, b in parts:
                add(a, b, "quoted")
            if not parts and secret_name(name_words(names_before(text, s))):
                add(s, e, "quoted")
    if path is None or CONFIG.search(path):
        for m in _CONFIG_LINE.finditer(text):
            s, e = m.span(2)
            if (scheme := _SCHEME.match(text[s:e])):
                s += scheme.end()
            if (comment := _COMMENT.search(text[s:e])):
                e = s + comment.start()
            if not re.search(r"\s", text[s:e]):
                add(s, e, "config")
    for m in _LOOSE.finditer(text):
        if _MIXED.search(m.group(1)):
            add(m.start(1), m.start(1) + len(m.group(1).rstrip(".")), "bare")
    for m in _BARE.finditer(text):
        v = m.group().rstrip(".")
        if (_MIXED.search(v) and sum(c.isdigit() for c in v) >= 2) or any(x.match(v) for x in ISSUERS.values()):
            add(m.start(), m.start() + len(v), "bare")
    out = []
    breaks = np.flatnonzero(np.frombuffer(text.encode("utf-32-le"), np.uint32) == 10)
    for s, e, kind in sorted(found):
        at = s if kind != "private" else text.rfind("-----BEGIN", 0, s)
        out.append(Candidate(int(np.searchsorted(breaks, at)) + 1, s, e, text[s:e], names_before(text, at), kind))
    return out


def names_before(text: str, at: int) -> str:
    begin = text.rfind("\n", 0, at) + 1
    names = _IDENT.findall(text[max(begin, at - 80) : at])
    return " ".join([x for x in names if x.lower() not in _FILLER][-5:])


def _key_body(text: str, at: int) -> int:
    m = re.compile(r"(?:\\n|[\sA-Za-z0-9+/=:,\-])*").match(text, at)
    return m.end() if m else at


def name_words(names: str) -> list[str]:
    last = names.split(" ")[-1] if names else ""
    return [p.lower() for p in _PARTS.findall(last)]


def secret_name(words: list[str]) -> bool:
    """Do the words end in a noun for a secret (and not in what describes one)?"""
    while words and words[-1].isdigit():
        words = words[:-1]
    if not words:
        return False
    if words[-1] == "id" and words[-2:-1] == ["key"] and "access" in words:
        return True
    if words[-1] == "key" and words[-2:-1] and words[-2] in ("public", "primary", "foreign", "cache", "sort", "partition", "map", "object"):
        return False
    return words[-1] in NOUNS or "".join(words) in NOUNS or "".join(words[-2:]) in ("databaseurl", "connectionstring")


def weak_family(kind: str, value: str, names: str) -> str | None:
    """The family of patterns that labels a candidate: one of FAMILIES for a credential, ``placeholder``,
    ``lookalike`` (long, or under a secret's name) or ``harmless`` for none, None where the patterns aren't sure."""
    words = name_words(names)
    if kind == "private":
        return "private"
    if PLACEHOLDER.search(value):
        return "placeholder"
    if kind == "userinfo":
        return "userinfo"
    for issuer, form in ISSUERS.items():
        if form.match(value):
            return issuer
    mixed = any(c.isdigit() for c in value) and any(c.isalpha() for c in value)
    plain = PLAIN.search(value)
    if secret_name(words):
        if plain:
            return None if re.fullmatch(r"[a-z]{8,}", value) else "lookalike"
        return "named" if mixed and 8 <= len(value) <= 200 and not re.search(r"[(){};]", value) else None
    if plain or set(words) & OTHER:
        return "lookalike" if len(value) >= 20 else "harmless"
    if "base64" in names:
        return "lookalike"
    if len(value) >= 16 and mixed and re.fullmatch(r"[\w+/=\-]+", value):
        return None  # could be a key under any name
    return "harmless" if kind != "bare" and not any(secret_name([w]) for n in names.split(" ") for w in [p.lower() for p in _PARTS.findall(n)]) else None


_BUCKET: dict[str, int] = {}


def _bucket(word: str) -> int:
    if len(_BUCKET) > 200_000:
        _BUCKET.clear()
    h = _BUCKET.get(word)
    if h is None:
        h = _BUCKET[word] = zlib.crc32(word.encode("utf-8", "replace")) >> 3
    return h


def _of_value(value: str, pair_log: np.ndarray) -> tuple[list[float], int, int, set[int]]:
    """The numbers of a value, its bins of likelihood and length, and the buckets of its words."""
    b = np.frombuffer(value.encode("utf-8", "replace"), np.uint8)
    steps = pair_log[b[:-1].astype(np.int64) * 256 + b[1:]] if len(b) > 1 else np.full(1, -3.0)
    total, n = float(steps.sum()), max(1, len(value))
    like = total / len(steps)
    shape = value.translate(_CLASS)
    lower, upper, digits = shape.count("a") / n, shape.count("A") / n, shape.count("0") / n
    counts = np.bincount(b, minlength=1)
    p = counts[counts > 0] / max(1, len(b))
    runs = _LETTERS.findall(value)
    words = sum(map(len, _WORDS.findall(value))) / n
    dense = [
        like, float(np.sort(steps)[: (len(steps) + 1) // 2].mean()), float(np.log(n)), float(-(p * np.log2(p)).sum()), lower, upper, digits, 1 - lower - upper - digits,
        len(_MARKUP.findall(value)) / n, (value.count("/") + value.count(".")) / n, max(map(len, runs), default=0) / n, max([1, *(m.end() - m.start() for m in _SAME.finditer(value))]) / n,
        len(set(value)) / n, len(_CHANGE.findall(shape)) / n, value.count(" ") / n, -total / 40, min(max(-like - 3, 0.0), 2.0) * min(n, 40) / 40, float(value.lower().strip("0123456789abcdef-") == ""),
        float(digits == 0), words, float(value[:1] in "$%{<[@!&"), float(digits == 0) * words,
    ]
    return dense, int(min(max(-2 * like - 1, 0), LIKE_BINS - 1)), min(LENGTH_BINS - 1, int(np.log2(n))), {_bucket(w.lower()) % INSIDE for w in runs if 3 <= len(w) <= 12}


def features(value: str, names: str, kind: str, path: str | None, pair_log: np.ndarray, memo: dict | None = None) -> tuple[list[float], list[int]]:
    """Numbers of the value, and the places of the features that are 1. ``memo`` keeps what is known of values."""
    memo = {} if memo is None else memo
    if len(memo) > 50_000:
        memo.clear()
    got = memo.get(value)
    if got is None:
        got = memo[value] = _of_value(value, pair_log)
    dense, like, length, inside = got
    at = DENSE
    ones = {at + like, at + LIKE_BINS + length}
    at += LIKE_BINS + LENGTH_BINS
    ones.update(at + i for i, x in enumerate(KINDS) if x == kind)
    at += len(KINDS)
    all_names = names.split(" ") if names else []
    last = all_names[-1:]
    ones.update(at + _bucket(w.lower()) % LAST for x in last for w in (*_PARTS.findall(x), "=" + x))
    at += LAST
    ones.update(at + _bucket(w.lower()) % EARLIER for x in all_names[:-1] for w in _PARTS.findall(x))
    at += EARLIER
    ones.update(at + i for i in inside)
    at += INSIDE
    ones.update(at + _bucket(w.lower()) % PLACE for w in _LETTERS.findall((path or "").rsplit("/", 1)[-1])[-2:])
    return dense, sorted(ones)


def _packed(dense: list[float], ones: list[int]) -> bytes:
    return np.asarray(dense, np.float32).tobytes() + np.asarray(ones, np.uint16).tobytes()


def _matrix(rows) -> np.ndarray:
    x = np.zeros((len(rows), FEATURES), np.float32)
    for i, r in enumerate(rows):
        x[i, :DENSE] = np.frombuffer(r, np.float32, count=DENSE)
        x[i, np.frombuffer(r, np.uint16, offset=4 * DENSE)] = 1
    return x


class Scorer:
    """Logistic regression with its scaling and calibration. Rows are gone through a few thousand at a time, so
    the driver holds them once, in single precision."""

    CHUNK = 4096

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = 5):
        x = np.asarray(x, np.float32)
        self.mean, self.sd = x.mean(0, dtype=float), np.maximum(x.std(0, dtype=float), 0.05)
        held = np.random.default_rng(seed).random(len(y)) < 0.2
        self.w, self.b = self._fit(x, y, np.flatnonzero(~held))
        s = self._margin(x)
        use = held if 0 < y[held].sum() < held.sum() else ~held
        a, c = Scorer._plain()._fit(s[:, None] / 4, y, np.flatnonzero(use), even=False)
        self.a, self.c = float(a[0]) / 4, c
        self.held_accuracy = float(((self(x[use]) >= 0.5) == y[use]).mean()) if use.any() else 1.0
        self.w, self.b = self._fit(x, y, np.arange(len(y)))  # with the held-out fifth, for what comes only once

    @classmethod
    def _plain(cls) -> Scorer:
        """One that doesn't scale its only feature."""
        out = cls.__new__(cls)
        out.mean, out.sd = 0.0, 1.0
        return out

    def _fit(self, x: np.ndarray, y: np.ndarray, rows: np.ndarray, ridge: float = 5e-3, rounds: int = 25, even: bool = True) -> tuple[np.ndarray, float]:
        """Newton's method on the rows named; where ``even``, classes weigh the same."""
        d, n = x.shape[1], len(rows)
        w, pos = np.zeros(d + 1), max(1, y[rows].sum())
        weight = np.where(y == 1, n / (2 * pos), n / (2 * max(1, n - pos))) if even else np.ones(len(y))
        for _ in range(rounds):
            g, h = ridge * n * w, ridge * n * np.eye(d + 1)
            for i in range(0, n, self.CHUNK):
                at = rows[i : i + self.CHUNK]
                z = np.hstack([(x[at] - self.mean) / self.sd, np.ones((len(at), 1))])
                p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
                g = g + z.T @ (weight[at] * (p - y[at]))
                h = h + (z * (weight[at] * p * (1 - p))[:, None]).T @ z
            step = np.linalg.solve(h, g)
            w -= step
            if np.abs(step).max() < 1e-4:
                break
        return w[:-1], float(w[-1])

    def _margin(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([((x[i : i + self.CHUNK] - self.mean) / self.sd) @ self.w + self.b for i in range(0, len(x), self.CHUNK)] or [np.zeros(0)])

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.a * self._margin(x) + self.c, -30, 30)))


def pair_likelihoods(texts: DataFrame) -> np.ndarray:
    """log P(next byte | byte) over all rows' ``text``; the driver gets at most 65,536 counts."""

    def count(batches):
        total = np.zeros(65536, np.int64)
        for pdf in batches:
            b = np.frombuffer("\n".join(pdf["text"]).encode("utf-8", "replace"), np.uint8).astype(np.int32)
            total += np.bincount(b[:-1] * 256 + b[1:], minlength=65536)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"pair": at.astype(np.int32), "n": total[at]})

    m = np.zeros(65536)
    for r in texts.select("text").mapInPandas(count, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():
        m[r.pair] = r.n
    m = m.reshape(256, 256) + 0.05
    return np.log(m / m.sum(1, keepdims=True)).ravel()


def score_candidates(texts: DataFrame, key: str, text: str, path: str, sample: int = 4_000, without: tuple[str, ...] = ()) -> DataFrame:
    """``key, line_no, start_char, end_char, kind, family, weak, score`` for each candidate of each text.

    ``key`` (BIGINT) must be unique. Null keys and texts have no candidates, empty texts neither; a null
    path counts as a path of unknown kind. Without weakly labelled rows of both labels the weak label
    itself is the score (unsure: 0). ``sample`` bounds the rows of each family that training sees (twice as many
    at most). Families of patterns in ``without`` label nothing, to measure what is found without them."""
    spark = texts.sparkSession
    base = texts.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"), F.col(path).alias("path"))
    pair_log = pair_likelihoods(base)
    model = spark.sparkContext.broadcast(pair_log)

    def find(batches):
        memo: dict = {}
        for pdf in batches:
            out = []
            for k, t, p in zip(pdf["key"], pdf["text"], pdf["path"]):
                for c in candidates(t, p):
                    out.append((k, c.line, c.start, c.end, c.kind, weak_family(c.kind, c.value, c.names), _packed(*features(c.value, c.names, c.kind, p, model.value, memo))))
            yield pd.DataFrame(out, columns=["key", "line_no", "start_char", "end_char", "kind", "family", "x"])

    found = written(base.mapInPandas(find, "key long, line_no int, start_char int, end_char int, kind string, family string, x binary"), "secret-candidates")
    weak = F.when(F.col("family").isin(*without) if without else F.lit(False), -1).otherwise(F.coalesce(F.col("family").isin(*FAMILIES).cast("int"), F.lit(-1)))
    found = found.withColumn("weak", weak)
    result = ["key", "line_no", "start_char", "end_char", "kind", "family", "weak"]
    sizes = {r.family: r.n for r in found.where("weak >= 0").groupBy("family").agg(F.count("*").alias("n")).collect()}
    train = []
    for family, n in sorted(sizes.items()):  # a family for each row of patterns
        rows = found.where((F.col("family") == family) & (F.col("weak") >= 0))
        if n > sample:
            rows = rows.where(F.pmod(F.xxhash64("key", "start_char"), F.lit(1 << 20)) < int((1 << 20) * sample / n))
        train.append(rows.select("weak", "x").limit(2 * sample).toPandas())
    labels = pd.concat([t["weak"] for t in train]).to_numpy(dtype=float) if train else np.zeros(0)
    if len(set(labels)) < 2:
        return found.select(*result, F.when(F.col("weak") == 1, 1.0).otherwise(0.0).alias("score")).withColumnRenamed("key", key)
    scorer = spark.sparkContext.broadcast(Scorer(_matrix([x for t in train for x in t["x"]]), labels))

    @F.pandas_udf("double")
    def score(b: pd.Series) -> pd.Series:
        return pd.Series(scorer.value(_matrix(b)) if len(b) else [], dtype=float)

    return found.select(*result, score("x").alias("score")).withColumnRenamed("key", key)


def redact(texts: DataFrame, key: str, text: str, scored: DataFrame, threshold: float = 0.5, mask: str = "REDACTED") -> DataFrame:
    """``texts`` with the values of ``scored`` at or above the threshold replaced in ``text``, and
    ``n_redacted``. Nothing else changes: quotes, names, line ends and the frame of a key block stay,
    and of a value of several lines each line is replaced by itself."""
    spans = scored.where(F.col("score") >= threshold).groupBy(key).agg(F.sort_array(F.collect_list(F.struct("start_char", "end_char"))).alias("_spans"))

    @F.pandas_udf("string")
    def cut(t: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.Series:
        out = []
        for s, a, b in zip(t, starts, ends):
            if s is not None and a is not None:
                for i, j in sorted(zip(a, b), reverse=True):
                    s = s[:i] + re.sub(r"[^\s\\](?:[^\n\\]*[^\s\\])?", mask, s[i:j].replace("\\n", "\x00")).replace("\x00", "\\n") + s[j:]
            out.append(s)
        return pd.Series(out, dtype=object)

    joined = texts.join(spans, key, "left")
    return joined.withColumn(text, cut(F.col(text), F.col("_spans.start_char"), F.col("_spans.end_char"))).withColumn("n_redacted", F.coalesce(F.size("_spans"), F.lit(0))).withColumn("n_redacted", F.greatest("n_redacted", F.lit(0))).drop("_spans")
