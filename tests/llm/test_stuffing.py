"""Spam pages against ordinary ones."""

import math
import random
from collections import Counter

from codelode.llm import stuffing, words

rng = random.Random(5)
NOUNS = [f"{a}{b}" for a in ("ba", "ko", "ri", "tu", "me", "lo", "sa") for b in ("ker", "lin", "mot", "der", "nas")]
SENTENCES = ["The {} is read once before the {} starts.", "When the {} fails, we keep the old {} in place.", "You can set the {} from the command line.", "It does not change the {} until the {} is closed."]


def sentence():
    s = rng.choice(SENTENCES)
    return s.format(*[rng.choice(NOUNS) for _ in range(s.count("{}"))])


def prose(n=12):
    return " ".join(sentence() for _ in range(n))


SPAM = {
    "repeat": "buy cheap kolin " * 60,
    "stuffed": " ".join("Looking for cheap kolin? Our cheap kolin is the best cheap kolin. Why cheap kolin? Because cheap kolin is cheap kolin." for _ in range(6)),
    "links": "\n".join(f"https://shop{i}.example/a/b?ref={i}" for i in range(20)),
    "anchors": "\n".join(f'<a href="http://x{i}.example/">cheap kolin</a>' for i in range(20)),
    "tags": " ".join(f"#tag{i}{rng.choice(NOUNS)}" for i in range(40)),
    "goods": "; ".join(f"{rng.choice(NOUNS)} {rng.choice(NOUNS)} kit ${i}.99" for i in range(40)),
    "salad": " ".join(rng.choice(NOUNS) for _ in range(160)).upper(),
    "framed": prose(2) + "\n\n" + "mega kolin deal " * 60 + "\n\n" + prose(1),
}
PLAIN = {
    "prose": prose(),
    "changelog": "# Changelog\n\n## 1.2.0\n" + "\n".join(f"- {sentence()} ([#{i}](https://git.example/o/r/pull/{i}))" for i in range(20)),
    "table": "| name | size |\n| --- | --- |\n" + "\n".join(f"| {rng.choice(NOUNS)} | {i} |" for i in range(30)),
    "log": "\n".join(f"[12:00:{i:02}] {rng.choice(NOUNS)} error: {rng.choice(NOUNS)} not found (attempt {i})" for i in range(30)),
    "code": "\n".join(f"def {rng.choice(NOUNS)}_{i}(a, b):\n    return {rng.choice(NOUNS)}(a) + b[{i}]" for i in range(20)),
    "sources": prose(4) + "\n\nSources:\n" + "\n".join(f"[{i}] src/{rng.choice(NOUNS)}.py:{i}" for i in range(8)),
    "declares": "\n".join(f"- method {rng.choice(NOUNS)}.{rng.choice(NOUNS)} (exported)" for i in range(30)),
    "near_empty": "cheap cheap cheap",
    "empty": "",
}


def test_kinds(spark):
    rows = [(f"spam-{k}", t) for k, t in SPAM.items()] + [(f"plain-{k}", t) for k, t in PLAIN.items()] + [(f"fill-{i}", prose()) for i in range(300)] + [("null", None)]
    got = {r.k: r for r in stuffing.score_pages(spark.createDataFrame(rows, "k string, t string"), "k", "t").collect()}
    assert "null" not in got and len(got) == len(rows) - 1
    assert {k for k, r in got.items() if r.flagged} == {f"spam-{k}" for k in SPAM}
    assert got["spam-salad"].pmi < got["plain-prose"].pmi


def test_empty_and_repeated(spark):
    df = spark.createDataFrame([], "k string, t string")
    assert stuffing.score_pages(df, "k", "t").count() == 0
    twice = spark.createDataFrame([("a", SPAM["links"]), ("a", SPAM["links"]), ("b", prose() * 400)], "k string, t string")
    assert sorted((r.k, r.flagged) for r in stuffing.score_pages(twice, "k", "t").collect())[:2] == [("a", True), ("a", True)]


def test_words_of_bytes():
    text = "Größe, naïve—test “quoted” a_b1c\n\nЖук жук 全角。漢字 x"
    b = stuffing.np.frombuffer(text.lower().encode(), stuffing.np.uint8)
    h, at = stuffing.words_of(b)
    want = ["größe", "naïve", "test", "quoted", "a", "b", "c", "жук", "жук", "全角", "漢字", "x"]
    assert len(h) == len(want) and all((h[i] == h[j]) == (want[i] == want[j]) for i in range(len(want)) for j in range(len(want)))
    assert [bytes(b[i : i + 1]).isascii() or want[n][0] > "z" for n, i in enumerate(at)] == [True] * len(want)


def test_without_pmi_word_salad_and_lists_pass(spark):
    word = lambda: rng.choice(NOUNS) + rng.choice("aeiou")
    spam = {f"salad{i}": " ".join(word() for _ in range(160)) for i in range(5)} | {f"tags{i}": ", ".join(f"{word()} {word()}" for _ in range(60)) for i in range(5)}
    spam |= {f"links{i}": "\n".join(f"http://{word()}-{word()}.example/{word()}/{word()}/{word()}" for _ in range(25)) for i in range(5)} | {"repeat": SPAM["repeat"]}
    rows = list(spam.items()) + [(f"fill-{i}", prose()) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, t string")
    flags = lambda **kw: {r.k for r in stuffing.score_pages(df, "k", "t", **kw).where("flagged").collect()}
    every, without = flags(), flags(listed=0.0, loose=0.0)
    assert every == set(spam) and len(every - without) >= len(every) / 2 and "repeat" in without


def test_copies_do_not_vouch_for_each_other(spark):
    """Rare words are in no other page than in a page's own copies."""
    r = random.Random(8)
    page = " ".join("#" + "".join(r.choices("abcdefghijklmnop", k=9)) for _ in range(60))
    rows = [(f"copy-{i}", page + " " * i) for i in range(40)] + [(f"fill-{i}", prose()) for i in range(300)]
    got = stuffing.score_pages(spark.createDataFrame(rows, "k string, t string"), "k", "t").where("flagged").collect()
    assert {x.k for x in got} == {f"copy-{i}" for i in range(40)}


def test_counts_are_exact_at_any_size(spark, monkeypatch):
    """Over a million distinct pairs, in many batches and slices: each batch gets the corpus's exact counts."""
    monkeypatch.setattr(stuffing, "BATCH", 1 << 20)
    monkeypatch.setattr(words, "BLOCK", 1 << 18)
    monkeypatch.setattr(stuffing, "SLICE", 1 << 20)
    r = random.Random(3)
    word = ["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=4)) for _ in range(30_000)]
    texts = [" ".join(r.choices(word, k=5000)) for _ in range(260)]
    salad = " ".join(f"{a} {b}" for a, b in zip(NOUNS * 4, reversed(NOUNS * 4))) + " " + " ".join(r.choices(NOUNS, k=300))
    rows = [(f"t{i}", t) for i, t in enumerate(texts)] + [("salad", salad)] + [(f"n{i}", " ".join(r.choices(NOUNS, k=4))) for i in range(20_000)]
    n_word, pairs = Counter(), Counter()
    for t in {t for _, t in rows}:  # exact copies are one page
        w = t.split()
        n_word.update(w)
        pairs.update(zip(w, w[1:]))
    assert len(pairs) > 1_000_000
    got = {x.k: x for x in stuffing.score_pages(spark.createDataFrame(rows, "k string, t string").repartition(4), "k", "t").collect()}
    assert len(got) == len(rows)
    nw, np_ = sum(n_word.values()), sum(pairs.values())
    for k, t in rows[:3] + rows[260:262]:
        w = t.split()
        own = Counter(zip(w, w[1:]))
        pmi = [math.log((pairs[p] - own[p]) / np_) - math.log(n_word[p[0]] / nw) - math.log(n_word[p[1]] / nw) if pairs[p] > own[p] else 0.0 for p in zip(w, w[1:])]
        assert abs(got[k].pmi - sum(pmi) / len(pmi)) < 1e-9
