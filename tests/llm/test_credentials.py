"""Secrets found, other literals left, texts otherwise unchanged."""

import os
import random
import string

import pytest

from codelode.llm import credentials as K

rng = random.Random(9)
TABLES = "/root/testdata/sf0.1"


def rand(n, alphabet=string.ascii_letters + string.digits):
    return "".join(rng.choice(alphabet) for _ in range(n))


def hexa(n):
    return rand(n, "0123456789abcdef")


def lines():
    yes = [f'password = "{rng.choice(["Amber", "Quiet"])}_{rng.choice(["willow", "north"])}{rng.randint(1000, 9999)}!"', f'const token = "ghp_{rand(36)}";', f'aws_key = "AKIA{rand(16, string.ascii_uppercase + string.digits)}"', f'api_key = "{hexa(40)}"',
           f'dsn = "postgres://app:{rand(14)}@db.example:5432/x"', f'headers["Authorization"] = "Bearer {rand(48)}"', f'k = "xoxb-{rand(12, string.digits)}-{rand(24)}"', f'client = connect("x" /* clientSecret */, "{rand(40)}")']
    no = ['password = "<password>"', 'token = "$GITHUB_TOKEN"', 'api_key = os.environ["API_KEY"]', f'commit_sha = "{hexa(40)}"', f'integrity = "sha512-{rand(80)}=="', 'password_field = "password"', 'token = "ghp_' + "x" * 36 + '"', 'dsn = "mysql://user:${DB_PASS}@db.example/x"',
          f'icon = "data:image/png;base64,{rand(90)}"', 'name = "hello"', 'path = "src/token/reader.py"', f'checksum = "{hexa(64)}"', 'token_label = "young token"', 'x = prompt_token["weight"]']
    return yes, no


def corpus(n=60):
    rows, want = [], set()
    for i in range(n):
        yes, no = lines()
        text = ["def f(x):", "    return gather_words(x)", rng.choice(no), rng.choice(no)]
        if i % 2:
            text.insert(2, rng.choice(yes))
            want.add((i, 3))
        rows.append((i, "\n".join(text), "src/app.py"))
    key = "-----BEGIN RSA PRIVATE KEY-----\n" + "\n".join(rand(64) for _ in range(4)) + "\n-----END RSA PRIVATE KEY-----"
    public = key.replace("RSA PRIVATE", "PUBLIC")
    rows += [(1000, f'a = 1\nkey = """{key}"""\nb = 2', "a.py"), (1001, f'key = """{public}"""', "a.py"), (1002, "PASSWORD=Amber.willow9461?\nURL=http://h.example/", "deploy/x.env"), (1003, "", "a.py"), (1004, None, "a.py"), (1005, "password = Amber_willow9461", None)]
    return rows, want | {(1000, 2), (1002, 1), (1005, 1)}


def test_found_and_redacted(spark):
    rows, want = corpus()
    df = spark.createDataFrame(rows, "k long, t string, p string")
    scored = K.score_candidates(df, "k", "t", "p").cache()
    assert {(r.k, r.line_no) for r in scored.where("score >= 0.5").collect()} == want
    before = {r[0]: r[1] for r in rows}
    after = {r.k: (r.t, r.n_redacted) for r in K.redact(df, "k", "t", scored).collect()}
    assert set(after) == set(before)
    for k, (t, n) in after.items():
        assert (n > 0) == (k in {x for x, _ in want})
        if not n:
            assert t == before[k]
        else:
            assert t.count("\n") == before[k].count("\n") and "REDACTED" in t
            assert [x for i, x in enumerate(t.split("\n"), 1) if (k, i) not in want and k != 1000] == [x for i, x in enumerate(before[k].split("\n"), 1) if (k, i) not in want and k != 1000]
    assert "-----BEGIN RSA PRIVATE KEY-----" in after[1000][0] and after[1000][0].startswith("a = 1\n") and after[1000][0].endswith('"""\nb = 2')


def test_without_labels(spark):
    df = spark.createDataFrame([(1, "x = 1", "a.py")], "k long, t string, p string")
    assert K.score_candidates(df, "k", "t", "p").count() == 0
    assert K.score_candidates(df.limit(0), "k", "t", "p").count() == 0
    only = spark.createDataFrame([(1, f'token = "ghp_{rand(36)}"', "a.py")], "k long, t string, p string")
    assert [r.score for r in K.score_candidates(only, "k", "t", "p").collect()] == [1.0]


def test_calibration_held_out(spark):
    import numpy as np

    x = np.random.default_rng(0).normal(size=(2000, 3))
    y = (x[:, 0] + 0.3 * x[:, 1] + 0.5 * np.random.default_rng(1).normal(size=2000) > 0).astype(float)
    s = K.Scorer(x, y)
    p = s(x)
    assert s.held_accuracy > 0.8 and abs(p[p > 0.5].mean() - y[p > 0.5].mean()) < 0.1


def test_values_with_comments_blanks_and_length():
    got = lambda text, path=None: [(c.value, c.names.split(" ")[-1]) for c in K.candidates(text, path)]
    assert got("password: s3cretPw9 # prod", "a.yml") == [("s3cretPw9", "password")]
    assert got("db.password = hunter22x ; prod\nx = y#z1234", "a.ini") == [("hunter22x", "db.password"), ("y#z1234", "x")]
    assert ("s3cretPw9", "password") in got("dsn = 'host=db user=app password=s3cretPw9'", "a.py")
    assert ("Blue 42 horses run", "passphrase") in got('passphrase = "Blue 42 horses run"', "a.py")
    assert got('title = "Blue 42 horses run"', "a.py") == []
    assert K.weak_family("quoted", "aB3" * 200, "api_key") is None
    flat = K.np.zeros(65536)
    assert K.features("a" * 400, "x", "quoted", None, flat) != K.features("a" * 400 + "Z9" * 50, "x", "quoted", None, flat)


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="the tables are absent")
def test_a_family_is_found_without_its_patterns(spark):
    """Keys of an issuer whose format labels nothing, in the project's chunks."""
    texts = spark.read.parquet(f"{TABLES}/chunks.parquet").dropDuplicates(["chunk_no"])
    s = K.score_candidates(texts, "chunk_no", "text", "path", without=("github",)).toPandas()
    own, sure = s[s.family == "github"], s[s.family.isin(["harmless", "lookalike"])]
    assert len(own) > 20 and (own.weak == -1).all() and (own.score >= 0.5).mean() >= 0.9
    assert (sure.score >= 0.5).mean() <= 0.001


def test_the_score_decides_and_likelihood_moves_it():
    """Random strings and words under a name that no pattern knows."""
    text = "def gather(words, width):\n    return merge(words, width)  # as the reader expects it\n" * 200
    pair = K.np.full((256, 256), 0.05)
    b = K.np.frombuffer(text.encode(), K.np.uint8)
    K.np.add.at(pair, (b[:-1], b[1:]), 1)
    logs = K.np.log(pair / pair.sum(1, keepdims=True)).ravel()
    train = [(f"{n}", v, 1) for n in ("token", "api_key") for v in [rand(30) for _ in range(60)]] + [("label", rng.choice(["gather the words", "merge_width", "reader expects"]), 0) for _ in range(120)]
    x = [K._packed(*K.features(v, n, "quoted", "a.py", logs)) for n, v, _ in train]
    scorer = K.Scorer(K._matrix(x), K.np.array([y for *_, y in train], float))
    new = K._matrix([K._packed(*K.features(v, "thing", "quoted", "a.py", logs)) for v in ("gather words merge width as it", rand(30))])
    assert scorer(new)[0] < 0.5 <= scorer(new)[1]
    flat = new.copy()
    flat[:, :2] = x_mean = K._matrix(x)[:, :2].mean(0)  # the value's likelihood made average
    assert abs(scorer(flat) - scorer(new)).max() > 0 and x_mean[0] < 0
