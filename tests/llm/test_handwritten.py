"""Vendored, generated, minified and data files against hand-written ones."""

import random
import re

from codelode.llm import handwritten as H

rng = random.Random(11)
V = ["load", "store", "merge", "split", "scan", "pack", "tag", "route", "bind", "trace"]
N_ = ["Frame", "Queue", "Label", "Panel", "Graph", "Cache", "Token", "Layer", "Batch", "Index"]


def hand(n=25, r=rng):
    out = ["// Not generated: edit this file by hand, then run the queue generator."]
    for i in range(n):
        a, b, c = r.choice(V) + r.choice(N_), r.choice(V) + r.choice(N_) + str(r.randint(0, 99)), r.choice(N_).lower() + str(r.randint(0, 999))
        out.append(r.choice([f"export function {a}{i}({c}) {{\n  const x{i} = {b}({c}, {r.randint(1, 999)});\n  return x{i}.{r.choice(V)};\n}}", f"for (const v of {b}({c})) {{\n  if (v.size > {r.randint(1, 99)}) {a}(v);\n}}", f"// The {c} keeps {b} in place.\nlet {c}_{i} = {{ kind: '{a}', width: {r.randint(1, 999)} }};"]))
    return "\n".join(out) + "\n"


LIB = hand(30, random.Random(99)).split("\n", 1)[1]
CASES = {
    "generated": ["// @generated by toolx 1.2\n" + hand(6), "/*\n * Code generated by stub. DO NOT EDIT.\n */\n" + hand(5), "class S {\n" + "\n".join(f"  get{rng.choice(N_)}{i}() {{ return this.fields[{i}]; }}" for i in range(30)) + "\n}\n"],
    "minified": ["(()=>{" + "".join(f"var a{i}=e.x{i}||{{}},b{i}={i};if(e.k>{i}){{t(a{i})}}" for i in range(80)) + "})();"],
    "data": ["const t = [\n" + "\n".join("    " + ",".join(str(rng.randint(0, 65535)) for _ in range(16)) + "," for _ in range(40)) + "\n];\n", 'export const blob = "' + "".join(rng.choice("ABCabc0123456789+/") for _ in range(4000)) + '";\n', "const h = [\n" + "\n".join("  " + ", ".join(f"0x{rng.randint(0, 255):02x}" for _ in range(12)) + "," for _ in range(40)) + "\n];\n"],
    None: [hand(), hand(8) + "const table = [" + ", ".join(str(i) for i in range(40)) + "];\n", hand(20) + 'const sample = "' + "lorem ipsum " * 80 + '";\n', "x = 1;\n"],
}


def test_structure():
    for kind, texts in CASES.items():
        assert [H.structure(t) for t in texts] == [kind] * len(texts)


def test_winnowing_guarantee():
    memo = H._Hash()
    shared = " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(H.K + H.W - 1))
    a, b = (H.fingerprints(" ".join(f"q{rng.randint(0, 10**9)}" for _ in range(50)) + " " + shared + " " + " ".join(f"z{rng.randint(0, 10**9)}" for _ in range(50)), False, memo) for _ in range(2))
    assert set(a.tolist()) & set(b.tolist())
    assert len(H.fingerprints("a b c", False, memo)) == 0
    w = H.fingerprints("x = 1 # c\n" * 40, True, memo)
    assert w.tolist() == H.fingerprints("x  =  1\n" * 40, True, memo).tolist()


def test_renamed_copies_share_their_prints():
    memo = H._Hash()
    text = LIB.split("\n", 1)[1]
    renamed = re.sub(r"\b(\d+)\b", "7", re.sub(r"'\w+'", "'other'", re.sub(r"\b(load|store|merge|split|scan|pack|tag|route|bind|trace)([A-Z])", r"my_\1\2", text)))
    assert renamed != text and H.fingerprints(renamed, False, memo).tolist() == H.fingerprints(text, False, memo).tolist() != []


def test_vendored(spark):
    rows = [(i, i, f"vendor/lib{i}.js", "// lib 1.0\n" + LIB.replace("\n", "\r\n") if i % 2 else LIB) for i in range(4)]
    rows += [(10 + i, 50, f"own/copy{i}.js", hand(30, random.Random(7))) for i in range(5)]  # copies inside one repository
    rows += [(20 + i, 60 + i, f"vendor/mine{i}.ts", hand(30, random.Random(100 + i))) for i in range(5)]
    rows += [(30, 1, "a.yaml", LIB), (31, 1, "b.js", None), (32, 1, "c.js", ""), (33, None, "d.js", hand(9)), (34, 2, "e.min.js", CASES["minified"][0])]
    files = spark.createDataFrame(rows, "file_id long, repo_id long, path string, content string")
    repos = spark.createDataFrame([(i, f"o{i}") for i in range(4)] + [(50, "o50")] + [(60 + i, None) for i in range(3)], "repo_id long, owner string")
    got = {r.file_id: r.kind for r in H.file_kinds(files, repos, "file_id", "repo_id", "path", "content").collect()}
    assert {k for k, v in got.items() if v == "vendored"} == {0, 1, 2, 3} and got[34] == "minified" and got[20] is None and got[10] is None and got[33] is None
    assert set(got) == {0, 1, 2, 3, 10, 11, 12, 13, 14, 20, 21, 22, 23, 24, 33, 34}
    same = repos.replace({"o1": "o0", "o2": "o0", "o3": "o0"}, subset="owner")
    assert "vendored" not in {r.kind for r in H.file_kinds(files, same, "file_id", "repo_id", "path", "content").collect()}
    assert H.file_kinds(files.limit(0), repos, "file_id", "repo_id", "path", "content").count() == 0
