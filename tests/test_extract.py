"""Imports, calls and declarations from whole texts; ranks without sorting groups."""

import random

import pytest
from pyspark.sql import functions as F

from codelode.operators import edges as E
from codelode.operators import explore as O
from codelode.operators import extract as P
from codelode.sources import tree

TS = """// import nothing from "commented";
import def, {
  a,
  b as c, // two
} from "./multi.js";
import * as ns from 'pkg';
import type { T } from "./types";
import "side";
export { x } from "./again";
export * from './all';
const r = require("req"), q = require('two');
const d = await import("later");
/* paint("no") */
export class Widget {
  render(p: string): void {
    paint("x(y)"); this.p.draw(p); new Other(1);
  }
}
export const arrow = (x) => paint(x);
function plain() { return helper('it\\'s (a) "q"'); }
"""
PY = '''import os, os.path as osp, json
from .relative import (one,
    two as deux,  # a comment
)
from ..pkg.deep import *
class A:
    """call(me) not"""
    class B(Base):
        def m(self):
            def inner(): pass
            return run(self.m())
    def _h(self): pass
def top(): print("x(1)")
def _inner(): pass
'''
JAVA = """package com.acme.app;
import com.acme.Store;
import static com.acme.Util.max;
import com.acme.model.*;
public class App extends Base {
  public int f(int x) {
    return max(new Item(x).size());
  }
}
"""
GO = """package main

import (
\t"fmt"
\tst "git.example/store"
\t_ "git.example/side"
\t"git.example/lib/v2"
)

func (s *Server) Run(n int) error {
\treturn fmt.Println(st.Open("a(b)"), listen(n))
}

type Server struct {
\tx string `json:"y(z)"`
}
"""


@pytest.fixture(scope="module")
def files(spark):
    rows = [(1, "TypeScript", TS), (2, "python", PY), (3, "java", JAVA), (4, "go", GO.replace("\n", "\r\n")), (5, None, TS), (6, "python", None), (7, "python", "")]
    return spark.createDataFrame(rows, "id int, language string, content string")


def test_imports_and_their_names(files):
    got = {}
    for r in P.imported(files, "id", "language", "content").orderBy("id", "line", "specifier").collect():
        got.setdefault(r.id, []).append((r.line, r.kind, r.specifier, [(n.local_name, n.imported_name) for n in r.names]))
    assert got[1] == [(2, "esm", "./multi.js", [("def", "default"), ("a", "a"), ("c", "b")]), (6, "esm", "pkg", [("ns", "*")]), (7, "esm", "./types", [("T", "T")]), (8, "esm", "side", []), (9, "esm", "./again", []),
                      (10, "esm", "./all", []), (11, "require", "req", []), (11, "require", "two", []), (12, "dynamic", "later", [])]
    assert got[2] == [(1, "python", "json", [("json", "json")]), (1, "python", "os", [("os", "os")]), (1, "python", "os.path", [("osp", "os.path")]), (2, "python", ".relative", [("one", "one"), ("deux", "two")]), (5, "python", "..pkg.deep", [("*", "*")])]
    assert got[3] == [(2, "java", "com.acme.Store", [("Store", "Store")]), (3, "java", "com.acme.Util.max", [("max", "max")]), (4, "java", "com.acme.model.*", [])]
    assert got[4] == [(4, "go", "fmt", [("fmt", "*")]), (5, "go", "git.example/store", [("st", "*")]), (6, "go", "git.example/side", []), (7, "go", "git.example/lib/v2", [("lib", "*")])]
    assert set(got) == {1, 2, 3, 4} and P.imported(files.limit(0), "id", "language", "content").count() == 0


def test_calls(files):
    got = {}
    for r in P.called(files, "id", "language", "content").collect():
        got.setdefault(r.id, {})[r.callee] = r.n
    assert got[1] == {"require": 2, "render": 1, "paint": 2, "draw": 1, "helper": 1} | {k: v for k, v in got[1].items() if k == "arrow"}
    assert got[2] == {"run": 1, "m": 1, "print": 1} and got[4] == {"Println": 1, "Open": 1, "listen": 1, "Run": got[4].get("Run", 0)} | {k: v for k, v in got[4].items() if k != "Run"}
    assert got[3]["max"] == 1 and got[3]["Item"] == 1 and got[3]["size"] == 1 and set(got) == {1, 2, 3, 4}


def test_declarations_in_classes(files):
    got = {}
    for r in P.declared(files, "id", "language", "content").collect():
        got.setdefault(r.id, {})[r.qualified_name] = (r.kind, r.exported)
    assert got[1] == {"Widget": ("class", True), "Widget.render": ("method", False), "arrow": ("function", True), "plain": ("function", False)}
    assert got[2] == {"A": ("class", True), "A.B": ("class", True), "A.B.m": ("method", True), "A.B.inner": ("method", True), "A._h": ("method", False), "top": ("function", True), "_inner": ("function", False)}
    assert got[3] == {"App": ("class", True), "App.f": ("method", True)} and got[4] == {"Server.Run": ("method", True), "Server": ("class", True)}


def test_value_at_rank(spark):
    rng = random.Random(1)
    rows = [("a", rng.choice([1.0, 2.0, 2.0, rng.random() * 1e6])) for _ in range(700)] + [("b", 5.0)] * 9 + [("c", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    by = {g: sorted((v for h, v in rows if h == g and v is not None), reverse=True) for g in "abc"}
    for k in (1, 2, 9, 333, 700):
        got = {r.g: r.v for r in E.value_at_rank(df, ["g"], "v", df.select("g").distinct().withColumn("k", F.lit(k)), "k", bins=16).collect()}
        assert got == {g: v[k - 1] for g, v in by.items() if len(v) >= k}


def test_top_rows_and_layout(spark):
    rows = [(g, i, float((i * 7919) % 101)) for g in (1, 2) for i in range(400)] + [(3, 0, 1.0)]
    df = spark.createDataFrame(rows, "g int, k int, v double")
    got = sorted((r.g, r.place, r.k) for r in O.top_rows(df, ["g"], [F.desc("v"), F.asc("k")], 5, salts=3).collect())
    want = [(g, p + 1, x[1]) for g in (1, 2, 3) for p, x in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: (-r[2], r[1]))[:5])]
    assert got == want
    points = spark.createDataFrame([(1, i, float(i), 0.0, 0.0, 1.0 if i < 10 else 0.0) for i in range(20)] + [(2, 0, 3.0, 4.0, 0.0, 0.0)], "g int, k int, x double, y double, z double, w double")
    r = {x.g: x for x in O.layout(points, ["g"], "k", "x", "y", "z", "w").collect()}
    assert (r[1].cx, r[1].radius, r[1].mx, r[1].overview, r[1].extent) == (4.5, 4.5, 9.5, 9.5, 14.5) and (r[2].cx, r[2].radius, r[2].extent) == (3.0, 100.0, 100.0)
    c = O.cluster_frame(points, ["g"], "x", "y", "z", least=5.0).where("g = 1").first()
    assert (c.mx, c.radius) == (9.5, pytest.approx(1.4 * 9.5))
    assert O.layout(points.limit(0), ["g"], "k", "x", "y", "z", "w").count() == 0


def test_manifests(spark):
    df = spark.createDataFrame([("a/go.mod", "// m\nmodule  \"git.example/x\" // y\n"), ("go.mod", "go 1.22"), ("package.json", '{"name": "@a/b"}'), ("b/package.json", "{")], "path string, content string")
    assert sorted((r.path, r.package, r.module) for r in tree.package_names(df).collect()) == [("a/go.mod", None, "git.example/x"), ("b/package.json", None, None), ("go.mod", None, None), ("package.json", "@a/b", None)]
    assert {"site-packages", ".gradle"} <= tree.SKIPPED and "out" not in tree.SKIPPED
