"""The grammars against valid and broken texts, Python's against the interpreter's own."""

import ast
import glob
import os
import random
import shutil
import subprocess
import warnings

import pytest

from codelode.llm import validity

GOOD = {
    "javascript": ["", "let a = 1\nlet b = 2", "const f = async (x, {y = 2}, ...z) => ({...x, [y]: z?.a ?? 1})", "for (const [k, v] of m) { if (/[/)]}/.test(k)) continue; else v++ }", "class A extends B { static #p = 1; get x() { return `a${`b${1}`}c` } async *g() { yield* this.#p } }",
                   "import a, {b as c} from './x.js'\nexport default class {}\nexport * as n from 'y'", "label: while (1) { switch (x) { case 1: default: break label } }", "try { a() } catch { b() } finally { c() }", "var a = b / c / d, r = /x\\/[\\]/]+/g", "with (a) b", "new (foo())(1).bar`x`"],
    "typescript": ["type A<T extends object = {}> = { readonly [K in keyof T]?: T[K] } | (T extends (infer U)[] ? U : never)", "abstract class A<T> implements B, C<T> { constructor(private readonly x: number, y?: string) { super() } abstract f<K>(this: A<K>, ...r: K[]): asserts x is string; [k: string]: any }",
                   "enum E { A = 1, B }\ndeclare module 'x' { export const y: number }\nnamespace N.M { export type T = typeof import('z') }", "const f = <T,>(x: T): x is T => x as unknown as T; let y = <any>z!; g<number>(1)", "import type { A } from 'a'; export type { A }; let t: [a: string, b?: number, ...rest: boolean[]]", "function f(x: string): void; function f(x: any) {}"],
    "tsx": ["const a = <div className=\"x\" {...p}>don't {items.map(i => <Item key={i} />)} <></> 50% — ok</div>;", "const b = <A.B<string> on={() => 1}>{/* c */}</A.B>", "let x = a < b && c > d"],
    "java": ["", "package a.b;\nimport static java.util.List.*;\n@A(x = {1, 2}) public sealed class C<T extends D & E> extends F implements G permits H { int[] a = {1}, b[]; static { } <K> C(K... k) throws X { this.<K>m(k); } }", "record P(int x, @N String y) { P { if (x < 0) throw new E(); } }",
             "enum E { A(1) { void f() {} }, B; int x; }", "interface I { default void f() { var x = switch (y) { case 1, 2 -> 3; default -> { yield 4; } }; Runnable r = () -> {}; Object o = (Runnable & S) () -> g(); for (var i : xs) { if (o instanceof P p && p.q) continue; } } }", 'class T { String s = """\n  a "quoted" text\n  """; char c = \'\\u0041\'; int i = (int) x >>> 2; List<List<String>> l = new ArrayList<>(); java.util.function.Supplier<int[]> q = int[]::new; }'],
    "go": ["package a", "package a\nimport (\n\t\"fmt\"\n\tx \"y/z\"\n)\ntype T[K comparable, V any] struct {\n\tA, B int `json:\"a\"`\n\t*C\n}\nfunc (t *T[K, V]) F(a, b int, c ...string) (x int, err error) {\n\tif v, ok := m[k]; ok && f(func() {}) {\n\t\treturn\n\t}\n\tfor i := range 10 {\n\t\tgo t.g(i)\n\t}\n\tselect {\n\tcase c <- 1:\n\tdefault:\n\t}\n\tswitch y := z.(type) {\n\tcase int, *T[int, string]:\n\t\tx = y\n\t}\n\tL:\n\tfor {\n\t\tbreak L\n\t}\n\treturn map[string][]int{\"a\": {1, 2}}, nil\n}",
           "package a\nvar x, y = 1, 'b'\nconst (\n\tA = iota\n\tB\n)\ntype I interface {\n\tF(int) string\n\t~int | ~string\n}"],
    "python": ["", "async def f(a, /, b: int = 1, *args, c, **kw) -> x:\n    async with a as b, c: pass\n    return [await x async for y in z if y]\n", "match x:\n    case {'a': [1, *_], **r} if r: pass\n    case C(x=1) | None: pass\n", "if x:\n\ty = lambda *a, k=1: (yield)\nelif z: pass\nelse:\n\tprint(f\"{a['b']!r:>{w}}\")\n", "x: int = 1; del a, b[1:2, ::3]\n@d\nclass A(B, metaclass=M):\n    '''doc'''\n", "try: pass\nexcept* E as e: pass\nfinally: pass\n", "a = b = (c := 1)\nwith (open(a) as f, open(b)): pass\n"],
}
BAD = {
    "javascript": ["function f( {", "let a = ;", "const s = 'x", "if (a { b }", "<<<<<<< HEAD\na\n=======\nb\n>>>>>>> x", "let x: number = 1", "const e = <div/>;", "class A { x( }", "`abc", "a b", "return <A>1</A>", "var class = 1", "{ a: 1, b: 2 }"],
    "typescript": ["let x: = 1", "interface A { x: }", "function f(x: string {", "const e = <div>a b</div>;"],
    "tsx": ["const e = <div>;", "const e = <a></div", "let x = “y”"],
    "java": ["class A { void f() { int x = ; } }", "class A {", "int x = 3;", "class A { void f( { } }", "class A { void f() { x + 1; } }", 'class A { String s = "x; }', "package a; import b class C {}"],
    "go": ["package a\nfunc f() int {\n\tx = \n}", "func f() {}", "package a\nfunc f( {\n}", "package a\nx := 1", "package a\nfunc f() {\n\ta + b\n}\n", "package a\nvar s = `x", "package a\nfunc f()\n{\n}"],
    "python": ["def f(:\n  pass\n", "print 'x'\n", "if x:\npass\n", "x = (1,\n", "'''abc", "a = 08\n", "  x = 1\n", "if x:\n    a\n  b\n", "for x in y\n    pass\n", "class A:\n", "x = 'a\n", "<<<<<<< HEAD\n", "lambda: yield = 1 = \n"],
}


@pytest.mark.parametrize("language", list(GOOD))
def test_languages(language):
    c = validity.checker(language)
    assert [t for t in GOOD[language] if not c.check(t)[0]] == []
    assert [t for t in BAD[language] if c.check(t)[0]] == []


def test_place_of_error():
    assert validity.checker("python").check("x = 1\ny = )\n") == (False, 2, False)
    assert validity.checker("java").check("class A {\n  void f() {\n") [::2] == (False, True)
    assert validity.checker("javascript").check("a\r\nb c\r\n")[:2] == (False, 2)


def test_python_against_ast():
    warnings.simplefilter("ignore")
    c, rng = validity.checker("python"), random.Random(0)
    files = sorted(glob.glob(os.path.join(os.path.dirname(ast.__file__), "*.py")))[:60]
    differ = []
    for f in files:
        text = open(f, encoding="utf-8").read()[:6000]
        tries = [text[: text.rfind("\n", 0, 5000) + 1]] + [text[:i] + rng.choice(["(", ")", ":", "'", "\n  ", ""]) + text[i + rng.randint(0, 3) :] for i in (rng.randrange(len(text)) for _ in range(4))]
        for t in tries:
            try:
                ast.parse(t)
                ok = True
            except (SyntaxError, ValueError):
                ok = False
            differ.append(ok != c.check(t)[0])
    assert sum(differ) <= 0.02 * len(differ)


def test_javascript_against_node(tmp_path):
    if not shutil.which("node"):
        pytest.skip("node is absent")
    c, rng = validity.checker("javascript"), random.Random(1)
    base = [t for t in GOOD["javascript"] if "import " not in t and t]
    tries = base + [t[:i] + rng.choice(["(", "}", ";", "'", ""]) + t[i + 1 :] for t in base for i in (rng.randrange(len(t)) for _ in range(12))]
    script = "const vm=require('vm');const ts=JSON.parse(require('fs').readFileSync(0));console.log(JSON.stringify(ts.map(t=>{try{new vm.Script(t);return true}catch(e){return false}})))"
    import json

    want = json.loads(subprocess.run(["node", "-e", script], input=json.dumps(tries), capture_output=True, text=True, check=True).stdout)
    wrong = [t for t, w in zip(tries, want) if w and not c.check(t)[0]]
    assert wrong == [] and sum(c.check(t)[0] != w for t, w in zip(tries, want)) <= 0.1 * len(tries)


def test_memo_can_be_emptied(monkeypatch):
    from codelode.llm.syntax import derivatives

    c = validity.checker("go")
    monkeypatch.setattr(derivatives, "MOST_STATES", 10)
    assert all(c.check(t)[0] for t in GOOD["go"] * 2) and not any(c.check(t)[0] for t in BAD["go"])


def test_operator(spark):
    rows = [(1, 7, "a.py", "x = 1\n"), (2, 7, "b.py", "x = ("), (3, 8, "c.JSON", "{"), (4, 8, "d.ts", None), (5, 8, "e.go", ""), (6, 8, None, "x"), (2, 7, "b.py", "x = ("), (7, 8, "big.py", "y = 2\n" * 50_000)]
    df = spark.createDataFrame(rows, "k long, repo long, p string, c string")
    got = sorted((r.k, r.has_errors, r.cut_off) for r in validity.syntax_flags(df, "k", "p", "c").collect())
    assert got == [(1, False, False), (2, True, True), (2, True, True), (5, False, False), (7, False, False)]
    assert validity.syntax_flags(df.limit(0), "k", "p", "c").count() == 0
    rates = validity.error_rates(validity.syntax_flags(df, "k", "p", "c"), "language")
    assert {r.language: (r.files, r.with_errors) for r in rates.collect()}["python"] == (4, 2)


DEEP = "x => { if (x) { return { b: { c: `${[1].map(y => { if (y) { return { d: '}' } } })}` } }; } }"


@pytest.mark.parametrize("language", ["javascript", "typescript", "tsx"])
def test_templates_of_any_depth(language):
    c = validity.checker(language)
    text = DEEP
    for _ in range(4):
        assert c.check(f"const a = 1\nconst s = `a${{b.map({text})}}c${{d}}`\nf(s)")[0]
        assert c.check(f"const a = 1\nconst s = `a${{b.map({text})}}c${{d e}}`\nf(s)")[:2] == (False, 2)
        assert not c.check(f"const s = `a${{b.map({text.replace('return', 'return return')})}}c`")[0]
        text = f"x => {{ if (x) {{ return {{ b: `${{b.map({text})}}` }}; }} }}"
    assert c.check('const s = `${"}"}${`}`}\\``')[0] and c.check("f`$${a}$`\ng``")[0]
    assert not c.check("const s = `${a")[0] and not c.check("const s = `${{a}`")[0]


F_GOOD = ['f"{x}"', "f'{a[\"b\"]}'", 'f"{x!r:>{w}.{p}}"', 'f"{x=}"', 'f"{x = !r}"', 'f"{{}}"', 'f"{a, *b}"', "f'{x:%Y-%m}'", 'f"{(lambda: 1)()}"', 'f"{a != b}"', 'rf"\\d{n}"', 'f"\\N{BULLET}{x}"', 'f"{x:=5}"', 'f"a" "b" f"{c}"', 'f"{ {1: 2}[1] }"', 'f"{f\'{y}\'}"', "f'''{\n x\n}'''", 'f"{(yield)}"', 'f""']
F_BAD = ['f"{x"', 'f"{x +}"', 'f"{}"', 'f"{a b}"', 'f"}"', 'f"{x!z}"', 'f"{x:{}}"', 'f"{ }"', 'f"{f\'{y +}\'}"', 'f"{x)}"', 'f"{lambda x: 1}"', 'f"{a b!r}"', 'f"{!r}"']


def test_expressions_in_f_strings():
    c = validity.checker("python")
    for s, good in [(s, True) for s in F_GOOD] + [(s, False) for s in F_BAD]:
        try:
            ast.parse(f"a = 1\nb = {s}\n")
            valid = True
        except SyntaxError:
            valid = False
        assert (s, c.check(f"a = 1\nb = {s}\n")[0], valid) == (s, good, good)


STATEMENTS = ["f() = 1", "1 = x", "f(a=1, 2)", "def f(a=1, b): pass", "a, b += 1", "del f()", "for f() in x: pass", 's = "\\N{zzz}"', 's = "\\N{BULLET}"', 's = "\\x1"', "s = b'é'", "f(**k, *a)", "f(**k, a)", "f(**k, b=1, **m)", "f(a, *b, c, d=1, *e)", "f(x for x in y)", "f(x for x in y, 1)", "a.b[1].c = d = 2",
              "*a, (b, [c, d.e]) = x", "(a): int = 1", "a.b: int", "(a, b): int", "a[1] += 2", "(a) = 1", "() = x", "[] = x", "a = yield", "a = b = yield c", "x = y := 1", "(y := 1)", "f(y := 1)", "(y.z := 1)", "def f(a, /, b=1, *, c, d=2, **e): pass", "def f(*): pass", "def f(*, **k): pass", "def f(a, /, b, /): pass", "def f(**k, a): pass",
              "def f(a, b=1, /, c): pass", "def f(*a, b, c=1, d): pass", "lambda a=1, b: 0", "lambda *a, b: 0", "lambda *, a=1, b: 0", "lambda: 0", "del a, b[1], (c.d)", "del (a, b), [c]", "del *a", "del a + b", "for a.b, c[0] in x: pass", "for *a, b in x: pass", "with a as b.c, d as (e, f): pass", "with a as f(): pass", "[x for f() in y]", "[x for x, *y in z if a if b]", "[x for x in y if z := 1]", "a + 1 = 2", "-a = 1", "a if b else c = 1", "None = 1", "lambda: x = 1", "a < b = c", "await x = 1", "f()[0] = g().h = 1", "x: int = yield"]


def test_targets_and_argument_order_in_python():
    warnings.simplefilter("ignore")
    c = validity.checker("python")
    for s in STATEMENTS:
        try:
            ast.parse(s + "\n")
            valid = True
        except SyntaxError:
            valid = False
        assert (s, c.check(s + "\n")[0]) == (s, valid)


SCRIPTS = ["1 = x", "a++ = 1", "const a;", "let {a};", "({a = 1})", "({a = 1} = x)", "[a.b, c[0] = 2, ...d] = x", "({a: b.c, ...d.e} = x)", "({a: 1} = x)", "(a) = 1", "(a, b) = 1", "a.b += 1", "f() += 1", "++a.b", "++f()", "--1", "a?.b = 1", "for (a.b of x);", "for ([a, b.c] of x);", "for (f() of x);", "for (const [a] of x);",
           "for (let i = 0, j; i < j; i++);", "if (a) /re/.test(b);", "while (x) /[)]/g.exec(y);", "a = (b) / c / d", "x = y => ({z} = y)", "(a, {b = 1}, ...c) => 1", "new a.b.c = 1", "this.x = 1", "this = 1", "async () => await x", "delete a.b, typeof -x, !a++", "-a ** 2 || 1", "`${f(\"}\")}`", "`${'`'}`", "x = a ? b : c = d", "a ? b : c ? d : e = f", "for (x in y in z);", "for (var i = 0 in {});", "yield = 1"]


def test_targets_in_javascript_against_node():
    if not shutil.which("node"):
        pytest.skip("node is absent")
    import json

    c = validity.checker("javascript")
    script = "const vm=require('vm');const ts=JSON.parse(require('fs').readFileSync(0));console.log(JSON.stringify(ts.map(t=>{try{new vm.Script(t);return true}catch(e){return false}})))"
    want = json.loads(subprocess.run(["node", "-e", script], input=json.dumps(SCRIPTS), capture_output=True, text=True, check=True).stdout)
    assert [(t, w) for t, w in zip(SCRIPTS, want) if c.check(t)[0] != w and t != "-a ** 2 || 1"] == []
