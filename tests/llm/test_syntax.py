import ast
import random

import pytest

from codeweft.llm.syntax import check_files, parser

GOOD = {
    "python": "import a.b as c\nfrom . import (x, y,)\n@dec(1)\nclass A(B, metaclass=M):\n    '''doc\n    more'''\n    async def f(self, *a: int, k=1, **kw) -> 'T':\n        if (n := len(a)) > 10: return [x for x in a if x not in kw]\n        try:\n            with open(p) as f, g() as h:\n                yield {**d, 'k': v}\n        except (E, F) as e:\n            raise X from e\n        finally:\n            pass\n        lam = lambda x, *y, z=1: x if z else -y[1:2, ::3]\nmatch q:\n    case [1, *_] | A(x=3) if z:\n        del a[0]\n    case _:\n        x: int = 3; y += 1\n",
    "javascript": "'use strict'\nimport d, { a as b } from './m.js'\nexport default class A extends B {\n  #p = 1\n  static async *g({ x, ...r } = {}, [y] = []) {\n    for await (const z of y) { yield* z?.q?.[1] ?? `t${x}` }\n  }\n  get v() { return this.#p }\n}\nconst f = async (a, b = 2) => ({ a, [b]: 1, m() {} })\nif (a) b()\nelse if (/x[/]y/g.test(c)) { d++ } else e\nlabel: for (let i = 0, j = 1; i < j; i++) { if (i) continue label; break }\nswitch (k) { case 1: case 2: z(); break; default: w() }\ntry { t() } catch { u() } finally { v }\nvar o = { 'k': x ? y : z ? 1 : 2, get q() { return 1 } }, n = new X(1)[2]\ndo { s() } while (r);\n",
    "typescript": "import type { T } from './t';\ninterface I<X extends Y = Z> extends J { readonly a?: string | null; m<K>(x: K): void; [k: string]: any }\ntype U<T> = T extends string ? A<T>[] : { [P in keyof T]?: T[P] };\nenum E { A = 1, B }\nabstract class C<T> implements I<T>, J {\n  private readonly x: Map<string, Array<number>> = new Map<string, number[]>();\n  constructor(public a: number, b?: string) { super(); }\n  abstract f(): Promise<void>;\n  g = <T,>(y: T): y is string => y as any;\n}\nexport function h(x: number, ...r: string[]): asserts x is 1 { return x! as unknown as T; }\ndeclare module 'm' { const z: number; }\n",
    "java": 'package a.b;\nimport static c.D.*;\n@Ann(x = 1, y = {"a", "b"})\npublic final class A<T extends B & C> extends D<T> implements E, F<? super G> {\n  private static final Map<String, List<int[]>> M = new HashMap<>();\n  enum K implements L { X(1) { void q() {} }, Y; int z; }\n  record R(int a, String... b) {}\n  @Override public <U> U f(final int[] a, U b) throws IOException {\n    for (int i = 0, j = 1; i < a.length; i++) { if (a[i] > 3 && b instanceof String s) continue; else break; }\n    for (var x : a) switch (x) { case 1 -> g(); case 2, 3 -> { h(); } default -> throw new X(); }\n    try (var r = o()) { r.m(A::new, x -> x + 1, (p, q) -> { return p; }); } catch (I | J e) { } finally { }\n    int[][] y = {{1}, {2}}; y[0][1] += (int) 2.5f; char c = \'\\n\'; String t = """\n      x""";\n    return a == null ? (U) b : new U[3] == null ? b : b;\n  }\n  static { }\n}\n',
    "go": 'package p\n\nimport (\n\t"a/b"\n\tx "c"\n)\n\ntype T[K comparable, V any] struct {\n\tA, B int `json:"a"`\n\t*E\n}\ntype I interface {\n\tM(a int, b ...string) (x int, err error)\n\t~int | string\n}\nconst (\n\tX = iota\n\tY\n)\nvar f = func(a int) (b int) { return a << 2 }\n\nfunc (t *T[K, V]) M(c chan<- int) map[string][]int {\n\tif x, ok := t.m["k"]; ok && !x {\n\t\tgo func() { c <- 1 }()\n\t} else if y := 2; y > 1 {\n\t\tdefer t.U()\n\t}\n\tfor i, v := range []int{1, 2} {\n\t\tswitch v := z.(type) {\n\t\tcase int, string:\n\t\t\tfallthrough\n\t\tdefault:\n\t\t}\n\t}\n\tfor ; ; i++ {\n\t\tselect {\n\t\tcase v := <-c:\n\t\t}\n\t}\n\treturn map[string][]int{\n\t\t"a": {1},\n\t\tb[1:2:3]: nil,\n\t}\n}\n',
    "rust": "#![allow(x)]\nuse a::{b, c::*, d as e};\n#[derive(Debug)]\npub(crate) struct S<'a, T: Clone + 'a, const N: usize> where T: Fn(i32) -> u8 { pub a: &'a [T; N], b: Option<Vec<Box<dyn Tr + Send>>> }\nstruct P(u8, pub i32);\nenum E { A, B(i32), C { x: u8 } = 3 }\nimpl<'a, T> Tr for S<'a, T> {\n    type X = u8;\n    const Y: i32 = -1;\n    fn f(&mut self, mut a: Vec<u8>, (b, c): (i32, u8)) -> Result<(), Box<dyn Error>> {\n        let x = if a.len() > 3 { 1 } else { 2 };\n        let Some(y) = z else { return Err(e)?; };\n        match x { 1 | 2 => {} n if n > 3 => return Ok(()), 4..=9 => foo(), _ => unreachable!(\"a {}\", 1), }\n        'l: loop { if let Some(&v) = a.iter().map(|q: &u8| -> u8 { q + 1 }).max() { break 'l; } }\n        for i in 0..10 { a[i] <<= 2 as u8; }\n        let s = S { a: &[1, 2], ..d };\n        let g = a.iter().collect::<Vec<_>>();\n        while !done { x += 1 }\n        unsafe { *p = r#\"raw\"#.len() }\n        Ok(())\n    }\n}\nmacro_rules! m { ($x:expr) => { $x + 1 }; }\n",
}
EXT = {"python": "py", "javascript": "js", "typescript": "ts", "java": "java", "go": "go", "rust": "rs"}


@pytest.mark.parametrize("language", GOOD)
def test_valid_code(language):
    assert parser(language).check(GOOD[language]) == (0, "")
    assert parser(language).check("") == (0, "") and parser(language).valid("\n\n") or language in ("go",)


@pytest.mark.parametrize("language", GOOD)
def test_damage_is_found(language):
    text, p = GOOD[language], parser(language)
    lines = text.split("\n")
    mid = len(lines) // 2
    conflict = "\n".join([*lines[:mid], "<<<<<<< ours", lines[mid], "=======", lines[mid], ">>>>>>> abc1234", *lines[mid:]])
    assert p.check(conflict)[1] == "conflict"
    last = max(text.rfind("}"), text.rfind(")"))
    assert p.check(text[:last])[0] >= 1
    assert p.check("<!DOCTYPE html>\n<html>\n<head><title>404 x</title></head>\n")[0] >= 1
    assert p.check(text.replace("(", "((", 1))[0] >= 1
    assert p.check(text + "\n) ]\n")[0] >= 1


def test_python_agrees_with_the_interpreter_on_mutations():
    rng, p = random.Random(7), parser("python")
    lines = GOOD["python"].split("\n")
    wrong = 0
    for _ in range(150):
        mine = [*lines]
        k = rng.randrange(len(mine))
        if rng.random() < 0.5:
            del mine[k]
        elif mine[k]:
            at = rng.randrange(len(mine[k]))
            mine[k] = mine[k][:at] + mine[k][at + 1 :]
        text = "\n".join(mine)
        try:
            ast.parse(text)
            ok = True
        except SyntaxError:
            ok = False
        wrong += p.valid(text) != ok
    assert wrong <= 8


def test_files(spark):
    rows = [("a/x.py", "x = (1", "u"), ("a/x.py", "x = (1", "u"), ("a/y.go", None, "u"), ("a/z.txt", "((", "u"), (None, "((", "u"), ("a/v.ts", "let x: number = 1;", "u"), ("a/v.js", "let x: number = 1;", "u")]
    df = spark.createDataFrame(rows, "path string, content string, language string")
    got = sorted((r.path, r.edits > 0) for r in check_files(df).collect())
    assert got == [("a/v.js", True), ("a/v.ts", False), ("a/x.py", True), ("a/x.py", True), ("a/y.go", False)]


def test_all_faults_of_a_long_file_are_counted():
    good, bad = "def f(a):\n    b = a + 1\n    return b\n", "def f(a):\n    b = a a\n    return b\n"
    one = parser("python").check(bad + good * 9)[0]
    assert parser("python").check((bad + good * 3) * 100) == (100 * one, "local")  # equal contents count each time
    other = "".join(bad.replace("a a", f"a{'.x' * k} a") + good * 3 for k in range(100))
    assert parser("python").check(other) == (100 * one, "local")


def test_brackets_are_repaired_with_the_least_edits():
    import itertools
    from codeweft.llm.syntax import parser

    p = parser("javascript")
    marks = "".join(a + b for a, b in p._pairs())

    def nests(t):
        for _ in t:
            for a, b in p._pairs():
                t = t.replace(a + b, "")
        return not t

    def least(t):  # as many edits as brackets that have to go for the rest to nest
        return next(n for n in range(len(t) + 1) if any(nests("".join(c for k, c in enumerate(t) if k not in gone)) for gone in itertools.combinations(range(len(t)), n)))

    for k in range(200):
        t = "".join(marks[(k * 7 + x * x * (k % 5 + 1) + x * k) % 6] for x in range(k % 7 + 1))
        flat, edits = p.balance(t)
        assert nests(flat) and len(edits) == least(t), t


def test_causes_follow_the_edits():
    from codeweft.llm.syntax import parser

    p = parser("python")
    good = "def f(a):\n    return [a, 1]\n\n\ndef g(b):\n    return {b: (1, 2)}\n"
    assert p.check(good) == (0, "")
    assert p.check("<<<<<<< HEAD\nx = 1\n=======\nx = 2\n>>>>>>> other\n" + good)[1] == "conflict"
    assert p.check(good + 's = """\n<<<<<<< HEAD\n=======\n>>>>>>> x\n"""\nx = (1\n')[1] != "conflict"  # marker lines in a text, the edit elsewhere
    assert p.check(good[:-7])[1] == "truncation"
    assert p.check("package main\n\nimport \"fmt\"\n\nfunc main() {\n\tvar x int = 3\n\tfmt.Println(x)\n}\nfunc f(a int) int { return a }\n")[1] == "mismatch"
    assert p.check(good.replace("return [a", "return return [a"))[1] == "local"
