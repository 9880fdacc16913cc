from pyspark.sql import functions as F

from codeweft.functions import text
from codeweft.operators import chunks, graph, imports


def column(spark, rows, f, *names):
    df = spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in rows], ", ".join(f"{n} string" for n in names))
    return [r[0] for r in df.select(f(*map(F.col, names)).alias("x")).collect()]


def test_comments_are_left_out_but_not_in_quotes(spark):
    cases = {
        ("a = 1 # b\nc", "python"): "a = 1 \nc", ('s = "# no" # yes', "python"): 's = "# no" ', ('d = """a # b\n# c""" # x', "python"): 'd = """a # b\n# c""" ',
        ("a // b\nc /* d\ne */ f", "go"): "a \nc  f", ("u = 'http://x' // y", "javascript"): "u = 'http://x' ", ("a # b // c", "rust"): "a # b ", ("x /* open", "java"): "x ",
        (r"s = 'it\'s # so' # c", "python"): r"s = 'it\'s # so' ", ("`a // b` // c", "go"): "`a // b` ", ("'open # x", "python"): "'open # x", (None, "go"): "", ("a // b", None): "a ",
    }
    assert column(spark, list(cases), text.without_comments, "t", "l") == list(cases.values())
    long = "x = '" + "ab\\'" * 50_000 + "' # gone"
    assert column(spark, [(long, "python")], text.without_comments, "t", "l") == [long[:-6]]


def test_parameters_of_signatures(spark):
    cases = {("def f(self, a, b=(1, 2)):", "python"): 3, ("def f(self):", "python"): 0, ("func f()", "go"): 0, ("no brackets", "go"): None, ("f(a, , b)", "go"): 2, (") (", "go"): None, (None, "go"): None, ("f(self, a)", "java"): 2}
    assert column(spark, list(cases), text.parameters, "s", "l") == list(cases.values())
    body = "x\ndef f(a,\n  b,\n  c):\n  pass"
    assert column(spark, [body], lambda c: text.signature(c, F.lit(2)), "t") == ["def f(a,   b,   c):"]
    assert column(spark, [body], lambda c: text.signature(c, F.lit(2), 2), "t") == ["def f(a,   b,"]


def test_lines_literals_and_nesting(spark):
    assert column(spark, ["", None, "a", "a\n", "a\r\nb"], text.loc, "t") == [1, 1, 1, 2, 2]
    assert column(spark, ["", None, "# a\n  // b\n\n/* c\n* d\n\'\'\'e\n\"\"\"f\nx = 1\n\u00a0\n\ty"], text.sloc, "t") == [0, 0, 2]
    assert column(spark, ["a = 7 + 3 + 42.5 - 1000 x9 9x 0.5 10 1.0", None, ""], lambda c: text.magic_literals(F.coalesce(c, F.lit(""))), "t") == [4, 0, 0]
    assert column(spark, ["{{}}", "}}{", "{", "", "{}{{{}}}"], text.nesting, "t") == [1, 0, 0, 0, 2]
    assert column(spark, ["if a and elif b: else: for x", ""], text.complexity, "t") == [6, 1]


def test_strategies_and_labels(spark):
    big = "x\n" * 10_001
    rows = [("a.py", "x"), ("a.pb.go", "x"), ("b_generated.go", "x\n" * 100_001), ("c.py", big), ("d.py", big + "def f\n" * 4), ("e.py", big + "def f\n" * 101)]
    f = lambda p, t: text.file_strategy(p, t, text.functions_named(t, F.lit("python")))
    assert column(spark, rows, f, "p", "t") == ["normal", "god_file", "data_file", "data_file", "large_normal", "god_file"]
    assert column(spark, ["99", "100", "500", "501"], lambda c: text.render_strategy(c.cast("int")), "n") == ["show_all", "make_group", "make_group", "search_only"]
    assert column(spark, ["85", "65", "40", "39.9"], lambda c: text.maintainability_label(c.cast("double")), "n") == ["Highly Maintainable", "Maintainable", "Needs Attention", "Hard to Maintain"]
    assert column(spark, [r"a\nb\tc", "a\r\nb\n", r"x\r\ny", None], text.plain_snippet, "t") == ["a\nb    c", "a\nb", "x\ny", ""]


FNS = "repo string, file string, virtual_module string, name string, line_start int, line_end int, complexity int, calls array<string>"


def test_chunks_by_class_complexity_and_lines(spark):
    f = [("r", "a", "a", f"f{k:03d}", k * 10, k * 10 + 5, 1, []) for k in range(1, 53)] + [("r", "b", "b", "x", 1, 5, 16, []), ("r", "b", "b", "y", 6, 9, 6, []), ("r", "b", "b", "z", 10, 11, 1, []), ("r", "c", "c", "m", 5, 6, 1, []), ("r", "c", "c", "out", 50, 60, 99, [])]
    c = spark.createDataFrame([("c", "Outer", 1, 20), ("c", "Inner", 4, 8)], "file string, name string, line_start int, line_end int")
    got = {(r.file, r.name): (r.virtual_module, r.strategy) for r in chunks.chunk(spark.createDataFrame(f, FNS), c.where("name = 'Outer'")).collect()}
    assert got["a", "f001"] == ("Group 1 (lines 10–505)", "line_range") and got["a", "f052"] == ("Group 2 (lines 510–525)", "line_range")
    assert [got["b", n] for n in "xyz"] == [("High Complexity", "complexity"), ("Medium Complexity", "complexity"), ("Low Complexity", "complexity")]
    assert got["c", "m"] == ("Outer", "class") and ("c", "out") not in got
    inner = {r.name: r.class_name for r in chunks.innermost(spark.createDataFrame(f, FNS), c).where("file = 'c'").collect()}
    assert inner == {"m": "Inner", "out": None}


def test_anonymous_functions_give_their_calls_away(spark):
    f = [("r", "a", "a", "outer", 1, 20, 1, ["x"]), ("r", "a", "a", "inner", 2, 9, 1, []), ("r", "a", "a", "anonymous_3", 3, 4, 1, ["y", "x"]), ("r", "a", "a", "anonymous_12", 12, 13, 1, ["z"]), ("r", "a", "a", "anonymous_90", 90, 91, 1, ["lost"])]
    got = {r.name: r.calls for r in graph.anonymous_merged(spark.createDataFrame(f, FNS)).collect()}
    assert got == {"outer": ["x", "z"], "inner": ["x", "y"]}
    ids = {(r.scope, r.line_start): r.id for r in graph.node_ids(spark.createDataFrame([("r", "a", v, "f", n, n, 1, []) for v, n in (("A", 1), ("A", 2), ("B", 3))], FNS)).collect()}
    assert ids == {("A", 1): "f:1", ("A", 2): "f:2", ("B", 3): "f"}


def test_root_modules_and_inert_files(spark):
    m = spark.createDataFrame([("r", "p"), ("r", "p/a"), ("r", "p/a/b"), ("q", "x"), ("q", "y/z"), ("s", "one")], "repo string, module string")
    assert [(r.repo, r.module) for r in graph.root_module(m).collect()] == [("r", "p")]
    nodes = spark.createDataFrame([("r", "a/__init__.py", 0), ("r", "b/__init__.py", 0), ("r", "__init__.py", 1), ("r", "c/my__init__.py", 0)], "repo string, file string, functions int")
    edges = spark.createDataFrame([("r", "b/__init__.py", "x.py")], "repo string, source string, target string")
    assert {r.file for r in graph.without_inert(nodes, edges).collect()} == {"b/__init__.py", "__init__.py", "c/my__init__.py"}


def test_imports_of_each_language(spark):
    rows = [
        ("a.py", "python", "import os.path\nfrom core.x import y\nfrom . import z\nfrom .rel import w\nos.getcwd()\n"), ("b.ts", "typescript", "import { A } from './util/a'\nconst b = require('lodash.merge')\nimport 'x/y.css'\nlodash(1)"),
        ("c.java", "java", "import com.ex.Foo;\nclass B extends Base implements P, Q { Foo f = new Bar(); }"), ("d.go", "go", 'import (\n\t"fmt"\n\t"a/b-c"\n)\nfmt.Println("x y")'), ("e.rs", "rust", "use crate::foo::Bar;\nuse serde::De;\nuse std;\nfoo()"),
        ("f.c", "c", '#include "lib/my.h"\n#include <std.h>'), ("g.cs", "csharp", "using System.Text;\nText x;"), ("h.md", None, "import x"), ("i.py", "python", None),
    ]
    df = spark.createDataFrame(rows, "path string, language string, content string")
    got = {}
    for r in imports.extract(df).orderBy("path", "pos").collect():
        got.setdefault(r.path, []).append(r.raw)
    assert got == {"a.py": ["os", "core"], "b.ts": ["./util/a", "y", "lodash"], "c.java": ["Foo", "Bar", "Base", "P", "Q"], "d.go": ["fmt", "b-c"], "e.rs": ["foo", "serde"], "f.c": ["my"], "g.cs": ["Text"]}
    loose = {(r.path, r.raw) for r in imports.unused(df).collect()}
    assert loose == {("a.py", "core"), ("b.ts", "./util/a"), ("b.ts", "y"), ("d.go", "b-c"), ("e.rs", "serde"), ("f.c", "my")}
