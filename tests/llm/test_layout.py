from codeweft.llm.layout import Libraries, classify_files, kind_of

HAND = "import os\n\n# helper\n\ndef load(path):\n    with open(path) as f:\n        return f.read()\n\n\ndef save(path, text):\n    # keep the mode\n    with open(path, 'w') as f:\n        f.write(text)\n"


def stubs(n):
    return "\n".join(f"function rule{k}(buf, value) {{\n  peek(buf, {k * 8});\n  return value;\n}}\n" for k in range(n))


def test_kinds():
    assert kind_of("python", HAND, None)[0] == ""
    assert kind_of("python", "# Code generated by schemac v1.2. DO NOT EDIT.\n" + HAND, None)[0] == "generated"
    assert kind_of("python", "# Automatisch erzeugt aus a.xml - nicht bearbeiten\n" + HAND, None)[0] == "generated"
    assert kind_of("python", 'BANNER = "Code generated by x. DO NOT EDIT."\n' + HAND, None)[0] == ""
    assert kind_of("python", "# @generated files are skipped by this walker\n" + HAND, None)[0] == ""
    assert kind_of("javascript", stubs(9), None)[0] == "generated"
    assert kind_of("javascript", "".join(f"var a{k}={{k:{k},n:!0}};function b{k}(e){{return e>{k}?t(e):u(e)}}" for k in range(40)), None)[0] == "minified"
    assert kind_of("go", "package data\nvar x = []int{\n" + "    1, 2, 3, 4, 5, 6, 7, 8,\n" * 30 + "}\n", None)[0] == "data"
    assert kind_of("python", "", None)[0] == kind_of("python", "\n \n", None)[0] == ""


def test_vendored_copies_changed_or_not():
    code = "\n".join(f"    total_{k} = combine(total_{k - 1}, weight_{k})" for k in range(1, 30))
    lib = Libraries([("lib", code), ("other", "def unrelated_function(value):\n    return value * 17\n")])
    assert kind_of("python", code, lib)[0] == "vendored"
    assert kind_of("python", "# our header\r\n" + code.replace("\n", "\r\n").replace("weight_7", "w7") + "\nextra_call(1)\n", lib)[0] == "vendored"
    assert kind_of("python", HAND, lib)[0] == ""


def test_files(spark):
    df = spark.createDataFrame([("a/x.js", stubs(9), 1), ("a/x.js", stubs(9), 1), ("b.md", stubs(9), 1), ("c.py", None, 1)], "path string, content string, kind int")
    assert sorted((r.path, r.kind) for r in classify_files(df).collect()) == [("a/x.js", "generated"), ("a/x.js", "generated"), ("c.py", "")]
    libs = spark.createDataFrame([("l", None)], "lib string, content string")
    assert classify_files(df.limit(0), libs).count() == 0


def test_libraries_of_any_size_give_one_result(spark, monkeypatch):
    from codeweft.llm import layout

    code = "\n".join(f"    total_{k} = combine(total_{k - 1}, weight_{k})" for k in range(1, 30))
    small = "\n".join(f"    part_{k} = divide(part_{k - 1}, {k})" for k in range(1, 5))
    libs = spark.createDataFrame([("a", code + "\nshared_everywhere(1)"), ("b", "shared_everywhere(1)\n" + small), ("c", "shared_everywhere(1)"), ("d", None)], "lib string, content string")
    rows = [("x/copy.py", "# ours\n" + code.replace("weight_7", "w7")), ("x/part.py", HAND + small), ("x/own.py", HAND + "shared_everywhere(1)\n"), ("x/none.py", None), ("x/copy.py", "# ours\n" + code.replace("weight_7", "w7")), ("x/a.js", stubs(9))]
    df = spark.createDataFrame(rows, "path string, content string")
    want = sorted((r.path, r.kind, round(r.strength, 9)) for r in classify_files(df, libs).collect())
    assert ("x/copy.py", "vendored") in [w[:2] for w in want] and len(want) == len(rows)
    monkeypatch.setattr(layout, "LIBRARIES_MOST", 0)
    assert sorted((r.path, r.kind, round(r.strength, 9)) for r in classify_files(df, libs).collect()) == want


def test_canonical_layout():
    from codeweft.llm.layout import Layout, measure

    m = measure("java", "class A {\n    int x;\n    void f() {\n        g();\n    }\n}\n")
    assert m["same"] == 1.0 and m["expansion"] == 1.0
    one = measure("java", "class A{int x;void f(){g();}}")
    assert one["expansion"] == 6.0 and one["same"] == 0.0
    lay = Layout("java")
    lines = lay.emit("".join(map(lay.lex.table.__getitem__, lay.lex.tokens("class A{void f(){g();}}"))))
    assert [d for d, _ in lines] == [0, 1, 2, 1, 0]
