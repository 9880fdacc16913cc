import pytest

from codeweft.operators import classes, rules, smells

SPECS = {s["pattern"]: s for s in rules.load_specs()}

CLASSES = "repo string, name string, kind string, bases array<string>, interfaces array<string>, fields array<struct<name:string,type:string,is_collection:boolean>>, method_names array<string>"
FNS = "repo string, name string, class_name string, calls array<string>, instantiates array<string>"


def test_strategy_and_negatives(spark):
    c = spark.createDataFrame(
        [("r", "Pay", "interface", [], [], [], ["pay"]), ("r", "Card", "class", [], ["Pay"], [], ["pay"]), ("r", "Cash", "class", [], ["Pay"], [], ["pay"]), ("r", "Shop", "class", [], [], [("how", "Pay", False)], ["buy"]), ("r", "Idle", "class", None, None, [("how", "Pay", False)], None)],
        CLASSES,
    )
    f = spark.createDataFrame([("r", "pay", "Card", [], None), ("r", "pay", "Cash", [], []), ("r", "buy", "Shop", ["pay"], [])], FNS)
    g = classes.ClassGraph(c, f)
    got = [(r.bindings, r.field, r.confidence) for r in rules.evaluate(g, SPECS["Strategy"]).collect()]
    assert got == [({"strategy_interface": "Pay", "context": "Shop"}, "how", 0.94)]
    assert rules.evaluate(g, SPECS["Observer"]).count() == 0


def test_proxy_and_decorator(spark):
    one = [("io", "Stream", False)]
    c = spark.createDataFrame([("r", "Stream", "interface", [], [], [], ["read"]), ("r", "Lazy", "class", [], ["Stream"], one, ["read"]), ("r", "Loud", "class", [], ["Stream"], one, ["read"])], CLASSES)
    f = spark.createDataFrame([("r", "read", "Lazy", ["read"], []), ("r", "read", "Loud", ["log", "read"], [])], FNS)
    g = classes.ClassGraph(c, f)
    by = {p: [r.bindings["wrapper"] for r in rules.evaluate(g, SPECS[p]).collect()] for p in ("Proxy", "Decorator")}
    assert by == {"Proxy": ["Lazy"], "Decorator": ["Loud"]}


def test_creators_and_mediators(spark):
    c = [("r", n, k, [], [], [], m) for n, k, m in [("Car", "class", []), ("Van", "class", []), ("Maker", "class", []), ("Copy", "class", []), ("Hub", "class", ["tell"]), ("A", "class", []), ("B", "class", [])]]
    f = [
        ("r", "build", "Maker", [], ["Car"]), ("r", "paint", "Maker", [], []), ("r", "fill", "Maker", [], None), ("r", "both", "Maker", [], ["Car", "Van"]), ("r", "Clone", "Copy", [], ["Copy", "Ghost"]),
        ("r", "tell", "Hub", [], []), ("r", "go", "A", ["tell"], []), ("r", "run", "B", ["tell"], []),
    ]
    g = classes.ClassGraph(spark.createDataFrame(c, CLASSES), spark.createDataFrame(f, FNS))
    names = lambda n: {r.binding for r in rules.PREDICATES[n][0](g).collect()}
    assert names("builder_candidates") == {"Maker"} and names("prototype_candidates") == {"Copy"} and names("mediator_candidates") == {"Hub"}
    assert names("factory_candidates") == {"Maker"} and names("singleton_candidates") == names("facade_candidates") == set()
    assert [r.repo for r in rules.fan_out_to_common_hub(g, ["A", "B"]).collect()] == ["r"] and rules.fan_out_to_common_hub(g, ["A", "Hub"]).count() == 0
    assert rules.no_direct_edges_between(g, ["A", "B"]).count() == 1 and rules.no_direct_edges_between(g, ["A", "Hub"]).count() == 0


def test_go_structs_implement_by_their_methods(spark):
    c = [("r", "Reader", "interface", "go", [], [], [], ["Read", "Close"]), ("r", "File", "struct", "go", [], [], [], []), ("r", "Half", "struct", "go", [], [], [], [])]
    cols = CLASSES.replace("kind string", "kind string, language string")
    f = [("r", "File.Read", "File", [], [], "go"), ("r", "File.Close", "File", [], [], "go"), ("r", "Half.Read", "Half", [], [], "go")]
    g = classes.ClassGraph(spark.createDataFrame(c, cols), spark.createDataFrame(f, FNS + ", language string"))
    assert [(r.child, r.parent) for r in g.implements.collect()] == [("File", "Reader")]


def test_specs_of_a_folder_and_unknown_predicates(spark, tmp_path):
    (tmp_path / "b.yaml").write_text("pattern: Two\nrequires: [{predicate: nothing, role: x}]\n")
    (tmp_path / "a.yml").write_text("pattern: One\ntier: low\nrequires: [{predicate: every_class, role: any}, {predicate: has_role_method, class: any, role_name: BUILDER_BUILD}]\nconfidence_weights: {every_class: 0.5, has_role_method: 0.4}\n")
    specs = rules.load_specs(str(tmp_path))
    assert [s["pattern"] for s in specs] == ["One", "Two"]
    g = classes.ClassGraph(spark.createDataFrame([("r", "Kit", "class", [], [], [], ["Build"]), ("r", "Pot", "class", [], [], [], None)], CLASSES), spark.createDataFrame([], FNS))
    (row,) = rules.evaluate(g, specs[0]).collect()
    assert (row.bindings, row.confidence, row.category) == ({"any": "Kit"}, 0.9, "Other") and row.place is None and row.evidence == ["every_class: Kit (1.00)", "has_role_method: Kit (1.00)"]
    with pytest.raises(ValueError, match="unknown predicate nothing"):
        rules.evaluate(g, specs[1])


def test_idioms_have_lines(spark):
    rows = [("a.go", "go", "package a\n\nvar once sync.Once\nvar b sync.Once"), ("b.rs", "rust", "static X: OnceCell<u8> = OnceCell::new();"), ("c.py", "python", "sync.Once"), ("d.go", "go", None)]
    got = {(r.path, r.line, r.idiom) for r in rules.singleton_idioms(spark.createDataFrame(rows, "path string, language string, content string")).collect()}
    assert got == {("a.go", 3, "sync.Once"), ("a.go", 4, "sync.Once"), ("b.rs", 1, "OnceCell")}


def test_all_rules_run_on_empty_tables(spark):
    g = classes.ClassGraph(spark.createDataFrame([], CLASSES), spark.createDataFrame([], FNS))
    assert all(rules.evaluate(g, s).isEmpty() for s in list(SPECS.values())[:4])


def test_causation_goes_by_detected_types_only(spark):
    rows = [("r", "god_class", "f", "a", None, "high"), ("r", "long_method", "f", "b", 1, "medium"), ("r", "too_many_params", "f", "b", 1, "medium"), ("q", "god_module", "f", "a", None, "high"), ("q", "feature_envy", "f", "x", 2, "medium")]
    df = spark.createDataFrame(rows, "repo string, smell string, file string, name string, line_start int, severity string")
    assert {(r.repo, r.smell, r.leads_to) for r in smells.reached(df).collect()} == {("r", "god_class", "long_method"), ("r", "god_class", "too_many_params"), ("r", "long_method", "too_many_params"), ("q", "god_module", "feature_envy")}
    plan = [(r.step, r.smell, r.resolves) for r in smells.fix_plan(df).where("repo = 'r'").collect()]
    assert plan == [(1, "long_method", 2), (2, "god_class", 1)]
    tree = {(r.path, r.nodes) for r in smells.fix_tree(df).where("repo = 'r'").collect()}
    assert tree == {("god_class", 1), ("god_class > long_method", 1), ("god_class > too_many_params", 1), ("god_class > long_method > too_many_params", 1)}
