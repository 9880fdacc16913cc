"""Smells of function rows, and names that stand in texts."""

import pytest

import __spark_entry__ as entry
from codeweft.operators import graph, smells

FUNCTIONS = "name string, file string, language string, module string, virtual_module string, line_start int, line_end int, complexity int, calls array<string>, param_count int, max_nesting_depth int, literal_count int, repo string"
FILES = "path string, repo string, language string, content string"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Two rows of one name and line that call 5 and 6 names, and a private name that nothing calls."""
    d = str(tmp_path_factory.mktemp("smells"))
    row = lambda name, line, calls: (name, "r/a.py", "python", "", "", line, line + 2, 1, calls, 0, 0, 0, "r")
    rows = [row("twice", 1, [*"abcde"]), row("twice", 1, [*"abcdef"]), row("_alone", 5, []), row("_used", 9, [])]
    spark.createDataFrame(rows, FUNCTIONS).selectExpr("*", "cast(null as string) as class_name", "cast(null as array<string>) as instantiates").write.parquet(f"{d}/parsed_functions.parquet")
    spark.createDataFrame([("r/a.py", "r", "python", "_alone _used"), ("r/b.py", "r", "python", "_used")], FILES).write.parquet(f"{d}/files.parquet")
    return d


def test_rows_of_one_name_and_line_count_once_each(spark, tables):
    rows = entry.queries()["smells_all"](spark, tables).collect()
    assert sorted((r.smell, r.name) for r in rows if r.smell in ("feature_envy", "dead_code")) == [("dead_code", "_alone"), ("feature_envy", "twice"), ("feature_envy", "twice")]


def test_smell_summary_counts_rows(spark, tables):
    rows = entry.queries()["smell_summary"](spark, tables).collect()
    assert {(r.smell, r.severity): r.findings for r in rows} == {("dead_code", "high"): 1, ("feature_envy", "medium"): 1, ("feature_envy", "high"): 1}


def test_words_are_sorted_out_before_they_are_shuffled(spark):
    fan = spark.createDataFrame([("r", "a.py", f"f{k}", k, 0, 0) for k in range(4)], "repo string, file string, name string, line_start int, fan_in long, fan_out int")
    files = spark.createDataFrame([("a.py", "r", "python", "f0 f1 f1 f3 # f0"), ("b.py", "r", "python", "f2 f3 " + "word " * 100)], FILES)
    out = graph.rescued(fan, files)
    assert {r.name: r.fan_in for r in out.collect()} == {"f0": 0, "f1": 1, "f2": 1, "f3": 1}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan and plan.index("Aggregate [repo") < plan.index("LeftSemi") < plan.index("explode(")


@pytest.mark.parametrize("marks", [1, 1 << 20])
def test_marks_shared_by_names_change_nothing(spark, monkeypatch, marks):
    monkeypatch.setattr(graph, "MARKS", marks, raising=False)
    fan = spark.createDataFrame([("r", "a.py", "x", 1, 0, 0), ("r", "a.py", "y", 2, 3, 0)], "repo string, file string, name string, line_start int, fan_in long, fan_out int")
    files = spark.createDataFrame([("b.py", "r", "python", "y z")], FILES)
    assert {r.name: r.fan_in for r in graph.rescued(fan, files).collect()} == {"x": 0, "y": 3}


def test_fix_plan_goes_by_arrow_tables(spark):
    """The most gain first: a critical class leads to the long method, which is gone then; no pandas frame a project."""
    rows = [("r", "god_class", None, "C", None, "critical"), ("r", "long_method", "a.py", "f", 3, "medium"), ("r", "lazy_class", "a.py", "D", None, "low"), ("s", "lazy_class", "b.py", "E", None, "low")]
    plan = smells.fix_plan(spark.createDataFrame(rows, "repo string, smell string, file string, name string, line_start int, severity string"))
    got = sorted((r.repo, r.step, r.smell, r.file, r.name, r.resolves, r.effort, r.roi, r.score) for r in plan.collect())
    assert got == [("r", 1, "lazy_class", "a.py", "D", 1, 1, 1.0, 1), ("r", 2, "god_class", None, "C", 2, 5, 0.4, 6), ("s", 1, "lazy_class", "b.py", "E", 1, 1, 1.0, 1)]
    assert "FlatMapGroupsInArrow" in plan._jdf.queryExecution().executedPlan().toString()


def test_file_ranking_by_row(spark, tables):
    assert {r.file: r.weight for r in entry.queries()["file_ranking"](spark, tables).collect()} == {"r/a.py": 8}


def test_debt_score_by_row(spark, tables):
    assert [(r.findings, r.debt) for r in entry.queries()["debt_score"](spark, tables).collect()] == [(3, 11.5)]


def test_smell_scores_by_row(spark, tables):
    rows = entry.queries()["smell_scores"](spark, tables).collect()
    assert {(r.smell, r.severity): r.instances for r in rows} == {("dead_code", "high"): 1, ("feature_envy", "medium"): 1, ("feature_envy", "high"): 1}


def test_smells_by_layer_by_row(spark, tables):
    assert {r.layer: r.findings for r in entry.queries()["smells_by_layer"](spark, tables).collect()} == {"function": 3}


def test_smell_root_causes_by_row(spark, tables):
    rows = entry.queries()["smell_root_causes"](spark, tables).collect()
    assert sorted((r.rank, r.name, r.score) for r in rows) == [(1, "twice", 3), (2, "_alone", 3), (3, "twice", 2)]


def test_smell_fix_tree_by_row(spark, tables):
    assert {r.path: r.nodes for r in entry.queries()["smell_fix_tree"](spark, tables).collect()} == {"dead_code": 1, "feature_envy": 2}


def test_fallback_plan_by_row(spark, tables):
    rows = entry.queries()["fallback_plan"](spark, tables).collect()
    assert sorted((r.step, r.smell, r.severity) for r in rows) == [(1, "dead_code", "high"), (2, "feature_envy", "high"), (3, "feature_envy", "medium")]


def test_worst_severity_by_row(spark, tables):
    assert {r.name: r.worst for r in entry.queries()["worst_severity"](spark, tables).collect()} == {"twice": "high", "_alone": "high"}


def test_small_projects_start_no_rounds(spark, tables, monkeypatch):
    monkeypatch.setattr(graph, "_rounds", None)
    for name in ("scc_members", "risk_top50", "risk_histogram", "risk_warnings", "transitive_closure"):
        entry.queries()[name](spark, tables).collect()


def test_repeated_edges_count_once(spark):
    edges = spark.createDataFrame([("r", "a", "b"), ("r", "a", "b"), ("r", "b", "a"), ("r", "b", "c")], "repo string, src string, dst string")
    assert graph._split(edges)[1] is None
    assert [tuple(r) for r in graph.longest_chain(edges).collect()] == [("r", 1)]
    assert [tuple(r) for r in graph.simple_cycles(edges).collect()] == [("r", "a > b", 2)]
