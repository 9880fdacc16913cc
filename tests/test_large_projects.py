"""A project of more than 20 000 edges is walked in memory, with the results of a walk by hand."""

import random
from collections import Counter

import pytest

import __spark_entry__ as entry
from codeweft.operators import graph

N = 700


def _up() -> dict[str, set[str]]:
    """Names that call later ones at random, and a few on cycles that call into them."""
    rng = random.Random(5)
    up: dict[str, set[str]] = {}
    for k in range(21_000):
        a, b = sorted(rng.sample(range(N), 2))
        up.setdefault(f"n{a:04d}", set()).add(f"n{b:04d}")
    for a, b in ("ab", "bc", "ca", "cb", "cd"):
        up.setdefault(a, set()).add(b)
    up["d"] = {"n0000"}
    return up


UP = _up()


def _reached() -> dict[str, set[str]]:
    out = {}
    for v in UP:
        seen, todo = set(), [v]
        while todo:
            new = UP.get(todo.pop(), set()) - seen
            seen |= new
            todo += new
        out[v] = seen
    return out


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("large"))
    names = sorted(set(UP) | {y for x in UP.values() for y in x})
    rows = [(n, "r/f.py", "python", "r", "", k + 1, k + 2, 1, sorted(UP.get(n, ())), 0, 0, 0, "r") for k, n in enumerate(names)]
    kinds = "name string, file string, language string, module string, virtual_module string, line_start int, line_end int, complexity int, calls array<string>, param_count int, max_nesting_depth int, literal_count int, repo string"
    f = spark.createDataFrame(rows, kinds).selectExpr("*", "cast(null as string) as class_name", "cast(null as array<string>) as instantiates")
    f.write.parquet(f"{d}/parsed_functions.parquet")
    spark.createDataFrame([("r/f.py", "r", "python", "")], "path string, repo string, language string, content string").write.parquet(f"{d}/files.parquet")
    return d


@pytest.fixture
def run(spark, tables, monkeypatch):
    def rounds(edges):
        assert edges.isEmpty(), "a project went by rounds"

    monkeypatch.setattr(graph, "_rounds", rounds)
    return lambda name: entry.queries()[name](spark, tables).collect()


def test_risk_scores(run):
    assert sum(map(len, UP.values())) > 20_000
    got = {r.name: (r.direct, r.transitive, r.in_cycle) for r in run("risk_scores")}
    reached = _reached()
    assert got == {n: (len(UP.get(n, ())), len(reached.get(n, set()) - {n}), int(n in reached.get(n, ()))) for n in got} and len(got) >= N


def test_smells_all(run):
    rows = run("smells_all")
    depth: dict[str, int] = {}
    loop = {"a", "b", "c"}
    for v in [*sorted(UP, reverse=True)]:
        depth[v] = 0
    order = [*sorted((v for v in UP if v.startswith("n")), reverse=True), "d", "c", "b", "a"]
    for v in order:
        depth[v] = max((1 + depth.get(w, 0) for w in UP[v] if not {v, w} <= loop), default=0)
    assert [r.name for r in rows if r.smell == "long_call_chain"] == [f"depth={min(40, max(depth.values()))}"]
    assert sorted(r.name for r in rows if r.smell == "circular_dependency") == ["a → b → c → a", "b → c → b"]


def test_effective_fields(spark, run, tables):
    n = 210
    rows = [(f"c{k:03d}", "r/f.py", "python", "class", [f"c{j:03d}" for j in range(k)], [], [("x", "c000", False)] if not k else [], [], k + 1, "r") for k in range(n)]
    kinds = "name string, file string, language string, kind string, bases array<string>, interfaces array<string>, fields array<struct<name string, type string, is_collection boolean>>, method_names array<string>, line_start int, repo string"
    spark.createDataFrame(rows, kinds).write.mode("overwrite").parquet(f"{tables}/parsed_classes.parquet")
    assert n * (n - 1) // 2 > 20_000
    assert {(r.owner, r.field, r.origin) for r in run("effective_fields")} == {(f"c{k:03d}", "x", "c000") for k in range(n)}


def test_scc_members(run):
    assert {(r.name, r.component, r["size"]) for r in run("scc_members")} == {(v, "a", 3) for v in "abc"}


def test_max_chain_depth(run):
    depth: dict[str, int] = {}
    for v in [*sorted((v for v in UP if v.startswith("n")), reverse=True), "d", "c", "b", "a"]:
        depth[v] = max((1 + depth.get(w, 0) for w in UP[v] if not {v, w} <= {"a", "b", "c"}), default=0)
    assert [(r.repo, r.depth) for r in run("max_chain_depth")] == [("r", min(40, max(depth.values())))]


def test_simple_cycles_le6(run):
    assert {(r.nodes, r.length) for r in run("simple_cycles_le6")} == {("a > b > c", 3), ("b > c", 2)}


def test_transitive_closure(run):
    rows = [(r.src, r.dst) for r in run("transitive_closure")]
    want = {(v, w) for v, x in _reached().items() for w in x}
    assert set(rows) == want and len(rows) == len(want)


def test_risk_top50(run):
    every = [r for r in run("risk_scores") if r.direct > 0]
    best = sorted(every, key=lambda r: (-r.score, -r.transitive, r.repo, r.file, r.name, r.line_start))[:50]
    assert [(r.name, r.score) for r in run("risk_top50")] == [(r.name, r.score) for r in best]


def test_risk_histogram(run):
    assert {r.level: r.functions for r in run("risk_histogram")} == Counter(r.level for r in run("risk_scores"))


def test_risk_warnings(run):
    got = {r.name: r.warning for r in run("risk_warnings")}
    assert set(got) == {r.name for r in run("risk_scores") if r.level == "high"}
    assert got["a"] == f"1 direct; {len(_reached()['a'] - {'a'})} transitive; on a cycle"


def test_smell_summary(run):
    assert {(r.smell, r.severity): r.findings for r in run("smell_summary")} == Counter((r.smell, r.severity) for r in run("smells_all"))


def test_file_ranking(run):
    weight = {"critical": 4, "high": 3, "medium": 2, "low": 1}
    want: Counter[str] = Counter()
    for r in run("smells_all"):
        want[r.file or "(unknown)"] += weight[r.severity]
    assert {r.file: r.weight for r in run("file_ranking")} == want and "(unknown)" in want


def test_worst_severity(run):
    worst = {r.name: r.worst for r in run("worst_severity")}
    assert worst["a → b → c → a"] == "high" and worst["b → c → b"] == "critical"


def test_smells_by_layer(run):
    assert {r.layer: r.findings for r in run("smells_by_layer")}["architecture"] == 3


def test_debt_score(run):
    (r,) = run("debt_score")
    assert r.findings == len(run("smells_all")) and r.debt > 0


def test_smell_scores(run):
    assert {(r.smell, r.severity): r.instances for r in run("smell_scores")} == Counter((r.smell, r.severity) for r in run("smells_all"))


def test_smell_root_causes(run):
    rows = run("smell_root_causes")
    assert [r.rank for r in rows] == [*range(1, 7)] and rows[0].score == max(r.score for r in run("smell_scores"))


def test_smell_fix_tree(run):
    assert {r.path: r.nodes for r in run("smell_fix_tree") if r.depth == 1}["circular_dependency"] == 2


def test_fix_plan(run):
    rows = run("fix_plan")
    assert [r.step for r in rows] == [*range(1, len(rows) + 1)] and {r.smell for r in rows} & {"circular_dependency", "long_call_chain"}


def test_fallback_plan(run):
    rows, plan = run("fallback_plan"), run("fix_plan")
    assert [(r.step, r.smell, r.name) for r in rows] == [(r.step, r.smell, r.name) for r in plan if r.step <= 6] and all(r.label for r in rows)
