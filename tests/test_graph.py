import random

import pyarrow as pa
import pytest

from codeweft.operators import graph


@pytest.mark.parametrize("small", [0, 20_000])  # by rounds of joins, and by project
def test_closure_components_and_cycles_match_brute_force(spark, monkeypatch, small):
    monkeypatch.setattr(graph, "SMALL", small)
    rng = random.Random(3)
    edges = sorted({("r", f"n{rng.randrange(14):02d}", f"n{rng.randrange(14):02d}") for _ in range(24)})
    edges = [e for e in edges if e[1] != e[2]]
    df = spark.createDataFrame(edges, "repo string, src string, dst string")
    up = {}
    for _, a, b in edges:
        up.setdefault(a, set()).add(b)
    reach = {}
    for v in up:
        seen, todo = {}, [(v, 0)]
        for x, d in todo:
            for y in up.get(x, ()):
                if y not in seen:
                    seen[y] = d + 1
                    todo.append((y, d + 1))
        reach[v] = seen
    closed = graph.closure(df).cache()
    assert {(r.src, r.dst): r.depth for r in closed.collect()} == {(a, b): d for a, s in reach.items() for b, d in s.items()}
    comp = {r.name: r["size"] for r in graph.components(closed).collect()}
    assert comp == {v: sum(1 for x in reach[v] if v in reach.get(x, ())) for v in reach if v in reach[v]}
    cycles = set()

    def walk(path):
        for y in up.get(path[-1], ()):
            if y == path[0]:
                cycles.add(" > ".join(path))
            elif y > path[0] and y not in path and len(path) < 6:
                walk([*path, y])

    for v in up:
        walk([v])
    assert {r.nodes for r in graph.simple_cycles(df).collect()} == cycles
    few = sorted({r.nodes for r in graph.simple_cycles(df, first=1).collect()}, key=lambda c: (c.count(">"), c))
    assert few[:1] == sorted(cycles, key=lambda c: (c.count(">"), c))[:1] and set(few) <= cycles
    got = {r.name: r for r in graph.reach(df).collect()}
    assert {n: r.transitive for n, r in got.items()} == {v: len(set(s) - {v}) for v, s in reach.items()}
    assert {n: r["size"] for n, r in got.items() if r.component} == comp
    on = {v for v in reach if v in reach[v]}
    apart = {}
    for _, a, b in edges:
        if not (a in on and b in on and a in reach[b]):
            apart.setdefault(a, set()).add(b)

    def longest(v):
        return max((1 + longest(x) for x in apart.get(v, ())), default=0)

    assert graph.longest_chain(df).first().depth == max(longest(v) for v in apart)


def test_empty_graph(spark):
    df = spark.createDataFrame([], "repo string, src string, dst string")
    closed = graph.closure(df)
    assert closed.count() == graph.simple_cycles(df).count() == graph.reach(df).count() == graph.longest_chain(df).count() == 0


@pytest.mark.parametrize("towards", [False, True])  # a hub of many callees, and one of many callers
def test_cycles_of_a_hub_are_shared_by_tasks(towards):
    rng = random.Random(5)
    ends = [("a", f"n{k:02d}") for k in range(40)] + [(f"n{k:02d}", "a") for k in range(12)]
    ends += sorted({(f"n{x:02d}", f"n{y:02d}") for x, y in ((rng.randrange(40), rng.randrange(40)) for _ in range(50)) if x != y})
    src, dst = (pa.chunked_array([[e[k] for e in ends]]) for k in ((1, 0) if towards else (0, 1)))
    project = graph._Project(src, dst)

    def found(part, parts):
        return [n for b in graph._cycles_of(6, None)(project, "r", part, parts) for n in b["nodes"].to_pylist()]

    whole, shares = found(0, 1), [found(k, 4) for k in range(4)]
    assert len(whole) == len(set(whole)) and sorted(whole) == sorted(sum(shares, []))
    hub = [sum(n.startswith("a > ") for n in share) for share in shares]
    assert max(hub) < 0.6 * sum(hub) and sum(hub) > 50


def _shuffled(spark):
    """Rows that all stages so far have written to shuffles."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))


def test_tasks_that_share_cycles_get_no_other_edges(spark):
    n, off = 35, 20_000
    layers = [(f"{a}{x:02d}", f"{b}{y:02d}") for a, b in ("ab", "bc", "cd") for x in range(n) for y in range(n)] + [(f"d{x:02d}", f"a{x:02d}") for x in range(n)]
    ends = layers + [(f"x{k // 100:03d}", f"y{k % 100:02d}") for k in range(off)]
    df = spark.createDataFrame([("r", *e) for e in ends], "repo string, src string, dst string").cache()
    count, before = df.count(), _shuffled(spark)
    rows = [(r.repo, r.nodes, r.length) for r in graph.simple_cycles(df).collect()]
    want = {("r", f"a{x:02d} > b{y:02d} > c{z:02d} > d{x:02d}", 4) for x in range(n) for y in range(n) for z in range(n)}
    assert len(rows) == len(want) and set(rows) == want
    assert _shuffled(spark) - before < 1.5 * count
    df.unpersist()


@pytest.mark.parametrize("small", [0, 8, 20_000])  # by rounds of joins, by project once what is on no cycle is gone, and by project
def test_cycles_of_raw_calls(spark, monkeypatch, small):
    monkeypatch.setattr(graph, "SMALL", small)
    calls = [("a", "b"), ("b", "a"), ("b", "c"), ("c", "a")] * 2 + [("a", "a"), ("c", "log"), ("b", "log"), ("log", "log"), ("d", "a"), ("d", "print")]
    df = spark.createDataFrame([("r", *e) for e in calls] + [(None, "a", "b"), (None, "b", "a")], "repo string, src string, dst string")
    assert sorted((r.repo, r.nodes, r.length) for r in graph.simple_cycles(df).collect()) == [("r", "a > b", 2), ("r", "a > b > c", 3)]
