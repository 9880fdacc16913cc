import random

from pyspark.sql import functions as F

from codeweft.operators.hierarchy import Hierarchy, class_links, parent_name
from codeweft.plans.problems import p2_paths

CLASSES = "repo string, name string, bases array<string>, interfaces array<string>"


def brute(links):
    up = {}
    for a, b in links:
        up.setdefault(a, set()).add(b)
    far, cyc = {}, set()
    for v in up:
        dist, todo = {v: 0}, [v]
        for x in todo:
            for y in up.get(x, ()):
                if y == v:
                    cyc.add(v)
                if y not in dist:
                    dist[y] = dist[x] + 1
                    todo.append(y)
        far |= {(v, x): d for x, d in dist.items() if d}
    return far, cyc, {b for _, b in links} - set(up)


def check(spark, links):
    h = Hierarchy(spark.createDataFrame(links, "child long, parent long"))
    far, cyc, roots = brute(links)
    got = {(r.v, r["at"]): r.way.d for r in h.ancestors().collect() if r.v != r["at"]}
    assert got == far
    assert {(r.v, r["at"]): r.way.d for r in h.ancestors(only_roots=True).collect()} == {k: d for k, d in far.items() if k[1] in roots}
    assert {r.id for r in h.cycles().collect()} == cyc
    assert {r.id for r in h.roots().collect()} == roots


def test_random_graphs_chains_and_cycles(spark):
    rng = random.Random(5)
    links = [(a, a + 1) for a in range(40)]  # a long chain
    links += [(100 + k, 100 + (k + 1) % 7) for k in range(7)] + [(200, 200), (201, 200), (300, 301), (301, 300)]
    links += [(rng.randrange(400, 430), rng.randrange(400, 430)) for _ in range(45)]
    links += links[:5]
    links += [(500 + k, 500 + (k + 1) % 3) for k in range(3)] + [(600 + k, 500) for k in range(3)] + [(700, 600)]  # mostly without splitters
    check(spark, links)


def test_empty_and_null_links(spark):
    h = Hierarchy(spark.createDataFrame([(None, 1), (2, None)], "child long, parent long"))
    assert h.ancestors().count() == h.cycles().count() == h.roots().count() == 0


def test_paths_are_least(spark):
    h = Hierarchy(spark.createDataFrame([("d", "c"), ("d", "b"), ("c", "a"), ("b", "a")], "child string, parent string"), paths="")
    got = {(r.v, r["at"]): list(r.way.p) for r in h.ancestors().collect()}
    assert got["d", "a"] == ["b", "a"]


def test_parent_names_and_links(spark):
    entries = [" *core.Base[T] ", "crate::x::Base<A, b.C>", "Base", "\tBase ", "&Base"]
    df = spark.createDataFrame([(e,) for e in entries], "e string").select(parent_name(F.col("e")).alias("p"))
    assert {r.p for r in df.collect()} == {"Base"}
    rows = [("r", "A", ["B", None, "", "Nowhere"], None), ("r", "B", None, []), ("q", "B", None, None), ("r", None, ["B"], None), ("r", "A", ["B"], None), (None, "A", ["A"], None)]
    nodes, links = class_links(spark.createDataFrame(rows, CLASSES).withColumn("g", F.lit(1)))
    assert {(r.id.g, r.id.n) for r in nodes.collect()} == {("r", "A"), ("r", "B"), ("q", "B"), ("", "A")}
    assert {(r.child.n, r.parent.n) for r in links.collect()} == {("A", "B"), ("A", "A")}


def test_every_class_has_its_paths(spark, tmp_path):
    rows = [("r", "A", ["B"], None), ("r", "B", ["C"], None), ("r", "C", None, None), ("r", "Alone", None, None), ("r", "X", ["Y"], None), ("r", "Y", ["X"], None), ("r", "Z", ["X"], None)]
    spark.createDataFrame(rows, CLASSES).write.parquet(str(tmp_path / "parsed_classes.parquet"))
    got = {(r.name, r.root, r.depth, r.path) for r in p2_paths(spark, str(tmp_path)).collect()}
    assert got == {("A", "C", 2, "C > B > A"), ("B", "C", 1, "C > B"), ("C", "C", 0, "C"), ("Alone", "Alone", 0, "Alone"),
                   ("X", "", -1, "X > Y > X"), ("Y", "", -1, "Y > X > Y"), ("Z", "", -1, "X > Z")}
