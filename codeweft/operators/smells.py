"""Code smells as one table, their causes, debt, a greedy fix plan and the tree of what leads to what."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeweft.operators.relations import call_edges

# Thresholds of the detectors, weights of severities, the detectors' order, and which smell worsens which.
THRESHOLDS = {
    "long_method_lines": 50, "long_method_cc": 10, "too_many_params": 5, "feature_envy_min_fan_out": 5, "feature_envy_ratio": 3.0,
    "deep_nesting_depth": 4, "deep_nesting_cc_heur": 0.18, "switch_smell_min_cc": 6, "switch_smell_max_loc": 40, "magic_number_min": 5,
    "god_module_fn_count": 20, "god_module_avg_cc": 7.0, "god_class_fn_count": 7, "god_class_avg_cc": 4.0, "lazy_class_max_fns": 2,
    "data_clump_param_min": 4, "data_clump_fn_count": 3, "shotgun_surgery_files": 8, "shotgun_surgery_utility_fan_in": 30, "long_chain_depth": 7,
}
SEVERITY = {"critical": 4, "high": 3, "medium": 2, "low": 1}
DETECTORS = (
    "long_method", "god_class", "god_module", "feature_envy", "shotgun_surgery", "dead_code", "too_many_params", "deep_nesting", "switch_smell", "lazy_class",
    "duplicate_code", "data_clumps", "magic_numbers", "circular_dependency", "long_call_chain",
)
# name: effort, layer, smells that it worsens
CAUSATION = {
    "god_class": (5.0, "module", ("long_method", "too_many_params", "feature_envy", "dead_code", "divergent_change", "deep_nesting", "duplicate_code", "switch_smell", "data_clumps", "magic_numbers")),
    "god_module": (5.0, "module", ("long_method", "too_many_params", "feature_envy", "dead_code", "large_module", "divergent_change", "deep_nesting", "duplicate_code", "switch_smell", "data_clumps")),
    "circular_dependency": (4.0, "architecture", ("feature_envy", "inappropriate_intimacy", "divergent_change")),
    "large_module": (3.0, "module", ("long_method", "dead_code", "divergent_change", "duplicate_code")),
    "long_call_chain": (3.0, "architecture", ("feature_envy", "inappropriate_intimacy")),
    "shotgun_surgery": (3.0, "module", ("feature_envy",)),
    "long_method": (2.0, "function", ("too_many_params", "deep_nesting", "switch_smell")),
    "divergent_change": (2.0, "module", ("feature_envy",)),
    "data_clumps": (2.0, "function", ("too_many_params",)),
    "deep_nesting": (2.0, "function", ("too_many_params",)),
    "duplicate_code": (2.0, "function", ()),
    "switch_smell": (2.0, "function", ()),
    "feature_envy": (2.0, "function", ()),
    "too_many_params": (1.0, "function", ()),
    "dead_code": (0.5, "function", ()),
    "inappropriate_intimacy": (2.0, "module", ()),
    "lazy_class": (1.0, "module", ()),
    "magic_numbers": (1.0, "function", ()),
    "primitive_obsession": (2.0, "function", ("too_many_params", "data_clumps")),
}
# Names and prefixes of entry points, and names and endings of what a runtime calls.
ENTRY_NAMES = (
    "main", "init", "run", "start", "stop", "shutdown", "close", "setUp", "tearDown", "setUpClass", "tearDownClass", "setUpModule", "tearDownModule", "runTest",
    "handler", "lambda_handler", "application", "wsgi_app", "create_app", "make_app", "configure", "bootstrap", "app_factory",
    "toString", "hashCode", "equals", "compareTo", "compare", "clone", "finalize", "execute", "call",
    "render", "componentDidMount", "componentWillUnmount", "componentDidUpdate", "shouldComponentUpdate", "getDerivedStateFromProps", "getSnapshotBeforeUpdate",
    "mounted", "created", "destroyed", "updated", "beforeMount", "beforeCreate", "beforeDestroy", "beforeUpdate",
    "ngOnInit", "ngOnDestroy", "ngOnChanges", "ngAfterViewInit", "ngAfterContentInit", "ngDoCheck",
    "get", "post", "put", "patch", "delete", "head", "options", "ServeHTTP", "String", "Error", "new", "default", "fmt", "from", "into", "drop",
)
ENTRY_PREFIX = (
    "test_", "Test", "spec_", "it_", "should_", "given_", "when_", "then_", "on_", "On", "handle_", "Handle", "before_", "after_", "pre_", "post_",
    "middleware_", "fixture_", "plugin_", "register_", "setup_", "init_", "dispatch_", "emit_", "notify_", "receive_", "visit_",
)
RUNTIME_SUFFIX = (
    "Handler", "handler", "Callback", "callback", "Listener", "listener", "Hook", "hook", "Action", "action", "Event", "event", "Trigger", "trigger", "Observer", "observer",
    "Middleware", "middleware", "Interceptor", "interceptor", "Decorator", "decorator", "Wrapper", "wrapper", "Resolver", "resolver", "Plugin", "plugin",
)
RUNTIME_NAMES = (
    "onClick", "onChange", "onSubmit", "onLoad", "onError", "onSuccess", "onFailure", "onComplete", "onDone", "onReady", "onKeyUp", "onKeyDown", "onMouseOver",
    "onMouseOut", "onFocus", "onBlur", "onScroll", "onResize",
)


def is_entry(name: F.Column) -> F.Column:
    """Names of entry points: fixed ones, any with two underscores around, and those with a prefix of tests or hooks."""
    return name.isin(*ENTRY_NAMES) | name.rlike(r"\A__(?s:.*)__\z|\A___?\z") | name.rlike(rf"\A(?:{'|'.join(ENTRY_PREFIX)})")


def is_runtime(name: F.Column) -> F.Column:
    return name.isin(*RUNTIME_NAMES) | name.rlike(rf"(?:{'|'.join(RUNTIME_SUFFIX)})\z")


def is_private(name: F.Column, language: F.Column) -> F.Column:
    """A private name by the rule of its language; unknown languages go by one underscore."""
    script = name.startswith("_") | name.startswith("#")
    python = name.startswith("_") & ~name.rlike(r"\A__(?s:.*)__\z|\A___?\z")
    return F.when(language == "python", python).when(language.isin("javascript", "typescript"), script).otherwise(name.startswith("_"))


def is_dead(rows: DataFrame, fan_in: F.Column) -> F.Column:
    name = F.col("name")
    dead = (fan_in == 0) & ~is_entry(name) & ~name.rlike(r"\Aanonymous_[0-9]+\z") & ~is_runtime(name) & is_private(name, F.col("language"))
    return dead & ~F.coalesce("is_abstract", F.lit(False)) if "is_abstract" in rows.columns else dead


def dead_code(fns: DataFrame, fan: DataFrame) -> DataFrame:
    """(repo, file, name, line_start, is_dead, confidence): uncalled private functions that no runtime calls.

    ``fan`` holds the calls of each function row. Abstract functions, where a column ``is_abstract`` says so, are not dead.
    """
    key = ["repo", "file", "name", "line_start"]
    rows = fns.join(fan.select(*key, F.col("fan_in").alias("__in")).distinct(), key)
    dead = is_dead(rows, F.col("__in"))
    return rows.select(*key, dead.alias("is_dead"), F.when(dead, "high").otherwise("none").alias("confidence"))


def _first_of(cond_values, other: str | None = None) -> F.Column:
    out = F
    for cond, value in cond_values:
        out = out.when(cond, value)
    return out if other is None else out.otherwise(other)


def function_smells(fan: DataFrame, t: dict) -> DataFrame:
    """Smells of single functions, in one pass: each row's findings come as an array that is inlined."""
    c = F.col
    key = ["repo", "file", "name", "line_start"]
    cc, params, deep, out_, in_ = c("complexity"), c("param_count"), c("max_nesting_depth"), c("fan_out"), c("fan_in")
    n, least = c("lines"), F.greatest(c("lines"), F.lit(1))
    ratio = out_ / F.greatest(in_, F.lit(1))
    dense = (deep == 0) & (least > 5) & (cc > 6) & (cc / least >= t["deep_nesting_cc_heur"])
    found = {
        "long_method": F.when((n > t["long_method_lines"]) | (cc > t["long_method_cc"]), _first_of([((n > 200) | (cc > 25), "critical"), ((n > 80) | (cc > 15), "high")], "medium")),
        "feature_envy": F.when((out_ >= t["feature_envy_min_fan_out"]) & (ratio >= t["feature_envy_ratio"]), _first_of([((ratio >= 6) | (out_ >= 12), "high")], "medium")),
        "dead_code": F.when(is_dead(fan, in_), "high"),
        "too_many_params": F.when(params > t["too_many_params"], _first_of([(params >= 9, "high")], "medium")),
        "deep_nesting": _first_of([(deep >= F.greatest(F.lit(7), F.lit(t["deep_nesting_depth"])), "critical"), (deep >= F.greatest(F.lit(5), F.lit(t["deep_nesting_depth"])), "high"), (deep >= t["deep_nesting_depth"], "medium"), (dense & (cc / least >= 0.30), "high"), (dense, "medium")]),
        "switch_smell": F.when((cc >= t["switch_smell_min_cc"]) & (least <= t["switch_smell_max_loc"]), _first_of([(cc >= 12, "high")], "medium")),
        "magic_numbers": F.when(c("literal_count") >= t["magic_number_min"], _first_of([(c("literal_count") >= 10, "high")], "medium")),
    }
    every = F.array(*[F.struct(F.lit(k).alias("smell"), v.alias("severity")) for k, v in found.items()])
    rows = fan.select(*key, F.filter(every, lambda x: x["severity"].isNotNull()).alias("x")).select(*key, F.inline("x"))
    return rows.select("repo", "smell", "file", "name", "line_start", "severity")


def module_smells(fns: DataFrame, t: dict) -> DataFrame:
    """god_class, god_module, data_clumps and lazy_class. Buckets are modules (files without one), lazy classes virtual modules.

    A bucket of one virtual module that is not its own is a class. A module with modules below it is named as its root files.
    """
    c = F.col
    mod = F.when(c("module") != "", c("module")).otherwise(c("file"))
    base = fns.withColumn("mod", mod).withColumn("at", F.struct("file", "line_start", "name")).withColumn("vm", F.coalesce("virtual_module", F.lit("")))
    clump = c("param_count") >= t["data_clump_param_min"]
    per = base.groupBy("repo", "mod").agg(
        F.count("*").alias("k"), F.avg("complexity").alias("a"), F.min_by("file", "at").alias("file"), F.min("vm").alias("vm"), F.max("vm").alias("vm2"),
        F.count_if(clump).alias("clumps"), F.avg(F.when(clump, c("param_count"))).alias("params"),
        F.min_by(F.when(clump, c("file")), F.when(clump, F.struct(-c("param_count"), c("at")))).alias("worst"),
    )
    parts = F.split("mod", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    parents = per.where(F.size(parts) > 1).select("repo", F.explode(above).alias("mod")).distinct().withColumn("nested", F.lit(True))
    per = per.join(parents, ["repo", "mod"], "left")
    one = (c("vm") == c("vm2")) & (c("vm") != "") & (c("vm") != c("mod"))
    god = F.when(one, (c("k") >= t["god_class_fn_count"]) | (c("a") >= t["god_class_avg_cc"])).otherwise((c("k") >= t["god_module_fn_count"]) | (c("a") >= t["god_module_avg_cc"]))
    severity = _first_of([((c("k") > 60) | (c("a") > 15), "critical"), ((c("k") > 20) | (c("a") > 10), "high")], "medium")
    name = F.when(one, c("vm")).when(c("nested"), F.concat("mod", F.lit(" (root files)"))).otherwise(c("mod"))
    none = F.lit(None).cast("int").alias("line_start")
    gods = per.where(god).select("repo", F.when(one, "god_class").otherwise("god_module").alias("smell"), "file", name.alias("name"), none, severity.alias("severity"))
    clumps = per.where(c("clumps") >= t["data_clump_fn_count"])
    clumps = clumps.select("repo", F.lit("data_clumps").alias("smell"), c("worst").alias("file"), F.format_string("%s (%d functions)", "mod", "clumps").alias("name"), none, F.when((c("params") >= 7) | (c("clumps") >= 5), "high").otherwise("medium").alias("severity"))
    lazy = base.where((c("vm") != "") & (c("vm") != c("mod")) & (c("vm") != c("file"))).groupBy("repo", "vm").agg(F.count("*").alias("k"), F.max("lines").alias("most"), F.min_by("file", "at").alias("file"))
    lazy = lazy.where((c("k") <= t["lazy_class_max_fns"]) & (c("most") > 3)).select("repo", F.lit("lazy_class").alias("smell"), "file", c("vm").alias("name"), none, F.lit("low").alias("severity"))
    return gods.unionByName(clumps).unionByName(lazy)


def shotgun_surgery(fns: DataFrame, fan: DataFrame, t: dict) -> DataFrame:
    """Names called from many files; of those with several definitions the last one counts."""
    c = F.col
    files = call_edges(fns).groupBy("repo", c("dst").alias("name")).agg(F.countDistinct("file").alias("files")).where(c("files") >= t["shotgun_surgery_files"])
    at = F.struct("file", "line_start")
    last = fan.groupBy("repo", "name").agg(F.max_by("file", at).alias("file"), F.max_by("line_start", at).alias("line_start"), F.max_by("fan_in", at).alias("fan_in"))
    rows = files.join(last, ["repo", "name"]).where(c("fan_in") <= t["shotgun_surgery_utility_fan_in"])
    return rows.select("repo", F.lit("shotgun_surgery").alias("smell"), "file", "name", "line_start", F.when(c("files") >= 20, "critical").otherwise("high").alias("severity"))


def circular_dependency(cycles: DataFrame, fns: DataFrame, most: int = 5) -> DataFrame:
    """A finding for each of a project's first ``most`` cycles, the shortest first, then by names.

    ``cycles`` is (repo, nodes, length); the closing node stands in the name and counts in the severity. The file is that
    of the last definition of the first node.
    """
    w = Window.partitionBy("repo").orderBy("length", "nodes")
    top = cycles.withColumn("r", F.row_number().over(w)).where(F.col("r") <= most)
    first = F.split_part("nodes", F.lit(" > "), F.lit(1))
    at = F.struct("file", "line_start")
    last = fns.groupBy("repo", "name").agg(F.max_by("file", at).alias("file"))
    rows = top.withColumn("name", first).join(last, ["repo", "name"])
    chain = F.substring(F.concat_ws(" → ", F.replace("nodes", F.lit(" > "), F.lit(" → ")), "name"), 1, 70)
    severity = F.when(F.col("length") + 1 <= 3, "critical").otherwise("high")
    return rows.select("repo", F.lit("circular_dependency").alias("smell"), "file", chain.alias("name"), F.lit(None).cast("int").alias("line_start"), severity.alias("severity"))


def long_call_chain(depths: DataFrame, t: dict) -> DataFrame:
    """A finding for each project (repo, depth) whose call chains are deep."""
    d = F.col("depth")
    severity = _first_of([(d >= 15, "critical"), (d >= 10, "high")], "medium")
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    return depths.where(d >= t["long_chain_depth"]).select("repo", F.lit("long_call_chain").alias("smell"), none("string", "file"), F.format_string("depth=%d", d).alias("name"), none("int", "line_start"), severity.alias("severity"))


def detect(fns: DataFrame, fan: DataFrame, cycles: DataFrame | None = None, depths: DataFrame | None = None, thresholds: dict | None = None) -> DataFrame:
    """(repo, smell, file, name, line_start, severity) of all detectors; module, chain and cycle findings have no line.

    ``fan`` has the function rows with fan_in and fan_out; ``cycles`` and ``depths`` feed the two detectors on call chains. The duplicate detector finds nothing by definition.
    """
    t = THRESHOLDS | (thresholds or {})
    out = [function_smells(fan, t), module_smells(fan, t), shotgun_surgery(fns, fan, t)]
    if cycles is not None:
        out.append(circular_dependency(cycles, fns))
    if depths is not None:
        out.append(long_call_chain(depths, t))
    return reduce(DataFrame.unionByName, out)


def causation_paths() -> list[tuple[str, str, list[str]]]:
    """(smell, what it leads to, the smells between) of every way through CAUSATION, which has no cycles."""
    out, todo = [], [(k, k, []) for k in CAUSATION]
    while todo:
        start, at, via = todo.pop()
        for x in CAUSATION[at][2]:
            out.append((start, x, via))
            todo.append((start, x, [*via, x]))
    return out


def catalog(spark) -> DataFrame:
    """(smell, effort, layer, detector): the fixed table of smell types."""
    order = {k: n for n, k in enumerate(DETECTORS)}
    return spark.createDataFrame([(k, v[0], v[1], order.get(k)) for k, v in CAUSATION.items()], "smell string, effort double, layer string, detector int")


def weights(spark) -> DataFrame:
    return spark.createDataFrame([*SEVERITY.items()], "severity string, weight int")


def reached(smells: DataFrame) -> DataFrame:
    """(repo, smell, leads_to): detected types that a detected type leads to by way of detected types only."""
    paths = smells.sparkSession.createDataFrame(causation_paths(), "smell string, leads_to string, via array<string>")
    found = smells.groupBy("repo").agg(F.collect_set("smell").alias("found"))  # at most the fixed types
    rows = found.select("repo", "found", F.explode("found").alias("smell")).join(F.broadcast(paths), "smell")
    return rows.where(F.array_contains("found", F.col("leads_to")) & (F.size(F.array_except("via", "found")) == 0)).select("repo", "smell", "leads_to").distinct()


def scores(smells: DataFrame) -> DataFrame:
    """(repo, smell, severity, instances, downstream, score, gain): the root-cause score of each instance of a kind.

    An instance's score is its weight and that of all instances it leads to; all instances of one type and severity in a
    project have the same, so no graph of instances is built.
    """
    spark = smells.sparkSession
    w = smells.join(F.broadcast(weights(spark)), "severity").groupBy("repo", "smell", "severity", "weight").agg(F.count("*").alias("instances"))
    per = w.groupBy("repo", F.col("smell").alias("leads_to")).agg(F.sum(F.col("weight") * F.col("instances")).alias("w"), F.sum("instances").alias("k"))
    down = reached(smells).join(per, ["repo", "leads_to"]).groupBy("repo", "smell").agg(F.sum("w").alias("reach"), F.sum("k").alias("downstream"))
    out = w.join(down, ["repo", "smell"], "left").na.fill(0, ["reach", "downstream"]).join(F.broadcast(catalog(spark)), "smell")
    out = out.withColumn("score", F.col("weight") + F.col("reach"))
    return out.select("repo", "smell", "severity", "instances", "downstream", "score", (F.col("score") / F.greatest("effort", F.lit(0.5))).alias("gain"))


def root_causes(smells: DataFrame, top: int = 6) -> DataFrame:
    """(repo, rank, smell, severity, file, name, score): a project's ``top`` instances by score, then in detectors' order."""
    order = F.broadcast(catalog(smells.sparkSession).select("smell", "detector"))
    rows = smells.join(scores(smells).select("repo", "smell", "severity", "score"), ["repo", "smell", "severity"]).join(order, "smell")
    w = Window.partitionBy("repo").orderBy(F.desc("score"), "detector", "file", "line_start", "name")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).select("repo", "rank", "smell", "severity", "file", "name", "score")


def debt(smells: DataFrame) -> DataFrame:
    """(repo, findings, debt, days_x10): sum of weight times effort; days of 24 points, in tenths, rounded half up."""
    spark = smells.sparkSession
    j = smells.join(F.broadcast(weights(spark)), "severity").join(F.broadcast(catalog(spark)), "smell")
    out = j.groupBy("repo").agg(F.count("*").alias("findings"), F.sum(F.col("weight") * F.col("effort")).alias("debt"))
    return out.withColumn("days_x10", F.floor(F.col("debt") / 24 * 10 + 0.5))


PLAN = "repo string, step int, smell string, severity string, file string, name string, resolves long, effort int, roi double, score long"


def fix_plan(smells: DataFrame, steps: int = 10) -> DataFrame:
    """PLAN rows: greedily the instance with the most gain; it and all it leads to count as resolved. Ranked by ROI at last.

    Only the first ``steps`` instances of a type can be picked, so a project's state is those and its counts: at most
    ``steps`` rows for each of the fixed types. Ties go in the order of detectors, files and lines.
    """
    spark = smells.sparkSession
    sized = scores(smells)
    order = F.broadcast(catalog(spark).select("smell", "detector", "effort"))
    rows = smells.join(sized.select("repo", "smell", "severity", "score", "gain"), ["repo", "smell", "severity"]).join(order, "smell")
    w = Window.partitionBy("repo", "smell").orderBy(F.desc("gain"), "file", "line_start", "name")
    rows = rows.withColumn("r", F.row_number().over(w)).where(F.col("r") <= steps)
    counts = sized.groupBy("repo", "smell").agg(F.sum("instances").alias("k"))
    leads = reached(smells).groupBy("repo", "smell").agg(F.array_sort(F.collect_list("leads_to")).alias("leads"))
    rows = rows.join(counts, ["repo", "smell"]).join(leads, ["repo", "smell"], "left")

    def plan(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: (r["detector"] is None, r["detector"], r["r"]))
        size = {r["smell"]: r["k"] for r in rows}
        gone: set[str] = set()
        picked: dict[str, int] = {}
        out = []
        while len(out) < steps:
            left = [r for r in rows if r["smell"] not in gone and r["r"] > picked.get(r["smell"], 0)]
            if not left:
                break
            best = max(left, key=lambda r: r["gain"])
            leads = [x for x in (best["leads"] if best["leads"] is not None else ()) if x not in gone]
            resolves = 1 + sum(size[x] - picked.get(x, 0) for x in leads)
            effort = max(1, min(5, round(best["effort"])))
            out.append((best["repo"], 0, best["smell"], best["severity"], best["file"], best["name"], resolves, effort, round(resolves / effort, 3), best["score"]))
            gone.update(leads)
            picked[best["smell"]] = best["r"]
        out.sort(key=lambda r: (-r[8], -SEVERITY[r[3]]))
        kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64()}
        columns = zip(*[(r[0], k + 1, *r[2:]) for k, r in enumerate(out)])
        return pa.table({name: pa.array(c, kinds[kind]) for (name, kind), c in zip(map(str.split, PLAN.split(", ")), columns)})

    needed = ("repo", "smell", "severity", "file", "name", "score", "gain", "detector", "effort", "r", "k", "leads")
    return rows.select(*needed).groupBy("repo").applyInArrow(plan, PLAN)


def fix_tree(smells: DataFrame) -> DataFrame:
    """(repo, path, depth, nodes): the trees from root types down, at most three deep; ``nodes`` is how many a path stands for.

    A root type is one that no other detected type leads to. A tree of instances would repeat every instance below each
    of its parents; a path of types with the product of their instances says the same.
    """
    spark = smells.sparkSession
    edges = F.broadcast(spark.createDataFrame([(k, x) for k, v in CAUSATION.items() for x in v[2]], "smell string, child string"))
    per = smells.groupBy("repo", "smell").agg(F.count("*").alias("k"))
    kids = per.select("repo", F.col("smell").alias("child"), F.col("k").alias("kk"))
    linked = per.join(edges, "smell").join(kids, ["repo", "child"])
    roots = per.join(linked.select("repo", F.col("child").alias("smell")).distinct(), ["repo", "smell"], "left_anti")
    level = roots.select("repo", F.col("smell").alias("path"), F.lit(1).alias("depth"), F.col("k").alias("nodes"), "smell")
    out = [level]
    for depth in (2, 3):
        level = level.join(edges, "smell").join(kids, ["repo", "child"])
        level = level.select("repo", F.concat_ws(" > ", "path", "child").alias("path"), F.lit(depth).alias("depth"), (F.col("nodes") * F.col("kk")).alias("nodes"), F.col("child").alias("smell"))
        out.append(level)
    return reduce(DataFrame.union, out).select("repo", "path", "depth", "nodes")
