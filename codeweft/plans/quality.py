"""Queries of smells, layers, text metrics, classes, rules, history and sessions, and the SQL that each must equal."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweft.functions import text
from codeweft.operators import architecture, classes, graph, halstead, history, imports, layers, rules, smells
from codeweft.operators.relations import functions, name_graph, once
from codeweft.plans.code import COMMITS
from codeweft.plans.code import ORACLE as ORACLES_CODE
from codeweft.plans.graphs import BASE, RESCUE, RESOLVED
from codeweft.session import cut, table


def fns(spark: SparkSession, d: str) -> DataFrame:
    return functions(table(spark, d, "parsed_functions"))


def _files(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "files").select("repo", "path", "language", "content").distinct()


def _fan(spark: SparkSession, d: str) -> DataFrame:
    return graph.rescued(graph.fan(fns(spark, d)), _files(spark, d))


def _smells(spark: SparkSession, d: str) -> DataFrame:
    every = fns(spark, d)
    own = ["language", "module", "virtual_module", "lines", "complexity", "param_count", "max_nesting_depth", "literal_count", *(c for c in ("is_abstract",) if c in every.columns)]
    f = cut(every.select("repo", "file", "name", "line_start", "calls", *own))
    edges = cut(name_graph(f))
    return cut(smells.detect(f, cut(graph.rescued(graph.fan(f, *own), _files(spark, d))), graph.simple_cycles(edges, first=5), graph.longest_chain(edges)))


def dead_code(spark: SparkSession, d: str) -> DataFrame:
    return smells.dead_code(fns(spark, d), _fan(spark, d))


def dead_code_totals(spark: SparkSession, d: str) -> DataFrame:
    """A row a project: dead functions, files with unused imports, and unused imports."""
    dead = dead_code(spark, d).groupBy("repo").agg(F.count_if("is_dead").alias("dead"))
    loose = imports.unused(_files(spark, d)).groupBy(F.split("path", "/")[0].alias("repo")).agg(F.countDistinct("path").alias("files"), F.count("*").alias("unused"))
    return dead.join(loose, "repo", "full").na.fill(0)


def smell_summary(spark: SparkSession, d: str) -> DataFrame:
    return _smells(spark, d).groupBy("smell", "severity").agg(F.count("*").alias("findings"))


def smells_by_layer(spark: SparkSession, d: str) -> DataFrame:
    layer = smells.catalog(spark).select("smell", "layer")
    return _smells(spark, d).join(F.broadcast(layer), "smell").groupBy("repo", "layer").agg(F.count("*").alias("findings"))


def worst_severity(spark: SparkSession, d: str) -> DataFrame:
    """The worst severity of each name that findings have."""
    s = _smells(spark, d).join(F.broadcast(smells.weights(spark)), "severity")
    return s.groupBy("repo", "name").agg(F.max_by("severity", "weight").alias("worst"))


def file_ranking(spark: SparkSession, d: str) -> DataFrame:
    s = _smells(spark, d).join(F.broadcast(smells.weights(spark)), "severity")
    return s.groupBy(F.coalesce("file", F.lit("(unknown)")).alias("file")).agg(F.sum("weight").alias("weight"))


def loc_sloc(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("content")
    return _files(spark, d).select("path", text.loc(c).alias("loc"), text.sloc(c).alias("sloc")).distinct()


def text_metrics(spark: SparkSession, d: str) -> DataFrame:
    c = F.coalesce("content", F.lit(""))
    return _files(spark, d).select("path", text.complexity(c).alias("complexity"), text.nesting(c).alias("nesting")).distinct()


def file_strategies(spark: SparkSession, d: str) -> DataFrame:
    """How each file is taken: by its name, its lines and the functions that its text defines."""
    c = F.coalesce("content", F.lit(""))
    return _files(spark, d).select("path", text.file_strategy(F.col("path"), c, text.functions_named(c, F.col("language"))).alias("strategy")).distinct()


def render_strategies(spark: SparkSession, d: str) -> DataFrame:
    return fns(spark, d).groupBy("repo").agg(F.count("*").alias("nodes")).withColumn("strategy", text.render_strategy(F.col("nodes")))


def parameter_counts(spark: SparkSession, d: str) -> DataFrame:
    """Parameters of each function by its first line, and by its lines up to the first closing bracket."""
    at = fns(spark, d).select("repo", "file", "name", "line_start", F.col("language").alias("lang")).distinct()
    rows = at.join(_files(spark, d).groupBy(F.col("path").alias("file")).agg(F.max("content").alias("content")), "file")
    rows = rows.where((F.col("line_start") > 0) & (F.col("line_start") <= text.loc(F.col("content"))))
    one, more = (text.parameters(text.signature(F.col("content"), F.col("line_start"), n), F.col("lang")) for n in (1, 11))
    return rows.select("repo", "file", "name", "line_start", F.coalesce(one, F.lit(0)).alias("first_line"), more.alias("signature"))


def project_metrics(spark: SparkSession, d: str) -> DataFrame:
    """A row a project: sizes, averages and totals of its files and functions; orphans are uncalled, call nothing and are no entry points."""
    f = fns(spark, d)
    half_up = lambda c, n: F.floor(c * 10**n + 0.5) / 10**n
    per = f.groupBy("repo").agg(
        F.count("*").alias("functions"), F.sum(F.size("calls")).alias("calls"), half_up(F.avg("complexity"), 2).alias("avg_complexity"),
        F.max("complexity").alias("most_complex"), F.sum(F.greatest(F.col("complexity") - 1, F.lit(0))).alias("decisions"),
        half_up(F.round(F.avg("complexity"), 2) * 1.2 + F.avg("max_nesting_depth") * 0.5, 2).alias("cognitive"),
    )
    files = _files(spark, d).groupBy("repo").agg(F.countDistinct("path").alias("files"))
    alone = _fan(spark, d).where((F.col("fan_in") == 0) & (F.col("fan_out") == 0) & ~smells.is_entry(F.col("name")))
    return per.join(files, "repo").join(alone.groupBy("repo").agg(F.count("*").alias("orphans")), "repo", "left").na.fill(0, ["orphans"])


def layer_violations(spark: SparkSession, d: str) -> DataFrame:
    return layers.violations(table(spark, d, "file_imports"))


def layer_violations_by_module(spark: SparkSession, d: str) -> DataFrame:
    return layers.by_module(layer_violations(spark, d), once(table(spark, d, "parsed_functions")))


def layer_files(spark: SparkSession, d: str) -> DataFrame:
    return _files(spark, d).select("path", layers.file_layer(F.col("path")).alias("layer")).distinct()


def _graph(spark: SparkSession, d: str) -> classes.ClassGraph:
    return classes.ClassGraph(once(table(spark, d, "parsed_classes")), fns(spark, d))


def _rule_graph(spark: SparkSession, d: str) -> classes.ClassGraph:
    """The class graph with its relations written, as many rules read them."""
    g = _graph(spark, d)
    for name in ("classes", "inherits", "implements", "type_edges", "fields", "methods"):
        setattr(g, name, cut(getattr(g, name)))
    for name in ("ancestors", "effective_fields", "method_calls"):
        done = cut(getattr(g, name)())
        setattr(g, name, lambda done=done: done)
    return g


def design_patterns(spark: SparkSession, d: str) -> DataFrame:
    """Matches of all built-in specs, and idioms without confidence; the surest first is how they are shown."""
    found = rules.detect(_rule_graph(spark, d))
    text_of = lambda m: F.array_join(F.transform(F.map_entries(m), lambda e: F.concat_ws("=", e["key"], e["value"])), ", ")
    rows = found.select("repo", "pattern", "tier", "category", "confidence", text_of("bindings").alias("bindings"), F.coalesce("field", F.lit("")).alias("field"), F.concat_ws("; ", "place", F.array_join("evidence", "; ")).alias("evidence"))
    idioms = rules.singleton_idioms(_files(spark, d)).select(F.split("path", "/")[0].alias("repo"), F.lit("Singleton").alias("pattern"), F.lit("idiom").alias("tier"), F.lit("Creational").alias("category"), F.lit(None).cast("double").alias("confidence"), F.col("idiom").alias("bindings"), F.lit("").alias("field"), F.format_string("%s:%d", "path", "line").alias("evidence"))
    return rows.union(idioms)


def pattern_counts(spark: SparkSession, d: str) -> DataFrame:
    """Matches of each pattern in a project, with the best confidence."""
    return rules.detect(_rule_graph(spark, d)).groupBy("repo", "pattern").agg(F.count("*").alias("matches"), F.max("confidence").alias("best"))


def simple_patterns(spark: SparkSession, d: str) -> DataFrame:
    """The patterns of a single requirement that SQL can state: their projects and classes."""
    g = _rule_graph(spark, d)
    names = ("prototype_candidates", "builder_candidates", "memento_candidates", "facade_candidates", "mediator_candidates", "factory_candidates", "double_dispatch_candidates")
    return reduce(DataFrame.union, [rules.PREDICATES[n][0](g).select("repo", F.lit(n).alias("predicate"), F.col("binding").alias("class")) for n in names])


def architecture_patterns(spark: SparkSession, d: str) -> DataFrame:
    f = fns(spark, d)
    return architecture.detect(_files(spark, d), f, graph.file_calls(f))


def last_writer(spark: SparkSession, d: str) -> DataFrame:
    """Events as a trace with one variable for each user: errors write it, all else reads it."""
    e = table(spark, d, "events")
    writes = F.col("event_type") == "error"
    return history.last_writers(e.select(F.col("user_id").alias("run"), F.col("event_id").alias("ord"), F.lit("v").alias("var"), (~writes).alias("reads"), writes.alias("writes")))


def halstead_counts(spark: SparkSession, d: str) -> DataFrame:
    return halstead.halstead(_files(spark, d))


def maintainability(spark: SparkSession, d: str) -> DataFrame:
    m = halstead.measures(halstead_counts(spark, d))
    f = fns(spark, d).groupBy("repo").agg(F.avg("complexity").alias("cc"), F.count("*").alias("k"))
    sloc = _files(spark, d).groupBy("repo").agg(F.sum(text.sloc(F.col("content"))).alias("sloc"))
    per = m.join(f, "repo").join(sloc, "repo")
    return per.select("repo", "vocab", "volume", text.maintainability(F.col("volume"), F.col("cc"), F.col("sloc") / F.col("k")).alias("mi"))


def service_summary(spark: SparkSession, d: str) -> DataFrame:
    """Modules of a service's functions, blank ones left out, and its files, those without functions too."""
    mods = fns(spark, d).where(F.trim("module") != "").groupBy("repo", "service").agg(F.countDistinct(F.trim("module")).alias("modules"))
    per = table(spark, d, "files").where("service is not null").groupBy("repo", "service").agg(F.countDistinct("path").alias("files"))
    return per.join(mods, ["repo", "service"], "left").na.fill(0, ["modules"])


def sweep_windows(spark: SparkSession, d: str) -> DataFrame:
    w = F.window("ts", "30 minutes")
    return table(spark, d, "events").groupBy(w.alias("w")).agg(F.count("*").alias("events"), F.countDistinct("user_id").alias("users")).select(F.col("w.start").alias("start"), "events", "users")


def session_inactivity(spark: SparkSession, d: str) -> DataFrame:
    """Whole minutes from each user's last event to the last of all."""
    per = table(spark, d, "events").groupBy("user_id").agg(F.max(F.col("ts").cast("timestamp")).alias("last"))
    end = per.agg(F.max("last")).scalar()
    return per.select("user_id", F.floor((F.unix_micros(end) - F.unix_micros("last")) / 60_000_000).alias("minutes"))


def effective_fields(spark: SparkSession, d: str) -> DataFrame:
    return _graph(spark, d).effective_fields()


def git_backward_loc(spark: SparkSession, d: str) -> DataFrame:
    now = _files(spark, d).groupBy("repo").agg(F.sum(text.loc(F.col("content"))).cast("long").alias("loc"))
    return history.backward_loc(table(spark, d, "commits"), now)


def commit_estimates(spark: SparkSession, d: str) -> DataFrame:
    """Lines, functions and maintainability as of each commit, estimated from the project as it is."""
    files = _files(spark, d).groupBy("repo").agg(F.sum(text.sloc(F.col("content"))).cast("long").alias("sloc"), F.countDistinct("path").alias("files"))
    f = fns(spark, d).groupBy("repo").agg(F.count("*").alias("functions"), F.avg("complexity").alias("complexity"))
    volume = halstead.measures(halstead_counts(spark, d)).select("repo", "volume")
    return history.estimates(table(spark, d, "commits"), files.join(f, "repo").join(volume, "repo"))


def commit_days(spark: SparkSession, d: str) -> DataFrame:
    return once(table(spark, d, "commits")).select("hash", history.commit_date(F.col("date")).alias("day")).distinct()


def session_gaps(spark: SparkSession, d: str) -> DataFrame:
    s = history.sessions(table(spark, d, "events"), "user_id", "ts")
    return s.groupBy("user").agg(F.count("*").alias("sessions"), F.max("events").alias("most_events"))


QUERIES = {
    "smells_all": lambda s, d: _smells(s, d).na.fill("", ["file"]).na.fill(0, ["line_start"]),
    "smell_scores": lambda s, d: smells.scores(_smells(s, d)),
    "smell_root_causes": lambda s, d: smells.root_causes(_smells(s, d)),
    "smell_fix_tree": lambda s, d: smells.fix_tree(_smells(s, d)),
    "debt_score": lambda s, d: smells.debt(_smells(s, d)),
    "fix_plan": lambda s, d: smells.fix_plan(_smells(s, d)),
    "fallback_plan": lambda s, d: smells.fix_plan(_smells(s, d)).where("step <= 6").withColumn("label", text.effort_label(F.col("effort"))),
    "unique_method_resolution": lambda s, d: _graph(s, d).unique_methods(),
    "method_calls": lambda s, d: _graph(s, d).method_calls(),
    "structural_implements": lambda s, d: _graph(s, d).structural(),
    "git_churn": lambda s, d: history.churn(table(s, d, "commits")),
    "import_resolution_hint": lambda s, d: imports.resolve(table(s, d, "file_imports"), table(s, d, "files")),
    "import_extract": lambda s, d: imports.extract(_files(s, d)),
    "unused_imports": lambda s, d: imports.unused(_files(s, d)),
    "magic_literals": lambda s, d: _files(s, d).select("path", text.magic_literals(F.coalesce("content", F.lit(""))).alias("literals")).distinct(),
    **{f.__name__: f for f in (dead_code, dead_code_totals, smell_summary, smells_by_layer, worst_severity, file_ranking, loc_sloc, text_metrics, file_strategies, render_strategies, parameter_counts, project_metrics, layer_violations, layer_violations_by_module, layer_files, design_patterns, pattern_counts, simple_patterns, architecture_patterns, last_writer, halstead_counts, maintainability, service_summary, sweep_windows, session_inactivity, effective_fields, git_backward_loc, commit_estimates, commit_days, session_gaps)},
}

_ENTRY = (
    "name IN ('main', 'init', 'run', 'start', 'stop', 'shutdown', 'close', 'setUp', 'tearDown', 'setUpClass', 'tearDownClass', 'setUpModule', 'tearDownModule', 'runTest', "
    "'handler', 'lambda_handler', 'application', 'wsgi_app', 'create_app', 'make_app', 'configure', 'bootstrap', 'app_factory', "
    "'toString', 'hashCode', 'equals', 'compareTo', 'compare', 'clone', 'finalize', 'execute', 'call', "
    "'render', 'componentDidMount', 'componentWillUnmount', 'componentDidUpdate', 'shouldComponentUpdate', 'getDerivedStateFromProps', 'getSnapshotBeforeUpdate', "
    "'mounted', 'created', 'destroyed', 'updated', 'beforeMount', 'beforeCreate', 'beforeDestroy', 'beforeUpdate', "
    "'ngOnInit', 'ngOnDestroy', 'ngOnChanges', 'ngAfterViewInit', 'ngAfterContentInit', 'ngDoCheck', "
    "'get', 'post', 'put', 'patch', 'delete', 'head', 'options', 'ServeHTTP', 'String', 'Error', 'new', 'default', 'fmt', 'from', 'into', 'drop') "
    "OR (starts_with(name, '__') AND ends_with(name, '__')) "
    "OR regexp_matches(name, '^(test_|Test|spec_|it_|should_|given_|when_|then_|on_|On|handle_|Handle|before_|after_|pre_|post_|middleware_|fixture_|plugin_|register_|setup_|init_|dispatch_|emit_|notify_|receive_|visit_)')"
)
_RUNTIME = (
    "name IN ('onClick', 'onChange', 'onSubmit', 'onLoad', 'onError', 'onSuccess', 'onFailure', 'onComplete', 'onDone', 'onReady', 'onKeyUp', 'onKeyDown', 'onMouseOver', "
    "'onMouseOut', 'onFocus', 'onBlur', 'onScroll', 'onResize') "
    "OR regexp_matches(name, '([Hh]andler|[Cc]allback|[Ll]istener|[Hh]ook|[Aa]ction|[Ee]vent|[Tt]rigger|[Oo]bserver|[Mm]iddleware|[Ii]nterceptor|[Dd]ecorator|[Ww]rapper|[Rr]esolver|[Pp]lugin)$')"
)
FAN = RESCUE + f""",
dead AS (SELECT repo, file, name, line_start, fan_in = 0 AND NOT ({_ENTRY}) AND NOT regexp_matches(name, '^anonymous_[0-9]+$') AND NOT ({_RUNTIME})
  AND CASE WHEN language = 'python' THEN starts_with(name, '_') AND NOT (starts_with(name, '__') AND ends_with(name, '__'))
    WHEN language IN ('javascript', 'typescript') THEN starts_with(name, '_') OR starts_with(name, '#') ELSE starts_with(name, '_') END AS is_dead FROM fan)
"""
#: Cycles of at most 6 calls, and the longest chains of calls that are on no cycle; over the closure that BASE gives.
CHAINS = """,
r AS (SELECT repo, src, dst FROM e UNION SELECT r.repo, r.src, e.dst FROM r JOIN e ON e.repo = r.repo AND e.src = r.dst),
cyc AS (SELECT DISTINCT a.repo, a.src, a.dst FROM e a JOIN r b ON a.repo = b.repo AND a.src = b.dst AND a.dst = b.src),
wk AS (SELECT repo, [src, dst] AS p, dst AS at FROM cyc WHERE dst > src UNION ALL SELECT wk.repo, list_append(p, cyc.dst), cyc.dst FROM wk JOIN cyc ON cyc.repo = wk.repo AND cyc.src = wk.at WHERE cyc.dst > p[1] AND NOT list_contains(p, cyc.dst) AND len(p) < 6),
cy AS (SELECT wk.repo, p, len(p) AS n, row_number() OVER (PARTITION BY wk.repo ORDER BY len(p), array_to_string(p, ' > ')) AS rn FROM wk JOIN cyc ON cyc.repo = wk.repo AND cyc.src = wk.at AND cyc.dst = p[1]),
ac AS (SELECT * FROM e EXCEPT SELECT * FROM cyc),
ch AS (SELECT DISTINCT repo, dst AS at, 1 AS d FROM ac UNION SELECT ch.repo, ac.dst, ch.d + 1 FROM ch JOIN ac ON ac.repo = ch.repo AND ac.src = ch.at WHERE ch.d < 40),
dp AS (SELECT repo, max(d) AS depth FROM ch GROUP BY ALL)
"""
SMELLS = FAN + CHAINS + """,
bk AS (SELECT *, CASE WHEN module <> '' THEN module ELSE file END AS mod, coalesce(virtual_module, '') AS vm FROM fan),
per AS (SELECT repo, mod, count(*) AS k, avg(complexity) AS a, arg_min(file, (file, line_start, name)) AS file, min(vm) AS vm, max(vm) AS vm2, count(*) FILTER (param_count >= 4) AS cl, avg(param_count) FILTER (param_count >= 4) AS cp,
  arg_min(file, (-param_count, file, line_start, name)) FILTER (param_count >= 4) AS worst FROM bk GROUP BY ALL),
g AS (SELECT per.*, vm = vm2 AND vm <> '' AND vm <> mod AS one, EXISTS (SELECT 1 FROM per o WHERE o.repo = per.repo AND starts_with(o.mod, per.mod || '/')) AS nested FROM per),
lz AS (SELECT repo, vm, count(*) AS k, max(lines) AS most, arg_min(file, (file, line_start, name)) AS file FROM bk WHERE vm <> '' AND vm <> mod AND vm <> file GROUP BY ALL),
sh AS (SELECT repo, dst AS name, count(DISTINCT file) AS files FROM c GROUP BY ALL),
la AS (SELECT repo, name, max_by(file, (file, line_start)) AS file, max_by(line_start, (file, line_start)) AS line_start, max_by(fan_in, (file, line_start)) AS fan_in FROM fan GROUP BY ALL),
sm AS (
  SELECT repo, 'long_method' AS smell, file, name, line_start, CASE WHEN lines > 200 OR complexity > 25 THEN 'critical' WHEN lines > 80 OR complexity > 15 THEN 'high' ELSE 'medium' END AS severity FROM fan WHERE lines > 50 OR complexity > 10
  UNION ALL SELECT repo, 'too_many_params', file, name, line_start, CASE WHEN param_count >= 9 THEN 'high' ELSE 'medium' END FROM fan WHERE param_count > 5
  UNION ALL SELECT repo, 'switch_smell', file, name, line_start, CASE WHEN complexity >= 12 THEN 'high' ELSE 'medium' END FROM fan WHERE complexity >= 6 AND greatest(lines, 1) <= 40
  UNION ALL SELECT repo, 'magic_numbers', file, name, line_start, CASE WHEN literal_count >= 10 THEN 'high' ELSE 'medium' END FROM fan WHERE literal_count >= 5
  UNION ALL SELECT repo, 'feature_envy', file, name, line_start, CASE WHEN fan_out / greatest(fan_in, 1) >= 6 OR fan_out >= 12 THEN 'high' ELSE 'medium' END FROM fan WHERE fan_out >= 5 AND fan_out / greatest(fan_in, 1) >= 3
  UNION ALL SELECT repo, 'deep_nesting', file, name, line_start, CASE WHEN max_nesting_depth >= 7 THEN 'critical' WHEN max_nesting_depth >= 5 THEN 'high' WHEN max_nesting_depth >= 4 THEN 'medium' WHEN complexity / greatest(lines, 1) >= 0.30 THEN 'high' ELSE 'medium' END
    FROM fan WHERE max_nesting_depth >= 4 OR (max_nesting_depth = 0 AND greatest(lines, 1) > 5 AND complexity > 6 AND complexity / greatest(lines, 1) >= 0.18)
  UNION ALL SELECT repo, 'dead_code', file, name, line_start, 'high' FROM dead WHERE is_dead
  UNION ALL SELECT repo, CASE WHEN one THEN 'god_class' ELSE 'god_module' END, file, CASE WHEN one THEN vm WHEN nested THEN mod || ' (root files)' ELSE mod END, NULL, CASE WHEN k > 60 OR a > 15 THEN 'critical' WHEN k > 20 OR a > 10 THEN 'high' ELSE 'medium' END
    FROM g WHERE CASE WHEN one THEN k >= 7 OR a >= 4 ELSE k >= 20 OR a >= 7 END
  UNION ALL SELECT repo, 'data_clumps', worst, mod || ' (' || cl || ' functions)', NULL, CASE WHEN cp >= 7 OR cl >= 5 THEN 'high' ELSE 'medium' END FROM g WHERE cl >= 3
  UNION ALL SELECT repo, 'lazy_class', file, vm, NULL, 'low' FROM lz WHERE k <= 2 AND most > 3
  UNION ALL SELECT sh.repo, 'shotgun_surgery', la.file, sh.name, la.line_start, CASE WHEN files >= 20 THEN 'critical' ELSE 'high' END FROM sh JOIN la ON la.repo = sh.repo AND la.name = sh.name WHERE files >= 8 AND fan_in <= 30
  UNION ALL SELECT cy.repo, 'circular_dependency', la.file, left(array_to_string(list_append(p, p[1]), ' → '), 70), NULL, CASE WHEN n <= 2 THEN 'critical' ELSE 'high' END FROM cy JOIN la ON la.repo = cy.repo AND la.name = p[1] WHERE rn <= 5
  UNION ALL SELECT repo, 'long_call_chain', NULL, 'depth=' || depth, NULL, CASE WHEN depth >= 15 THEN 'critical' WHEN depth >= 10 THEN 'high' ELSE 'medium' END FROM dp WHERE depth >= 7),
wt(severity, weight) AS (VALUES ('critical', 4), ('high', 3), ('medium', 2), ('low', 1)),
ef(smell, effort, layer, detector) AS (VALUES ('god_class', 5.0, 'module', 1), ('god_module', 5.0, 'module', 2), ('circular_dependency', 4.0, 'architecture', 13), ('long_call_chain', 3.0, 'architecture', 14), ('shotgun_surgery', 3.0, 'module', 4),
  ('long_method', 2.0, 'function', 0), ('data_clumps', 2.0, 'function', 11), ('deep_nesting', 2.0, 'function', 7), ('switch_smell', 2.0, 'function', 8), ('feature_envy', 2.0, 'function', 3), ('too_many_params', 1.0, 'function', 6),
  ('dead_code', 0.5, 'function', 5), ('lazy_class', 1.0, 'module', 9), ('magic_numbers', 1.0, 'function', 12)),
ct(smell, child) AS (SELECT k, unnest(string_split(v, ' ')) FROM (VALUES ('god_class', 'long_method too_many_params feature_envy dead_code deep_nesting switch_smell data_clumps magic_numbers'),
  ('god_module', 'long_method too_many_params feature_envy dead_code deep_nesting switch_smell data_clumps'), ('circular_dependency', 'feature_envy'), ('long_call_chain', 'feature_envy'), ('shotgun_surgery', 'feature_envy'),
  ('long_method', 'too_many_params deep_nesting switch_smell'), ('data_clumps', 'too_many_params'), ('deep_nesting', 'too_many_params')) t(k, v)),
ty AS (SELECT repo, smell, count(*) AS k FROM sm GROUP BY ALL),
ed AS (SELECT a.repo, a.smell, b.smell AS child, b.k FROM ty a JOIN ct ON ct.smell = a.smell JOIN ty b ON b.repo = a.repo AND b.smell = ct.child),
rc AS (SELECT repo, smell, child FROM ed UNION SELECT rc.repo, rc.smell, ed.child FROM rc JOIN ed ON ed.repo = rc.repo AND ed.smell = rc.child),
sc AS (SELECT t.repo, t.smell, t.severity, t.instances, coalesce(d.downstream, 0) AS downstream, t.weight + coalesce(d.w, 0) AS score, (t.weight + coalesce(d.w, 0)) / greatest(effort, 0.5) AS gain
  FROM (SELECT repo, smell, sm.severity, weight, count(*) AS instances FROM sm JOIN wt ON wt.severity = sm.severity GROUP BY ALL) t JOIN ef ON ef.smell = t.smell
  LEFT JOIN (SELECT rc.repo, rc.smell, count(*) AS downstream, sum(weight) AS w FROM rc JOIN sm ON sm.repo = rc.repo AND sm.smell = rc.child JOIN wt ON wt.severity = sm.severity GROUP BY ALL) d ON d.repo = t.repo AND d.smell = t.smell)
"""
_FILES = "WITH p AS (SELECT DISTINCT path, coalesce(content, '') AS t FROM files), l AS (SELECT path, t, string_split(t, chr(10)) AS x FROM p) "
_AROUND = "'^[\\s\\p{Z}\\x0b\\x1c-\\x1f\\x{85}]+'"


def _q(p: str) -> str:
    return p.replace("'", "''")


_HALSTEAD = f"""
WITH p AS (SELECT DISTINCT repo, path, regexp_replace(coalesce(content, ''), '{_q(halstead.NOISE)}', ' ', 'g') AS t FROM files),
w AS (SELECT repo, path, w, count(*) AS k FROM (SELECT repo, path, unnest(regexp_extract_all(t, '{halstead.WORD}')) AS w FROM p) GROUP BY ALL),
m AS (SELECT repo, w, count(*) AS k FROM (SELECT repo, unnest(regexp_extract_all(t, '{halstead.MARKS}')) AS w FROM p) GROUP BY ALL),
kw AS (SELECT unnest({halstead.KEYWORDS!r}) AS w),
fi AS (SELECT repo, w, min(path) AS first FROM w WHERE w IN (SELECT w FROM kw) GROUP BY ALL),
o AS (SELECT repo, w, sum(k) AS k FROM w WHERE w IN (SELECT w FROM kw) GROUP BY ALL UNION ALL SELECT * FROM m),
i AS (SELECT w.repo, w.w, sum(k) AS k FROM w LEFT JOIN fi ON fi.repo = w.repo AND fi.w = w.w WHERE first IS NULL OR path < first GROUP BY ALL),
a AS (SELECT repo, count(*) AS n1, CAST(sum(k) AS BIGINT) AS total1 FROM o GROUP BY ALL),
b AS (SELECT repo, count(*) AS n2, CAST(sum(k) AS BIGINT) AS total2 FROM i GROUP BY ALL)
"""


_LAYERS = (
    ("router", "route|routes|router|routers|routing|routings"),
    ("controller", "controller|controllers|handler|handlers|api|view|views|presenter|presenters|endpoint|endpoints|resource|resources|rest|graphql|resolver|resolvers|action|actions|command|commands|request|requests|response|responses"),
    ("service", "service|services|usecase|usecases|use_case|use_cases|business|interactor|interactors|application|manager|managers|facade|facades|processor|processors|workflow|workflows|orchestrator|orchestrators"),
    ("repository", "repository|repositories|repo|repos|dao|daos|store|stores|storage|gateway|gateways|finder|finders"),
    ("model", "model|models|entity|entities|schema|schemas|dto|dtos|struct|structs|domain|aggregate|aggregates|valueobject|value_object"),
    ("database", "db|database|databases|migration|migrations|seed|seeds|connection|connections|orm|datasource|data_source|infrastructure|infra|persistence|adapter|adapters|query|queries"),
    ("middleware", "middleware|middlewares|interceptor|interceptors|guard|guards|filter|filters|hook|hooks|plugin|plugins|decorator|decorators"),
    ("utility", "util|utils|utility|utilities|helper|helpers|shared|common|lib|libs|constant|constants|config|configs|configuration|logger|logging|log|exception|exceptions|error|errors|validator|validators|validation|formatter|formatters|converter|converters|mapper|mappers|types|type"),
)
_EXACT = "CASE " + " ".join(f"WHEN regexp_matches(s, '^({w})$') THEN '{k}'" for k, w in _LAYERS) + " END"
_AFFIX = "CASE " + " ".join(f"WHEN regexp_matches({{0}}, '^({w})|({w})$') THEN '{k}'" for k, w in _LAYERS) + " END"
_PATH_LAYER = "coalesce(list_filter(list_transform(list_reverse(string_split(lower(path), '/')[:-2]), lambda s: " + _EXACT + "), lambda s: s IS NOT NULL)[1], " + _AFFIX.format("regexp_replace(lower(string_split(path, '/')[-1]), '(.)[.][^.]+$', '\\1')") + ", 'unknown')"
_RAW_LAYER = "coalesce(list_filter(list_transform(list_reverse(string_split_regex(regexp_replace(lower(raw), '[.](js|jsx|ts|tsx|py|java|go|rs|cs|cpp|c)$', ''), '[/.]')), lambda s: " + _AFFIX.format("s") + "), lambda s: s IS NOT NULL)[1], 'unknown')"
#: What breaks the order: the type and severity of each pair of layers that may not import one another.
_BROKEN = """SELECT a.l AS source_layer, b.l AS target_layer, CASE WHEN b.o < a.o THEN 'reverse_dependency' WHEN b.o = a.o THEN 'cross_layer' ELSE 'layer_skip' END AS type, CASE WHEN b.o = a.o THEN 'medium' ELSE 'high' END AS severity
  FROM (VALUES ('router', 0, 'controller middleware'), ('controller', 1, 'service'), ('middleware', 2, 'service'), ('service', 3, 'repository model service'), ('repository', 4, 'model database'), ('model', 5, ''), ('database', 5, '')) a(l, o, may)
  CROSS JOIN (VALUES ('controller', 1), ('middleware', 2), ('service', 3), ('repository', 4), ('model', 5), ('database', 5)) b(l, o) WHERE NOT list_contains(string_split(a.may, ' '), b.l)"""
_VIOLATIONS = "WITH i AS (SELECT DISTINCT path, raw FROM file_imports), j AS (SELECT path, raw, " + _PATH_LAYER + " AS source_layer, " + _RAW_LAYER + " AS target_layer FROM i), tr AS (" + _BROKEN + "), v AS (SELECT path, raw, source_layer, target_layer, type, severity FROM j JOIN tr USING (source_layer, target_layer)) "

_PARTS = """WITH RECURSIVE fl AS (SELECT DISTINCT repo, path, lower(replace(path, chr(92), '/')) AS p FROM files),
fx AS (SELECT *, regexp_matches(p, 'model|schema|entity') AS model, regexp_matches(p, 'view|template|page') AS vw, contains(p, 'controller') AS controller, contains(p, 'presenter') AS presenter, regexp_matches(p, 'service|repo') AS spare,
  CASE WHEN regexp_matches(p, 'controller|route|view|api|handler') THEN 0 WHEN regexp_matches(p, 'service|usecase|use_case|logic|manager') THEN 1 WHEN regexp_matches(p, 'repo|dao|database|db|store') THEN 2 END AS tier,
  CASE WHEN regexp_matches(p, 'entity|entities|domain|model') THEN 0 WHEN regexp_matches(p, 'usecase|use_case|interactor|application') THEN 1 WHEN regexp_matches(p, 'controller|presenter|gateway|interface|adapter') THEN 2 WHEN regexp_matches(p, 'framework|infra|db|web|external') THEN 3 END AS ring,
  regexp_matches(p, 'domain|core') AS dom, regexp_matches(p, 'port|interface') AS port, regexp_matches(p, 'adapter|infra') AS adapter, contains(p, 'repo') AS rp, contains(p, 'service') AS sv, regexp_extract(p, '([^/]*)$', 1) AS base FROM fl),
"""
_ARCHITECTURE = _PARTS + BASE.replace("WITH RECURSIVE", "") + """
lf AS (SELECT repo, name, max_by(file, (file, line_start)) AS file FROM f GROUP BY ALL),
ce AS (SELECT c.repo, c.file AS cf, lf.file AS tf, count(*) AS n FROM c JOIN lf ON lf.repo = c.repo AND lf.name = c.dst GROUP BY ALL),
h AS (SELECT repo, count(*) FILTER (model) AS models, count(*) FILTER (vw) AS views, count(*) FILTER (controller) AS controllers, count(*) FILTER (presenter) AS presenters, count(*) FILTER (spare) AS spares,
  count(DISTINCT tier) AS tiers, count(DISTINCT ring) AS rings, count(*) FILTER (dom) AS doms, count(*) FILTER (port) + count(*) FILTER (adapter) AS outer_, count(*) FILTER (rp) AS repos, count(*) FILTER (sv) AS svs FROM fx GROUP BY ALL),
x AS (SELECT ce.repo, ce.n, ce.cf <> ce.tf AS apart, a.vw AND (CASE WHEN h.models > 0 THEN b.model ELSE b.spare END) AS vm, a.tier AS t1, b.tier AS t2, a.ring AS r1, b.ring AS r2, a.dom AND (b.port OR b.adapter) AS dx
  FROM ce JOIN fx a ON a.path = ce.cf JOIN fx b ON b.path = ce.tf JOIN h ON h.repo = ce.repo),
y AS (SELECT repo, count(*) FILTER (apart AND vm) AS vm, count(*) FILTER (apart AND dx) AS dx, coalesce(sum(n) FILTER (t1 <> t2), 0) AS tc, coalesce(sum(n) FILTER (t1 > t2), 0) AS tv, coalesce(sum(n) FILTER (r1 <> r2), 0) AS rc, coalesce(sum(n) FILTER (r1 < r2), 0) AS rv FROM x GROUP BY ALL),
rb AS (SELECT DISTINCT repo, base FROM fx WHERE rp),
k1 AS (SELECT DISTINCT f.repo FROM f JOIN rb ON rb.repo = f.repo AND rb.base = regexp_extract(lower(f.file), '([^/]*)$', 1) WHERE regexp_matches(lower(f.name), 'find|save|update|delete|query|execute|fetch|insert|get|create')),
k2 AS (SELECT DISTINCT ce.repo FROM ce JOIN rb ON rb.repo = ce.repo AND rb.base = regexp_extract(lower(ce.tf), '([^/]*)$', 1) WHERE contains(lower(ce.cf), 'service')),
z AS (SELECT h.*, coalesce(vm, 0) AS vm, coalesce(dx, 0) AS dx, coalesce(tc, 0) AS tc, coalesce(tv, 0) AS tv, coalesce(rc, 0) AS rc, coalesce(rv, 0) AS rv, k1.repo IS NOT NULL AS crud, k2.repo IS NOT NULL AS called FROM h LEFT JOIN y ON y.repo = h.repo LEFT JOIN k1 ON k1.repo = h.repo LEFT JOIN k2 ON k2.repo = h.repo),
o AS (SELECT repo, CASE WHEN presenters > 0 AND controllers = 0 THEN 'MVP' ELSE 'MVC' END AS pattern, vm AS violations, (3 - vm) / 3.0 AS c FROM z WHERE (models > 0 OR spares > 0) AND views > 0 AND (controllers > 0 OR presenters > 0)
  UNION ALL SELECT repo, 'Layered/N-Tier', tv, greatest(0.4, 0.95 - 0.5 * CASE WHEN tc > 0 THEN tv / tc ELSE 0 END) FROM z WHERE tiers >= 2
  UNION ALL SELECT repo, 'Clean Architecture', rv, greatest(0.3, 0.95 - CASE WHEN rc > 0 THEN rv / rc ELSE 0 END) FROM z WHERE rings >= 3
  UNION ALL SELECT repo, 'Hexagonal Architecture', dx, greatest(0.4, 0.9 - 0.1 * dx) FROM z WHERE doms > 0 AND outer_ > 0
  UNION ALL SELECT repo, 'Repository Pattern', 0, (1 + CAST(crud AS INT) + CAST(called AS INT) + CAST(svs > 0 AS INT)) / 4.0 FROM z WHERE repos > 0)
SELECT repo, pattern, CAST(violations AS BIGINT) AS violations, CAST(floor(c * 100 + 0.5 + 1e-9) AS INT) AS confidence_pct FROM o WHERE floor(c * 100 + 0.5 + 1e-9) >= 55
"""

#: Classes by their last rows, methods with a body, known method names and whom calls mean.
_CLASSES = BASE + """
c0 AS (SELECT DISTINCT * EXCLUDE (ingested_at, parsed_at, session_id) FROM parsed_classes WHERE name IS NOT NULL),
cl AS (SELECT repo, name, arg_max(kind, (file, line_start, kind)) AS kind, arg_max(language, (file, line_start, kind)) AS language, list_distinct(list_filter(coalesce(arg_max(coalesce(method_names, []), (file, line_start, kind)), []), lambda x: x IS NOT NULL)) AS mn FROM c0 GROUP BY ALL),
mm AS (SELECT DISTINCT repo, class_name AS class, regexp_extract(name, '([^.]*)$', 1) AS name, calls, coalesce(instantiates, []) AS made, language FROM f WHERE class_name IS NOT NULL),
km AS (SELECT repo, name AS class, unnest(mn) AS name FROM cl UNION SELECT repo, class, name FROM mm),
un AS (SELECT repo, name, min(class) AS class FROM km GROUP BY ALL HAVING count(*) = 1),
mc AS (SELECT mm.repo, mm.class, mm.name AS method, u.callee, un.class AS target FROM (SELECT DISTINCT repo, class, name, calls, unnest(calls) AS callee FROM mm) u JOIN (SELECT DISTINCT repo, class, name, calls FROM mm) mm ON mm.repo = u.repo AND mm.class = u.class AND mm.name = u.name AND mm.calls = u.calls LEFT JOIN un ON un.repo = u.repo AND un.name = u.callee),
lk AS (SELECT DISTINCT repo, class, method, callee, target FROM mc WHERE target IS NOT NULL AND target <> class),
nl AS (SELECT repo, list(name) AS names FROM cl GROUP BY repo),
mk AS (SELECT mm.repo, class, name, calls, made, list_filter(made, lambda x: list_contains(names, x)) AS makes FROM mm JOIN nl ON nl.repo = mm.repo)
"""

ORACLE = {
    "maintainability": _HALSTEAD + ", h AS (SELECT coalesce(a.repo, b.repo) AS repo, coalesce(n1, 0) + coalesce(n2, 0) AS vocab, (coalesce(total1, 0) + coalesce(total2, 0)) * log2(greatest(coalesce(n1, 0) + coalesce(n2, 0), 2)) AS v FROM a FULL JOIN b ON a.repo = b.repo), fx AS (SELECT DISTINCT * EXCLUDE (ingested_at, parsed_at, session_id) FROM parsed_functions WHERE name <> '__file__'), c AS (SELECT repo, avg(complexity) AS cc, count(*) AS k FROM fx GROUP BY repo), sl AS (SELECT repo, sum(len(list_filter(string_split(t, chr(10)), lambda s: regexp_replace(s, " + _AROUND + ", '') <> '' AND NOT regexp_matches(regexp_replace(s, " + _AROUND + ", ''), '^(#|//|/[*]|[*]|\\x27{3}|\\x22{3})')))) AS sloc FROM (SELECT DISTINCT repo, path, coalesce(content, '') AS t FROM files) GROUP BY repo) SELECT h.repo, vocab, floor(v * 10 + 0.5) / 10 AS volume, floor(greatest(0, least(100, (171 - 5.2 * ln(greatest(floor(v * 10 + 0.5) / 10, 1)) - 0.23 * cc - 16.2 * ln(greatest(sloc / k, 1))) * 100 / 171)) * 10 + 0.5) / 10 AS mi FROM h JOIN c ON c.repo = h.repo JOIN sl ON sl.repo = h.repo",
    "effective_fields": _CLASSES + """, pn AS (SELECT repo, name AS child, unnest(list_concat(coalesce(bases, []), coalesce(interfaces, []))) AS e, FROM c0), pc AS (SELECT DISTINCT repo, child, regexp_replace(regexp_replace(regexp_replace(e, '(?s)[<\\[(].*$', ''), '^[\\s\\p{Z}*&]+|[\\s\\p{Z}*&]+$', '', 'g'), '(?s)^.*(?:::|[.\\\\/:])[\\s\\p{Z}*&]*', '') AS parent FROM pn WHERE e IS NOT NULL),
te AS (SELECT DISTINCT pc.repo, child, parent FROM pc JOIN cl ON cl.repo = pc.repo AND cl.name = parent WHERE child <> parent), an AS (SELECT repo, child, parent FROM te UNION SELECT an.repo, an.child, te.parent FROM an JOIN te ON te.repo = an.repo AND te.child = an.parent),
fd0 AS (SELECT repo, name AS owner, unnest(fields) AS f FROM c0), fd1 AS (SELECT repo, owner, f.name AS field, regexp_replace(f.type, '^[\\s"''&*]+|[\\s"'']+$|\\[\\]|^dyn\\s+', '', 'g') AS t, coalesce(f.is_collection, false) AS collection FROM fd0),
fd2 AS (SELECT repo, owner, field, collection, CASE WHEN regexp_extract(t, '^[\\w.:]+[<\\[]([^<>\\[\\],]+)[>\\]]$', 1) <> '' THEN regexp_extract(t, '^[\\w.:]+[<\\[]([^<>\\[\\],]+)[>\\]]$', 1) ELSE t END AS t FROM fd1),
fd AS (SELECT DISTINCT x.repo, owner, field, y.name AS type, collection FROM fd2 x JOIN cl y ON y.repo = x.repo AND y.name = regexp_replace(regexp_replace(regexp_replace(x.t, '(?s)[<\\[(].*$', ''), '^[\\s\\p{Z}*&]+|[\\s\\p{Z}*&]+$', '', 'g'), '(?s)^.*(?:::|[.\\\\/:])[\\s\\p{Z}*&]*', '')),
ev AS (SELECT repo, owner, field, type, collection, owner AS origin, 0 AS rk FROM fd UNION ALL SELECT an.repo, an.child, field, type, collection, an.parent, 1 FROM an JOIN fd ON fd.repo = an.repo AND fd.owner = an.parent WHERE an.child <> an.parent),
fs AS (SELECT *, min((rk, origin)) OVER (PARTITION BY repo, owner, field) AS first FROM ev) SELECT repo, owner, field, type, collection, origin FROM fs WHERE (rk, origin) = first""",
    "dead_code_totals": FAN.replace("WITH RECURSIVE", "WITH RECURSIVE ui AS (" + ORACLES_CODE["unused_imports"] + "), ", 1) + ", dd AS (SELECT repo, count(*) FILTER (is_dead) AS dead FROM dead GROUP BY repo), uu AS (SELECT split_part(path, '/', 1) AS repo, count(DISTINCT path) AS files, count(*) AS unused FROM ui GROUP BY ALL) SELECT coalesce(dd.repo, uu.repo) AS repo, coalesce(dead, 0) AS dead, coalesce(files, 0) AS files, coalesce(unused, 0) AS unused FROM dd FULL JOIN uu ON uu.repo = dd.repo",
    "commit_estimates": _HALSTEAD.replace("WITH p AS", COMMITS + ", p AS", 1) + ", h AS (SELECT coalesce(a.repo, b.repo) AS repo, floor((coalesce(total1, 0) + coalesce(total2, 0)) * log2(greatest(coalesce(n1, 0) + coalesce(n2, 0), 2)) * 10 + 0.5) / 10 AS v FROM a FULL JOIN b ON a.repo = b.repo), fx AS (SELECT DISTINCT * EXCLUDE (ingested_at, parsed_at, session_id) FROM parsed_functions WHERE name <> '__file__'), c AS (SELECT repo, avg(complexity) AS cc, count(*) AS k FROM fx GROUP BY repo), sl AS (SELECT repo, count(DISTINCT path) AS files, CAST(sum(len(list_filter(string_split(t, chr(10)), lambda s: regexp_replace(s, " + _AROUND + ", '') <> '' AND NOT regexp_matches(regexp_replace(s, " + _AROUND + ", ''), '^(#|//|/[*]|[*]|\\x27{3}|\\x22{3})')))) AS BIGINT) AS sloc FROM (SELECT DISTINCT repo, path, coalesce(content, '') AS t FROM files) GROUP BY repo), " + """
u AS (SELECT repo, hash, min(day) AS day, min(deletions - insertions) AS step, min(coalesce(fn_removed, 0) - coalesce(fn_added, 0)) AS fstep FROM cm GROUP BY ALL),
s1 AS (SELECT u.repo, hash, day, step, fstep, sloc + sum(step) OVER w AS s, k + sum(fstep) OVER w AS g, files, v, cc FROM u JOIN sl ON sl.repo = u.repo JOIN c ON c.repo = u.repo JOIN h ON h.repo = u.repo WINDOW w AS (PARTITION BY u.repo ORDER BY day DESC NULLS LAST, hash)),
s2 AS (SELECT *, min(s) OVER w AS ls, min(g) OVER w AS lg FROM s1 WINDOW w AS (PARTITION BY repo ORDER BY day DESC NULLS LAST, hash ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s3 AS (SELECT repo, hash, CAST(s - step - least(coalesce(ls, 0), 0) AS BIGINT) AS loc, CAST(g - fstep - least(coalesce(lg, 0), 0) AS BIGINT) AS functions, files, v, cc FROM s2)
SELECT repo, hash, loc, functions, CAST(floor(greatest(0, least(100, (171 - 5.2 * ln(greatest(v, 1)) - 0.23 * cc - 16.2 * ln(greatest(1, loc / files))) * 100 / 171)) + 0.5) AS BIGINT) AS mi FROM s3""",
    "simple_patterns": _CLASSES + """, cd AS (SELECT DISTINCT repo, class, target FROM lk), fo AS (SELECT repo, class, count(*) AS o FROM cd GROUP BY ALL), fi AS (SELECT repo, target AS class, count(*) AS i FROM cd GROUP BY ALL),
bo AS (SELECT repo, class, min(name) AS name FROM mk WHERE lower(name) IN ('build', 'construct') GROUP BY ALL), sv AS (SELECT repo, class, min(name) AS name FROM mk WHERE lower(name) IN ('save', 'create_memento', 'creatememento') GROUP BY ALL),
ot AS (SELECT repo, class, name, list_distinct(list_filter(makes, lambda x: x <> class)) AS others, list_filter(makes, lambda x: x <> class)[1] AS first FROM mk)
SELECT DISTINCT repo, 'prototype_candidates' AS predicate, class FROM mk WHERE lower(name) IN ('clone', '__copy__', '__deepcopy__') AND list_contains(makes, class)
UNION ALL SELECT bo.repo, 'builder_candidates', bo.class FROM bo WHERE EXISTS (SELECT 1 FROM ot WHERE ot.repo = bo.repo AND ot.class = bo.class AND ot.name = bo.name AND len(others) > 0) AND (SELECT count(*) FROM mk WHERE mk.repo = bo.repo AND mk.class = bo.class AND mk.name <> bo.name AND len(makes) = 0) >= 2
UNION ALL SELECT sv.repo, 'memento_candidates', sv.class FROM sv WHERE EXISTS (SELECT 1 FROM ot WHERE ot.repo = sv.repo AND ot.class = sv.class AND ot.name = sv.name AND len(others) > 0) AND EXISTS (SELECT 1 FROM mk WHERE mk.repo = sv.repo AND mk.class = sv.class AND lower(mk.name) IN ('restore', 'set_memento', 'setmemento'))
UNION ALL SELECT fo.repo, 'facade_candidates', fo.class FROM fo LEFT JOIN fi ON fi.repo = fo.repo AND fi.class = fo.class WHERE o >= 5 AND coalesce(i, 0) <= o * 0.4
UNION ALL SELECT fi.repo, 'mediator_candidates', fi.class FROM fi WHERE i >= 2 AND NOT EXISTS (SELECT 1 FROM cd a JOIN cd b ON b.repo = a.repo AND b.class = a.class JOIN cd c ON c.repo = a.repo AND c.class = b.target AND c.target = a.target WHERE a.repo = fi.repo AND a.target = fi.class)
UNION ALL SELECT repo, 'factory_candidates', class FROM ot WHERE len(others) > 0 GROUP BY repo, class HAVING max(len(others)) >= 2 OR count(DISTINCT name) >= 2 AND count(DISTINCT first) >= 2
UNION ALL SELECT DISTINCT a.repo, 'double_dispatch_candidates', a.class FROM lk a JOIN lk b ON b.repo = a.repo AND b.class = a.target AND b.method = a.callee AND b.target = a.class""",
    "structural_implements": _CLASSES + ", sm AS (SELECT repo, class, list(name) AS have FROM mm WHERE language = 'go' GROUP BY ALL) SELECT i.repo, s.name AS child, i.name AS parent FROM cl i JOIN cl s ON s.repo = i.repo AND s.kind = 'struct' AND s.language = 'go' JOIN sm ON sm.repo = s.repo AND sm.class = s.name WHERE i.kind = 'interface' AND i.language = 'go' AND len(i.mn) > 0 AND list_has_all(have, i.mn)",
    "architecture_patterns": _ARCHITECTURE,
    "render_strategies": BASE + "z AS (SELECT repo, count(*) AS nodes FROM f GROUP BY ALL) SELECT repo, nodes, CASE WHEN nodes < 100 THEN 'show_all' WHEN nodes <= 500 THEN 'make_group' ELSE 'search_only' END AS strategy FROM z",
    "file_strategies": "WITH p AS (SELECT DISTINCT path, language, coalesce(content, '') AS t FROM files), n AS (SELECT path, language, t, len(string_split(t, chr(10))) AS k, regexp_matches(lower(path), '([.]pb[.]go|[.]pb[.]gw[.]go|_grpc[.]pb[.]go|[.]gen[.]go|[.]generated[.]go|_generated[.]go)$') AS made FROM p) SELECT DISTINCT path, CASE WHEN made AND k > 100000 THEN 'data_file' WHEN made THEN 'god_file' WHEN k <= 10000 THEN 'normal' ELSE 'large' END AS strategy FROM n",
    "import_resolution_hint": "WITH " + RESOLVED.strip() + " SELECT path, raw, target FROM im",
    "layer_violations_by_module": _VIOLATIONS + ", o AS (SELECT file, max_by(module, line_start) FILTER (trim(module) <> '') AS m FROM parsed_functions GROUP BY file) SELECT split_part(path, '/', 1) AS repo, coalesce(m, regexp_replace(path, '/?[^/]*$', '')) AS module, count(*) AS count, CASE WHEN bool_or(severity = 'high') THEN 'high' ELSE 'medium' END AS severity FROM v LEFT JOIN o ON o.file = v.path GROUP BY ALL",
    "smell_fix_tree": SMELLS + ", rt AS (SELECT * FROM ty WHERE NOT EXISTS (SELECT 1 FROM ed WHERE ed.repo = ty.repo AND ed.child = ty.smell)), l2 AS (SELECT rt.repo, rt.smell || ' > ' || ed.child AS path, rt.k * ed.k AS nodes, ed.child FROM rt JOIN ed ON ed.repo = rt.repo AND ed.smell = rt.smell) SELECT repo, smell AS path, 1 AS depth, k AS nodes FROM rt UNION ALL SELECT repo, path, 2, nodes FROM l2 UNION ALL SELECT l2.repo, path || ' > ' || ed.child, 3, nodes * ed.k FROM l2 JOIN ed ON ed.repo = l2.repo AND ed.smell = l2.child",
    "smell_root_causes": SMELLS + "SELECT repo, rank, smell, severity, file, name, score FROM (SELECT sm.repo, CAST(row_number() OVER (PARTITION BY sm.repo ORDER BY sc.score DESC, detector, sm.file NULLS FIRST, sm.line_start NULLS FIRST, sm.name) AS INT) AS rank, sm.smell, sm.severity, sm.file, sm.name, CAST(sc.score AS BIGINT) AS score FROM sm JOIN sc ON sc.repo = sm.repo AND sc.smell = sm.smell AND sc.severity = sm.severity JOIN ef ON ef.smell = sm.smell) WHERE rank <= 6",
    "dead_code": FAN + "SELECT repo, file, name, line_start, is_dead, CASE WHEN is_dead THEN 'high' ELSE 'none' END AS confidence FROM dead",
    "smells_all": SMELLS + "SELECT repo, smell, coalesce(file, '') AS file, name, coalesce(line_start, 0) AS line_start, severity FROM sm",
    "smell_summary": SMELLS + "SELECT smell, severity, count(*) AS findings FROM sm GROUP BY ALL",
    "smells_by_layer": SMELLS + "SELECT repo, layer, count(*) AS findings FROM sm JOIN ef ON ef.smell = sm.smell GROUP BY ALL",
    "worst_severity": SMELLS + "SELECT repo, name, max_by(sm.severity, weight) AS worst FROM sm JOIN wt ON wt.severity = sm.severity GROUP BY ALL",
    "file_ranking": SMELLS + "SELECT coalesce(file, '(unknown)') AS file, CAST(sum(weight) AS BIGINT) AS weight FROM sm JOIN wt ON wt.severity = sm.severity GROUP BY ALL",
    "debt_score": SMELLS + "SELECT repo, count(*) AS findings, sum(weight * effort) AS debt, CAST(floor(sum(weight * effort) / 24 * 10 + 0.5) AS BIGINT) AS days_x10 FROM sm JOIN wt ON wt.severity = sm.severity JOIN ef ON ef.smell = sm.smell GROUP BY repo",
    "smell_scores": SMELLS + "SELECT repo, smell, severity, instances, downstream, CAST(score AS BIGINT) AS score, gain FROM sc",
    "loc_sloc": _FILES + "SELECT DISTINCT path, CAST(len(x) AS INT) AS loc, CAST(len(list_filter(x, lambda s: regexp_replace(s, " + _AROUND + ", '') <> '' AND NOT regexp_matches(regexp_replace(s, " + _AROUND + ", ''), '^(#|//|/[*]|[*]|\\x27{3}|\\x22{3})'))) AS INT) AS sloc FROM l",
    "text_metrics": "WITH p AS (SELECT DISTINCT path, coalesce(content, '') AS t FROM files), w AS (SELECT unnest(['if ', 'elif ', 'else:', 'for ', 'while ', 'case ', 'catch', 'except', '&&', '||']) AS w), b AS (SELECT path, t, 1 + sum((length(t) - length(replace(t, w, ''))) // length(w)) AS k FROM p CROSS JOIN w GROUP BY path, t) SELECT DISTINCT path, CAST(k AS INT) AS complexity, CAST(greatest(0, list_reduce(list_transform(string_split(regexp_replace(t, '[^{}]', '', 'g'), ''), lambda s: {'d': CASE s WHEN '{' THEN 1 WHEN '}' THEN -1 ELSE 0 END, 'm': 0}), lambda a, b: {'d': a.d + b.d, 'm': greatest(a.m, a.d + b.d)}, {'d': 0, 'm': 0}).m - 1) AS INT) AS nesting FROM b",
    "project_metrics": FAN + f", og AS (SELECT repo, count(*) AS orphans FROM fan WHERE fan_in = 0 AND fan_out = 0 AND NOT ({_ENTRY}) GROUP BY ALL), g AS (SELECT repo, count(*) AS functions, CAST(sum(len(calls)) AS BIGINT) AS calls, floor(avg(complexity) * 100 + 0.5) / 100 AS avg_complexity, max(complexity) AS most_complex, CAST(sum(greatest(complexity - 1, 0)) AS BIGINT) AS decisions, floor((round(avg(complexity), 2) * 1.2 + avg(max_nesting_depth) * 0.5) * 100 + 0.5) / 100 AS cognitive FROM f GROUP BY ALL), n AS (SELECT repo, count(DISTINCT path) AS files FROM files GROUP BY ALL) SELECT g.*, files, coalesce(orphans, 0) AS orphans FROM g JOIN n ON n.repo = g.repo LEFT JOIN og ON og.repo = g.repo",
    "layer_files": "SELECT DISTINCT path, " + _PATH_LAYER + " AS layer FROM files",
    "layer_violations": _VIOLATIONS + "SELECT * FROM v",
    "unique_method_resolution": _CLASSES + "SELECT repo, name, class FROM un",
    "method_calls": _CLASSES + "SELECT repo, class, method, callee, target FROM mc",
    "git_churn": "WITH c AS (SELECT DISTINCT * EXCLUDE (ingested_at) FROM commits) SELECT repo, count(DISTINCT hash) AS commits, CAST(sum(insertions) AS BIGINT) AS insertions, CAST(sum(deletions) AS BIGINT) AS deletions, CAST(sum(insertions + deletions) AS BIGINT) AS churn, count(DISTINCT author) AS authors FROM c GROUP BY repo",
    "last_writer": "WITH t AS (SELECT user_id AS run, event_id AS ord, event_type, last_value(CASE WHEN event_type = 'error' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS writer_ord FROM events) SELECT run, ord, 'v' AS var, writer_ord FROM t WHERE event_type <> 'error' AND writer_ord IS NOT NULL",
    "halstead_counts": _HALSTEAD + "SELECT coalesce(a.repo, b.repo) AS repo, coalesce(n1, 0) AS n1, coalesce(n2, 0) AS n2, coalesce(total1, 0) AS total1, coalesce(total2, 0) AS total2 FROM a FULL JOIN b ON a.repo = b.repo",
    "service_summary": "WITH m AS (SELECT repo, service, count(DISTINCT trim(module)) AS modules FROM parsed_functions WHERE name <> '__file__' AND trim(module) <> '' GROUP BY ALL) SELECT f.repo, f.service, f.files, coalesce(modules, 0) AS modules FROM (SELECT repo, service, count(DISTINCT path) AS files FROM files WHERE service IS NOT NULL GROUP BY ALL) f LEFT JOIN m ON m.repo = f.repo AND m.service = f.service",
    "sweep_windows": "SELECT time_bucket(INTERVAL 30 MINUTE, ts) AS start, count(*) AS events, count(DISTINCT user_id) AS users FROM events GROUP BY ALL",
    "session_inactivity": "SELECT user_id, CAST(floor((epoch_us((SELECT max(ts) FROM events)) - epoch_us(max(ts))) / 60000000) AS BIGINT) AS minutes FROM events GROUP BY user_id",
    "session_gaps": "WITH a AS (SELECT user_id AS u, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > INTERVAL 3 HOUR THEN 1 ELSE 0 END AS n FROM events), b AS (SELECT u, sum(n) OVER (PARTITION BY u ORDER BY ts) AS k FROM a), g AS (SELECT u, k, count(*) AS c FROM b GROUP BY ALL) SELECT u AS user, count(*) AS sessions, max(c) AS most_events FROM g GROUP BY ALL",
}
