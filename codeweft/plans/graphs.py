"""Queries of the dependency graphs over the test tables, and the SQL that each must equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweft.operators import graph, imports
from codeweft.operators.relations import functions, name_graph, once, raw_calls
from codeweft.session import cut, table


def fns(spark: SparkSession, d: str) -> DataFrame:
    return functions(table(spark, d, "parsed_functions"))


def _edges(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    f = cut(fns(spark, d).select("repo", "file", "module", "name", "line_start", "calls"))
    return f, cut(name_graph(f))


def _rows(spark: SparkSession, d: str) -> DataFrame:
    """Function rows with those that stand for files without functions."""
    return once(table(spark, d, "parsed_functions"))


def _resolved(spark: SparkSession, d: str) -> DataFrame:
    return imports.resolve(table(spark, d, "file_imports"), table(spark, d, "files"))


def _files(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "files").select("repo", "path", "language", "content").distinct()


def group_graph(by: str):
    return lambda s, d: graph.group_edges(fns(s, d), _rows(s, d), _resolved(s, d), by)


def scc_members(spark: SparkSession, d: str) -> DataFrame:
    return graph.reach(_edges(spark, d)[1]).where("component is not null").select("repo", "name", "component", "size")


def risk_scores(spark: SparkSession, d: str) -> DataFrame:
    f, e = _edges(spark, d)
    return graph.risk(f, e, graph.reach(e))


def risk_histogram(spark: SparkSession, d: str) -> DataFrame:
    return risk_scores(spark, d).groupBy("level").agg(F.count("*").alias("functions"))


def risk_top50(spark: SparkSession, d: str) -> DataFrame:
    order = (F.desc("score"), F.desc("transitive"), "repo", "file", "name", "line_start")
    return risk_scores(spark, d).where("direct > 0").orderBy(*order).limit(50).select("repo", "file", "name", "line_start", "score", "transitive")


def risk_warnings(spark: SparkSession, d: str) -> DataFrame:
    """Why a function of high risk is one, in words: the parts of its score that are not 0."""
    part = lambda c, form: F.when(F.col(c) > 0, F.format_string(form, F.col(c)))
    text = F.concat_ws("; ", part("direct", "%d direct"), part("transitive", "%d transitive"), part("cross_file", "%d in other files"), F.when(F.col("in_cycle") > 0, "on a cycle"))
    return risk_scores(spark, d).where("level = 'high'").select("repo", "file", "name", "line_start", text.alias("warning"))


def transitive_closure(spark: SparkSession, d: str) -> DataFrame:
    return graph.pairs(_edges(spark, d)[1])


def _most_called(e: DataFrame):
    return e.groupBy("repo", "dst").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "repo", "dst").first()


def impact_bfs(spark: SparkSession, d: str) -> DataFrame:
    """Impact of the name that most names call: the ends are picked by the data."""
    f, e = _edges(spark, d)
    r = _most_called(e)
    return graph.impact(f, e, r["repo"], r["dst"]).select("name", "depth", "direct")


def impact_files(spark: SparkSession, d: str) -> DataFrame:
    """Files and modules of :func:`impact_bfs`'s names, each name by its first row in the order of files and lines."""
    f, e = _edges(spark, d)
    r = _most_called(e)
    names = graph.impact(f, e, r["repo"], r["dst"])
    at = F.struct("file", "line_start")
    first = f.where(F.col("repo") == r["repo"]).groupBy("name").agg(F.min_by("file", at).alias("file"), F.min_by("module", at).alias("module"))
    rows = names.join(first, "name")
    kinds = [rows.where(F.col(c) != "").groupBy(F.lit(c).alias("kind"), F.col(c).alias("id")).agg(F.count("*").alias("names"), F.min("depth").alias("depth")) for c in ("file", "module")]
    return kinds[0].union(kinds[1])


def impact_first100(spark: SparkSession, d: str) -> DataFrame:
    """The feature's own first 100 of :func:`impact_bfs`, the nearest first, with how many there are."""
    rows = impact_bfs(spark, d)
    return rows.withColumn("total", F.lit(rows.count())).orderBy("depth", "name").limit(100)


def simple_cycles_le6(spark: SparkSession, d: str) -> DataFrame:
    return graph.simple_cycles(raw_calls(table(spark, d, "parsed_functions")))


def max_chain_depth(spark: SparkSession, d: str) -> DataFrame:
    _, e = _edges(spark, d)
    return graph.longest_chain(e)


def files_graph(spark: SparkSession, d: str) -> DataFrame:
    """All files as nodes, without those ``__init__.py`` that say nothing."""
    return graph.without_inert(graph.file_nodes(fns(spark, d), table(spark, d, "files")), group_graph("file")(spark, d))


def fan_in_rescued(spark: SparkSession, d: str) -> DataFrame:
    return graph.rescued(graph.fan(fns(spark, d)), _files(spark, d))


def top_nodes(spark: SparkSession, d: str) -> DataFrame:
    return graph.top_nodes(graph.fan(fns(spark, d))).select("repo", "file", "name", "line_start", "degree")


def all_calls(spark: SparkSession, d: str) -> DataFrame:
    """CALLS edges as the store has them: a caller by name and file, and every function that has the called name."""
    f = fns(spark, d).select("repo", "name", "file", "calls")
    calls = f.select("repo", F.col("name").alias("caller"), F.col("file").alias("caller_file"), F.explode("calls").alias("callee"))
    return calls.join(f.select("repo", F.col("name").alias("callee"), F.col("file").alias("callee_file")), ["repo", "callee"]).select("repo", "caller", "caller_file", "callee", "callee_file").distinct()


def store_tier1_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges between modules as the store counts them: CALLS edges by the modules of both files."""
    of = _rows(spark, d).groupBy("file").agg(F.max(F.when(F.trim("module") != "", F.trim("module"))).alias("m")).where("m is not null")
    e = all_calls(spark, d).join(of.select(F.col("file").alias("caller_file"), F.col("m").alias("source")), "caller_file").join(of.select(F.col("file").alias("callee_file"), F.col("m").alias("target")), "callee_file")
    return e.where("source <> target").groupBy("repo", "source", "target").agg(F.count("*").alias("calls"))


def store_tier1_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Modules as the store counts them: lines, distinct function names and languages; files without functions count too."""
    r = _rows(spark, d).where(F.trim("module") != "")
    real = F.col("name") != "__file__"
    langs = F.concat_ws(",", F.array_sort(F.collect_set("language")))
    loc = F.coalesce(F.sum(F.when(real, F.col("line_end") - F.col("line_start"))), F.lit(0)).cast("long")
    return r.groupBy("repo", F.trim("module").alias("module")).agg(loc.alias("loc"), F.countDistinct(F.when(real, F.col("name"))).alias("functions"), langs.alias("languages"))


def modules_below(spark: SparkSession, d: str) -> DataFrame:
    """Projects whose modules all stand below one, and that one."""
    return graph.root_module(_rows(spark, d).where(F.trim("module") != "").select("repo", F.trim("module").alias("module")))


def top_files(spark: SparkSession, d: str) -> DataFrame:
    """Files that stand in a module with modules below it, and in none of those."""
    mods = _rows(spark, d).where(F.trim("module") != "").select("repo", F.trim("module").alias("module"), "file").distinct()
    parts = F.split("module", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    parents = mods.where(F.size(parts) > 1).select("repo", F.explode(above).alias("module")).distinct()
    return mods.join(parents, ["repo", "module"], "left_semi").select("repo", "module", "file")


def call_pairs(spark: SparkSession, d: str) -> DataFrame:
    """What calls stand behind an edge between modules, by pairs of files."""
    f = fns(spark, d)
    mod = lambda c, name: f.groupBy("repo", F.col("file").alias(c)).agg(F.max(graph.group_of()).alias(name))
    rows = graph.file_calls(f).join(mod("source", "from_module"), ["repo", "source"]).join(mod("target", "to_module"), ["repo", "target"])
    return rows.where("from_module <> to_module").select("repo", "from_module", "to_module", "source", "target", "n")


def full_graph(spark: SparkSession, d: str) -> DataFrame:
    """All functions, then all calls between them, in order."""
    f = fns(spark, d)
    nodes = f.select("repo", F.lit("node").alias("kind"), F.col("name").alias("a"), F.col("file").alias("b")).distinct()
    edges = all_calls(spark, d).select("repo", F.lit("edge").alias("kind"), F.col("caller").alias("a"), F.col("callee").alias("b")).distinct()
    return nodes.union(edges).orderBy("repo", F.desc("kind"), "a", "b")


def search_nodes(spark: SparkSession, d: str) -> DataFrame:
    """The hits of a search with the ids by which a graph shows them."""
    f = fns(spark, d)
    return graph.search(f, "load").join(graph.node_ids(f), ["repo", "file", "name", "line_start"])


QUERIES = {
    "tier1_nodes": lambda s, d: graph.module_nodes(_rows(s, d)),
    "tier1_module_graph": group_graph("module"),
    "tier2_file_graph": group_graph("file"),
    "tier3_function_nodes": lambda s, d: graph.function_nodes(fns(s, d)),
    "tier3_function_edges": lambda s, d: graph.function_edges(fns(s, d)),
    "tier3_chunk_edges": lambda s, d: graph.chunk_edges(fns(s, d)),
    "edge_details_top40": lambda s, d: graph.edge_details(fns(s, d), _rows(s, d), _resolved(s, d)),
    "edge_details_modules": lambda s, d: graph.edge_details(fns(s, d), _rows(s, d), _resolved(s, d), "module"),
    "anonymous_merged": lambda s, d: graph.anonymous_merged(fns(s, d)).select("repo", "file", "name", "line_start", F.array_join("calls", ",").alias("calls")),
    "fan_in_out": lambda s, d: graph.fan(fns(s, d)),
    "neighbors_both": lambda s, d: graph.neighbours(fns(s, d)),
    "neighbors_callees": lambda s, d: graph.neighbours(fns(s, d), both=False),
    "search_ranked": lambda s, d: graph.search(fns(s, d), "load"),
    **{f.__name__: f for f in (modules_below, top_files, call_pairs, full_graph, search_nodes, files_graph, fan_in_rescued, top_nodes, all_calls, store_tier1_edges, store_tier1_nodes, scc_members, risk_scores, risk_histogram, risk_top50, risk_warnings, transitive_closure, impact_bfs, impact_files, impact_first100, simple_cycles_le6, max_chain_depth)},
}

#: Deduplicated functions with clean calls, the names' last definitions, call rows and the name graph, as SQL.
BASE = """
WITH RECURSIVE f0 AS (
  SELECT DISTINCT * EXCLUDE (ingested_at, parsed_at, session_id) FROM parsed_functions WHERE name <> '__file__'),
f AS (SELECT * EXCLUDE (calls), line_end - line_start AS lines,
  list_sort(list_distinct(list_filter(list_transform(coalesce(calls, []), lambda x: regexp_replace(x, '^[\\s\\p{Z}\\x0b\\x1c-\\x1f\\x{85}]+|[\\s\\p{Z}\\x0b\\x1c-\\x1f\\x{85}]+$', '', 'g')), lambda x: x IS NOT NULL AND x <> ''))) AS calls FROM f0),
last AS (SELECT repo, name, max_by(file, (file, line_start)) AS file, max_by(coalesce(module, ''), (file, line_start)) AS module FROM f GROUP BY ALL),
c AS (SELECT repo, file, module, name AS src, unnest(calls) AS dst FROM f),
e AS (SELECT DISTINCT c.repo, src, dst FROM c JOIN (SELECT DISTINCT repo, name FROM f) n ON n.repo = c.repo AND n.name = dst WHERE src <> dst),
"""
CLOSED = BASE + """
r AS (SELECT repo, src, dst FROM e UNION SELECT r.repo, r.src, e.dst FROM r JOIN e ON e.repo = r.repo AND e.src = r.dst),
"""
RISK = CLOSED + """
cr AS (SELECT repo, file, name, count(*) AS cross_file FROM (
  SELECT DISTINCT e.repo, s.file, e.src AS name, e.dst FROM e JOIN (SELECT DISTINCT repo, name, file FROM f) s ON s.repo = e.repo AND s.name = e.src
  WHERE NOT EXISTS (SELECT 1 FROM f x WHERE x.repo = e.repo AND x.name = e.dst AND x.file = s.file)) GROUP BY ALL),
m AS (SELECT n.repo, n.file, n.name, n.line_start, coalesce(di.k, 0) AS direct, coalesce(tr.k, 0) AS transitive, coalesce(cr.cross_file, 0) AS cross_file, CAST(coalesce(cy.k, 0) AS INT) AS in_cycle
  FROM (SELECT DISTINCT repo, file, name, line_start FROM f) n
  LEFT JOIN (SELECT repo, src, count(*) AS k FROM e GROUP BY ALL) di ON di.repo = n.repo AND di.src = n.name
  LEFT JOIN (SELECT repo, src, count(*) AS k FROM r WHERE src <> dst GROUP BY ALL) tr ON tr.repo = n.repo AND tr.src = n.name
  LEFT JOIN cr ON cr.repo = n.repo AND cr.name = n.name AND cr.file = n.file
  LEFT JOIN (SELECT DISTINCT repo, src, 1 AS k FROM r WHERE src = dst) cy ON cy.repo = n.repo AND cy.src = n.name),
risk AS (SELECT *, 2 * direct + (transitive - direct) + 2 * cross_file + 6 * in_cycle AS score FROM m),
lev AS (SELECT *, CASE WHEN score >= 25 THEN 'high' WHEN score >= 10 THEN 'medium' WHEN score >= 1 THEN 'low' ELSE 'none' END AS level FROM risk)
"""
#: Imports resolved to files by their last part and their folders, the deepest first.
RESOLVED = """
i0 AS (SELECT DISTINCT path, raw FROM file_imports),
i1 AS (SELECT path, raw, split_part(path, '/', 1) AS repo, list_filter(string_split_regex(lower(raw), '[/.:\\\\]+'), lambda x: x <> '') AS parts FROM i0),
i2 AS (SELECT path, raw, repo, parts[-1] AS stem, list_reverse(parts[:-2]) AS hints FROM i1 WHERE len(parts) > 0),
k0 AS (SELECT DISTINCT repo, path AS target, lower(regexp_extract(path, '([^/.]+)\\.[^/.]+$', 1)) AS stem, string_split(lower(regexp_replace(path, '/[^/]*$', '')), '/') AS folders FROM files),
i3 AS (SELECT i2.path, i2.raw, k0.target, coalesce(list_position(list_transform(hints, lambda h: list_contains(folders, h)), true), 1000000) AS hp FROM i2 JOIN k0 ON k0.repo = i2.repo AND k0.stem = i2.stem WHERE i2.path <> k0.target AND k0.stem <> ''),
im AS (SELECT path, raw, arg_min(target, (CASE WHEN hp = 0 THEN 1000000 ELSE hp END, target)) AS target FROM i3 GROUP BY ALL)
"""


def _edge_sql(by: str) -> str:
    group = "CASE WHEN trim(module) <> '' THEN trim(module) ELSE file END" if by == "module" else "file"
    return BASE + RESOLVED + f""",
lg AS (SELECT repo, name, max_by({group}, (file, line_start)) AS g FROM f GROUP BY ALL),
fg AS (SELECT repo, file, max_by({group}, (line_start, name)) AS g FROM (SELECT DISTINCT * EXCLUDE (ingested_at, parsed_at, session_id) FROM parsed_functions) GROUP BY ALL),
j AS (SELECT c.repo, a.g AS s, b.g AS t, 'call' AS kind, c.src, c.dst FROM c JOIN lg a ON a.repo = c.repo AND a.name = c.src JOIN lg b ON b.repo = c.repo AND b.name = c.dst WHERE a.g <> b.g
  UNION ALL SELECT a.repo, a.g, b.g, 'import', im.path, im.raw FROM im JOIN fg a ON a.file = im.path JOIN fg b ON b.file = im.target AND b.repo = a.repo WHERE a.g <> b.g AND a.repo = split_part(im.path, '/', 1))
"""


#: Functions with fan_out and fan_in, the latter by names in texts where no call has them.
RESCUE = (
    BASE + "k AS (SELECT repo, dst, count(*) AS n FROM c GROUP BY ALL), g0 AS (SELECT f.* EXCLUDE (fan_in, fan_out), CAST(len(calls) AS INT) AS fan_out, coalesce(k.n, 0) AS fan_in FROM f LEFT JOIN k ON k.repo = f.repo AND k.dst = f.name), p AS (SELECT DISTINCT repo, path, coalesce(content, '') AS t, CASE WHEN language = 'python' THEN 1 ELSE 0 END AS py FROM files), "
    + "q AS (SELECT repo, path, CASE py WHEN 1 THEN regexp_replace(t, '" + r"(\"\"\"(?s:.*?)(?:\"\"\"|\z)|(?s:.*?)(?:|\z)|```(?s:.*?)(?:```|\z)|\"[^\"\\]*(?:\\(?s:.)[^\"\\]*)*(?:\"|\\?\z)|''[^''\\]*(?:\\(?s:.)[^''\\]*)*(?:''|\\?\z)|`[^`\\]*(?:\\(?s:.)[^`\\]*)*(?:`|\\?\z))|#[^\n]*" + "', '\\1', 'g') "
    + "ELSE regexp_replace(t, '" + r"(\"[^\"\\]*(?:\\(?s:.)[^\"\\]*)*(?:\"|\\?\z)|''[^''\\]*(?:\\(?s:.)[^''\\]*)*(?:''|\\?\z)|`[^`\\]*(?:\\(?s:.)[^`\\]*)*(?:`|\\?\z))|//[^\n]*|/\*(?s:.*?)(?:\*/|\z)" + "', '\\1', 'g') END AS t FROM p), w AS (SELECT repo, path, unnest(regexp_extract_all(t, '[\\p{L}\\p{M}\\p{N}_]+')) AS name FROM q), h AS (SELECT repo, name, path, count(*) AS n FROM w GROUP BY ALL), o AS (SELECT repo, name, count(*) AS files FROM h GROUP BY ALL)"
    + ", fan AS (SELECT g0.* REPLACE (CASE WHEN g0.fan_in = 0 AND (coalesce(o.files, 0) > (CASE WHEN h.n > 0 THEN 1 ELSE 0 END) OR coalesce(h.n, 0) > 1) THEN 1 ELSE g0.fan_in END AS fan_in) FROM g0 LEFT JOIN o ON o.repo = g0.repo AND o.name = g0.name LEFT JOIN h ON h.repo = g0.repo AND h.name = g0.name AND h.path = g0.file) "
)
IMPACT = """
t AS (SELECT repo, dst FROM e GROUP BY ALL ORDER BY count(*) DESC, repo, dst LIMIT 1), w AS (SELECT e.repo, e.src AS name, 1 AS depth FROM e JOIN t ON t.repo = e.repo AND t.dst = e.dst UNION SELECT e.repo, e.src, w.depth + 1 FROM w JOIN e ON e.repo = w.repo AND e.dst = w.name WHERE w.depth < 40),
ib AS (SELECT name, min(depth) AS depth, min(depth) = 1 AS direct FROM w WHERE name <> (SELECT dst FROM t) GROUP BY ALL)
"""

ORACLE = {
    "tier1_nodes": "WITH r AS (SELECT DISTINCT * EXCLUDE (ingested_at, parsed_at, session_id) FROM parsed_functions) SELECT repo, CASE WHEN trim(module) <> '' THEN trim(module) ELSE file END AS id, CASE WHEN trim(module) <> '' THEN 'module' ELSE 'file' END AS type, CAST(sum(CASE WHEN name <> '__file__' THEN line_end - line_start ELSE 0 END) AS BIGINT) AS loc, count(*) FILTER (name <> '__file__') AS functions, coalesce(string_agg(DISTINCT language, ',' ORDER BY language), '') AS languages FROM r GROUP BY ALL",
    "tier1_module_graph": _edge_sql("module") + "SELECT repo, s AS source, t AS target, count(*) AS call_count FROM j GROUP BY ALL",
    "tier2_file_graph": _edge_sql("file") + "SELECT repo, s AS source, t AS target, count(*) AS call_count FROM j GROUP BY ALL",
    "files_graph": _edge_sql("file") + ", z AS (SELECT repo, file, count(*) AS functions, CAST(sum(lines) AS BIGINT) AS loc FROM f GROUP BY ALL), n AS (SELECT p.repo, p.path AS file, coalesce(functions, 0) AS functions, coalesce(loc, 0) AS loc FROM (SELECT DISTINCT repo, path FROM files) p LEFT JOIN z ON z.repo = p.repo AND z.file = p.path) SELECT * FROM n WHERE NOT (regexp_matches(file, '(^|/)__init__[.]py$') AND functions = 0 AND NOT EXISTS (SELECT 1 FROM j WHERE j.repo = n.repo AND (j.s = n.file OR j.t = n.file)))",
    "tier3_function_nodes": BASE + "z AS (SELECT *, count(*) OVER (PARTITION BY repo, file, name) AS k FROM f WHERE NOT regexp_matches(name, '^anonymous_[0-9]+$')) SELECT repo, file, CASE WHEN k > 1 THEN name || ':' || line_start ELSE name END AS id, name, line_start, complexity, lines FROM z",
    "tier3_chunk_edges": BASE + "h AS (SELECT DISTINCT file, name, virtual_module AS vm FROM f), k AS (SELECT file, virtual_module AS source, unnest(calls) AS callee FROM f) SELECT k.file, source, h.vm AS target, count(*) AS call_count FROM k JOIN h ON h.file = k.file AND h.name = k.callee WHERE source <> h.vm GROUP BY ALL",
    "edge_details_top40": _edge_sql("file") + ", p AS (SELECT DISTINCT repo, s, t, kind, src, dst FROM j), q AS (SELECT repo, s AS source, t AS target, kind, src, dst, CAST(row_number() OVER (PARTITION BY repo, s, t ORDER BY kind, src, dst) AS INT) AS rank, count(*) OVER (PARTITION BY repo, s, t) AS total FROM p) SELECT * FROM q WHERE rank <= 40",
    "fan_in_out": BASE + "k AS (SELECT repo, dst, count(*) AS n FROM c GROUP BY ALL) SELECT f.repo, f.name, f.file, f.line_start, CAST(len(calls) AS INT) AS fan_out, coalesce(k.n, 0) AS fan_in FROM f LEFT JOIN k ON k.repo = f.repo AND k.dst = f.name",
    "neighbors_callees": BASE + "z AS (SELECT 1) SELECT repo, src AS name, dst AS other, 'callee' AS direction FROM e",
    "neighbors_both": BASE + "z AS (SELECT 1) SELECT repo, src AS name, dst AS other, 'callee' AS direction FROM e UNION ALL SELECT repo, dst, src, 'caller' FROM e",
    "search_ranked": BASE + "z AS (SELECT repo, name, file, line_start, CAST(CASE WHEN lower(name) = 'load' THEN 0 WHEN starts_with(lower(name), 'load') THEN 1 WHEN contains(lower(name), 'load') THEN 2 WHEN contains(lower(file), 'load') THEN 3 END AS INT) AS rank FROM f) SELECT * FROM z WHERE rank IS NOT NULL ORDER BY rank, name, file, line_start LIMIT 50",
    "risk_warnings": RISK + "SELECT repo, file, name, line_start, concat_ws('; ', CASE WHEN direct > 0 THEN direct || ' direct' END, CASE WHEN transitive > 0 THEN transitive || ' transitive' END, CASE WHEN cross_file > 0 THEN cross_file || ' in other files' END, CASE WHEN in_cycle > 0 THEN 'on a cycle' END) AS warning FROM lev WHERE level = 'high'",
    "top_nodes": BASE + "k AS (SELECT repo, dst, count(*) AS n FROM c GROUP BY ALL) SELECT f.repo, f.file, f.name, f.line_start, CAST(len(calls) + coalesce(k.n, 0) AS BIGINT) AS degree FROM f LEFT JOIN k ON k.repo = f.repo AND k.dst = f.name ORDER BY degree DESC, f.repo, f.file, f.name, f.line_start LIMIT 100",
    "all_calls": BASE + "z AS (SELECT 1) SELECT DISTINCT c.repo, c.src AS caller, c.file AS caller_file, c.dst AS callee, f.file AS callee_file FROM c JOIN f ON f.repo = c.repo AND f.name = c.dst",
    "store_tier1_edges": BASE + "a AS (SELECT DISTINCT c.repo, c.src, c.file AS cf, c.dst, f.file AS tf FROM c JOIN f ON f.repo = c.repo AND f.name = c.dst), o AS (SELECT file, max(trim(module)) AS m FROM parsed_functions WHERE trim(module) <> '' GROUP BY file) SELECT a.repo, s.m AS source, t.m AS target, count(*) AS calls FROM a JOIN o s ON s.file = a.cf JOIN o t ON t.file = a.tf WHERE s.m <> t.m GROUP BY ALL",
    "store_tier1_nodes": "WITH r AS (SELECT DISTINCT * EXCLUDE (ingested_at, parsed_at, session_id) FROM parsed_functions WHERE trim(module) <> '') SELECT repo, trim(module) AS module, CAST(coalesce(sum(line_end - line_start) FILTER (name <> '__file__'), 0) AS BIGINT) AS loc, count(DISTINCT name) FILTER (name <> '__file__') AS functions, coalesce(string_agg(DISTINCT language, ',' ORDER BY language), '') AS languages FROM r GROUP BY ALL",
    "tier3_function_edges": BASE + "z AS (SELECT *, count(*) OVER (PARTITION BY repo, file, name) AS k FROM f WHERE NOT regexp_matches(name, '^anonymous_[0-9]+$')), n AS (SELECT *, CASE WHEN k > 1 THEN name || ':' || line_start ELSE name END AS id FROM z), a AS (SELECT file, id, unnest(calls) AS callee FROM n), b AS (SELECT file, id, unnest(instantiates) AS made FROM n) SELECT DISTINCT a.file, a.id AS source, n.id AS target, 'call' AS kind FROM a JOIN n ON n.file = a.file AND n.name = a.callee WHERE a.id <> n.id UNION SELECT DISTINCT b.file, b.id, n.id, 'instantiate' FROM b JOIN n ON n.file = b.file AND n.name = '__init__' AND n.class_name = b.made WHERE b.id <> n.id",
    "fan_in_rescued": RESCUE + "SELECT repo, name, file, line_start, fan_out, fan_in FROM fan",
    "edge_details_modules": _edge_sql("module") + ", p AS (SELECT DISTINCT repo, s, t, kind, src, dst FROM j), q AS (SELECT repo, s AS source, t AS target, kind, src, dst, CAST(row_number() OVER (PARTITION BY repo, s, t ORDER BY kind, src, dst) AS INT) AS rank, count(*) OVER (PARTITION BY repo, s, t) AS total FROM p) SELECT * FROM q WHERE rank <= 40",
    "anonymous_merged": BASE + "fx AS (SELECT DISTINCT repo, file, name, line_start, line_end, calls, regexp_matches(name, '^anonymous_[0-9]+$') AS an FROM f), b AS (SELECT i.repo, i.file, i.calls AS more, arg_min((o.name, o.line_start), (o.line_end - o.line_start, o.name, o.line_start)) AS x FROM fx i JOIN fx o ON o.repo = i.repo AND o.file = i.file AND NOT o.an AND o.line_start <= i.line_start AND i.line_end <= o.line_end WHERE i.an GROUP BY i.repo, i.file, i.line_start, i.line_end, i.calls), m AS (SELECT repo, file, x[1] AS name, x[2] AS line_start, flatten(list(more)) AS more FROM b GROUP BY ALL) SELECT fx.repo, fx.file, fx.name, fx.line_start, array_to_string(list_sort(list_distinct(list_concat(calls, coalesce(more, [])))), ',') AS calls FROM fx LEFT JOIN m ON m.repo = fx.repo AND m.file = fx.file AND m.name = fx.name AND m.line_start = fx.line_start WHERE NOT an",
    "modules_below": "WITH m AS (SELECT DISTINCT repo, trim(module) AS module FROM parsed_functions WHERE trim(module) <> '') SELECT a.repo, a.module FROM m a JOIN m b ON b.repo = a.repo GROUP BY ALL HAVING count(*) > 1 AND count(*) FILTER (starts_with(b.module, a.module || '/')) = count(*) - 1",
    "top_files": "WITH m AS (SELECT DISTINCT repo, trim(module) AS module, file FROM parsed_functions WHERE trim(module) <> '') SELECT repo, module, file FROM m a WHERE EXISTS (SELECT 1 FROM m b WHERE b.repo = a.repo AND starts_with(b.module, a.module || '/'))",
    "call_pairs": BASE + "g AS (SELECT repo, file, max(CASE WHEN trim(module) <> '' THEN trim(module) ELSE file END) AS g FROM f GROUP BY ALL), k AS (SELECT c.repo, c.file AS source, last.file AS target, count(*) AS n FROM c JOIN last ON last.repo = c.repo AND last.name = c.dst GROUP BY ALL) SELECT k.repo, a.g AS from_module, b.g AS to_module, source, target, n FROM k JOIN g a ON a.repo = k.repo AND a.file = source JOIN g b ON b.repo = k.repo AND b.file = target WHERE a.g <> b.g",
    "full_graph": BASE + "z AS (SELECT 1) SELECT DISTINCT repo, 'node' AS kind, name AS a, file AS b FROM f UNION ALL SELECT DISTINCT c.repo, 'edge', c.src, c.dst FROM c JOIN f ON f.repo = c.repo AND f.name = c.dst",
    "search_nodes": BASE + "v AS (SELECT *, (SELECT count(DISTINCT y.virtual_module) FROM f y WHERE y.repo = f.repo AND y.file = f.file) AS vms FROM f), s AS (SELECT *, CASE WHEN vms > 1 AND virtual_module IS NOT NULL THEN virtual_module ELSE file END AS scope FROM v), i AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY repo, file, scope, name) > 1 THEN name || ':' || line_start ELSE name END AS id FROM s), z AS (SELECT repo, name, file, line_start, scope, id, CAST(CASE WHEN lower(name) = 'load' THEN 0 WHEN starts_with(lower(name), 'load') THEN 1 WHEN contains(lower(name), 'load') THEN 2 WHEN contains(lower(file), 'load') THEN 3 END AS INT) AS rank FROM i) SELECT * FROM z WHERE rank IS NOT NULL ORDER BY rank, name, file, line_start LIMIT 50",
    "transitive_closure": CLOSED + "z AS (SELECT 1) SELECT repo, src, dst FROM r",
    "scc_members": CLOSED + "m AS (SELECT a.repo, a.src, a.dst FROM r a JOIN r b ON a.repo = b.repo AND a.src = b.dst AND a.dst = b.src) SELECT repo, src AS name, min(dst) AS component, count(*) AS size FROM m GROUP BY ALL",
    "risk_scores": RISK + "SELECT repo, file, name, line_start, direct, transitive, cross_file, in_cycle, score, level FROM lev",
    "risk_histogram": RISK + "SELECT level, count(*) AS functions FROM lev GROUP BY ALL",
    "risk_top50": RISK + "SELECT repo, file, name, line_start, score, transitive FROM lev WHERE direct > 0 ORDER BY score DESC, transitive DESC, repo, file, name, line_start LIMIT 50",
    "impact_bfs": BASE + "t AS (SELECT repo, dst FROM e GROUP BY ALL ORDER BY count(*) DESC, repo, dst LIMIT 1), w AS (SELECT e.repo, e.src AS name, 1 AS depth FROM e JOIN t ON t.repo = e.repo AND t.dst = e.dst UNION SELECT e.repo, e.src, w.depth + 1 FROM w JOIN e ON e.repo = w.repo AND e.dst = w.name WHERE w.depth < 40) SELECT name, min(depth) AS depth, min(depth) = 1 AS direct FROM w WHERE name <> (SELECT dst FROM t) GROUP BY ALL",
    "impact_first100": BASE + IMPACT + "SELECT *, (SELECT count(*) FROM ib) AS total FROM ib ORDER BY depth, name LIMIT 100",
    "impact_files": BASE + IMPACT + ", ff AS (SELECT name, min_by(file, (file, line_start)) AS file, min_by(module, (file, line_start)) AS module FROM f WHERE repo = (SELECT repo FROM t) GROUP BY name), x AS (SELECT * FROM ib JOIN ff USING (name)) SELECT 'file' AS kind, file AS id, count(*) AS names, min(depth) AS depth FROM x WHERE file <> '' GROUP BY ALL UNION ALL SELECT 'module', module, count(*), min(depth) FROM x WHERE module <> '' GROUP BY ALL",
    "max_chain_depth": CLOSED + "cyc AS (SELECT DISTINCT a.repo, a.src, a.dst FROM e a JOIN r b ON a.repo = b.repo AND a.src = b.dst AND a.dst = b.src), ac AS (SELECT * FROM e EXCEPT SELECT * FROM cyc), ch AS (SELECT DISTINCT repo, dst AS pos, 1 AS d FROM ac UNION SELECT ch.repo, ac.dst, ch.d + 1 FROM ch JOIN ac ON ac.repo = ch.repo AND ac.src = ch.pos WHERE ch.d < 40) SELECT repo, max(d) AS depth FROM ch GROUP BY ALL",
    "simple_cycles_le6": CLOSED + "cyc AS (SELECT DISTINCT a.repo, a.src, a.dst FROM e a JOIN r b ON a.repo = b.repo AND a.src = b.dst AND a.dst = b.src), w AS (SELECT repo, [src, dst] AS p, dst AS at FROM cyc WHERE dst > src UNION ALL SELECT w.repo, list_append(p, cyc.dst), cyc.dst FROM w JOIN cyc ON cyc.repo = w.repo AND cyc.src = w.at WHERE cyc.dst > p[1] AND NOT list_contains(p, cyc.dst) AND len(p) < 6) SELECT w.repo, array_to_string(p, ' > ') AS nodes, CAST(len(p) AS INT) AS length FROM w JOIN cyc ON cyc.repo = w.repo AND cyc.src = w.at AND cyc.dst = p[1]",
}
