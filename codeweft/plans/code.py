"""Queries of parsing, imports, chunks, services and commits, and the SQL that each must equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweft.functions import text
from codeweft.operators import chunks, history, imports
from codeweft.operators.relations import functions, once
from codeweft.plans.graphs import BASE
from codeweft.session import table
from codeweft.sources import code, parsers


def fns(spark: SparkSession, d: str) -> DataFrame:
    return functions(table(spark, d, "parsed_functions"))


def _files(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "files").select("repo", "path", "language", "content").distinct()


def parse_functions(spark: SparkSession, d: str) -> DataFrame:
    return parsers.parse_functions(_files(spark, d))


def parse_classes(spark: SparkSession, d: str) -> DataFrame:
    return parsers.parse_classes(_files(spark, d))


def go_types(spark: SparkSession, d: str) -> DataFrame:
    """Types of Go files as the parser has them: name, kind and first line."""
    return parsers.parse_classes(_files(spark, d).where("language = 'go'")).select("file", "name", "kind", "line_start")


def go_functions(spark: SparkSession, d: str) -> DataFrame:
    """How many functions and methods the parser finds in a Go file."""
    rows = parsers.parse_functions(_files(spark, d).where("language = 'go'")).where("name <> '__file__'")
    return rows.groupBy("file").agg(F.count("*").alias("functions"))


def import_names(spark: SparkSession, d: str) -> DataFrame:
    return imports.extract(_files(spark, d)).select("path", "raw")


def god_chunks(spark: SparkSession, d: str) -> DataFrame:
    """The files of more than 6 functions cut to chunks, as the tables hold no god file of 10 000 lines."""
    f = fns(spark, d)
    big = f.groupBy("file").agg(F.count("*").alias("k")).where("k > 6").select("file")
    c = once(table(spark, d, "parsed_classes")).where("name is not null and line_start is not null").select("file", "name", "line_start", "line_end")
    return chunks.chunk(f.join(big, "file", "left_semi"), c)


def chunk_functions(spark: SparkSession, d: str) -> DataFrame:
    return chunks.chunk_functions(fns(spark, d))


def class_of_functions(spark: SparkSession, d: str) -> DataFrame:
    return chunks.innermost(fns(spark, d), once(table(spark, d, "parsed_classes")).where("name is not null"))


def modules_of_paths(spark: SparkSession, d: str) -> DataFrame:
    return _files(spark, d).select("path", text.module_of(F.col("path")).alias("module")).distinct()


def services_found(spark: SparkSession, d: str) -> DataFrame:
    """Services of each project: its folders with a manifest, or with the name of one."""
    below = _files(spark, d).select("repo", F.expr("substring(path, length(repo) + 2)").alias("path")).distinct()
    return code._folders(below, 0).select("service").distinct()


def service_calls(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "files").select("service", "path", "content").distinct()
    return code.service_edges(f)


def queue_calls(spark: SparkSession, d: str) -> DataFrame:
    return code.queue_edges(table(spark, d, "files").select("service", "path", "content").distinct())


def commit_months(spark: SparkSession, d: str) -> DataFrame:
    """Commits and churn of each project and month; commits without a readable date have month ''."""
    rows = once(table(spark, d, "commits")).withColumn("day", history.commit_date(F.col("date")))
    return rows.groupBy("repo", F.coalesce(F.date_format("day", "yyyy-MM"), F.lit("")).alias("month")).agg(F.count("*").alias("commits"), F.sum("churn").alias("churn"))


QUERIES = {f.__name__: f for f in (parse_functions, parse_classes, go_types, go_functions, import_names, god_chunks, chunk_functions, class_of_functions, modules_of_paths, services_found, service_calls, queue_calls, commit_months)}

_LAST = "regexp_replace(regexp_extract(rtrim(x, '/'), '([^/]*)$', 1), '(.)[.][^.]*$', '\\\\1')"
#: Names that files import, by the patterns of their languages.
IMPORT_NAMES = (
    """WITH p AS (SELECT DISTINCT path, language AS l, coalesce(content, '') AS t FROM files),
r AS (SELECT path, 'last' AS how, unnest(regexp_extract_all(t, '(?m)^\\s*import\\s+(?:static\\s+)?([\\w.]+)\\s*;', 1)) AS x FROM p WHERE l = 'java'
  UNION ALL SELECT path, 'plain', unnest(regexp_extract_all(t, '\\bnew\\s+([A-Z][A-Za-z0-9_]*)\\s*\\(', 1)) FROM p WHERE l = 'java'
  UNION ALL SELECT path, 'plain', unnest(regexp_extract_all(t, '\\bextends\\s+([A-Z][A-Za-z0-9_]*)\\b', 1)) FROM p WHERE l = 'java'
  UNION ALL SELECT path, 'plain', trim(unnest(flatten(list_transform(regexp_extract_all(t, '\\bimplements\\s+([A-Z][A-Za-z0-9_\\s,]*)\\b', 1), lambda s: string_split(s, ','))))) FROM p WHERE l = 'java'
  UNION ALL SELECT path, 'path', unnest(regexp_extract_all(t, 'import\\s+(?:[\\w*{}\\s,]+\\s+from\\s+)?[''"]([^''"]+)[''"]', 1)) FROM p WHERE l IN ('javascript', 'typescript')
  UNION ALL SELECT path, 'path', unnest(regexp_extract_all(t, 'require\\s*\\(\\s*[''"]([^''"]+)[''"]\\s*\\)', 1)) FROM p WHERE l IN ('javascript', 'typescript')
  UNION ALL SELECT path, 'first', unnest(regexp_extract_all(t, '(?m)^\\s*import\\s+([\\w.]+)', 1)) FROM p WHERE l = 'python'
  UNION ALL SELECT path, 'absolute', unnest(regexp_extract_all(t, '(?m)^\\s*from\\s+([\\w.]+)\\s+import', 1)) FROM p WHERE l = 'python'
  UNION ALL SELECT path, 'stem', unnest(regexp_extract_all(t, '"([\\w./\\-]+)"', 1)) FROM p WHERE l = 'go'
  UNION ALL SELECT path, 'crate', unnest(regexp_extract_all(t, '(?m)^\\s*use\\s+([\\w:]+)', 1)) FROM p WHERE l = 'rust'),
n AS (SELECT path, CASE how WHEN 'plain' THEN x WHEN 'last' THEN string_split(x, '.')[-1] WHEN 'first' THEN string_split(x, '.')[1] WHEN 'absolute' THEN CASE WHEN NOT starts_with(x, '.') THEN string_split(x, '.')[1] END
  WHEN 'path' THEN CASE WHEN starts_with(x, '.') THEN x ELSE """ + _LAST + """ END WHEN 'stem' THEN """ + _LAST + """
  WHEN 'crate' THEN CASE WHEN string_split(x, '::')[1] NOT IN ('crate', 'super', 'self', 'std', 'core', 'alloc') THEN string_split(x, '::')[1] ELSE string_split(x, '::')[2] END END AS raw FROM r)"""
)
_DAY = """coalesce(try_strptime(regexp_extract(trim(date), '^(\\d{4}-\\d{2}-\\d{2})', 1), '%Y-%m-%d'), try_strptime(trim(date), ['%Y/%m/%d', '%d.%m.%Y', '%m/%d/%Y', '%d %b %Y', '%b %d, %Y', '%Y%m%d']))"""
COMMITS = f"WITH cm AS (SELECT *, CAST({_DAY} AS DATE) AS day FROM (SELECT DISTINCT * EXCLUDE (ingested_at) FROM commits))"
ORACLE = {
    "commit_days": COMMITS + " SELECT DISTINCT hash, day FROM cm",
    "commit_months": COMMITS + " SELECT repo, coalesce(strftime(day, '%Y-%m'), '') AS month, count(*) AS commits, CAST(sum(churn) AS BIGINT) AS churn FROM cm GROUP BY ALL",
    "git_backward_loc": COMMITS + ", lo AS (SELECT repo, sum(len(string_split(coalesce(content, ''), chr(10)))) AS loc FROM (SELECT DISTINCT repo, path, content FROM files) GROUP BY repo), u AS (SELECT repo, hash, min(day) AS day, min(deletions - insertions) AS step FROM cm GROUP BY ALL), s AS (SELECT u.repo, hash, day, loc + sum(step) OVER (PARTITION BY u.repo ORDER BY day DESC NULLS LAST, hash) AS s FROM u JOIN lo ON lo.repo = u.repo), m AS (SELECT repo, hash, s, min(s) OVER (PARTITION BY repo ORDER BY day DESC NULLS LAST, hash) AS low FROM s) SELECT repo, hash, CAST(s - least(low, 0) AS BIGINT) AS loc FROM m",
    "services_found": """WITH p AS (SELECT DISTINCT repo, string_split(path[len(repo) + 2:], '/') AS s FROM files), g AS (SELECT s[1] AS service, repo, bool_or(len(s) = 2 AND (s[2] IN ('package.json', 'requirements.txt', 'pyproject.toml', 'setup.py', 'pom.xml', 'build.gradle', 'build.gradle.kts', 'go.mod', 'Cargo.toml', 'Dockerfile') OR ends_with(lower(s[2]), '.csproj'))) AS m FROM p
WHERE len(s) > 1 AND lower(s[1]) NOT IN ('node_modules', '.git', '__pycache__', '.venv', 'venv', 'dist', 'build', '.idea', '.vscode', 'uploads') GROUP BY ALL) SELECT DISTINCT service FROM g WHERE m OR regexp_matches(lower(service), '(service|svc)$|^service')""",
    "go_types": """WITH p AS (SELECT DISTINCT path, content AS t FROM files WHERE language = 'go' AND content IS NOT NULL), h AS (SELECT path, t, unnest(regexp_extract_all(t, '\\btype\\s+[A-Za-z_]\\w*(?:\\[[^\\]]*\\])?\\s+(?:struct|interface)\\s*\\{')) AS m FROM p)
SELECT path AS file, regexp_extract(m, 'type\\s+([A-Za-z_]\\w*)', 1) AS name, regexp_extract(m, '\\s(struct|interface)\\s*\\{$', 1) AS kind, CAST(len(string_split(left(t, strpos(t, m)), chr(10))) AS INT) AS line_start FROM h""",
    "go_functions": """WITH p AS (SELECT DISTINCT path, content AS t FROM files WHERE language = 'go' AND content IS NOT NULL), h AS (SELECT path, unnest(regexp_extract_all(t, '\\bfunc\\s+(?:\\([^)]+\\)\\s*)?([A-Za-z_]\\w*)\\s*(?:\\[[^\\]]*\\])?\\([^;{]*\\{', 1)) AS name FROM p)
SELECT path AS file, count(*) AS functions FROM h WHERE name NOT IN ('if', 'for', 'switch', 'select', 'return', 'go', 'defer', 'range', 'make', 'new', 'len', 'cap', 'append', 'copy', 'delete', 'close', 'panic', 'recover', 'print', 'println', 'func', 'constructor') GROUP BY path""",
    "import_names": IMPORT_NAMES + " SELECT DISTINCT path, raw FROM n WHERE raw <> ''",
    "unused_imports": IMPORT_NAMES + """, b AS (SELECT DISTINCT path, CASE l WHEN 'python' THEN regexp_replace(t, '(?m)^\\s*(?:import |from ).*$', '', 'g') WHEN 'java' THEN regexp_replace(t, '(?m)^\\s*import .*$', '', 'g') WHEN 'go' THEN regexp_replace(t, '(?ms)^\\s*import [(].*?^\\s*[)]\\s*?$|^\\s*import [^\\n]*$', '', 'g') WHEN 'rust' THEN regexp_replace(t, '(?m)^\\s*use .*$', '', 'g')
  ELSE regexp_replace(t, '(?m)^\\s*import .*$|^.*require[(].*=.*$|^.*=.*require[(].*$', '', 'g') END AS body FROM p)
SELECT DISTINCT n.path, n.raw FROM n JOIN b ON b.path = n.path WHERE n.raw <> '' AND NOT regexp_matches(body, '\\b' || regexp_escape(n.raw) || '\\b')""",
    "god_chunks": BASE + """b AS (SELECT DISTINCT file, name, line_start, line_end, complexity FROM f WHERE file IN (SELECT file FROM f GROUP BY file HAVING count(*) > 6)),
cl AS (SELECT DISTINCT file, name AS cls, line_start AS a, line_end AS z FROM parsed_classes WHERE name IS NOT NULL AND line_start IS NOT NULL),
w AS (SELECT *, max(complexity) OVER (PARTITION BY file) AS most, (row_number() OVER (PARTITION BY file ORDER BY line_start, name) - 1) // 50 AS g FROM b WHERE file NOT IN (SELECT file FROM cl)),
v AS (SELECT *, min(line_start) OVER (PARTITION BY file, g) AS lo, last_value(line_end) OVER (PARTITION BY file, g ORDER BY line_start, name ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS hi FROM w)
SELECT b.file, b.name, b.line_start, cls AS virtual_module, 'class' AS strategy FROM b JOIN cl ON cl.file = b.file AND b.line_start BETWEEN a AND z
UNION ALL SELECT file, name, line_start, CASE WHEN most <= 5 THEN 'Group ' || (g + 1) || ' (lines ' || lo || '–' || hi || ')' WHEN complexity > 15 THEN 'High Complexity' WHEN complexity > 5 THEN 'Medium Complexity' ELSE 'Low Complexity' END, CASE WHEN most <= 5 THEN 'line_range' ELSE 'complexity' END FROM v""",
    "chunk_functions": BASE + "k AS (SELECT file, virtual_module, name AS source, unnest(calls) AS target FROM f) SELECT DISTINCT k.file, k.virtual_module, source, target FROM k JOIN f ON f.file = k.file AND f.virtual_module = k.virtual_module AND f.name = k.target WHERE source <> target",
    "class_of_functions": BASE + "fx AS (SELECT DISTINCT file, name, line_start, line_end FROM f), cl AS (SELECT DISTINCT file, name AS cls, line_start AS a, line_end AS b FROM parsed_classes WHERE name IS NOT NULL), j AS (SELECT fx.*, min_by(cls, (b - a, cls)) AS class_name FROM fx JOIN cl ON cl.file = fx.file AND a <= fx.line_start AND fx.line_end <= b GROUP BY ALL) SELECT fx.file, fx.name, fx.line_start, j.class_name FROM fx LEFT JOIN j ON j.file = fx.file AND j.name = fx.name AND j.line_start = fx.line_start AND j.line_end = fx.line_end",
    "modules_of_paths": "WITH p AS (SELECT DISTINCT path, string_split(path, '/') AS s FROM files), q AS (SELECT path, s, list_position(s, 'src') AS k FROM p) SELECT path, CASE WHEN k > 0 THEN array_to_string(s[k + 1:-2], '/') WHEN len(s) > 1 THEN array_to_string(s[:-2], '/') ELSE '' END AS module FROM q",
    "service_calls": """WITH l AS (SELECT DISTINCT service, path, content FROM files WHERE service IS NOT NULL AND content IS NOT NULL), x AS (SELECT service, path, unnest(string_split(lower(content), chr(10))) AS low, generate_subscripts(string_split(content, chr(10)), 1) AS line_no FROM l),
y AS (SELECT *, regexp_matches(low, 'https?://') AS a, regexp_matches(low, 'axios|fetch[(]|requests[.](get|post|put|delete|patch)|httpx[.]|resttemplate|webclient|http[.](get|post)[(]|http[.]newrequest|reqwest::|httpclient|urlopen|xmlhttprequest') AS b FROM x),
w AS (SELECT service, path, line_no, CASE WHEN a AND b THEN CAST(0.85 AS DOUBLE) ELSE CAST(0.6 AS DOUBLE) END AS confidence, unnest(regexp_extract_all(low, '[a-z0-9][a-z0-9_-]{3,}')) AS host FROM y WHERE a OR b),
h AS (SELECT DISTINCT service AS target, unnest([lower(service), replace(lower(service), '_', '-'), replace(lower(service), '-', '_'), regexp_replace(lower(service), '[_-]', '', 'g')]) AS host FROM l)
SELECT w.service AS source, h.target, arg_min(path, (-confidence, path, line_no)) AS path, CAST(arg_min(line_no, (-confidence, path, line_no)) AS INT) AS line_no, max(confidence) AS confidence FROM w JOIN h ON h.host = w.host AND len(h.host) >= 4 WHERE w.service <> h.target GROUP BY ALL""",
    "queue_calls": """WITH l AS (SELECT DISTINCT service, path, content FROM files WHERE service IS NOT NULL AND content IS NOT NULL), x AS (SELECT service, path, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS line_no FROM l),
q AS (SELECT *, regexp_extract(line, '[''"`]([\\w.\\-]{3,64})[''"`]', 1) AS queue, regexp_matches(lower(line), 'channel[.]publish|channel[.]basic_publish|channel[.]sendtoqueue|producer[.]send|kafkaproducer[.]send|basicpublish') AS p, regexp_matches(lower(line), 'channel[.]consume|channel[.]basic_consume|consumer[.]subscribe|kafkaconsumer[.]subscribe|@rabbitlistener|@kafkalistener') AS c FROM x),
s AS (SELECT service AS source, queue, min((path, line_no)) AS pos FROM q WHERE p AND queue <> '' GROUP BY ALL)
SELECT s.source, h.service AS target, s.queue, s.pos[1] AS path, CAST(s.pos[2] AS INT) AS line_no, CAST(0.75 AS DOUBLE) AS confidence FROM s JOIN (SELECT DISTINCT service, queue FROM q WHERE c AND queue <> '') h ON h.queue = s.queue WHERE s.source <> h.service""",
}
