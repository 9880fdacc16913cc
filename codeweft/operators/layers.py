"""Architecture layers of files and imports, and imports that break their order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Keywords of each layer, in order of precedence; the order of layers; what each may import.
KEYWORDS = {
    "router": ("route", "routes", "router", "routers", "routing", "routings"),
    "controller": (
        "controller", "controllers", "handler", "handlers", "api", "view", "views", "presenter", "presenters", "endpoint", "endpoints", "resource", "resources",
        "rest", "graphql", "resolver", "resolvers", "action", "actions", "command", "commands", "request", "requests", "response", "responses",
    ),
    "service": (
        "service", "services", "usecase", "usecases", "use_case", "use_cases", "business", "interactor", "interactors", "application", "manager", "managers",
        "facade", "facades", "processor", "processors", "workflow", "workflows", "orchestrator", "orchestrators",
    ),
    "repository": ("repository", "repositories", "repo", "repos", "dao", "daos", "store", "stores", "storage", "gateway", "gateways", "finder", "finders"),
    "model": ("model", "models", "entity", "entities", "schema", "schemas", "dto", "dtos", "struct", "structs", "domain", "aggregate", "aggregates", "valueobject", "value_object"),
    "database": (
        "db", "database", "databases", "migration", "migrations", "seed", "seeds", "connection", "connections", "orm", "datasource", "data_source",
        "infrastructure", "infra", "persistence", "adapter", "adapters", "query", "queries",
    ),
    "middleware": ("middleware", "middlewares", "interceptor", "interceptors", "guard", "guards", "filter", "filters", "hook", "hooks", "plugin", "plugins", "decorator", "decorators"),
    "utility": (
        "util", "utils", "utility", "utilities", "helper", "helpers", "shared", "common", "lib", "libs", "constant", "constants", "config", "configs", "configuration",
        "logger", "logging", "log", "exception", "exceptions", "error", "errors", "validator", "validators", "validation", "formatter", "formatters",
        "converter", "converters", "mapper", "mappers", "types", "type",
    ),
}
ORDER = {"router": 0, "controller": 1, "middleware": 2, "service": 3, "repository": 4, "model": 5, "database": 5, "utility": -1, "unknown": -2}
ALLOWED = {
    "router": ("controller", "middleware", "utility"), "controller": ("service", "utility"), "middleware": ("service", "utility"),
    "service": ("repository", "model", "utility", "service"), "repository": ("model", "database", "utility"),
    "model": ("utility",), "database": ("utility",), "utility": ("utility",),
}


def transition(source: str, target: str) -> tuple[str, str] | None:
    """(kind, severity) of an import between layers, None where it is fine."""
    if source in ("unknown", "utility") or target in ("unknown", "utility", "router") or target in ALLOWED[source]:
        return None
    a, b = ORDER[source], ORDER[target]
    return ("reverse_dependency", "high") if b < a else ("cross_layer", "medium") if a == b else ("layer_skip", "high")


def transitions() -> list[tuple[str, str, str, str]]:
    return [(s, t, *x) for s in KEYWORDS for t in KEYWORDS if (x := transition(s, t))]


def _first(name: F.Column, pattern: str) -> F.Column:
    out = F
    for layer, words in KEYWORDS.items():
        out = out.when(name.rlike(pattern.format("|".join(words))), layer)
    return out


def file_layer(path: F.Column) -> F.Column:
    """Layer of the deepest folder that is a keyword, else of the file's name without its last extension if it begins with
    or ends in one, in the order of the layers; else 'unknown'."""
    p = F.regexp_replace(F.lower(F.replace(path, F.lit("\\"), F.lit("/"))), r"(?:/\.?)+\z", "")
    parts = F.split(p, "/")
    folders = F.reverse(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))))
    hits = F.filter(F.transform(folders, lambda x: _first(x, r"\A(?:{0})\z")), lambda x: x.isNotNull())
    stem = F.regexp_replace(F.regexp_extract(p, r"([^/]*)\z", 1), r"(?<=.)\.[^.]+\z", "")
    return F.coalesce(F.get(hits, F.lit(0)), _first(stem, r"\A(?:{0})|(?:{0})\z"), F.lit("unknown"))


def import_layer(raw: F.Column) -> F.Column:
    """Layer of an import specifier's deepest segment that is, begins with or ends in a keyword, without extensions of code."""
    bare = F.regexp_replace(F.lower(F.replace(raw, F.lit("\\"), F.lit("/"))), r"\.(?:jsx?|tsx?|py|java|go|rs|cs|cpp|c)\z", "")
    hits = F.filter(F.transform(F.reverse(F.split(bare, r"[/.]")), lambda x: _first(x, r"\A(?:{0})|(?:{0})\z")), lambda x: x.isNotNull())
    return F.coalesce(F.get(hits, F.lit(0)), F.lit("unknown"))


def violations(imports: DataFrame) -> DataFrame:
    """(path, raw, source_layer, target_layer, type, severity) of (path, raw) import rows that break the order."""
    table = imports.sparkSession.createDataFrame(transitions(), "source_layer string, target_layer string, type string, severity string")
    rows = imports.select("path", "raw").distinct().withColumn("source_layer", file_layer(F.col("path"))).withColumn("target_layer", import_layer(F.col("raw")))
    return rows.join(F.broadcast(table), ["source_layer", "target_layer"]).select("path", "raw", "source_layer", "target_layer", "type", "severity")


def by_module(violations_: DataFrame, fns: DataFrame) -> DataFrame:
    """(repo, module, count, severity): violations of each module, with the worst severity.

    A file's module is that of its last function row that has one, else its folder.
    """
    module = F.when(F.trim("module") != "", F.col("module"))
    of = fns.groupBy(F.col("file").alias("path")).agg(F.max_by(module, F.struct(module.isNotNull(), "line_start")).alias("m"))
    rows = violations_.join(of, "path", "left").withColumn("module", F.coalesce("m", F.regexp_replace("path", r"/?[^/]*\z", "")))
    worst = F.when(F.bool_or(F.col("severity") == "high"), "high").otherwise("medium")
    return rows.groupBy(F.split("path", "/")[0].alias("repo"), "module").agg(F.count("*").alias("count"), worst.alias("severity"))
