"""Architecture patterns of projects, by keywords in paths and the direction of calls between files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Words in a path that stand for a part of a pattern; in TIERS and RINGS the first that fits counts.
MODEL, VIEW, SPARE_MODEL = ("model", "schema", "entity"), ("view", "template", "page", "pages"), ("service", "repository", "repo")
TIERS = (("controller", "route", "view", "api", "handler"), ("service", "usecase", "use_case", "logic", "manager"), ("repository", "repo", "dao", "database", "db", "store"))
RINGS = (
    ("entity", "entities", "domain", "model"), ("usecase", "use_case", "interactor", "application"), ("controller", "presenter", "gateway", "interface", "adapter"),
    ("framework", "infra", "infrastructure", "db", "web", "external"),
)
DOMAIN, PORTS, ADAPTERS, REPOSITORY = ("domain", "core"), ("port", "interface"), ("adapter", "infra", "infrastructure"), ("repository", "repo")
CRUD = ("find", "save", "update", "delete", "query", "execute", "fetch", "insert", "get", "create", "findall", "findbyid", "findbyemail")
LEAST = 55


def _has(column: F.Column, words: tuple[str, ...]) -> F.Column:
    return reduce(lambda a, b: a | b, [F.contains(column, F.lit(w)) for w in words])


def _place(column: F.Column, groups: tuple[tuple[str, ...], ...]) -> F.Column:
    out = F
    for k, words in enumerate(groups):
        out = out.when(_has(column, words), k)
    return out


def parts(files: DataFrame) -> DataFrame:
    """(repo, path, base, the parts of patterns that a path stands for, tier, ring) of each file."""
    p = F.lower(F.replace("path", F.lit("\\"), F.lit("/")))
    words = {"model": MODEL, "view": VIEW, "spare": SPARE_MODEL, "controller": ("controller",), "presenter": ("presenter",), "domain": DOMAIN, "port": PORTS, "adapter": ADAPTERS, "repository": REPOSITORY, "service": ("service",)}
    return files.select("repo", "path", F.regexp_extract(p, r"([^/]*)\z", 1).alias("base"), *[_has(p, w).alias(k) for k, w in words.items()], _place(p, TIERS).alias("tier"), _place(p, RINGS).alias("ring")).distinct()


def detect(files: DataFrame, fns: DataFrame, calls: DataFrame) -> DataFrame:
    """(repo, pattern, violations, confidence_pct) of the five patterns, LEAST and above.

    ``calls`` is (repo, source, target, n): calls between files, those within a file too. Confidence falls with the calls
    against the pattern: views that call models, lower tiers that call upper ones, inner rings outer ones, the domain its
    ports and adapters. Service and repository files stand in where there are no models.
    """
    p = parts(files)
    named = ("model", "view", "spare", "domain", "port", "adapter", "tier", "ring")
    have = p.groupBy("repo").agg(
        *[F.bool_or(k).alias(k) for k in ("model", "view", "spare", "controller", "presenter", "domain", "port", "adapter", "repository", "service")],
        F.countDistinct("tier").alias("tiers"), F.countDistinct("ring").alias("rings"),
    )
    src = p.select("repo", F.col("path").alias("source"), *[F.col(k).alias(f"s_{k}") for k in named])
    dst = p.select("repo", F.col("path").alias("target"), *[F.col(k).alias(f"t_{k}") for k in named])
    e = calls.join(src, ["repo", "source"]).join(dst, ["repo", "target"]).join(have.select("repo", F.col("model").alias("has_model")), "repo")
    apart = "source <> target"
    wrong = e.groupBy("repo").agg(
        F.count_if(F.expr(f"{apart} and s_view and if(has_model, t_model, t_spare)")).alias("view_model"),
        F.count_if(F.expr(f"{apart} and s_domain and (t_port or t_adapter)")).alias("outward"),
        F.sum(F.expr("if(s_tier <> t_tier, n, 0)")).alias("tier_calls"), F.sum(F.expr("if(s_tier > t_tier, n, 0)")).alias("tier_up"),
        F.sum(F.expr("if(s_ring <> t_ring, n, 0)")).alias("ring_calls"), F.sum(F.expr("if(s_ring < t_ring, n, 0)")).alias("ring_out"),
    )
    base = lambda c: F.regexp_extract(F.lower(c), r"([^/]*)\z", 1)
    repos = p.where("repository").select("repo", "base").distinct()
    crud = fns.where(_has(F.lower("name"), CRUD)).select("repo", base("file").alias("base")).join(repos, ["repo", "base"], "left_semi").select("repo").distinct().withColumn("crud", F.lit(1))
    called = calls.where(F.contains(F.lower("source"), F.lit("service"))).select("repo", base("target").alias("base")).join(repos, ["repo", "base"], "left_semi").select("repo").distinct().withColumn("called", F.lit(1))
    t = have.join(wrong, "repo", "left").join(crud, "repo", "left").join(called, "repo", "left").na.fill(0)
    rules = (
        ("if(presenter and not controller, 'MVP', 'MVC')", "(model or spare) and view and (controller or presenter)", "view_model", "(3 - view_model) / 3.0"),
        ("'Layered/N-Tier'", "tiers >= 2", "tier_up", "greatest(0.4D, 0.95D - 0.5D * coalesce(try_divide(tier_up, tier_calls), 0D))"),
        ("'Clean Architecture'", "rings >= 3", "ring_out", "greatest(0.3D, 0.95D - coalesce(try_divide(ring_out, ring_calls), 0D))"),
        ("'Hexagonal Architecture'", "domain and (port or adapter)", "outward", "greatest(0.4D, 0.9D - 0.1D * outward)"),
        ("'Repository Pattern'", "repository", "0L", "(1 + crud + called + int(service)) / 4.0"),
    )
    out = [t.where(cond).select("repo", F.expr(name).alias("pattern"), F.expr(v).cast("long").alias("violations"), F.expr(f"cast(floor(({c}) * 100 + 0.5 + 1e-9) as int)").alias("confidence_pct")) for name, cond, v, c in rules]
    return reduce(DataFrame.unionByName, out).where(F.col("confidence_pct") >= LEAST)
