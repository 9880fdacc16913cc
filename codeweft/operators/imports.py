"""Imports of source files: extraction, resolution to files, and those never used."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


# For each language the patterns of what it imports or uses as if imported, in order, and how what they find
# becomes a name: its first or last part, the stem of a path, the first part that is no root of a crate, or a list of names.
PATTERNS = {
    "java": (
        (r"(?m)^\s*import\s+(?:static\s+)?([\w.]+)\s*;", "last"), (r"\bnew\s+([A-Z][A-Za-z0-9_]*)\s*\(", "plain"), (r"\bextends\s+([A-Z][A-Za-z0-9_]*)\b", "plain"),
        (r"\bimplements\s+([A-Z][A-Za-z0-9_\s,]*)\b", "list"),
    ),
    "javascript": ((r"import\s+(?:[\w*{}\s,]+\s+from\s+)?['\"]([^'\"]+)['\"]", "path"), (r"require\s*\(\s*['\"]([^'\"]+)['\"]\s*\)", "path")),
    "python": ((r"(?m)^\s*import\s+([\w.]+)", "first"), (r"(?m)^\s*from\s+([\w.]+)\s+import", "absolute")),
    "go": ((r"\"([\w./\-]+)\"", "stem"),),
    "rust": ((r"(?m)^\s*use\s+([\w:]+)", "crate"),),
    "c": ((r"#include\s+\"([^\"]+)\"", "stem"),),
    "csharp": ((r"(?m)^\s*using\s+(?:static\s+)?([\w.]+)\s*;", "last"),),
}
PATTERNS["typescript"], PATTERNS["cpp"] = PATTERNS["javascript"], PATTERNS["c"]
CRATE_ROOTS = ("crate", "super", "self", "std", "core", "alloc")
#: Lines that are no use of what they import; a Go block goes as a whole.
IMPORT_LINES = {
    "python": r"(?m)^\s*(?:import |from ).*$", "javascript": r"(?m)^\s*import .*$|^(?=.*require\()(?=.*=).*$", "java": r"(?m)^\s*import .*$",
    "go": r"(?ms)^\s*import \(.*?^\s*\)\s*?$|^\s*import [^\n]*$", "rust": r"(?m)^\s*use .*$", "c": r"(?m)^\s*#include.*$", "csharp": r"(?m)^\s*using .*$",
}
IMPORT_LINES["typescript"], IMPORT_LINES["cpp"] = IMPORT_LINES["javascript"], IMPORT_LINES["c"]


def stem(path: F.Column) -> F.Column:
    """The last part of a path without its last extension."""
    last = F.regexp_extract(F.regexp_replace(path, r"/+\z", ""), r"([^/]*)\z", 1)
    return F.regexp_replace(last, r"(?<=.)\.[^.]*\z", "")


def _named(found: F.Column, how: str) -> F.Column:
    """Names of what a pattern found; null for what names nothing."""
    if how == "list":
        return F.filter(F.flatten(F.transform(found, lambda x: F.transform(F.split(x, ","), lambda y: F.trim(y)))), lambda x: x != "")
    ways = {
        "plain": lambda x: x,
        "last": lambda x: F.element_at(F.split(x, r"\."), -1),
        "first": lambda x: F.split(x, r"\.")[0],
        "absolute": lambda x: F.when(~x.startswith("."), F.split(x, r"\.")[0]),
        "stem": stem,
        "path": lambda x: F.when(x.startswith("."), x).otherwise(stem(x)),
        "crate": lambda x: F.when(~F.split(x, "::")[0].isin(*CRATE_ROOTS), F.split(x, "::")[0]).otherwise(F.get(F.split(x, "::"), F.lit(1))),
    }
    return F.transform(found, ways[how])


def names(content: F.Column, language: F.Column) -> F.Column:
    """The imports of a text, each once, in the order of its language's patterns and of the text; none of other languages."""
    out = F
    for lang, patterns in PATTERNS.items():
        every = F.concat(*[_named(F.regexp_extract_all(F.coalesce(content, F.lit("")), F.lit(p), 1), how) for p, how in patterns])
        out = out.when(language == lang, F.array_distinct(F.filter(every, lambda x: x.isNotNull() & (x != ""))))
    return out


def extract(files: DataFrame) -> DataFrame:
    """(path, raw, pos): each file's imports once, in order. ``files`` has path, language and content."""
    rows = files.select("path", names(F.col("content"), F.col("language")).alias("n")).distinct()
    return rows.select("path", F.posexplode("n").alias("pos", "raw")).select("path", "raw", "pos")


def unused(files: DataFrame) -> DataFrame:
    """(path, raw): imports that stand as a word nowhere in the file but on its import lines."""
    body = F
    for lang, pattern in IMPORT_LINES.items():
        body = body.when(F.col("language") == lang, F.regexp_replace(F.coalesce("content", F.lit("")), pattern, ""))
    rows = files.select("path", names(F.col("content"), F.col("language")).alias("n"), body.alias("body")).where(F.size("n") > 0).distinct()
    quoted = lambda x: F.concat(F.lit(r"(?U)\b\Q"), x, F.lit(r"\E\b"))
    return rows.select("path", F.explode(F.filter("n", lambda x: ~F.rlike(F.col("body"), quoted(x)))).alias("raw"))


def resolve(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(path, raw, target): the file that a specifier means, by its last component and folder hints; not itself.

    A single candidate wins; else the candidate whose folders hold the hint deepest in the specifier, in the order of
    paths. Projects don't import from each other. A stem with many files is spread by its importing rows.
    """
    rows = imports.select("path", "raw").distinct().withColumn("repo", F.split("path", "/")[0])
    parts = F.filter(F.split(F.lower("raw"), r"[/.:\\]+"), lambda x: x != "")
    rows = rows.withColumn("parts", parts).where(F.size("parts") > 0)
    rows = rows.withColumn("stem", F.element_at("parts", -1)).withColumn("hints", F.reverse(F.slice("parts", 1, F.size("parts") - 1)))
    known = files.select("repo", F.col("path").alias("target")).distinct()
    known = known.withColumn("stem", F.lower(F.regexp_extract("target", r"([^/.]+)\.[^/.]+$", 1))).where("stem <> ''")
    known = known.withColumn("folders", F.split(F.lower(F.regexp_replace("target", r"/[^/]*$", "")), "/"))
    j = rows.join(known, ["repo", "stem"]).where("path <> target")
    at = F.array_position(F.transform("hints", lambda h: F.array_contains("folders", h)), True)
    best = F.struct(F.when(at == 0, F.lit(1 << 20)).otherwise(at).alias("rank"), F.col("target"))
    return j.groupBy("path", "raw").agg(F.min(best).alias("b")).select("path", "raw", F.col("b.target").alias("target"))
