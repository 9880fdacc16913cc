"""Base relations that every analysis starts from, each free of repeats and keyed by ``repo`` (the session's project)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweft.operators.heavy import BLANKS

#: Columns that tell repeats of one record apart and nothing else.
ARRIVAL = ("ingested_at", "parsed_at", "uploaded_at", "session_id")
SENTINEL = "__file__"


def once(df: DataFrame) -> DataFrame:
    """Rows without the columns of arrival, each once."""
    return df.drop(*[c for c in ARRIVAL if c in df.columns]).distinct()


def clean_calls() -> F.Column:
    """A row's calls trimmed, distinct, and without blanks."""
    return F.array_distinct(F.filter(F.transform(F.coalesce("calls", F.array().cast("array<string>")), lambda x: F.regexp_replace(x, BLANKS, "")), lambda x: x.isNotNull() & (x != "")))


def functions(df: DataFrame) -> DataFrame:
    """Function rows without sentinels; calls trimmed, distinct, sorted, and without blanks."""
    rows = once(df.where(F.col("name") != SENTINEL)).withColumn("calls", F.array_sort(clean_calls()))
    return rows.withColumn("lines", F.col("line_end") - F.col("line_start"))


def call_edges(fns: DataFrame) -> DataFrame:
    """(repo, file, module, src, dst): each function row's called names."""
    return fns.select("repo", "file", "module", F.col("name").alias("src"), F.explode("calls").alias("dst"))


def raw_calls(df: DataFrame) -> DataFrame:
    """(repo, src, dst) of raw function rows as they come: with repeats, self edges and called names that no row defines."""
    return df.where(F.col("name") != SENTINEL).select("repo", F.col("name").alias("src"), F.explode(clean_calls()).alias("dst"))


def last_definition(fns: DataFrame) -> DataFrame:
    """(repo, name, file, module, line_start) of each name's last row in the order of file and line."""
    at = F.struct("file", "line_start")
    return fns.groupBy("repo", "name").agg(F.max_by("file", at).alias("file"), F.max_by(F.coalesce("module", F.lit("")), at).alias("module"), F.max_by("line_start", at).alias("line_start"))


def name_graph(fns: DataFrame) -> DataFrame:
    """(repo, src, dst) between defined names of a project, without self edges; same-named rows are merged."""
    names = fns.select("repo", F.col("name").alias("dst")).distinct()
    edges = call_edges(fns).select("repo", "src", "dst").where("src <> dst").distinct()
    return edges.join(names, ["repo", "dst"], "left_semi").select("repo", "src", "dst")
