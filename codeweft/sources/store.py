"""Tables of sessions: each is written by session, so that an upload replaces what its session had and nothing else."""

from __future__ import annotations

import os
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweft.operators.classes import ClassGraph
from codeweft.session import cut

#: What makes a row of each table one row.
KEYS = {
    "files": ("session_id", "path", "language"), "functions": ("session_id", "file", "name", "line_start"), "calls": ("session_id", "caller", "caller_file", "callee", "callee_file"),
    "chunks": ("session_id", "file", "virtual_module"), "classes": ("session_id", "repo", "name"), "inherits": ("session_id", "repo", "child", "parent"), "implements": ("session_id", "repo", "child", "parent"),
    "has_field": ("session_id", "repo", "owner", "field", "type"), "methods": ("session_id", "repo", "class", "name", "calls"), "unresolved": ("session_id", "repo", "name", "how"),
    "statements": ("function_id", "id"), "control_deps": ("function_id", "to_id"), "runs": ("run_id",), "executed": ("run_id", "ord"), "data_deps": ("run_id", "from_id", "to_id", "variable"),
}


def store(df: DataFrame, path: str) -> None:
    """Write rows by session; sessions that ``df`` holds are replaced, others stay."""
    df.write.option("partitionOverwriteMode", "dynamic").partitionBy("session_id").mode("overwrite").parquet(path)


def read(spark: SparkSession, folder: str, name: str) -> DataFrame | None:
    """A table of the store, or None before its first row."""
    try:
        return spark.read.parquet(os.path.join(folder, name))
    except AnalysisException:  # no such folder, or no file in it
        return None


def store_all(folder: str, session_id: str, files: DataFrame, functions: DataFrame) -> None:
    """Files, functions, calls between functions and chunks of one session; repeats of a key are one row."""
    sid = F.lit(session_id)
    tables = {"files": files, "functions": functions}
    f = functions.where(F.col("name") != "__file__")
    calls = f.select(F.col("name").alias("caller"), F.col("file").alias("caller_file"), F.explode("calls").alias("callee"))
    tables["calls"] = calls.join(f.select(F.col("name").alias("callee"), F.col("file").alias("callee_file")), "callee")
    tables["chunks"] = f.where("virtual_module is not null and virtual_module <> file").groupBy("file", "virtual_module").agg(F.count("*").alias("functions"))
    for name, df in tables.items():
        store(df.withColumn("session_id", sid).dropDuplicates([*KEYS[name]]), os.path.join(folder, name))


def store_class_graph(folder: str, session_id: str, g: ClassGraph) -> None:
    """Classes, what they inherit and implement, fields, methods, and parents that no class is, of one session."""
    tables = {"classes": g.classes, "inherits": g.inherits, "implements": g.implements, "has_field": g.fields, "methods": g.methods, "unresolved": g.unresolved()}
    for name, df in tables.items():
        store(df.withColumn("session_id", F.lit(session_id)).dropDuplicates([*KEYS[name]]), os.path.join(folder, name))


def add_edge(spark: SparkSession, folder: str, session_id: str, caller: str, callee: str) -> None:
    """One call between functions of a session; each that has the name. An edge that is there stays one."""
    f = read(spark, folder, "functions").where(F.col("session_id") == session_id)
    a = f.where(F.col("name") == caller).select(F.col("name").alias("caller"), F.col("file").alias("caller_file"))
    b = f.where(F.col("name") == callee).select(F.col("name").alias("callee"), F.col("file").alias("callee_file"))
    new = a.join(b).withColumn("session_id", F.lit(session_id))  # the definitions of two names
    old = read(spark, folder, "calls")
    known = new if old is None else old.where(F.col("session_id") == session_id).unionByName(new)
    store(cut(known.distinct()), os.path.join(folder, "calls"))  # written before the session's own rows are replaced


def delete_session(spark: SparkSession, folder: str, session_id: str) -> None:
    """Remove a session's rows from all tables that are kept by session."""
    for name in KEYS:
        path = spark._jvm.org.apache.hadoop.fs.Path(os.path.join(folder, name, f"session_id={session_id}"))
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def append_new(df: DataFrame, folder: str, name: str, key: tuple[str, ...]) -> None:
    """Add the rows whose ``key`` the table does not hold yet, each once."""
    old = read(df.sparkSession, folder, name)
    new = df.dropDuplicates([*KEYS[name]])
    new = new if old is None else new.join(old.select(*key).distinct(), [*key], "left_anti")
    cut(new).write.mode("append").parquet(os.path.join(folder, name))


def store_statements(folder: str, statements: DataFrame) -> None:
    """Statements and control edges of functions that are not stored yet: (function_id, id, line, kind, source, reads, writes,
    parent, branch)."""
    edges = statements.where("parent is not null").select("function_id", F.col("parent").alias("from_id"), F.col("id").alias("to_id"), "branch")
    append_new(edges, folder, "control_deps", ("function_id",))
    append_new(statements.drop("parent", "branch"), folder, "statements", ("function_id",))


def store_run(folder: str, run: DataFrame, executed: DataFrame, data_deps: DataFrame) -> None:
    """A run (run_id, function_id, inputs, status, error), what it executed (run_id, ord, id) and its data dependencies."""
    append_new(run, folder, "runs", ("run_id",))
    append_new(executed, folder, "executed", ("run_id",))
    append_new(data_deps, folder, "data_deps", ("run_id",))


def repeated_keys(spark: SparkSession, folder: str) -> DataFrame:
    """(table, n): how many rows of a table share their key with another; none for a store in order."""
    found = [(n, t) for n in KEYS if (t := read(spark, folder, n)) is not None]
    rows = [t.groupBy(*KEYS[n]).agg(F.count("*").alias("k")).where("k > 1").agg(F.coalesce(F.sum("k"), F.lit(0)).alias("n")).select(F.lit(n).alias("table"), "n") for n, t in found]
    return reduce(DataFrame.union, rows).where("n > 0") if rows else spark.createDataFrame([], "table string, n long")
