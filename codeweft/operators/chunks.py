"""God files in pseudo-modules: by class, else by complexity, else by groups of lines; and the graph between them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Functions of a group by lines.
GROUP = 50
# Complexity above which a function is of high or medium complexity.
HIGH, MEDIUM = 15, 5


def innermost(functions: DataFrame, classes: DataFrame) -> DataFrame:
    """(file, name, line_start, class_name): the smallest class around each function by lines, null for none.

    The join is on the file; a file's classes are few beside its functions.
    """
    f = functions.select("file", "name", "line_start", "line_end").distinct()
    c = classes.select("file", F.col("name").alias("class_name"), F.col("line_start").alias("a"), F.col("line_end").alias("b")).distinct()
    j = f.join(c, "file").where((F.col("a") <= F.col("line_start")) & (F.col("line_end") <= F.col("b")))
    best = j.groupBy("file", "name", "line_start", "line_end").agg(F.min_by("class_name", F.struct(F.col("b") - F.col("a"), "class_name")).alias("class_name"))
    return f.join(best, ["file", "name", "line_start", "line_end"], "left").select("file", "name", "line_start", "class_name")


def chunk(functions: DataFrame, classes: DataFrame) -> DataFrame:
    """(file, name, line_start, virtual_module, strategy) of the functions of god files.

    By class, where the file has any: each function by the class whose lines hold its first one, those in none left out, as
    the reference result has it. Else by complexity, if any function is beyond simple; else GROUP functions together in the
    order of lines, named by their number and lines.
    """
    f = functions.select("file", "name", "line_start", "line_end", "complexity").distinct()
    c = classes.select("file", F.col("name").alias("cls"), F.col("line_start").alias("a"), F.col("line_end").alias("b")).distinct()
    by_class = f.join(c, "file").where(F.col("line_start").between(F.col("a"), F.col("b"))).select("file", "name", "line_start", F.col("cls").alias("virtual_module"), F.lit("class").alias("strategy"))
    rest = f.join(c.select("file").distinct(), "file", "left_anti")
    w = Window.partitionBy("file")
    rest = rest.withColumn("most", F.max("complexity").over(w)).withColumn("group", F.floor((F.row_number().over(w.orderBy("line_start", "name")) - 1) / GROUP))
    kind = F.when(F.col("complexity") > HIGH, "High Complexity").when(F.col("complexity") > MEDIUM, "Medium Complexity").otherwise("Low Complexity")
    in_group = Window.partitionBy("file", "group")
    last = F.max_by("line_end", F.struct("line_start", "name")).over(in_group)
    lines = F.format_string("Group %d (lines %d–%d)", F.col("group") + 1, F.min("line_start").over(in_group), last)
    simple = F.col("most") <= MEDIUM
    rest = rest.select("file", "name", "line_start", F.when(simple, lines).otherwise(kind).alias("virtual_module"), F.when(simple, "line_range").otherwise("complexity").alias("strategy"))
    return by_class.union(rest)


def chunk_functions(functions: DataFrame) -> DataFrame:
    """(file, virtual_module, source, target): calls between functions of one chunk, without those to themselves."""
    f = functions.select("file", "virtual_module", "name", "calls")
    calls = f.select("file", "virtual_module", F.col("name").alias("source"), F.explode("calls").alias("target")).where("source <> target")
    here = f.select("file", "virtual_module", F.col("name").alias("target")).distinct()
    return calls.join(here, ["file", "virtual_module", "target"], "left_semi").select("file", "virtual_module", "source", "target").distinct()
