"""Per-key results where a few keys hold most records: combine on the map side, shuffle compact states only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: All Unicode white space and the control characters that some languages strip with it.
BLANKS = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"


def call_sets(functions: DataFrame) -> DataFrame:
    """(k1, k2, names): each function's called names as one array; rows of one function are taken together.

    A function is (file, name, line_start), of which two hashes of 64 bits are the key, so that what is shuffled is 16
    bytes and one array a function, not a row a pair. Repeats that say the same fall together before the shuffle. The
    function is shuffled on, never the called name, so no called name gathers rows in one task. Blank and null entries
    are left out, ``__file__`` rows are none, null key parts count as values.
    """
    rows = functions.where(F.col("name").isNull() | (F.col("name") != "__file__"))
    names = F.array_sort(F.array_distinct(F.filter(F.transform("calls", lambda x: F.regexp_replace(x, BLANKS, "")), lambda x: x.isNotNull() & (x != ""))))
    parts = [x for c in ("file", "name", "line_start") for x in (F.col(c).isNull(), F.col(c))]
    rows = rows.select(F.xxhash64(*parts).alias("k1"), F.xxhash64(F.lit("second"), *reversed(parts)).alias("k2"), names.alias("names"))
    return rows.groupBy("k1", "k2").agg(F.collect_set("names").alias("every")).select("k1", "k2", F.when(F.size("every") == 1, F.get("every", F.lit(0))).otherwise(F.array_distinct(F.flatten("every"))).alias("names"))


def callers_per_name(functions: DataFrame) -> DataFrame:
    """(callee, callers): calling functions of each called name.

    The count is algebraic: each task adds up its own rows in a bounded hash table that spills, and what is shuffled by
    name is at most one partial count for each name and task.
    """
    pairs = call_sets(functions).select(F.explode("names").alias("callee"))
    return pairs.groupBy("callee").agg(F.count("*").alias("callers"))


def heavy_names(functions: DataFrame, percent: int = 1) -> DataFrame:
    """(callee, callers) of the called names with at least ``percent`` of all pairs."""
    per = callers_per_name(functions)
    total = per.agg(F.sum("callers")).scalar()
    return per.where(F.col("callers") * 100 >= total * percent)
