"""Halstead measures and the maintainability index of projects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweft.functions import text

# Operator words and marks, and what is taken out before counting.
KEYWORDS = "if elif else while for switch case default do return break continue throw raise yield new delete typeof instanceof class function def lambda try catch except finally async await import from and or not in is with var let const pub fn impl use match struct enum".split()
MARKS = r"<<=?|>>=?|\*\*|//|->|=>|::|[+\-*/%&|^~]=?|[<>!=]=?|&&|\|\||[?:,;]"
WORD = r"[A-Za-z_][A-Za-z0-9_]*"
NOISE = r"(?s)\"\"\".*?\"\"\"|'''.*?'''|\"[^\"\\]*\"|'[^'\\]*'|`[^`]*`|//[^\n]*|/\*.*?\*/|#[^\n]*"


def halstead(files: DataFrame) -> DataFrame:
    """(repo, n1, n2, total1, total2) from (repo, path, content): distinct and all operators and identifiers.

    A word counts as an identifier in the files before the first, by path, that uses it as an operator. Tokens are added
    up for each file and word before they are shuffled by word.
    """
    clean = F.regexp_replace(F.coalesce("content", F.lit("")), NOISE, " ")
    rows = files.select("repo", "path", clean.alias("t"))
    words = rows.select("repo", "path", F.explode(F.regexp_extract_all("t", F.lit(WORD), 0)).alias("w")).groupBy("repo", "path", "w").agg(F.count("*").alias("k"))
    marks = rows.select("repo", F.explode(F.regexp_extract_all("t", F.lit(MARKS), 0)).alias("w")).groupBy("repo", "w").agg(F.count("*").alias("k"))
    is_op = F.col("w").isin(*KEYWORDS)
    first = words.where(is_op).groupBy("repo", "w").agg(F.min("path").alias("first"))
    ops = words.where(is_op).groupBy("repo", "w").agg(F.sum("k").alias("k")).union(marks)
    ids = words.join(first, ["repo", "w"], "left").where("first is null or path < first").groupBy("repo", "w").agg(F.sum("k").alias("k"))
    a = ops.groupBy("repo").agg(F.count("*").alias("n1"), F.sum("k").alias("total1"))
    b = ids.groupBy("repo").agg(F.count("*").alias("n2"), F.sum("k").alias("total2"))
    return a.join(b, "repo", "full").na.fill(0)


def measures(counts: DataFrame) -> DataFrame:
    """(repo, vocab, volume, difficulty, effort), rounded half up."""
    vocab, length = F.col("n1") + F.col("n2"), F.col("total1") + F.col("total2")
    volume = length * F.log2(F.greatest(vocab, F.lit(2)))
    difficulty = F.col("n1") / 2 * (F.col("total2") / F.greatest("n2", F.lit(1)))
    return counts.select("repo", vocab.alias("vocab"), text.round_half_up(volume, 1).alias("volume"), text.round_half_up(difficulty, 1).alias("difficulty"), F.floor(difficulty * volume + 0.5).alias("effort"))
