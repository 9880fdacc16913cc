"""The queries of the operators on source text and prose, as ``__spark_entry__`` registers them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweft.llm import credentials, encode, layout, mixing, prose, syntax
from codeweft.session import cut, table


def _secrets(files: DataFrame) -> DataFrame:
    rare = cut(credentials.confirm(credentials.index_literals(files)))
    return cut(credentials.without_words(rare, files))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "files")
    return credentials.find(files, _secrets(files))


def p1_redacted(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "files")
    return credentials.redact(files, _secrets(files))


def _kinds(spark: SparkSession, d: str) -> DataFrame:
    return layout.classify_files(table(spark, d, "files"), table(spark, d, "third_party"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _kinds(spark, d).where("kind <> ''").select("path").distinct()


def p4_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Files by language and kind; kind '' is hand-written."""
    return _kinds(spark, d).dropDuplicates(["path"]).groupBy("language", "kind").agg(F.count("*").alias("files"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    checked = syntax.check_files(table(spark, d, "files"))
    return checked.where("edits > 0").select("path").distinct()


def p5_rates(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "files")
    owner = files.groupBy("path").agg(F.max("repo").alias("repo"))
    checked = syntax.check_files(files).groupBy("path").agg(F.max("language").alias("language"), F.max("edits").alias("edits"), F.max("cause").alias("cause"))
    per = checked.join(owner, "path").groupBy("repo", "language")
    causes = [F.count_if(F.col("cause") == c).alias(c) for c in ("truncation", "conflict", "mismatch", "local")]
    out = per.agg(F.count("*").alias("files"), F.count_if(F.col("edits") > 0).alias("invalid"), *causes)
    return out.withColumn("rate", F.col("invalid") / F.col("files"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode.encode_corpus(table(spark, d, "documents"))


def _sizes(spark: SparkSession, d: str) -> DataFrame:
    return encode.token_counts(table(spark, d, "documents"), keep=("doc_id", "source"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    plan = mixing.mix_plan(_sizes(spark, d), table(spark, d, "mix_targets"))
    return plan.where("short").select("source")


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(cut(_sizes(spark, d)), table(spark, d, "mix_targets"))


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    sizes, targets = cut(_sizes(spark, d)), table(spark, d, "mix_targets")
    plan = mixing.mix_plan(sizes, targets)
    return mixing.mix_shares(mixing.mix(sizes, targets, plan=plan), plan)


def _types(spark: SparkSession, d: str) -> DataFrame:
    return prose.text_types(cut(prose.text_statistics(table(spark, d, "documents"), table(spark, d, "common_words"))))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _types(spark, d).where("prose < 0.5").select("doc_id")


def p8_statistics(spark: SparkSession, d: str) -> DataFrame:
    return _types(spark, d)


def queries() -> dict:
    names = [p1_found, p1_redacted, p4_found, p4_kinds, p5_found, p5_rates, p6_ids, p7_found, p7_mix, p7_shares, p8_found, p8_statistics]
    return {f.__name__: f for f in names}


def oracle_sql() -> dict[str, str]:
    return {}
