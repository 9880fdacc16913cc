"""Sources of code: folders, ZIP archives, git logs, services and what they say to one another."""

from __future__ import annotations

import io
import os
import re
import subprocess
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Folders that are skipped, extensions and their languages, size and depth limits of the features, files that
# make a folder a service, and marks of calls between services.
SKIP_DIRS = ("node_modules", ".git", "__pycache__", ".venv", "venv", "dist", "build", ".idea", ".vscode", "uploads")
LANGUAGES = {
    "py": "python", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "java": "java", "go": "go", "rs": "rust",
    "c": "c", "cpp": "cpp", "cs": "csharp",
}
MOST_BYTES, MOST_FILES, MOST_DEPTH, MOST_UPLOAD, MOST_COMMITS, DELTA_COMMITS = 2000 * 1024, 1000, 50, 50 * 1024 * 1024, 30, 20
MANIFESTS = ("package.json", "requirements.txt", "pyproject.toml", "setup.py", "pom.xml", "build.gradle", "build.gradle.kts", "go.mod", "Cargo.toml", "Dockerfile")
HTTP_MARKS = (
    "axios", "fetch(", "requests.get", "requests.post", "requests.put", "requests.delete", "requests.patch", "httpx.", "resttemplate", "webclient", "http.get(", "http.post(",
    "http.newrequest", "reqwest::", "httpclient", "urlopen", "xmlhttprequest",
)
PUBLISH_MARKS = ("channel.publish", "channel.basic_publish", "channel.sendtoqueue", "producer.send", "kafkaproducer.send", "basicpublish")
CONSUME_MARKS = ("channel.consume", "channel.basic_consume", "consumer.subscribe", "kafkaconsumer.subscribe", "@rabbitlistener", "@kafkalistener")
FILES = "path string, language string, size long, content string, ord long"


def language(path: F.Column) -> F.Column:
    """Language by extension; null for others."""
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z]+)$", 1))
    return F.element_at(F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv]), F.when(ext != "", ext))


def skipped(path: F.Column) -> F.Column:
    return F.arrays_overlap(F.transform(F.split(path, "/"), lambda x: F.lower(x)), F.array(*map(F.lit, SKIP_DIRS)))


def _decoded(content: str) -> F.Column:
    """Bytes as text; those that are no UTF-8 are left out."""
    raw = F.col(content).cast("string")
    return F.when(F.is_valid_utf8(raw), raw).otherwise(F.replace(F.make_valid_utf8(raw), F.lit("\ufffd"), F.lit("")))


def validate_upload(files: DataFrame) -> DataFrame:
    """(path, size, error): why an upload is refused, null if it isn't: its size, or an extension that is neither code nor ZIP."""
    known = language(F.col("path")).isNotNull() | F.lower("path").endswith(".zip")
    error = F.when(F.col("size") > MOST_UPLOAD, "too large").when(~F.coalesce(known, F.lit(False)), "unknown extension")
    return files.select("path", "size", error.alias("error"))


def upload_folder(files: DataFrame, most: int = MOST_FILES - 1) -> DataFrame:
    """The rows of an uploaded list of files (path, size, content, ord) that are kept, with clean paths: those that stay below
    the folder, in no skipped one, with a known extension and size; the first ``most`` in their order."""
    path = F.regexp_replace(F.replace("path", F.lit("\\"), F.lit("/")), r"^(?:\./)+", "")
    rows = files.withColumn("path", path).where(~F.col("path").rlike(r"^/|^[A-Za-z]:|(?:^|/)\.\.(?:/|$)") & (F.col("path") != ""))
    rows = rows.withColumn("language", language(F.col("path"))).where(F.col("language").isNotNull() & ~skipped(F.col("path")) & (F.col("size") <= MOST_BYTES))
    return rows.orderBy("ord").limit(most)


def scan_folder(spark: SparkSession, root: str, most: int | None = None) -> DataFrame:
    """Files below ``root`` as FILES, by path; skipped folders, unknown extensions and larger files are left out.

    ``most`` is the upload feature's cap on files; without it all files come.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    path = F.substring_index(F.col("path"), root.rstrip("/") + "/", -1)
    rows = raw.where(F.col("length") <= MOST_BYTES).select(path.alias("path"), F.col("length").alias("size"), "content")
    rows = rows.withColumn("language", language(F.col("path"))).where(F.col("language").isNotNull() & ~skipped(F.col("path")))
    rows = rows.select("path", "language", "size", _decoded("content").alias("content"), F.xxhash64("path").alias("ord"))
    return rows.orderBy("path").limit(most) if most is not None else rows


def safe_member(name: str) -> bool:
    """A member path that stays within the archive and no deeper than MOST_DEPTH."""
    parts = name.replace("\\", "/").split("/")
    return not name.startswith(("/", "\\")) and ".." not in parts and len(parts) <= MOST_DEPTH and not name.endswith("/")


def scan_zips(spark: SparkSession, pattern: str, most: int = MOST_FILES) -> DataFrame:
    """Members of all ZIP archives that match: (archive, path, size, content, error, language); archives are read in parallel.

    An archive that can't be read, or has more than ``most`` members to keep (the upload feature's limit), is one row with
    its ``error`` and no path.
    """

    def members(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for archive, data in zip(pdf["path"], pdf["content"]):
                rows, error = [], None
                try:
                    with zipfile.ZipFile(io.BytesIO(data)) as z:
                        keep = [m for m in z.infolist() if safe_member(m.filename) and m.file_size <= MOST_BYTES]
                        if len(keep) > most:
                            error = "too many members"
                        else:
                            rows = [(archive, m.filename, m.file_size, z.read(m).decode("utf-8", "ignore"), None) for m in keep]
                except (zipfile.BadZipFile, RuntimeError, NotImplementedError, zlib.error) as e:
                    error = f"unreadable: {type(e).__name__}"
                if error:
                    rows = [(archive, None, None, None, error)]
                yield pd.DataFrame(rows, columns=["archive", "path", "size", "content", "error"])

    raw = spark.read.format("binaryFile").load(pattern).where(F.col("length") <= MOST_UPLOAD).select("path", "content")
    rows = raw.mapInPandas(members, "archive string, path string, size long, content string, error string")
    rows = rows.withColumn("language", language(F.col("path")))
    return rows.where(F.col("error").isNotNull() | F.col("language").isNotNull() & ~skipped(F.col("path")))


def git_log(lines: DataFrame, most: int | None = None) -> DataFrame:
    """Commits of (repo, line_no, line) of a log with numstat whose headers are COMMIT|hash|message|author|date.

    The newest come first in a log; ``most`` keeps that many of each repo (the history feature takes MOST_COMMITS). Binary
    counts are 0.
    """
    w = Window.partitionBy("repo").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    is_head = F.col("line").startswith("COMMIT|")
    rows = lines.withColumn("head", F.last(F.when(is_head, F.col("line")), ignorenulls=True).over(w)).withColumn("ord", F.sum(is_head.cast("int")).over(w)).where("ord > 0")
    rows = rows.where(F.col("ord") <= most) if most is not None else rows
    p, n = F.split(F.rtrim("head"), r"\|", 5), F.split("line", "\t")
    num = lambda k: F.coalesce(F.when(F.get(n, F.lit(k)).rlike(r"^\d+$"), F.get(n, F.lit(k)).try_cast("long")), F.lit(0))
    stat = ~is_head & F.contains("line", F.lit("\t"))
    out = rows.groupBy("repo", "ord", "head").agg(F.sum(F.when(stat, num(0)).otherwise(0)).alias("insertions"), F.sum(F.when(stat, num(1)).otherwise(0)).alias("deletions"), F.count_if(stat).alias("files_changed"))
    part = lambda k, name: F.coalesce(F.get(p, F.lit(k)), F.lit("")).alias(name)
    return out.select("repo", "ord", part(1, "hash"), part(2, "message"), part(3, "author"), part(4, "date"), "insertions", "deletions", (F.col("insertions") + F.col("deletions")).alias("churn"), "files_changed")


def function_deltas(diffs: DataFrame, most: int = DELTA_COMMITS) -> DataFrame:
    """(repo, hash, fn_added, fn_removed) of diff lines (repo, hash, ord, line): lines that define a function or class.

    Only a repo's first ``most`` commits by ``ord`` are looked at, as the feature does; the others aren't listed.
    """
    defines = r"^\{0}(?!\{0}).*\b(?:def|function|func|fn|class)\s+\w"
    first = diffs.select("repo", "hash", "ord").distinct().withColumn("r", F.row_number().over(Window.partitionBy("repo").orderBy("ord", "hash"))).where(F.col("r") <= most)
    rows = diffs.join(first.select("repo", "hash"), ["repo", "hash"], "left_semi")
    return rows.groupBy("repo", "hash").agg(F.count_if(F.col("line").rlike(defines.format("+"))).alias("fn_added"), F.count_if(F.col("line").rlike(defines.format("-"))).alias("fn_removed"))


def git_root(root: str) -> str | None:
    """The repository's folder: ``root`` itself, or the first folder in it that is one."""
    for folder in (root, *sorted(e.path for e in os.scandir(root) if e.is_dir())):
        if os.path.isdir(os.path.join(folder, ".git")):
            return folder
    return None


def git_totals(repo: str) -> tuple[int, str]:
    """(number of commits, current branch) of a repository on this machine; (0, 'HEAD') if git can't tell."""

    def ask(*args: str) -> str:
        try:
            return subprocess.run(["git", *args], cwd=repo, capture_output=True, text=True, timeout=5, check=False).stdout.strip()
        except (OSError, subprocess.TimeoutExpired):
            return ""

    count = ask("rev-list", "--count", "HEAD")
    return int(count) if count.isdigit() else 0, ask("branch", "--show-current") or "HEAD"


def _folders(files: DataFrame, level: int) -> DataFrame:
    """(service, rel_path) of the folders at ``level`` that hold a manifest themselves or are named like a service."""
    parts = F.split("path", "/")
    name, base = F.get(parts, F.lit(level)), F.get(parts, F.lit(level + 1))
    rows = files.where((F.size(parts) > level + 1) & ~F.lower(name).isin(*SKIP_DIRS))
    held = (F.size(parts) == level + 2) & (base.isin(*MANIFESTS) | F.lower(base).endswith(".csproj"))
    per = rows.groupBy(name.alias("service"), F.array_join(F.slice(parts, 1, level + 1), "/").alias("rel_path")).agg(F.bool_or(held).alias("m"))
    return per.where(F.col("m") | F.lower("service").rlike(r"(?:service|svc)\z|\Aservice")).select("service", "rel_path")


def services(files: DataFrame) -> DataFrame:
    """(service, rel_path): top folders that hold a manifest or are named like a service; where there are none but only one
    folder that isn't skipped, the folders in that one."""
    top = _folders(files, 0)
    name = F.get(F.split("path", "/"), F.lit(0))
    tops = files.where(F.contains("path", F.lit("/")) & ~F.lower(name).isin(*SKIP_DIRS)).agg(F.countDistinct(name).alias("n"))
    wrapped = _folders(files, 1).crossJoin(F.broadcast(tops)).where("n = 1").drop("n")  # one row
    none = F.broadcast(top.agg(F.count("*").alias("k")))
    return top.union(wrapped.crossJoin(none).where("k = 0").drop("k"))


def with_service(files: DataFrame, found: DataFrame) -> DataFrame:
    """``files`` with the ``service`` whose folder they stand in, null for others; joined on the folder's path, not by prefix."""
    first = F.get(F.split("path", "/"), F.lit(0))
    two = F.array_join(F.slice(F.split("path", "/"), 1, 2), "/")
    rows = files.drop("service").withColumn("__top", F.when(F.contains("path", F.lit("/")), first)).withColumn("__two", two)
    by = found.select(F.col("rel_path").alias("__top"), F.col("service").alias("__s1"))
    rows = rows.join(by, "__top", "left").join(by.select(F.col("__top").alias("__two"), F.col("__s1").alias("__s2")), "__two", "left")
    return rows.withColumn("service", F.coalesce("__s1", "__s2")).drop("__top", "__two", "__s1", "__s2")


def _lines(files: DataFrame) -> DataFrame:
    rows = files.where(F.col("service").isNotNull()).select("service", "path", F.posexplode(F.split("content", "\n")).alias("n", "line"))
    return rows.select("service", "path", (F.col("n") + 1).alias("line_no"), "line", F.lower("line").alias("low"))


def _any(column: str, marks: tuple[str, ...]) -> F.Column:
    return F.col(column).rlike("|".join(re.escape(m) for m in marks))


def queue_edges(files: DataFrame) -> DataFrame:
    """(source, target, queue, path, line_no, confidence) of files with a ``service``: lines that publish to a queue and
    others' that consume from it; the first evidence in the order of paths and lines."""
    queue = F.regexp_extract("line", "['\"`]([\\w.\\-]{3,64})['\"`]", 1)
    rows = _lines(files).withColumn("queue", queue).where("queue <> ''")
    said = rows.where(_any("low", PUBLISH_MARKS)).groupBy(F.col("service").alias("source"), "queue").agg(F.min(F.struct("path", "line_no")).alias("at"))
    heard = rows.where(_any("low", CONSUME_MARKS)).select(F.col("service").alias("target"), "queue").distinct()
    return said.join(heard, "queue").where("source <> target").select("source", "target", "queue", "at.path", "at.line_no", F.lit(0.75).alias("confidence"))


def phantom_services(edges: DataFrame, found: DataFrame) -> DataFrame:
    """(service): ends of edges that no service is."""
    ends = edges.select(F.col("source").alias("service")).union(edges.select("target")).distinct()
    return ends.join(found.select("service"), "service", "left_anti")


def service_edges(files: DataFrame) -> DataFrame:
    """(source, target, path, line_no, confidence) of files with a ``service``: lines with a web scheme or a client's call and
    another service's host name.

    0.85 with both signals, else 0.6; the best line of each pair, first in path and line order. Host names are matched as
    the words of a line, so the join is on equal words.
    """
    scheme, client = F.col("low").rlike("https?://"), _any("low", HTTP_MARKS)
    lines = _lines(files).where(scheme | client).withColumn("confidence", F.when(scheme & client, 0.85).otherwise(0.6))
    words = lines.withColumn("host", F.explode(F.array_distinct(F.regexp_extract_all("low", F.lit(r"[a-z0-9][a-z0-9_-]{3,}"), 0))))
    low = F.lower("service")
    forms = F.filter(F.array_distinct(F.array(low, F.replace(low, F.lit("_"), F.lit("-")), F.replace(low, F.lit("-"), F.lit("_")), F.regexp_replace(low, "[_-]", ""))), lambda x: F.length(x) >= 4)
    hosts = files.where(F.col("service").isNotNull()).select("service").distinct().select(F.col("service").alias("target"), F.explode(forms).alias("host"))
    j = words.join(hosts, "host").where("service <> target").select(F.col("service").alias("source"), "target", "path", "line_no", "confidence").distinct()
    best = F.min(F.struct((-F.col("confidence")).alias("c"), "path", "line_no")).alias("b")
    return j.groupBy("source", "target").agg(best).select("source", "target", "b.path", "b.line_no", (-F.col("b.c")).alias("confidence"))
