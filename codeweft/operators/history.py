"""Commits over time, sessions of activity, and slices of recorded runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeweft.operators.relations import once
from codeweft.session import cut

#: Idle time that ends a session.
GAP = "3 hours"


def commit_date(c: F.Column) -> F.Column:
    """Dates in ISO, slashed, dotted and month-name notation, days and months of one digit too; blank and unreadable ones are null."""
    t = F.trim(c)
    forms = ("yyyy-M-d", "yyyy/M/d", "d.M.yyyy", "M/d/yyyy", "d MMM yyyy", "MMM d, yyyy", "yyyyMMdd")
    dates = [F.expr("null").cast("date")] + [F.try_to_timestamp(t, F.lit(f)).cast("date") for f in forms]
    iso = F.try_to_timestamp(F.regexp_extract(t, r"^(\d{4}-\d{2}-\d{2})", 1), F.lit("yyyy-MM-dd")).cast("date")
    return F.coalesce(iso, *dates)


def churn(commits: DataFrame) -> DataFrame:
    """(repo, commits, insertions, deletions, churn, authors), each commit once."""
    rows = once(commits)
    return rows.groupBy("repo").agg(F.countDistinct("hash").alias("commits"), F.sum("insertions").alias("insertions"), F.sum("deletions").alias("deletions"), F.sum(F.col("insertions") + F.col("deletions")).alias("churn"), F.countDistinct("author").alias("authors"))


def walk_back(commits: DataFrame, step: F.Column, now: DataFrame) -> DataFrame:
    """(repo, hash, until, before): a count as of each commit and before it, walking back from ``now`` (repo, start) by
    ``step``, never below 0.

    The clamped walk is the running sum reflected at its running minimum, so window passes do, without a loop. Commits are
    ordered newest first by date and hash; undated ones come last. Sums go by (repo, day, beginning of the hash) first and
    then over those parts, so that no task holds all commits of a large project.
    """
    rows = once(commits).select("repo", "hash", commit_date(F.col("date")).alias("day"), step.alias("step")).dropDuplicates(["repo", "hash"])
    rows = rows.join(now, "repo").withColumn("part", F.substring("hash", 1, 2))
    inner = Window.partitionBy("repo", "day", "part").orderBy("hash")
    whole, earlier = inner.rowsBetween(Window.unboundedPreceding, 0), inner.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("own", F.sum("step").over(whole)).withColumn("low", F.min("own").over(whole)).withColumn("low0", F.min("own").over(earlier))
    per = rows.groupBy("repo", "day", "part").agg(F.sum("step").alias("s"), F.min("own").alias("m"), F.max("start").alias("start"))
    before = Window.partitionBy("repo").orderBy(F.desc_nulls_last("day"), "part").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("base", F.col("start") + F.coalesce(F.sum("s").over(before), F.lit(0)))
    per = per.withColumn("lowest", F.coalesce(F.min(F.col("base") + F.col("m")).over(before), F.lit(0)))
    key = (F.col("a.repo") == F.col("b.repo")) & F.col("a.day").eqNullSafe(F.col("b.day")) & (F.col("a.part") == F.col("b.part"))
    out = rows.alias("a").join(per.alias("b"), key)
    value = lambda own, low: F.col("b.base") + own - F.least(F.col("b.base") + low, F.col("b.lowest"), F.lit(0))
    until = F.col("b.base") + F.col("a.own") - F.col("a.step") - F.least(F.coalesce(F.col("b.base") + F.col("a.low0"), F.lit(0)), F.col("b.lowest"), F.lit(0))
    return out.select("a.repo", "a.hash", until.alias("until"), value(F.col("a.own"), F.col("a.low")).alias("before"))


def backward_loc(commits: DataFrame, now: DataFrame) -> DataFrame:
    """(repo, hash, loc): lines before each commit, walking back from ``now`` (repo, loc)."""
    rows = walk_back(commits, F.col("deletions") - F.col("insertions"), now.select("repo", F.col("loc").alias("start")))
    return rows.select("repo", "hash", F.col("before").alias("loc"))


def estimates(commits: DataFrame, now: DataFrame) -> DataFrame:
    """(repo, hash, loc, functions, mi): as of each commit, lines, functions and a maintainability index in whole points.

    ``now`` is (repo, sloc, functions, files, volume, complexity) of the project as it is; the index takes lines by file.
    """
    lines = walk_back(commits, F.col("deletions") - F.col("insertions"), now.select("repo", F.col("sloc").alias("start"))).select("repo", "hash", F.col("until").alias("loc"))
    added = F.coalesce("fn_removed", F.lit(0)) - F.coalesce("fn_added", F.lit(0))
    fns = walk_back(commits, added, now.select("repo", F.col("functions").alias("start"))).select("repo", "hash", F.col("until").alias("functions"))
    rows = lines.join(fns, ["repo", "hash"]).join(now.drop("functions", "sloc"), "repo")
    per_file = F.greatest(F.lit(1.0), F.col("loc") / F.greatest("files", F.lit(1)))
    raw = 171 - 5.2 * F.log(F.greatest("volume", F.lit(1.0))) - 0.23 * F.col("complexity") - 16.2 * F.log(per_file)
    mi = F.floor(F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw * 100 / 171)) + 0.5)
    return rows.select("repo", "hash", "loc", "functions", mi.alias("mi"))


def sessions(events: DataFrame, user: str, at: str) -> DataFrame:
    """(user, start, end, events): activity with gaps of at most GAP; a gap of exactly GAP does not end a session."""
    w = F.session_window(F.col(at), GAP)
    out = events.groupBy(F.col(user).alias("user"), w.alias("w")).agg(F.count("*").alias("events"), F.min(at).alias("start"), F.max(at).alias("end"))
    return out.select("user", "start", "end", "events")


def last_writers(trace: DataFrame) -> DataFrame:
    """(run, ord, var, writer_ord) from (run, ord, var, reads, writes): each read with the last write before it."""
    w = Window.partitionBy("run", "var").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    return trace.withColumn("writer_ord", F.last(F.when(F.col("writes"), F.col("ord")), ignorenulls=True).over(w)).where("reads and writer_ord is not null").select("run", "ord", "var", "writer_ord")


def executed(trace: DataFrame, statements: DataFrame) -> DataFrame:
    """(run, ord, id) of the statements that a trace (run, ord, line) went through; the entry S1 comes first, with ord 0.

    Of several statements on a line the last counts; lines without one are left out.
    """
    at = statements.groupBy(F.col("line")).agg(F.max_by("id", F.substring("id", 2, 9).cast("int")).alias("id"))
    rows = trace.select("run", "ord", "line").join(at, "line").select("run", F.col("ord").cast("long").alias("ord"), "id")
    return rows.union(trace.select("run").distinct().select("run", F.lit(0).cast("long"), F.lit("S1")))


def execution_order(done: DataFrame) -> DataFrame:
    """(run, id, ord): the first time of each statement."""
    return done.groupBy("run", "id").agg(F.min("ord").alias("ord"))


def data_dependencies(done: DataFrame, statements: DataFrame) -> DataFrame:
    """(run, id, var, writer): for each read of an executed statement the statement that last wrote it, if it is another."""
    rows = done.join(statements.select("id", "reads", "writes"), "id")
    used = [rows.select("run", "ord", "id", F.explode(c).alias("var"), F.lit(c == "reads").alias("r")) for c in ("reads", "writes")]
    both = used[0].union(used[1]).groupBy("run", "ord", "id", "var").agg(F.bool_or("r").alias("reads"), F.bool_or(~F.col("r")).alias("writes"))
    w = Window.partitionBy("run", "var").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    both = both.withColumn("writer", F.last(F.when(F.col("writes"), F.col("id")), ignorenulls=True).over(w))
    return both.where("reads and writer is not null and writer <> id").select("run", "id", "var", "writer").distinct()


def control_dependencies(order: DataFrame, statements: DataFrame) -> DataFrame:
    """(run, id, parent, branch) of control edges both of whose ends a run went through."""
    edges = statements.where("parent is not null").select("id", "parent", "branch")
    rows = order.select("run", "id").join(edges, "id")
    return rows.join(order.select("run", F.col("id").alias("parent")), ["run", "parent"], "left_semi").select("run", "id", "parent", "branch")


def backward_slice(order: DataFrame, statements: DataFrame, data: DataFrame, control: DataFrame, run: str, criterion: str, variable: str) -> DataFrame:
    """(id, ord) of the statements of a run that a variable depends on at a statement, in the order of execution.

    A state is a statement with a variable of interest. By data it leads to the variable's writer, by control, whatever
    the variable, to the branch above; both of them then are of interest for all that they read. ``order``, ``data`` and
    ``control`` are as the functions above give them.
    """
    none = F.lit(None).cast("string")
    reads = statements.select("id", F.explode("reads").alias("var")).union(statements.select("id", none))  # a place without reads counts too
    to = reads.select(F.col("id").alias("next"), F.col("var").alias("next_var"))
    mine = lambda df: df.where(F.col("run") == run)
    steps = mine(data).select("id", "var", F.col("writer").alias("next")).union(mine(control).select("id", none, F.col("parent")))
    steps = cut(steps.join(to, "next").select("id", F.col("var").alias("on"), "next", "next_var").distinct())
    front = seen = order.sparkSession.createDataFrame([(criterion, variable)], "id string, var string")
    while not front.isEmpty():
        more = front.join(steps, "id").where(F.col("on").isNull() | (F.col("on") == F.col("var"))).select(F.col("next").alias("id"), F.col("next_var").alias("var")).distinct()
        old = seen.select(F.col("id").alias("i"), F.col("var").alias("v"))
        front = cut(more.join(old, (F.col("id") == F.col("i")) & F.col("var").eqNullSafe(F.col("v")), "left_anti"))
        seen = seen.union(front)
    return seen.select("id").distinct().join(mine(order).select("id", "ord"), "id").orderBy("ord")
