"""Mixing sources to target weights by Pfair scheduling of token blocks.

Each source is a task whose rate is its part of the mix. Its k-th block (k = 1, 2, ...) is released in slot
floor((k-1)/rate) and due by slot ceil(k/rate); earliest deadline first fills each slot with a released block, so after
any number of slots each source is less than one block from its share. The mix is a number of equal periods: in each, a
source has the same whole number of blocks, of its own size of at most ``block`` tokens, so that no weight is rounded
and the smallest source has a block. The schedule is one table for one period, and a record's slot is arithmetic on it.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Slots of a period at most, besides one for each source: bounds the one broadcast table.
SLOTS = 10_000
#: Sources that are tasks of their own, the largest; all others share one task, in which each is spread evenly.
TASKS = 10_000
#: Tokens of a block at most.
BLOCK = 8192


def norm(column: str) -> F.Column:
    """How sources are compared: without surrounding white space, in lower case."""
    return F.lower(F.regexp_replace(F.col(column), r"^\s+|\s+$", ""))


def pfair(counts: list[int]) -> list[int]:
    """The task of each slot of a period in which task k has ``counts[k]`` blocks and each slot one block.

    Tasks without blocks have no slot. Ties of deadlines go to the earlier task.
    """
    slots = sum(counts)
    waiting = [(0, k, 1) for k, n in enumerate(counts) if n]  # release slot, task, its block
    heapq.heapify(waiting)
    ready: list[tuple[int, int, int]] = []  # deadline, task, block
    order = []
    for t in range(slots):
        while waiting and waiting[0][0] <= t:
            _, k, block = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-block * slots // counts[k]), k, block))
        _, k, block = heapq.heappop(ready)
        order.append(k)
        if block < counts[k]:
            heapq.heappush(waiting, (block * slots // counts[k], k, block + 1))
    return order


def mix_plan(sizes: DataFrame, targets: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row for each source of ``targets`` (source, target_weight, max_repeats), from ``sizes`` (source, tokens).

    ``total`` is the tokens of all rows whose source is a target; ``own`` the source's own. The plan looks at a mix of
    ``total`` tokens: ``released`` is the blocks that the source's weight releases before its end, ``blocks`` those that
    its own tokens, taken max_repeats times, can fill. A source that can't fill all that are released starves; as the
    last of them may be due in part only, ``short`` compares its tokens with its weight's part (``goal``) exactly.
    ``planned`` is the goal or, for short sources, all they have; ``share`` is planned over all planned.

    Null sources fit no target; sources without rows have 0 tokens. A target row whose source repeats counts once for
    each row; null weights and repeats count as 0.
    """
    goal = targets.select(
        F.col("source"), norm("source").alias("__source"),
        F.coalesce(F.col("target_weight").cast("double"), F.lit(0.0)).alias("target_weight"),
        F.coalesce(F.col("max_repeats").cast("long"), F.lit(0)).alias("max_repeats"),
    )
    own = sizes.groupBy(norm("source").alias("__source")).agg(F.sum("tokens").alias("own"), F.count("*").alias("docs"))
    joined = goal.join(own, "__source", "left").na.fill(0, ["own", "docs"])
    first = F.row_number().over(Window.partitionBy("__source").orderBy("source")) == 1
    whole = F.sum(F.when(F.col("__first"), F.col("own")).otherwise(0)).over(Window.partitionBy())  # a row for each source
    plan = joined.withColumn("__first", first).withColumn("total", whole).drop("__first")
    plan = plan.withColumn("goal", F.col("target_weight") * F.col("total"))
    most = F.col("own") * F.col("max_repeats")
    plan = plan.withColumn("released", F.ceil(F.col("goal") / block)).withColumn("blocks", F.floor(most / block))
    starves = F.col("blocks") < F.col("released")  # also if only a part of the last block is missing
    plan = plan.withColumn("short", starves & (most < F.col("goal")))
    plan = plan.withColumn("planned", F.when(F.col("short"), most.cast("double")).otherwise(F.col("goal")))
    all_planned = F.sum("planned").over(Window.partitionBy())
    return plan.withColumn("share", F.when(all_planned > 0, F.col("planned") / all_planned).otherwise(F.lit(0.0)))


def _tasks(plan: DataFrame, most: int) -> list[tuple[str | None, float]]:
    """(source, planned) of the ``most`` largest sources, then (None, planned) of all others together if there are any."""
    rows = plan.where("planned > 0").orderBy(F.desc("planned"), "source").select("source", "planned").limit(most).collect()
    count, whole = plan.where("planned > 0").agg(F.count("*"), F.sum("planned")).first()
    tasks: list[tuple[str | None, float]] = [(r["source"], float(r["planned"])) for r in rows]
    if count > len(rows):
        tasks.append((None, float(whole) - sum(p for _, p in tasks)))
    return tasks


def mix(sizes: DataFrame, targets: DataFrame, key: str = "doc_id", block: int = BLOCK, slots: int = SLOTS, buckets: int | None = None, plan: DataFrame | None = None, tasks: int = TASKS) -> DataFrame:
    """The mixed corpus as (``key``, source, copy, tokens, slot, last_slot, place), to be read by slot, then place.

    Records of a source come in the order of a hash of their key, again from the first when all are used up, until the
    source's planned tokens are reached; ``copy`` counts from 0. A record stands in the slot of the block in which it
    begins; ``last_slot`` is that in which it ends, so records longer than a block are seen to cover several. Running sums
    go by (source, hash range), so that a source with a third of all rows is spread over ``buckets`` tasks; without
    ``buckets`` there is one for each 100 000 rows. Records without tokens take no place.
    """
    plan = mix_plan(sizes, targets, block) if plan is None else plan
    spark = sizes.sparkSession
    if buckets is None:
        buckets = max(64, sizes.count() // 100_000)
    mine = _tasks(plan, tasks)
    whole = sum(p for _, p in mine)
    periods = max(1, -(-int(whole) // (slots * block)))
    counts = [max(1, -int(-p // (periods * block))) for _, p in mine]  # blocks a period
    per, table = [0] * len(mine), []
    for slot, k in enumerate(pfair(counts)):
        table.append((k, per[k], slot))
        per[k] += 1
    place = spark.createDataFrame(table, "task int, turn long, at long")
    known = spark.createDataFrame([(k, s, n, p) for k, ((s, p), n) in enumerate(zip(mine, counts))], "task int, source string, turns long, task_planned double")
    rest = len(mine) - 1 if mine and mine[-1][0] is None else None
    of = plan.where("planned > 0").select("source", "__source", "own", "planned")
    of = of.join(F.broadcast(known.where("source is not null")), "source", "left")
    if rest is not None:
        of = of.withColumn("turns", F.coalesce("turns", F.lit(counts[rest]))).withColumn("task_planned", F.coalesce("task_planned", F.lit(mine[rest][1])))
        of = of.withColumn("task", F.coalesce("task", F.lit(rest)))
    h = F.xxhash64(F.col(key), F.lit(42))
    docs = sizes.where(F.col("tokens") > 0).select(F.col(key), F.col("tokens"), norm("source").alias("__source"), h.alias("__h"))
    docs = docs.join(of, "__source").withColumn("__b", F.pmod(F.shiftrightunsigned("__h", 32), F.lit(buckets)))
    sums = docs.groupBy("source", "__b").agg(F.sum("tokens").alias("__sum"))
    before = sums.withColumn("__before", F.sum("__sum").over(Window.partitionBy("source").orderBy("__b")) - F.col("__sum")).drop("__sum")
    w = Window.partitionBy("source", "__b").orderBy("__h", key)
    docs = docs.withColumn("__in", F.sum("tokens").over(w) - F.col("tokens")).join(before, ["source", "__b"])
    docs = docs.withColumn("__at", F.col("__before") + F.col("__in"))
    copies = F.ceil((F.col("planned") - F.col("__at")) / F.col("own")).cast("int")
    docs = docs.where(copies > 0).withColumn("copy", F.explode(F.sequence(F.lit(0), copies - 1)))
    start = F.col("__at") + F.col("copy") * F.col("own")
    end = F.least(start + F.col("tokens") - 1, F.col("planned"))
    every = F.col("turns") * periods  # a task's blocks in all periods; a source's place in its task is that in its own tokens
    index = lambda x: F.least(F.floor(x * every / F.col("planned")), every - 1)
    docs = docs.withColumn("__first", index(start)).withColumn("__last", index(end))
    for block_, out in (("__first", "slot"), ("__last", "last_slot")):
        docs = docs.withColumn("turn", F.pmod(F.col(block_), F.col("turns"))).join(F.broadcast(place), ["task", "turn"])
        docs = docs.withColumn(out, F.floor(F.col(block_) / F.col("turns")) * len(table) + F.col("at")).drop("at", "turn")
    return docs.select(key, "source", "copy", "tokens", "slot", "last_slot", start.alias("place"))


def mix_shares(mixed: DataFrame, plan: DataFrame) -> DataFrame:
    """What came out: each source's target weight, planned share, tokens and actual share of the mixed corpus."""
    got = mixed.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("records"))
    out = plan.select("source", "target_weight", "short", "share").join(got, "source", "left").na.fill(0, ["tokens", "records"])
    return out.withColumn("actual", F.col("tokens") / F.sum("tokens").over(Window.partitionBy()))  # one row a source
