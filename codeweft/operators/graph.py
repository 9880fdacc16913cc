"""Dependency graphs at three levels, neighbours, search, and recursion over call graphs.

Recursion goes by project. Projects of up to SMALL edges are walked in memory, over names as numbers in their order, with
no shuffle but that of their edges; where the result can be larger than the edges, several tasks share a project by the
nodes that rows begin with. Larger projects go by rounds: a frontier of new pairs is joined with the edges and what is
known is left out, until nothing is new. Both ways give the same rows. Lineage is cut each round.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeweft.functions import text
from codeweft.operators.relations import SENTINEL, call_edges
from codeweft.session import cut

#: Most evidence rows that one edge carries.
DETAILS = 40
#: Edges up to which a project is walked in memory.
SMALL = 4_000_000
#: Pairs of ends of a project for each task that shares its closure; tasks that share a project at most.
PAIRS, TASKS = 5_000_000, 64
#: Bytes of the bits that a task holds, rows that it gives at a time, and paths that it joins at a time; of a project's
#: walks of three edges, so many are a task's share of its cycles.
BITS, ROWS, PATHS = 1 << 27, 1 << 16, 1 << 20
#: Numbers that stand for names where words are sorted out.
MARKS = 1 << 20


def group_of(by: str = "module") -> F.Column:
    """The group of a function row: its module without white space around, files without one; or its file."""
    return F.coalesce(F.when(F.trim("module") != "", F.trim("module")), F.col("file")) if by == "module" else F.col(by)


def module_nodes(rows: DataFrame) -> DataFrame:
    """(repo, id, type, loc, functions, languages) of function rows, those that stand for a file without functions too."""
    real = F.col("name") != SENTINEL
    langs = F.concat_ws(",", F.array_sort(F.collect_set("language")))
    kind = F.when(F.trim("module") != "", "module").otherwise("file")
    out = rows.groupBy("repo", group_of().alias("id"), F.coalesce(kind, F.lit("file")).alias("type"))
    loc = F.sum(F.when(real, F.col("line_end") - F.col("line_start")).otherwise(0))
    return out.agg(loc.cast("long").alias("loc"), F.count_if(real).alias("functions"), langs.alias("languages"))


def _call_links(fns: DataFrame, by: str) -> DataFrame:
    """(repo, s, t, src, dst) of calls between groups; both ends by the name's last definition."""
    at = F.struct("file", "line_start")
    last = fns.groupBy("repo", "name").agg(F.max_by(group_of(by), at).alias("g"))
    edges = call_edges(fns).join(last.select("repo", F.col("name").alias("src"), F.col("g").alias("s")), ["repo", "src"])
    edges = edges.join(last.select("repo", F.col("name").alias("dst"), F.col("g").alias("t")), ["repo", "dst"])
    return edges.where("s <> t").select("repo", "s", "t", "src", "dst")


def _import_links(rows: DataFrame, resolved: DataFrame, by: str) -> DataFrame:
    """(repo, s, t, src, dst) of ``resolved`` imports (path, raw, target) between groups of files; dst is the specifier."""
    of = rows.groupBy("repo", "file").agg(F.max_by(group_of(by), F.struct("line_start", "name")).alias("g"))
    i = resolved.select(F.split("path", "/")[0].alias("repo"), "path", "raw", "target")
    i = i.join(of.select("repo", F.col("file").alias("path"), F.col("g").alias("s")), ["repo", "path"])
    i = i.join(of.select("repo", F.col("file").alias("target"), F.col("g").alias("t")), ["repo", "target"])
    return i.where("s <> t").select("repo", "s", "t", F.col("path").alias("src"), F.col("raw").alias("dst"))


def group_edges(fns: DataFrame, rows: DataFrame, resolved: DataFrame, by: str = "module") -> DataFrame:
    """(repo, source, target, call_count) between modules or files: calls and imports, each counted once for each row."""
    both = _call_links(fns, by).union(_import_links(rows, resolved, by))
    return both.groupBy("repo", F.col("s").alias("source"), F.col("t").alias("target")).agg(F.count("*").alias("call_count"))


def edge_details(fns: DataFrame, rows: DataFrame, resolved: DataFrame, by: str = "file") -> DataFrame:
    """Evidence of each edge: its first DETAILS calls, then imports, by name, and how many there are."""
    calls = _call_links(fns, by).withColumn("kind", F.lit("call"))
    pairs = calls.union(_import_links(rows, resolved, by).withColumn("kind", F.lit("import"))).distinct()
    w = Window.partitionBy("repo", "s", "t")
    ranked = pairs.withColumn("rank", F.row_number().over(w.orderBy("kind", "src", "dst"))).withColumn("total", F.count("*").over(w))
    return ranked.where(F.col("rank") <= DETAILS).select("repo", F.col("s").alias("source"), F.col("t").alias("target"), "kind", "src", "dst", "rank", "total")


def file_calls(fns: DataFrame) -> DataFrame:
    """(repo, source, target, n): calls from a file to the file of the called name's last definition, its own too."""
    last = fns.groupBy("repo", F.col("name").alias("dst")).agg(F.max_by("file", F.struct("file", "line_start")).alias("target"))
    return call_edges(fns).select("repo", F.col("file").alias("source"), "dst").join(last, ["repo", "dst"]).groupBy("repo", "source", "target").agg(F.count("*").alias("n"))


def without_inert(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """File nodes without those ``__init__.py`` that hold no functions and have no edge."""
    ends = edges.select("repo", F.col("source").alias("file")).union(edges.select("repo", "target")).distinct().withColumn("linked", F.lit(True))
    inert = F.col("file").rlike(r"(?:\A|[/\\\\])__init__\.py\z") & (F.col("functions") == 0) & F.col("linked").isNull()
    return nodes.join(ends, ["repo", "file"], "left").where(~inert).drop("linked")


def file_nodes(fns: DataFrame, files: DataFrame) -> DataFrame:
    """All files, those without functions too: (repo, file, functions, loc)."""
    per = fns.groupBy("repo", "file").agg(F.count("*").alias("functions"), F.sum("lines").alias("loc"))
    every = files.select("repo", F.col("path").alias("file")).distinct()
    return every.join(per, ["repo", "file"], "left").na.fill(0, ["functions", "loc"])


def function_nodes(fns: DataFrame) -> DataFrame:
    """Function nodes with ids: the name, with its line where the name repeats in the file; anonymous ones are left out."""
    named = fns.where(~F.col("name").rlike(r"^anonymous_[0-9]+$"))
    repeats = F.count("*").over(Window.partitionBy("repo", "file", "name"))
    node = F.when(repeats > 1, F.concat_ws(":", "name", "line_start")).otherwise(F.col("name"))
    return named.select("repo", "file", node.alias("id"), "name", "line_start", "complexity", "lines")


def chunk_edges(fns: DataFrame) -> DataFrame:
    """Calls between virtual modules of one file: (file, source, target, call_count)."""
    here = fns.select("file", "name", F.col("virtual_module").alias("vm")).distinct()
    calls = fns.select("file", F.col("virtual_module").alias("source"), "name", F.explode("calls").alias("callee"))
    j = calls.join(here.select("file", F.col("name").alias("callee"), F.col("vm").alias("target")), ["file", "callee"])
    return j.where("source <> target").groupBy("file", "source", "target").agg(F.count("*").alias("call_count"))


def fan(fns: DataFrame, *more: str) -> DataFrame:
    """(repo, file, name, line_start, fan_in, fan_out): calling rows of the name in its project; distinct callees. ``more``
    columns of the function rows come along."""
    calls = call_edges(fns).groupBy("repo", F.col("dst").alias("name")).agg(F.count("*").alias("fan_in"))
    out = fns.select("repo", "file", "name", "line_start", *more, F.size("calls").alias("fan_out"))
    return out.join(calls, ["repo", "name"], "left").na.fill(0, ["fan_in"])


def rescued(fan_rows: DataFrame, files: DataFrame) -> DataFrame:
    """``fan_rows`` with fan_in 1 instead of 0 where the name stands in another file's text, or more than once in its own.

    Texts are cut to words once, without comments. Words whose hash is that of no uncalled name (one of MARKS numbers, so
    the table of them is bounded) go first, before any shuffle; of the others one row a (repo, word) is joined exactly.
    """
    mark = lambda name: F.pmod(F.xxhash64("repo", name), F.lit(MARKS)).alias("mark")
    marks = fan_rows.where("fan_in = 0").select(mark("name")).distinct()
    clean = text.without_comments(F.col("content"), F.col("language"))
    words = files.select("repo", F.coalesce("path", F.lit("")).alias("path"), F.explode(F.regexp_extract_all(clean, F.lit(r"(?U)\w+"), 0)).alias("name"))
    some = words.withColumn("mark", mark("name")).join(F.broadcast(marks), "mark", "left_semi")
    per = some.groupBy("repo", "name").agg(F.min("path").alias("__first"), F.max("path").alias("__last"), F.count("*").alias("__n"))
    out = fan_rows.join(per, ["repo", "name"], "left")
    used = (F.col("__first") != F.col("__last")) | ~F.col("__first").eqNullSafe(F.col("file")) | (F.col("__n") > 1)
    return out.withColumn("fan_in", F.when((F.col("fan_in") == 0) & F.col("__n").isNotNull() & used, 1).otherwise(F.col("fan_in"))).select(*fan_rows.columns)


def top_nodes(fan_rows: DataFrame, most: int = 100) -> DataFrame:
    """The ``most`` function rows with the highest fan_in and fan_out together."""
    return fan_rows.withColumn("degree", F.col("fan_in") + F.col("fan_out")).orderBy(F.desc("degree"), "repo", "file", "name", "line_start").limit(most)


def function_edges(fns: DataFrame) -> DataFrame:
    """(file, source, target, kind) of each file's function graph: calls to same-named functions of the file, and
    ``instantiate`` edges to the ``__init__`` of a class that a function builds; ids as in :func:`function_nodes`."""
    nodes = function_nodes(fns).select("file", "id", "name", "line_start")
    rows = fns.join(nodes, ["file", "name", "line_start"])
    target = nodes.select("file", F.col("name").alias("callee"), F.col("id").alias("target"))
    calls = rows.select("file", F.col("id").alias("source"), F.explode("calls").alias("callee")).join(target, ["file", "callee"]).select("file", "source", "target", F.lit("call").alias("kind"))
    begin = rows.where("name = '__init__' and class_name is not null").select("file", F.col("class_name").alias("made"), F.col("id").alias("target"))
    made = F.explode(F.coalesce("instantiates", F.array().cast("array<string>")))
    builds = rows.select("file", F.col("id").alias("source"), made.alias("made")).join(begin, ["file", "made"]).select("file", "source", "target", F.lit("instantiate").alias("kind"))
    return calls.union(builds).where("source <> target").distinct()


def anonymous_merged(fns: DataFrame) -> DataFrame:
    """(repo, file, name, line_start, calls) of the named functions, with the calls of the anonymous ones within them.

    An anonymous function belongs to the smallest named one of its file around it by lines; those within none are left out.
    """
    is_anonymous = F.col("name").rlike(r"\Aanonymous_[0-9]+\z")
    key = ["repo", "file", "name", "line_start"]
    f = fns.select(*key, "line_end", "calls").distinct()
    inner = f.where(is_anonymous).select("repo", "file", F.col("line_start").alias("a"), F.col("line_end").alias("b"), F.col("calls").alias("more"))
    around = f.where(~is_anonymous).join(inner, ["repo", "file"]).where((F.col("line_start") <= F.col("a")) & (F.col("b") <= F.col("line_end")))
    span = F.struct(F.col("line_end") - F.col("line_start"), "name", "line_start")
    best = around.groupBy("repo", "file", "a", "b", "more").agg(F.min_by(F.struct("name", "line_start"), span).alias("x"))
    extra = best.select("repo", "file", "x.name", "x.line_start", "more").groupBy(*key).agg(F.flatten(F.collect_list("more")).alias("more"))
    out = f.where(~is_anonymous).join(extra, key, "left")
    both = F.array_sort(F.array_distinct(F.concat("calls", F.coalesce("more", F.array().cast("array<string>")))))
    return out.select(*key, both.alias("calls"))


def root_module(modules: DataFrame) -> DataFrame:
    """(repo, module): the module below which all others of a project stand, if there is one; of (repo, module) rows."""
    m = modules.select("repo", "module").distinct()
    parts = F.split("module", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    below = m.where(F.size(parts) > 1).select("repo", F.explode(above).alias("module")).groupBy("repo", "module").agg(F.count("*").alias("below"))
    whole = m.groupBy("repo").agg(F.count("*").alias("n")).where("n > 1")
    return m.join(below, ["repo", "module"]).join(whole, "repo").where("below = n - 1").select("repo", "module")


def neighbours(fns: DataFrame, both: bool = True) -> DataFrame:
    """(repo, name, other, direction): callees, and with ``both`` callers, of each defined name, without itself."""
    names = fns.select("repo", "name").distinct()
    e = call_edges(fns).select("repo", "src", "dst").where("src <> dst").distinct()
    out = e.select("repo", F.col("src").alias("name"), F.col("dst").alias("other"), F.lit("callee").alias("direction"))
    out = out.join(names.withColumnRenamed("name", "other"), ["repo", "other"], "left_semi")
    if both:
        callers = e.select("repo", F.col("dst").alias("name"), F.col("src").alias("other"), F.lit("caller").alias("direction"))
        out = out.unionByName(callers.join(names, ["repo", "name"], "left_semi"))
    return out.select("repo", "name", "other", "direction")


def search(fns: DataFrame, query: str, limit: int = 50) -> DataFrame:
    """Ranked name search: exact 0, prefix 1, substring 2, path 3; then name, file, line. ``limit`` is the feature's own."""
    low, t = F.lower("name"), F.lit(query.lower())
    rank = F.when(low == t, 0).when(low.startswith(t), 1).when(F.contains(low, t), 2).when(F.contains(F.lower("file"), t), 3)
    return fns.select("repo", "name", "file", "line_start", rank.alias("rank")).where("rank is not null").orderBy("rank", "name", "file", "line_start").limit(limit)


def node_ids(fns: DataFrame) -> DataFrame:
    """(repo, file, name, line_start, scope, id) as a graph shows a function: in a file of several virtual modules the scope
    is its own one, else the file; the id is the name, with its line where the name repeats in the scope."""
    many = fns.groupBy("repo", "file").agg(F.countDistinct("virtual_module").alias("__vms"))
    rows = fns.join(many, ["repo", "file"]).withColumn("scope", F.when((F.col("__vms") > 1) & F.col("virtual_module").isNotNull(), F.col("virtual_module")).otherwise(F.col("file")))
    repeats = F.count("*").over(Window.partitionBy("repo", "file", "scope", "name"))
    return rows.select("repo", "file", "name", "line_start", "scope", F.when(repeats > 1, F.concat_ws(":", "name", "line_start")).otherwise(F.col("name")).alias("id"))


def _split(edges: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Edges of small projects, and of the others, each once, if there are any; each has more than SMALL, so they are few."""
    large = [r.repo for r in edges.groupBy("repo").agg(F.count("*").alias("n")).where((F.col("n") > SMALL) & F.col("repo").isNotNull()).select("repo").collect()]
    if not large:
        return edges, None
    is_large = F.coalesce(F.col("repo").isin(large), F.lit(False))
    return edges.where(~is_large), edges.where(is_large).distinct()


def _by_project(edges: DataFrame, walk: Callable[..., Iterator[pa.RecordBatch]], schema: str, parts: F.Column | None = None) -> DataFrame:
    """What ``walk`` gives for each project's batches of (repo, src, dst, part, parts).

    With ``parts``, an expression on a project's ``pairs`` of ends, so many tasks get all of its edges, and each gives the
    rows of its own part.
    """
    count = F.least(F.greatest(F.ceil(parts), F.lit(1)), F.lit(TASKS)).cast("int") if parts is not None else F.lit(1)
    if parts is not None:
        sizes = edges.groupBy("repo").agg((F.countDistinct("src") * F.countDistinct("dst")).alias("pairs"))
        edges = edges.join(sizes.select("repo", count.alias("parts")), "repo").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        edges = edges.repartition(max(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), TASKS), "repo", "part")
    else:
        edges = edges.withColumns({"parts": count, "part": F.lit(0)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches))
        g = _Project(t["src"], t["dst"])
        yield from walk(g, t["repo"][0].as_py(), t["part"][0].as_py(), t["parts"][0].as_py())

    return edges.select("repo", "part", "src", "dst", "parts").groupBy("repo", "part").applyInArrow(run, schema)


def _firsts(lengths: np.ndarray) -> np.ndarray:
    """Where pieces of these lengths begin, and the end of the last."""
    return np.concatenate(([0], np.cumsum(lengths, dtype=np.int64)))


def _ranges(begin: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All places from each ``begin`` on, as many as ``lengths`` says."""
    return np.arange(int(lengths.sum())) + np.repeat(begin - _firsts(lengths)[:-1], lengths)


class _Project:
    """A project's graph over names as numbers, which are in the order of the names."""

    def __init__(self, src: pa.ChunkedArray, dst: pa.ChunkedArray):
        coded = pa.concat_arrays([*src.chunks, *dst.chunks]).dictionary_encode()
        order = pc.sort_indices(coded.dictionary)
        self.names = coded.dictionary.take(order)
        self.n = len(self.names)
        rank = np.empty(self.n, np.int64)
        rank[order.to_numpy()] = np.arange(self.n)
        ids = rank[coded.indices.to_numpy()]
        self.src, self.dst = np.divmod(np.unique(ids[: len(src)] * self.n + ids[len(src) :]), self.n)
        self.begin, self.to = self._rows(self.src, self.dst, self.n)
        self.loops = np.unique(self.src[self.src == self.dst])

    def within(self) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """The names on cycles of several, and the edges between those of one component as places among these names."""
        comp, _ = self.components()
        inner = (comp[self.src] == comp[self.dst]) & (self.src != self.dst)
        nodes, src = np.unique(self.src[inner], return_inverse=True)
        return self.names.take(pa.array(nodes)), src.astype(np.int32), np.searchsorted(nodes, self.dst[inner]).astype(np.int32)

    @staticmethod
    def _rows(src: np.ndarray, dst: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Where each node's edges begin among the ends that stand in the order of beginnings."""
        return _firsts(np.bincount(src, minlength=n)), dst[np.argsort(src, kind="stable")]

    def components(self) -> tuple[np.ndarray, np.ndarray]:
        """Each node's strongly connected component and each component's size; none has an edge to one of a higher number."""
        begin, to = self.begin.tolist(), self.to.tolist()
        at, low, comp = [0] * self.n, [0] * self.n, [-1] * self.n
        open_: list[int] = []
        clock = count = 0
        place = begin[:-1].copy()
        for root in range(self.n):
            if at[root]:
                continue
            way = [root]
            while way:
                v = way[-1]
                if not at[v]:
                    clock += 1
                    at[v] = low[v] = clock
                    open_.append(v)
                if place[v] < begin[v + 1]:
                    w = to[place[v]]
                    place[v] += 1
                    if not at[w]:
                        way.append(w)
                    elif comp[w] < 0 and at[w] < low[v]:
                        low[v] = at[w]
                    continue
                way.pop()
                if low[v] == at[v]:
                    while True:
                        w = open_.pop()
                        comp[w] = count
                        if w == v:
                            break
                    count += 1
                if way and low[v] < low[way[-1]] and comp[v] < 0:
                    low[way[-1]] = low[v]
        out = np.array(comp, np.int64)
        return out, np.bincount(out, minlength=count)

    def reached(self, comp: np.ndarray, count: int) -> Iterator[tuple[int, np.ndarray]]:
        """(first, bits) for each block of components: row v's bits are the components from ``first`` on that v reaches by
        edges between components. A block's rows are gone when the next comes."""
        links = np.unique(comp[self.src] * count + comp[self.dst])
        a, b = links // count, links % count
        a, b = a[a != b], b[a != b]
        begin = _firsts(np.bincount(a, minlength=count)).tolist()
        words = min(-(-count // 64), max(BITS // 8 // max(count, 1), 1))
        bits = np.zeros((count, words), np.uint64)
        for first in range(0, count, words * 64):
            bits[:] = 0
            mine = (b >= first) & (b < first + words * 64)
            at = b[mine] - first
            np.bitwise_or.at(bits, (a[mine], at >> 6), np.uint64(1) << (at & 63).astype(np.uint64))
            for v in range(first + 1, count):  # lower ones reach none of the block
                x, y = begin[v], begin[v + 1]
                if x < y:
                    bits[v] |= np.bitwise_or.reduce(bits[b[x:y]], axis=0)
            yield first, bits


def _closure_of(g: _Project, repo: str, part: int, parts: int) -> Iterator[pa.RecordBatch]:
    begin, to = g.begin.tolist(), g.to.tolist()
    rows: tuple[list[int], list[int], list[int]] = ([], [], [])

    def batch() -> pa.RecordBatch:
        src, dst = (g.names.take(pa.array(x, pa.int64())) for x in rows[:2])
        out = pa.RecordBatch.from_arrays([pa.array([repo] * len(src)), src, dst, pa.array(rows[2], pa.int32())], names=["repo", "src", "dst", "depth"])
        for x in rows:
            x.clear()
        return out

    for start in range(part, g.n, parts):
        depth: dict[int, int] = {}
        front, d = [start], 0
        while front:
            d += 1
            new = []
            for x in front:
                for y in to[begin[x] : begin[x + 1]]:
                    if y not in depth:
                        depth[y] = d
                        new.append(y)
            front = new
        rows[0].extend([start] * len(depth))
        rows[1].extend(depth)
        rows[2].extend(depth.values())
        if len(rows[0]) >= ROWS:
            yield batch()
    yield batch()


def _pairs_of(g: _Project, repo: str, part: int, parts: int) -> Iterator[pa.RecordBatch]:
    """(repo, srcs, dsts) of nodes that all reach the same others; the beginnings are this part's."""
    comp, size = g.components()
    count = len(size)
    cyclic = size > 1
    cyclic[comp[g.loops]] = True
    members = np.argsort(comp, kind="stable")
    first_member = _firsts(size)
    mine = members[members % parts == part]
    first_mine = _firsts(np.bincount(comp[mine], minlength=count))
    lists = lambda ids, lengths: pa.ListArray.from_arrays(pa.array(_firsts(lengths), pa.int32()), g.names.take(pa.array(ids)))
    rows: list[tuple[np.ndarray, np.ndarray]] = []

    def batch() -> pa.RecordBatch:
        columns = [lists(np.concatenate([r[k] for r in rows]), np.array([len(r[k]) for r in rows])) for k in (0, 1)]
        out = pa.RecordBatch.from_arrays([pa.array([repo] * len(rows)), *columns], names=["repo", "srcs", "dsts"])
        rows.clear()
        return out

    held = 0
    for first, bits in g.reached(comp, count):
        for v in np.unique(comp[mine]).tolist():
            ends = np.flatnonzero(np.unpackbits(bits[v].view(np.uint8), bitorder="little")) + first
            if cyclic[v] and first <= v < first + bits.shape[1] * 64:
                ends = np.append(ends, v)
            if len(ends):
                dsts = members[_ranges(first_member[ends], size[ends])]
                rows.append((mine[first_mine[v] : first_mine[v + 1]], dsts))
                held += len(dsts) + len(rows[-1][0])
            if held >= ROWS:
                yield batch()
                held = 0
    if rows:
        yield batch()


def _rounds(edges: DataFrame) -> DataFrame:
    step = edges.select("repo", F.col("src").alias("m"), F.col("dst").alias("to"))
    front = cut(edges.select("repo", "src", "dst").distinct().withColumn("depth", F.lit(1)))
    parts, depth = [front], 1
    seen = front.select("repo", "src", "dst")
    while not front.isEmpty():
        depth += 1
        more = front.select("repo", "src", F.col("dst").alias("m")).join(step, ["repo", "m"]).select("repo", "src", F.col("to").alias("dst")).distinct()
        front = cut(more.join(seen, ["repo", "src", "dst"], "left_anti").withColumn("depth", F.lit(depth)))
        parts.append(front)
        seen = seen.union(front.select("repo", "src", "dst"))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def closure(edges: DataFrame) -> DataFrame:
    """(repo, src, dst, depth) of all pairs linked by one edge or more, depth the fewest edges; cycles end by themselves."""
    small, large = _split(edges.select("repo", "src", "dst"))
    out = _by_project(small, _closure_of, "repo string, src string, dst string, depth int", F.col("pairs") / PAIRS)
    return out if large is None else out.union(_rounds(large))


def pairs(edges: DataFrame) -> DataFrame:
    """(repo, src, dst) of :func:`closure`. Nodes of one component share what they reach, and rows leave a task as lists."""
    small, large = _split(edges.select("repo", "src", "dst"))
    out = _by_project(small, _pairs_of, "repo string, srcs array<string>, dsts array<string>", F.col("pairs") / PAIRS)
    out = out.select("repo", F.explode("srcs").alias("src"), "dsts").select("repo", "src", F.explode("dsts").alias("dst"))
    return out if large is None else out.union(_rounds(large).select("repo", "src", "dst"))


def _reach_of(g: _Project, repo: str, part: int, parts: int) -> Iterator[pa.RecordBatch]:
    comp, size = g.components()
    count = len(size)
    others = np.where(size > 1, size - 1, 0)
    wide = np.flatnonzero(size > 1)
    for first, bits in g.reached(comp, count):
        others += np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
        for c in wide[(wide >= first) & (wide < first + bits.shape[1] * 64)].tolist():
            others += ((bits[:, (c - first) >> 6] >> np.uint64((c - first) & 63)) & np.uint64(1)).astype(np.int64) * (size[c] - 1)
    least = np.full(count, g.n)
    np.minimum.at(least, comp, np.arange(g.n))
    on = np.flatnonzero(np.diff(g.begin))
    c = comp[on]
    alone = (size[c] == 1) & ~np.isin(on, g.loops)
    columns = [pa.array([repo] * len(on)), g.names.take(pa.array(on)), pa.array(others[c]), g.names.take(pa.array(least[c], mask=alone)), pa.array(np.where(alone, 0, size[c]))]
    yield pa.RecordBatch.from_arrays(columns, names=["repo", "name", "transitive", "component", "size"])


def reach(edges: DataFrame) -> DataFrame:
    """(repo, name, transitive, component, size) of each node with an edge out: how many others it reaches, and its
    strongly connected component, named by its least member, if it is on a cycle (else null and 0)."""
    small, large = _split(edges.select("repo", "src", "dst"))
    out = _by_project(small, _reach_of, "repo string, name string, transitive long, component string, size long")
    if large is None:
        return out
    rest = cut(_rounds(large))
    count = rest.groupBy("repo", F.col("src").alias("name")).agg(F.count_if(F.col("src") != F.col("dst")).alias("transitive"))
    return out.unionByName(count.join(components(rest), ["repo", "name"], "left").na.fill(0, ["size"]))


def impact(fns: DataFrame, edges: DataFrame, repo: str, name: str) -> DataFrame:
    """Who is affected by a change of one function: (name, depth, direct), reverse reachability over bare names."""
    back = edges.where(F.col("repo") == repo).select(F.col("dst").alias("m"), F.col("src").alias("to"))
    front = cut(back.where(F.col("m") == name).select(F.col("to").alias("name")).where(F.col("name") != name).distinct().withColumn("depth", F.lit(1)))
    out, depth = front, 1
    while not front.isEmpty():
        depth += 1
        more = front.select(F.col("name").alias("m")).join(back, "m").select(F.col("to").alias("name")).where(F.col("name") != name).distinct()
        front = cut(more.join(out, "name", "left_anti").withColumn("depth", F.lit(depth)))
        out = cut(out.union(front))
    return out.withColumn("direct", F.col("depth") == 1)


def components(closed: DataFrame) -> DataFrame:
    """(repo, name, component, size) of nodes on cycles; a component is named by its least member."""
    back = closed.select("repo", F.col("dst").alias("src"), F.col("src").alias("dst"))
    mutual = closed.select("repo", "src", "dst").join(back, ["repo", "src", "dst"], "left_semi")
    return mutual.groupBy("repo", F.col("src").alias("name")).agg(F.min("dst").alias("component"), F.count("*").alias("size"))


def risk(fns: DataFrame, edges: DataFrame, reached: DataFrame) -> DataFrame:
    """Dependency risk of each function: 2 direct + (transitive - direct) + 2 cross-file + 6 if on a cycle; and its level.

    Names are one node whatever files define them; cross-file are the direct callees that the function's own file does
    not define. ``reached`` is :func:`reach` of the edges.
    """
    key = ["repo", "file", "name", "line_start"]
    direct = edges.groupBy("repo", F.col("src").alias("name")).agg(F.count("*").alias("direct"))
    at = fns.select("repo", "file", F.col("name").alias("src")).distinct()
    here = fns.select("repo", "file", F.col("name").alias("dst")).distinct()
    cross = edges.join(at, ["repo", "src"]).join(here, ["repo", "file", "dst"], "left_anti")
    cross = cross.groupBy("repo", "file", F.col("src").alias("name")).agg(F.count("*").alias("cross_file"))
    out = fns.select(*key).distinct().join(direct, ["repo", "name"], "left").join(reached, ["repo", "name"], "left").join(cross, ["repo", "file", "name"], "left")
    out = out.na.fill(0, ["direct", "transitive", "cross_file", "size"]).withColumn("in_cycle", (F.col("size") > 1).cast("int"))
    out = out.withColumn("score", F.expr("2 * direct + (transitive - direct) + 2 * cross_file + 6 * in_cycle"))
    level = F.when(F.col("score") >= 25, "high").when(F.col("score") >= 10, "medium").when(F.col("score") >= 1, "low").otherwise("none")
    return out.withColumn("level", level).select(*key, "direct", "transitive", "cross_file", "in_cycle", "score", "level")


def _walks(src: np.ndarray, dst: np.ndarray, n: int) -> list[np.ndarray]:
    """How many walks of three edges begin, and end, at each node."""
    walks = [np.ones(n), np.ones(n)]
    for _ in range(3):
        walks = [np.bincount(a, walks[k][b], n) for k, (a, b) in enumerate(((src, dst), (dst, src)))]
    return walks


class _Cycles:
    """Simple cycles within components: the ways from a cycle's least node and those back to it meet halfway.

    Nodes are dealt to the parts, and of those with more than a part's share of all ways the first edges of one side.
    """

    def __init__(self, names: pa.Array, src: np.ndarray, dst: np.ndarray, part: int, parts: int):
        self.n, self.names = len(names), names
        self.ways = [_Project._rows(src, dst, self.n), _Project._rows(dst, src, self.n)]
        nodes, self.part, self.parts = np.arange(self.n), part, parts
        walks = _walks(src, dst, self.n)
        ways = walks[0] * walks[1]
        wide = ways > ways.sum() / parts
        hubs, nodes = nodes[wide], nodes[~wide]
        nodes = nodes[nodes % parts == part]
        #: Starts and the side whose first edges are dealt, the one with more ways; None where all are this part's.
        self.chunks: list[tuple[np.ndarray, bool | None]] = [(v[None], bool(walks[1][v] > walks[0][v])) for v in hubs]
        self.chunks += [(x, None) for x in np.split(nodes, np.flatnonzero(np.diff(np.cumsum((walks[0] + walks[1])[nodes]) // PATHS)) + 1) if len(x)]

    def paths(self, starts: np.ndarray, back: bool, longest: int, dealt: bool | None = None) -> list[np.ndarray]:
        """Paths of 1, 2, ... edges from (with ``back``, to) the starts over higher nodes, a column each, the start first;
        where this side is ``dealt``, those whose first edge is this part's."""
        begin, to = self.ways[back]
        out, p = [], starts[None, :].astype(np.int32)
        for n in range(longest):
            k = begin[p[-1] + 1] - begin[p[-1]]
            at, edge = np.repeat(np.arange(len(k)), k), _ranges(begin[p[-1]], k)
            end = to[edge].astype(np.int32)
            keep = end > p[0][at]
            if n == 0 and dealt is back:
                keep &= edge % self.parts == self.part
            for x in p[1:]:
                keep &= end != x[at]
            p = np.vstack((p[:, at[keep]], end[keep]))
            out.append(p)
        return out

    def of(self, starts: np.ndarray, dealt: bool | None, lengths: range) -> Iterator[np.ndarray]:
        """The cycles of these lengths whose least nodes are ``starts``, a column each."""
        half = lengths[-1] // 2
        there, back = self.paths(starts, False, lengths[-1] - half, dealt), self.paths(starts, True, half, dealt)
        for n in lengths:
            a, b = there[n - n // 2 - 1], back[n // 2 - 1]
            key, mine = (p[0].astype(np.int64) * self.n + p[-1] for p in (b, a))
            order = np.argsort(key, kind="stable")
            key, b = key[order], b[:, order]
            lo = np.searchsorted(key, mine)
            k = np.searchsorted(key, mine, "right") - lo
            a, lo, k = a[:, k > 0], lo[k > 0], k[k > 0]
            between = b[1:-1][::-1]  # between the meeting node and the start
            edge = np.flatnonzero(np.diff(np.cumsum(k) // PATHS)) + 1
            for x, y in zip((0, *edge), (*edge, len(k))):
                left, right = np.repeat(np.arange(x, y), k[x:y]), _ranges(lo[x:y], k[x:y])
                keep = np.ones(len(left), bool)
                for w in a[1:-1]:
                    for v in between:
                        keep &= w[left] != v[right]
                yield np.vstack((a[:, left[keep]], between[:, right[keep]]))

    def batches(self, repo: str, rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        for x in range(0, rows.shape[1], ROWS):
            r = rows[:, x : x + ROWS]
            nodes = pc.binary_join_element_wise(*[self.names.take(pa.array(c)) for c in r], " > ")
            yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(repo, pa.string()), len(nodes)), nodes, pa.array(np.full(len(nodes), len(r), np.int32))], names=["repo", "nodes", "length"])


def _cycles_of(longest: int, first: int | None) -> Callable[..., Iterator[pa.RecordBatch]]:
    def walk(g: _Project, repo: str, part: int, parts: int) -> Iterator[pa.RecordBatch]:
        yield from _found(_Cycles(*g.within(), part, parts), repo, longest, first)

    return walk


def _found(c: _Cycles, repo: str, longest: int, first: int | None) -> Iterator[pa.RecordBatch]:
    found = 0
    for lengths in [range(2, longest + 1)] if first is None else [range(n, n + 1) for n in range(2, longest + 1)]:
        for starts, dealt in c.chunks:
            for rows in c.of(starts, dealt, lengths):
                found += rows.shape[1]
                yield from c.batches(repo, rows)
        if first is not None and found >= first:
            break


def _packed(g: _Project, repo: str, part: int, parts: int) -> Iterator[pa.RecordBatch]:
    """What :meth:`_Project.within` gives, compressed, and for how many tasks; nothing for a project without cycles."""
    graph = g.within()
    if len(graph[1]):
        row = pa.record_batch([pa.ListArray.from_arrays([0, len(x)], x) for x in (graph[0], *map(pa.array, graph[1:]))], names=["names", "src", "dst"])
        out = pa.BufferOutputStream()
        with pa.ipc.new_stream(out, row.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
            stream.write_batch(row)
        tasks = min(TASKS, 1 + int(_walks(*graph[1:], len(graph[0]))[0].sum() // PATHS))
        yield pa.RecordBatch.from_arrays([pa.array([repo]), pa.array([tasks], pa.int32()), pa.array([out.getvalue().to_pybytes()])], names=["repo", "parts", "graph"])


def _shared_cycles(edges: DataFrame, longest: int) -> DataFrame:
    """The cycles of small projects. What the tasks of a project all get is its cycles' edges only, as numbers."""
    rows = _by_project(edges, _packed, "repo string, parts int, graph binary")
    rows = rows.select("repo", "parts", "graph", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    tasks = max(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), TASKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for repo, part, parts, graph in zip(*(b[c] for c in ("repo", "part", "parts", "graph"))):
                row = pa.ipc.open_stream(graph.as_buffer()).read_next_batch()
                names, src, dst = (row[c].flatten() for c in ("names", "src", "dst"))
                yield from _found(_Cycles(names, src.to_numpy(), dst.to_numpy(), part.as_py(), parts.as_py()), repo.as_py(), longest, None)

    return rows.repartitionById(tasks, F.pmod(F.hash("repo"), F.lit(tasks)) + F.col("part")).mapInArrow(run, "repo string, nodes string, length int")


def simple_cycles(edges: DataFrame, longest: int = 6, first: int | None = None) -> DataFrame:
    """(repo, nodes, length): simple cycles of at most ``longest`` edges as a text that begins with the least name.

    ``edges`` may repeat, and may lead to names that call nothing: those are on no cycle. Paths start at a cycle's least
    node and never leave its component, so each cycle is met once. With ``first`` a small project's longer cycles are
    not looked for once it has so many shorter ones; those of one length always come whole.
    """
    small, large = _split(edges.select("repo", "src", "dst").where("repo is not null"))
    if large is not None:  # perhaps not without what is on no cycle
        begins = large.select("repo", F.col("src").alias("dst")).distinct()
        more, large = _split(cut(large.where("src <> dst").join(begins, ["repo", "dst"], "left_semi").select("repo", "src", "dst")))
        small = small.union(more)
    out = _shared_cycles(small, longest) if first is None else _by_project(small, _cycles_of(longest, first), "repo string, nodes string, length int")
    if large is None:
        return out
    comp = cut(reach(large)).where("component is not null").select("repo", "name", "component")
    a = comp.select("repo", F.col("name").alias("src"), F.col("component").alias("c"))
    b = comp.select("repo", F.col("name").alias("dst"), F.col("component").alias("c"))
    inner = cut(large.join(a, ["repo", "src"]).join(b, ["repo", "dst", "c"]).select("repo", "src", "dst"))
    step = inner.select("repo", F.col("src").alias("at"), F.col("dst").alias("to"))
    paths = inner.where("dst > src").select("repo", F.array("src", "dst").alias("p"), F.col("dst").alias("at"))
    for n in range(2, longest + 1):
        more = paths.join(step, ["repo", "at"])
        out = out.union(more.where(F.col("to") == F.col("p")[0]).select("repo", F.concat_ws(" > ", "p").alias("nodes"), F.lit(n).alias("length")))
        paths = cut(more.where((F.col("to") > F.col("p")[0]) & ~F.array_contains("p", F.col("to"))).select("repo", F.concat("p", F.array("to")).alias("p"), F.col("to").alias("at")))
    return out


def _chain_of(g: _Project, repo: str, part: int, parts: int) -> Iterator[pa.RecordBatch]:
    comp, _ = g.components()
    begin, to, comp_of = g.begin.tolist(), g.to.tolist(), comp.tolist()
    depth = [0] * g.n
    for v in np.argsort(comp, kind="stable").tolist():  # what a node calls outside of its component comes first
        depth[v] = max((1 + depth[w] for w in to[begin[v] : begin[v + 1]] if comp_of[w] != comp_of[v]), default=0)
    if most := max(depth):
        yield pa.RecordBatch.from_arrays([pa.array([repo]), pa.array([most], pa.int32())], names=["repo", "depth"])


def longest_chain(edges: DataFrame, cap: int = 40) -> DataFrame:
    """(repo, depth): longest call chain of each project, in calls, over the graph without its cycles' edges, at most ``cap``."""
    small, large = _split(edges.select("repo", "src", "dst"))
    out = _by_project(small, _chain_of, "repo string, depth int").select("repo", F.least("depth", F.lit(cap)).alias("depth"))
    if large is None:
        return out
    comp = cut(reach(large)).where("component is not null").select("repo", "name", "component")
    a, b = comp.select("repo", F.col("name").alias("src"), F.col("component").alias("c1")), comp.select("repo", F.col("name").alias("dst"), F.col("component").alias("c2"))
    e = cut(large.join(a, ["repo", "src"], "left").join(b, ["repo", "dst"], "left").where("c1 is null or c2 is null or c1 <> c2").select("repo", "src", "dst"))
    level, depth = cut(e.select("repo", F.col("dst").alias("at")).distinct()), 1
    step = e.select("repo", F.col("src").alias("at"), F.col("dst").alias("to"))
    while depth <= cap and not level.isEmpty():
        out = out.union(level.select("repo").distinct().withColumn("depth", F.lit(depth)))
        level = cut(level.join(step, ["repo", "at"]).select("repo", F.col("to").alias("at")).distinct())
        depth += 1
    return out.groupBy("repo").agg(F.max("depth").alias("depth"))
