"""Parent links to full hierarchies, by deterministic hash splitters.

A hash of its id makes a node a splitter. Every node walks upwards until it meets splitters or roots, which takes few
links however deep the hierarchy is, and even fewer rounds, as walks of twice the length are made of two. The pointers
between splitters form a graph a part of the size, which is solved by doubling; each node's answers are then its own
walk put before its splitters'. Nodes may have several parents.
Cycles that hold no splitter show in the walk, for their nodes come back to themselves; the others show in the reduced
graph.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweft.session import cut


def _least(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.min("way").alias("way"))


class Hierarchy:
    """Links (child, parent) of any id type, repeats and self links allowed; rows with a null id are no links.

    ``share``: one in how many nodes is a splitter. Within, nodes are 64-bit hashes of their ids, which are checked to
    be all different and drawn anew if they aren't; ``names`` (k, id) leads back. With ``paths``, a field of struct ids
    or "" for the id itself, each way also carries that label of the nodes behind the first, the least of the shortest
    ways. ``way`` is (d, p): number of links and labels.
    """

    def __init__(self, links: DataFrame, share: int = 3, paths: str | None = None):
        links = links.select("child", "parent").where(F.col("child").isNotNull() & F.col("parent").isNotNull()).distinct()
        links = cut(links)
        ids = links.select(F.col("child").alias("id")).union(links.select("parent")).distinct()
        for seed in range(8):
            key = lambda c: F.xxhash64(F.lit(seed), F.col(c))  # noqa: B023, E731
            self.names = cut(ids.select(key("id").alias("k"), "id"))
            if not self.names.groupBy("k").agg(F.count("*").alias("n")).where("n > 1").limit(1).count():
                break
        else:
            raise ValueError("ids hash to equal keys")
        self.share, self.paths = share, paths
        label = F.col(f"parent.{paths}" if paths else "parent").cast("string") if paths is not None else F.lit(0)
        rows = links.select(key("child").alias("c"), key("parent").alias("p"), label.alias("label"))
        inner = rows.select(F.col("c").alias("p"), F.lit(True).alias("inner")).distinct()
        rows = rows.join(inner, "p", "left").select("c", "p", "label", F.col("inner").isNull().alias("root"))
        self.rows = cut(rows.withColumn("split", ~F.col("root") & self._hashed("p")))
        self.walk = self._walk()
        self.reduced = self._solve()
        self._rooted: DataFrame | None = None

    def _hashed(self, c: str) -> F.Column:
        return F.pmod(F.xxhash64(c, F.lit(7)), F.lit(self.share)) == 0

    def _way(self, d: F.Column, p: F.Column) -> F.Column:
        return F.struct(d.cast("int").alias("d"), (p if self.paths is not None else F.lit(0)).alias("p")).alias("way")

    def _join_ways(self, a: str, b: str) -> F.Column:
        return self._way(F.col(f"{a}.d") + F.col(f"{b}.d"), F.concat(F.col(f"{a}.p"), F.col(f"{b}.p")))

    def _walk(self) -> DataFrame:
        """(v, at, way, root, split): what each node meets up to its first splitters and roots, each once.

        Walks of 1, 2, 4, ... links: those that have not ended are carried on by the walks of where they stand. Nodes of
        cycles without a splitter come back to themselves; as each node is met once, their walks end too.
        """
        walk = self.rows.select(F.col("c").alias("v"), F.col("p").alias("at"), self._way(F.lit(1), F.array("label")), "root", "split")
        length = 1
        while True:
            front = walk.where((F.col("way.d") == length) & ~F.col("root") & ~F.col("split")).select("v", F.col("at").alias("m"), F.col("way").alias("w1"))
            if front.isEmpty():
                return walk
            on = walk.select(F.col("v").alias("m"), "at", F.col("way").alias("w2"), "root", "split")
            more = front.join(on, "m").select("v", "at", self._join_ways("w1", "w2"), "root", "split")
            flags = (F.max(c).alias(c) for c in ("root", "split"))
            walk = cut(walk.union(more).groupBy("v", "at").agg(F.min("way").alias("way"), *flags))
            length *= 2

    def _solve(self) -> DataFrame:
        """(v, at, way) between splitters, all pairs that are linked, by doubling; only new ways are carried on."""
        now = cut(self.walk.where(F.col("split") & self._hashed("v")).select("v", "at", "way", F.lit(True).alias("fresh")))
        while True:
            fresh = now.where("fresh").select("v", F.col("at").alias("m"), F.col("way").alias("w1"))
            if fresh.isEmpty():
                return now.drop("fresh")
            on = now.select(F.col("v").alias("m"), "at", F.col("way").alias("w2"))
            more = fresh.join(on, "m").select("v", "at", self._join_ways("w1", "w2"), F.lit(None).cast(now.schema["way"].dataType).alias("old"))
            both = now.select("v", "at", "way", F.col("way").alias("old")).union(more).groupBy("v", "at").agg(F.min("way").alias("way"), F.min("old").alias("old"))
            now = cut(both.select("v", "at", "way", (F.col("old").isNull() | (F.col("way") < F.col("old"))).alias("fresh")))

    def _reach(self, only_roots: bool, within: DataFrame | None = None) -> DataFrame:
        """(v, at, way) of keys: each node and each that it reaches upwards by one link or more, by the fewest links.

        ``within``: keys (v) that no link leaves upwards; all else is left aside.
        """
        walk = self.walk if within is None else cut(self.walk.join(within, "v", "left_semi"))
        reduced = self.reduced if within is None else self.reduced.join(within, "v", "left_semi")
        ends = (walk.where("root") if only_roots else walk).select("v", "at", "way")
        up = reduced.select("v", F.col("at").alias("m"), F.col("way").alias("w1"))
        own = ends.where(self._hashed("v"))
        far = up.join(own.select(F.col("v").alias("m"), "at", F.col("way").alias("w2")), "m").select("v", "at", self._join_ways("w1", "w2"))
        from_split = own.union(far)
        from_split = cut(_least(from_split if only_roots else from_split.union(reduced), "v", "at"))
        first = walk.where(F.col("split") & ~self._hashed("v")).select("v", F.col("at").alias("m"), F.col("way").alias("w1"))
        tail = from_split.select(F.col("v").alias("m"), "at", F.col("way").alias("w2"))
        rest = first.join(tail, "m").select("v", "at", self._join_ways("w1", "w2"))
        return _least(ends.where(~self._hashed("v")).union(rest).union(from_split), "v", "at")

    def _to_roots(self) -> DataFrame:
        if self._rooted is None:
            self._rooted = cut(self._reach(only_roots=True))
        return self._rooted

    def _named(self, df: DataFrame, *keys: str) -> DataFrame:
        for key in keys:
            df = df.withColumnRenamed(key, "k").join(self.names, "k").drop("k").withColumnRenamed("id", key)
        return df

    def ancestors(self, only_roots: bool = False) -> DataFrame:
        """(v, at, way) of each node and each node it reaches upwards by one link or more, with the fewest links."""
        return self._named(self._to_roots() if only_roots else self._reach(False), "v", "at").select("v", "at", "way")

    def to_cycles(self) -> DataFrame:
        """(v, at, way): for each node at or below a cycle but below no root, the nearest node on a cycle.

        A node on a cycle has the way around to itself; the least of equally short ways counts.
        """
        loops = cut(self._cycles())
        lost = cut(self.rows.select(F.col("c").alias("v")).distinct().join(self._to_roots().select("v").distinct(), "v", "left_anti"))
        up = self._reach(False, within=lost).join(loops.select(F.col("id").alias("at")), "at", "left_semi")
        up = up.join(loops.select(F.col("id").alias("v"), F.lit(True).alias("on")), "v", "left").where("on is null or v = at")
        near = up.groupBy("v").agg(F.min(F.struct("way", "at")).alias("x")).select("v", F.col("x.at").alias("at"), F.col("x.way").alias("way"))
        return self._named(near, "v", "at").select("v", "at", "way")

    def children(self) -> DataFrame:
        """(id): nodes with parents."""
        return self._named(self.rows.select(F.col("c").alias("id")).distinct(), "id")

    def roots(self) -> DataFrame:
        """(id): nodes with children and without parents."""
        return self._named(self.rows.where("root").select(F.col("p").alias("id")).distinct(), "id")

    def cycles(self) -> DataFrame:
        """(id) of each node that is its own ancestor."""
        return self._named(self._cycles(), "id")

    def _cycles(self) -> DataFrame:
        loops = self.reduced.where("v = at").select(F.col("v").alias("id"))
        local = self.walk.where("v = at").select(F.col("v").alias("id"))
        x = loops.select(F.col("id").alias("s"))
        leave = self.walk.where("split").select("v", F.col("at").alias("s")).join(x, "s", "left_semi")
        between = self.reduced.select(F.col("v").alias("s"), F.col("at").alias("t")).join(x.select(F.col("s").alias("t")), "t", "left_semi")
        back = self.walk.where("not root and not split").select(F.col("v").alias("t"), F.col("at").alias("v"))
        back = back.join(x.select(F.col("s").alias("t")), "t", "left_semi")
        through = leave.join(between.union(x.select("s", F.col("s").alias("t"))), "s").select("v", "t").distinct()
        through = through.join(back, ["v", "t"], "left_semi").select(F.col("v").alias("id"))
        return loops.union(local).union(through).distinct()


def parent_name(entry: F.Column) -> F.Column:
    """The name in a parent entry, without type arguments, surrounding white space, pointer marks and qualifiers."""
    bare = F.regexp_replace(entry, r"(?s)[<\[(].*$", "")
    bare = F.regexp_replace(bare, r"^[\s\p{Z}*&]+|[\s\p{Z}*&]+$", "")
    return F.regexp_replace(bare, r"(?s)^.*(?:::|[.\\/:])[\s\p{Z}*&]*", "")


def class_links(classes: DataFrame, group: str = "repo") -> tuple[DataFrame, DataFrame]:
    """(nodes (id), links (child, parent)) of class rows; ids are (group, name), null groups count as ''.

    Classes are the distinct non-null names of a group, all rows of a name together; null arrays and entries, and
    entries that fit no class of the group, give no links.
    """
    g = F.coalesce(F.col(group), F.lit("")).alias("g")
    rows = classes.where(F.col("name").isNotNull()).select(g, F.col("name").alias("n"), F.col("bases").alias("b"), F.col("interfaces").alias("i"))
    nodes = rows.select("g", "n").distinct()
    entries = F.concat(F.coalesce("b", F.array().cast("array<string>")), F.coalesce("i", F.array().cast("array<string>")))
    links = rows.select("g", "n", F.explode(entries).alias("e")).select("g", "n", parent_name(F.col("e")).alias("p"))
    links = links.where(F.col("p").isNotNull() & (F.col("p") != "")).distinct()
    links = links.join(nodes.select("g", F.col("n").alias("p")), ["g", "p"], "left_semi")
    ident = lambda c: F.struct(F.col("g"), F.col(c).alias("n"))
    return nodes.select(ident("n").alias("id")), links.select(ident("n").alias("child"), ident("p").alias("parent"))
