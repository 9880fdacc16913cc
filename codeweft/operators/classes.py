"""The class graph: types, what they inherit and implement, fields, methods, and whom methods call.

Relations carry ``repo``. Classes are known by their bare names; of several rows of a name the last by file and line
gives kind and method names, all give parents and fields.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeweft.operators.graph import pairs
from codeweft.operators.hierarchy import parent_name
from codeweft.session import cut

INTERFACE_LIKE = ("interface", "trait", "abstract_class")
_TEXTS = "array<string>"


def _texts(c: str) -> F.Column:
    return F.coalesce(c, F.array().cast(_TEXTS))


def core_type(t: F.Column) -> F.Column:
    """The type's own name: without quotes, array marks, ``dyn``, one-argument wrappers and qualifiers."""
    bare = F.regexp_replace(t, r"^[\s\"'&*]+|[\s\"']+$|\[\]|^dyn\s+", "")
    inner = F.regexp_extract(bare, r"^[\w.:]+[<\[]([^<>\[\],]+)[>\]]$", 1)
    return parent_name(F.when(inner != "", inner).otherwise(bare))


class ClassGraph:
    """Relations of the parsed classes and functions of all projects."""

    def __init__(self, classes: DataFrame, functions: DataFrame):
        named = classes.where("name is not null")
        for c, kind in (("file", "string"), ("line_start", "int"), ("language", "string")):
            named = named if c in named.columns else named.withColumn(c, F.lit(None).cast(kind))
        at = F.struct("file", "line_start", "kind")
        last = F.max(F.struct(at.alias("at"), "kind", "language", F.array_sort(F.array_distinct(F.filter(_texts("method_names"), lambda x: x.isNotNull()))).alias("m"), "file", "line_start"))
        rows = named.groupBy("repo", "name").agg(last.alias("x"))
        self.classes = rows.select("repo", "name", "x.kind", "x.language", F.col("x.m").alias("method_names"), "x.file", "x.line_start")
        known = self.classes.select("repo", F.col("name").alias("parent"), "kind")
        both = [named.select("repo", F.col("name").alias("child"), F.explode(_texts(c)).alias("e"), F.lit(c).alias("how")) for c in ("bases", "interfaces")]
        edges = both[0].union(both[1]).select("repo", "child", parent_name(F.col("e")).alias("parent"), "how").where("parent <> '' and child <> parent").distinct()
        self.parents = edges
        found = edges.join(known, ["repo", "parent"])
        self.inherits = found.where("how = 'bases'").select("repo", "child", "parent")
        like = (F.col("how") == "interfaces") | F.col("kind").isin(*INTERFACE_LIKE)
        m = functions.where("class_name is not null")
        m = m if "language" in m.columns else m.withColumn("language", F.lit(None).cast("string"))
        bare = F.regexp_extract("name", r"([^.]*)\z", 1)
        m = m.select("repo", F.col("class_name").alias("class"), bare.alias("name"), "calls", _texts("instantiates").alias("makes"), "language").distinct()
        self.methods = m.drop("language").join(self._known_makes(m), ["repo", "class", "name", "calls", "makes"], "left").withColumn("makes", F.coalesce("kept", F.array().cast(_TEXTS))).drop("kept")
        self._bodied = m
        self.implements = found.where(like).select("repo", "child", "parent").union(self.structural()).distinct()
        self.type_edges = self.inherits.union(self.implements).distinct()
        own = named.select("repo", F.col("name").alias("owner"), F.explode("fields").alias("f"))
        own = own.select("repo", "owner", F.col("f.name").alias("field"), core_type(F.col("f.type")).alias("type"), F.coalesce("f.is_collection", F.lit(False)).alias("collection")).distinct()
        self.fields = own.join(known.select("repo", F.col("parent").alias("type")), ["repo", "type"], "left_semi").select("repo", "owner", "field", "type", "collection")

    def _known_makes(self, m: DataFrame) -> DataFrame:
        """Methods with the classes among what they build, in the order of the code."""
        key = ["repo", "class", "name", "calls", "makes"]
        rows = m.select(*key).distinct().select(*key, F.posexplode("makes").alias("pos", "product"))
        rows = rows.join(self.classes.select("repo", F.col("name").alias("product")), ["repo", "product"], "left_semi")
        return rows.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "product"))), lambda x: x["product"]).alias("kept"))

    def unresolved(self) -> DataFrame:
        """(repo, name, how, parents): the parents, by kind of link, that no class of the project is."""
        known = self.classes.select("repo", F.col("name").alias("parent"))
        return self.parents.join(known, ["repo", "parent"], "left_anti").groupBy("repo", F.col("child").alias("name"), "how").agg(F.array_sort(F.collect_set("parent")).alias("parents"))

    def known_methods(self) -> DataFrame:
        """(repo, class, name): names of methods with a body, and those that a class declares."""
        declared = self.classes.select("repo", F.col("name").alias("class"), F.explode("method_names").alias("name"))
        return declared.union(self.methods.select("repo", "class", "name")).distinct()

    def ancestors(self) -> DataFrame:
        """(repo, src, dst) of each class and each type it inherits or implements, at any depth."""
        return pairs(cut(self.type_edges.select("repo", F.col("child").alias("src"), F.col("parent").alias("dst"))))

    def effective_fields(self) -> DataFrame:
        """(repo, owner, field, type, collection, origin): own fields, then inherited ones that no nearer name hides.

        Among ancestors the alphabetically first wins, as the reference result has it.
        """
        own = self.fields.withColumn("origin", F.col("owner")).withColumn("rank", F.lit(0))
        inherited = self.ancestors().select("repo", F.col("src").alias("cls"), F.col("dst").alias("owner")).where("cls <> owner").join(self.fields, ["repo", "owner"])
        inherited = inherited.select("repo", F.col("cls").alias("owner"), "field", "type", "collection", F.col("owner").alias("origin"), F.lit(1).alias("rank"))
        every = own.unionByName(inherited)
        first = F.min(F.struct("rank", "origin")).over(Window.partitionBy("repo", "owner", "field"))
        return every.withColumn("first", first).where((F.col("rank") == F.col("first.rank")) & (F.col("origin") == F.col("first.origin"))).drop("first", "rank")

    def unique_methods(self) -> DataFrame:
        """(repo, name, class) of method names that exactly one class knows."""
        return self.known_methods().groupBy("repo", "name").agg(F.countDistinct("class").alias("k"), F.min("class").alias("class")).where("k = 1").select("repo", "name", "class")

    def method_calls(self) -> DataFrame:
        """(repo, class, method, callee, target): calls of methods; target is the class that alone declares the callee."""
        calls = self.methods.select("repo", "class", F.col("name").alias("method"), F.explode("calls").alias("callee"))
        target = self.unique_methods().select("repo", F.col("name").alias("callee"), F.col("class").alias("target"))
        return calls.join(target, ["repo", "callee"], "left")

    def structural(self) -> DataFrame:
        """(repo, child, parent): Go structs whose methods hold all that a Go interface declares (relational division).

        Method names are counted for each interface and struct, so a name that many declare is spread by both.
        """
        c = self.classes.where("language = 'go'")
        need = c.where("kind = 'interface' and size(method_names) > 0").select("repo", F.col("name").alias("parent"), F.size("method_names").alias("need"), F.explode("method_names").alias("name"))
        structs = c.where("kind = 'struct'").select("repo", F.col("name").alias("class"))
        have = self._bodied.where("language = 'go'").select("repo", "class", "name").distinct().join(structs, ["repo", "class"], "left_semi")
        j = need.join(have, ["repo", "name"]).groupBy("repo", F.col("class").alias("child"), "parent", "need").agg(F.count("*").alias("got"))
        return j.where("got = need").select("repo", "child", "parent")
