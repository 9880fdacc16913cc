"""Design patterns by declarative rules: specs in YAML, compiled to joins over the class graph.

A spec is a pattern, a tier, requirements in order, weights and a floor. A generator binds a role: its rows join what is
bound so far (on the roles its parameters name) and add columns. A checker keeps the rows whose bound parameters it holds
for. All requirements must hold; confidence is the sum of each predicate's weight times its strength, at most 1.
New predicates are functions under :func:`generator` or :func:`checker`.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from functools import reduce

import yaml
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweft.operators.classes import INTERFACE_LIKE, ClassGraph

SPECS = os.path.join(os.path.dirname(__file__), "specs.yaml")
# Which method names play which role, whatever their case; the group of each pattern.
ROLES = {
    "ITERATOR_NEXT": ("next", "__next__"), "ITERATOR_HAS_NEXT": ("hasnext", "has_next"), "BUILDER_BUILD": ("build", "construct"),
    "PROTOTYPE_CLONE": ("clone", "__copy__", "__deepcopy__"), "COMMAND_EXECUTE": ("execute", "run"), "MEMENTO_SAVE": ("save", "create_memento", "creatememento"),
    "MEMENTO_RESTORE": ("restore", "set_memento", "setmemento"), "INTERPRETER_INTERPRET": ("interpret",),
}
CATEGORIES = {
    "Creational": ("Factory Method", "Abstract Factory", "Builder", "Prototype", "Singleton"),
    "Structural": ("Adapter", "Bridge", "Composite", "Decorator", "Facade", "Flyweight", "Proxy"),
    "Behavioral": ("Chain of Responsibility", "Command", "Interpreter", "Iterator", "Mediator", "Memento", "Observer", "State", "Strategy", "Template Method", "Visitor"),
}
#: By name: (function, whether it binds a role, the parameters that may name a role).
PREDICATES: dict[str, tuple[Callable[..., DataFrame], bool, tuple[str, ...]]] = {}


def generator(*roles: str):
    """Register (graph, **values) to rows of repo, binding, maybe field, and a column for each of ``roles``."""
    return lambda f: PREDICATES.setdefault(f.__name__, (f, True, roles))[0]


def checker(*roles: str):
    """Register (graph, **values) to rows of repo, a column for each of ``roles``, and maybe strength."""
    return lambda f: PREDICATES.setdefault(f.__name__, (f, False, roles))[0]


def load_specs(path: str = SPECS) -> list[dict]:
    """Specs of a YAML file (a list, or one) or of all such files of a folder, in the order of names."""
    names = sorted(os.path.join(path, n) for n in os.listdir(path) if n.endswith((".yaml", ".yml"))) if os.path.isdir(path) else [path]
    out: list[dict] = []
    for name in names:
        with open(name, encoding="utf-8") as f:
            read = yaml.safe_load(f) or []
        out += read if isinstance(read, list) else [read]
    return out


def _like(g: ClassGraph) -> DataFrame:
    return g.classes.where(F.col("kind").isin(*INTERFACE_LIKE))


def _role(name: str, role: str) -> F.Column:
    return F.lower(name).isin(*ROLES.get(role, ("",)))


def _first_product(c: str = "makes") -> F.Column:
    return F.get(c, F.lit(0))


@generator()
def every_class(g: ClassGraph) -> DataFrame:
    return g.classes.select("repo", F.col("name").alias("binding"))


@generator()
def interface_with_single_method(g: ClassGraph) -> DataFrame:
    return _like(g).where(F.size("method_names") == 1).select("repo", F.col("name").alias("binding"))


@generator()
def interface_with_single_role_method(g: ClassGraph, role_name: str) -> DataFrame:
    return _like(g).where(F.exists("method_names", lambda m: _role(m, role_name))).select("repo", F.col("name").alias("binding"))


@generator("type")
def composition_field_of_type(g: ClassGraph) -> DataFrame:
    return g.effective_fields().select("repo", F.col("owner").alias("binding"), "field", "type").distinct()


@generator("type")
def collection_composition_field_of_type(g: ClassGraph) -> DataFrame:
    return g.effective_fields().where("collection").select("repo", F.col("owner").alias("binding"), "field", "type").distinct()


def _self_typed(g: ClassGraph) -> DataFrame:
    """(repo, owner, field, type, collection) of fields whose type is the class itself or one that it inherits or implements."""
    own = g.classes.select("repo", F.col("name").alias("owner"), F.col("name").alias("type"))
    types = own.union(g.ancestors().select("repo", F.col("src").alias("owner"), F.col("dst").alias("type"))).distinct()
    return g.effective_fields().join(types, ["repo", "owner", "type"], "left_semi")


@generator()
def list_of_own_type_field_candidates(g: ClassGraph) -> DataFrame:
    return _self_typed(g).where("collection").select("repo", F.col("owner").alias("binding"), "field").distinct()


@generator()
def single_field_of_own_type_candidates(g: ClassGraph) -> DataFrame:
    return _self_typed(g).where("not collection").select("repo", F.col("owner").alias("binding"), "field").distinct()


def _links(g: ClassGraph) -> DataFrame:
    """(repo, class, method, callee, target) of calls that mean one other class."""
    return g.method_calls().where("target is not null and class <> target")


@generator()
def double_dispatch_candidates(g: ClassGraph) -> DataFrame:
    """A's method calls B's, and that one calls some method of A."""
    e = _links(g)
    there = e.select("repo", F.col("class").alias("a"), F.col("target").alias("b"), F.col("callee").alias("m"))
    back = e.select("repo", F.col("class").alias("b"), F.col("method").alias("m"), F.col("target").alias("a"))
    return there.join(back, ["repo", "a", "b", "m"], "left_semi").select("repo", F.col("a").alias("binding")).distinct()


def _abstract(g: ClassGraph) -> DataFrame:
    """(repo, class, name) of methods that a class declares without a body."""
    declared = g.classes.select("repo", F.col("name").alias("class"), F.explode("method_names").alias("name"))
    return declared.join(g.methods.select("repo", "class", "name").distinct(), ["repo", "class", "name"], "left_anti")


@generator()
def factory_method_candidates(g: ClassGraph) -> DataFrame:
    """An abstract method that two subclasses override, each building another product first."""
    abstract = _abstract(g).join(_like(g).select("repo", F.col("name").alias("class")), ["repo", "class"], "left_semi")
    made = g.methods.where(F.size("makes") > 0).groupBy("repo", F.col("class").alias("child"), "name").agg(F.max(_first_product()).alias("product"))
    j = abstract.withColumnRenamed("class", "parent").join(g.type_edges, ["repo", "parent"]).join(made, ["repo", "child", "name"])
    per = j.groupBy("repo", "parent", "name").agg(F.countDistinct("child").alias("subs"), F.countDistinct("product").alias("products"))
    return per.where("subs >= 2 and products >= 2").select("repo", F.col("parent").alias("binding")).distinct()


@generator()
def abstract_factory_candidates(g: ClassGraph) -> DataFrame:
    """An interface of two methods or more, two of whose implementers build different families by them."""
    many = _like(g).where(F.size("method_names") >= 2).select("repo", F.col("name").alias("parent"), F.explode("method_names").alias("name"))
    made = g.methods.where(F.size("makes") > 0).groupBy("repo", F.col("class").alias("child"), "name").agg(F.max(_first_product()).alias("product"))
    j = many.join(g.type_edges, ["repo", "parent"]).join(made, ["repo", "child", "name"])
    family = j.groupBy("repo", "parent", "child").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("product")), "\\0").alias("family")).where("n >= 2")
    per = family.groupBy("repo", "parent").agg(F.count("*").alias("n"), F.countDistinct("family").alias("families"))
    return per.where("n >= 2 and families >= 2").select("repo", F.col("parent").alias("binding"))


def _builds_other(g: ClassGraph, role: str) -> DataFrame:
    """(repo, class, name): each class's first method of a role, by name, if it builds another class."""
    first = g.methods.where(_role("name", role)).groupBy("repo", "class").agg(F.min("name").alias("name"))
    other = g.methods.where(F.exists("makes", lambda x: x != F.col("class"))).select("repo", "class", "name").distinct()
    return first.join(other, ["repo", "class", "name"], "left_semi")


@generator()
def builder_candidates(g: ClassGraph) -> DataFrame:
    """A build method that builds another class, beside two methods or more that build nothing."""
    build = _builds_other(g, "BUILDER_BUILD").withColumnRenamed("name", "build")
    plain = g.methods.where(F.size("makes") == 0).join(build, ["repo", "class"]).where("name <> build")
    return plain.groupBy("repo", "class").agg(F.count("*").alias("n")).where("n >= 2").select("repo", F.col("class").alias("binding"))


@generator()
def prototype_candidates(g: ClassGraph) -> DataFrame:
    return g.methods.where(_role("name", "PROTOTYPE_CLONE") & F.array_contains("makes", F.col("class"))).select("repo", F.col("class").alias("binding")).distinct()


@generator()
def memento_candidates(g: ClassGraph) -> DataFrame:
    restore = g.methods.where(_role("name", "MEMENTO_RESTORE")).select("repo", "class").distinct()
    return _builds_other(g, "MEMENTO_SAVE").join(restore, ["repo", "class"], "left_semi").select("repo", F.col("class").alias("binding"))


@generator()
def adapter_candidates(g: ClassGraph) -> DataFrame:
    """A class that implements something and calls a method known of a field's type, which it neither is nor implements."""
    up = g.ancestors().select("repo", F.col("src").alias("class"), F.col("dst").alias("type"))
    f = g.effective_fields().select("repo", F.col("owner").alias("class"), "field", "type").where("class <> type").distinct()
    f = f.join(up, ["repo", "class", "type"], "left_anti").join(up.select("repo", "class").distinct(), ["repo", "class"], "left_semi")
    calls = g.method_calls().select("repo", "class", F.col("callee").alias("name")).distinct()
    known = g.known_methods().withColumnRenamed("class", "type")
    return f.join(calls, ["repo", "class"]).join(known, ["repo", "type", "name"], "left_semi").select("repo", F.col("class").alias("binding"), "field").distinct()


def _caches(g: ClassGraph) -> DataFrame:
    """(repo, class, method): methods that build what a collection field of their class holds."""
    made = g.methods.select("repo", "class", F.col("name").alias("method"), F.explode("makes").alias("type"))
    f = g.effective_fields().where("collection").select("repo", F.col("owner").alias("class"), "type").distinct()
    return made.join(f, ["repo", "class", "type"], "left_semi").select("repo", "class", "method").distinct()


@generator()
def flyweight_candidates(g: ClassGraph) -> DataFrame:
    return _caches(g).select("repo", F.col("class").alias("binding"), F.col("method").alias("field"))


@generator()
def mediator_candidates(g: ClassGraph) -> DataFrame:
    """Hubs that two classes or more call which don't call each other."""
    e = _links(g).select("repo", "class", "target").distinct()
    hubs = e.groupBy("repo", F.col("target").alias("hub")).agg(F.count("*").alias("k")).where("k >= 2")
    a = e.select("repo", F.col("target").alias("hub"), F.col("class").alias("a"))
    near = e.select("repo", F.col("class").alias("a"), F.col("target").alias("b"))
    b = a.select("repo", "hub", F.col("a").alias("b"))
    linked = a.join(near, ["repo", "a"]).join(b, ["repo", "hub", "b"], "left_semi").select("repo", "hub").distinct()
    return hubs.join(linked, ["repo", "hub"], "left_anti").select("repo", F.col("hub").alias("binding"))


@generator()
def interpreter_candidates(g: ClassGraph) -> DataFrame:
    """A class whose interpret method calls an interpret method known of a field's type that is its own."""
    f = _self_typed(g).select("repo", F.col("owner").alias("class"), "type").distinct()
    m = g.methods.where(_role("name", "INTERPRETER_INTERPRET")).select("repo", "class", F.explode("calls").alias("name")).where(_role("name", "INTERPRETER_INTERPRET"))
    known = g.known_methods().withColumnRenamed("class", "type")
    return f.join(m, ["repo", "class"]).join(known, ["repo", "type", "name"], "left_semi").select("repo", F.col("class").alias("binding")).distinct()


@generator()
def singleton_candidates(g: ClassGraph) -> DataFrame:
    own = single_field_of_own_type_candidates(g).select("repo", F.col("binding").alias("class")).distinct()
    return g.methods.where(F.array_contains("makes", F.col("class"))).join(own, ["repo", "class"], "left_semi").select("repo", F.col("class").alias("binding")).distinct()


@generator()
def factory_candidates(g: ClassGraph) -> DataFrame:
    """A method that builds two other classes, or two methods that first build different ones."""
    other = g.methods.withColumn("others", F.array_distinct(F.filter("makes", lambda x: x != F.col("class")))).where(F.size("others") > 0)
    per = other.groupBy("repo", "class").agg(F.max(F.size("others")).alias("most"), F.countDistinct("name").alias("methods"), F.countDistinct(_first_product("others")).alias("products"))
    return per.where("most >= 2 or methods >= 2 and products >= 2").select("repo", F.col("class").alias("binding"))


@generator()
def facade_candidates(g: ClassGraph, min_fan_out: int = 5, max_caller_ratio: float = 0.4) -> DataFrame:
    e = _links(g).select("repo", "class", "target").distinct()
    out = e.groupBy("repo", "class").agg(F.count("*").alias("o"))
    back = e.groupBy("repo", F.col("target").alias("class")).agg(F.count("*").alias("i"))
    rows = out.join(back, ["repo", "class"], "left").na.fill(0, ["i"])
    return rows.where((F.col("o") >= min_fan_out) & (F.col("i") <= F.col("o") * max_caller_ratio)).select("repo", F.col("class").alias("binding"))


@checker("of")
def min_implementers(g: ClassGraph, count: int = 2) -> DataFrame:
    per = g.implements.distinct().groupBy("repo", F.col("parent").alias("of")).agg(F.count("*").alias("k")).where(F.col("k") >= count)
    return per.select("repo", "of", F.when(F.col("k") > count, 1.15).otherwise(1.0).alias("strength"))


@checker("of", "type")
def any_implementer_has_field_of_type(g: ClassGraph) -> DataFrame:
    f = g.effective_fields().select("repo", F.col("owner").alias("child"), "type")
    return g.implements.join(f, ["repo", "child"]).select("repo", F.col("parent").alias("of"), "type").distinct()


@checker("class", "field")
def delegates_to_field(g: ClassGraph) -> DataFrame:
    """A method calls one known of the field's type: 1.0 if only that type knows it, 0.8 if the name is ambiguous."""
    f = g.effective_fields().select("repo", F.col("owner").alias("class"), "field", "type").distinct()
    calls = g.method_calls().select("repo", "class", F.col("callee").alias("name"), "target").distinct()
    known = g.known_methods().withColumnRenamed("class", "type")
    j = f.join(calls, ["repo", "class"]).join(known, ["repo", "type", "name"], "left_semi").where("target is null or target = type")
    return j.groupBy("repo", "class", "field").agg(F.max(F.when(F.col("target") == F.col("type"), 1.0).otherwise(0.8)).alias("strength"))


@checker("class", "field")
def wraps_and_extends(g: ClassGraph, kind: str | None = None) -> DataFrame:
    """Delegation through a field: 'decorator' if the first delegating method, by name, makes several calls, else 'proxy'."""
    f = g.effective_fields().select("repo", F.col("owner").alias("class"), "field", "type").distinct()
    calls = g.methods.select("repo", "class", F.col("name").alias("method"), F.size("calls").alias("k"), F.explode("calls").alias("name"))
    known = g.known_methods().withColumnRenamed("class", "type")
    j = f.join(calls, ["repo", "class"]).join(known, ["repo", "type", "name"], "left_semi")
    first = j.groupBy("repo", "class", "field").agg(F.min_by("k", "method").alias("k"))
    rows = first.join(delegates_to_field(g), ["repo", "class", "field"]).withColumn("kind", F.when(F.col("k") > 1, "decorator").otherwise("proxy"))
    return rows.where(F.col("kind") == kind if kind else F.lit(True)).select("repo", "class", "field", "strength")


@checker("class", "field")
def is_decorator_wrapping(g: ClassGraph) -> DataFrame:
    return wraps_and_extends(g, "decorator")


@checker("class", "field")
def is_proxy_wrapping(g: ClassGraph) -> DataFrame:
    return wraps_and_extends(g, "proxy")


@checker("class", "field")
def field_typed_as_own_interface(g: ClassGraph) -> DataFrame:
    up = g.ancestors().select("repo", F.col("src").alias("owner"), F.col("dst").alias("type"))
    return g.effective_fields().join(up, ["repo", "owner", "type"], "left_semi").select("repo", F.col("owner").alias("class"), "field").distinct()


@checker("class", "type")
def implements_or_inherits(g: ClassGraph) -> DataFrame:
    return g.ancestors().select("repo", F.col("src").alias("class"), F.col("dst").alias("type")).distinct()


@checker("class")
def has_role_method(g: ClassGraph, role_name: str) -> DataFrame:
    return g.known_methods().where(_role("name", role_name)).select("repo", "class").distinct()


@checker("class")
def has_self_referential_field(g: ClassGraph) -> DataFrame:
    return _self_typed(g).select("repo", F.col("owner").alias("class")).distinct()


@checker("class")
def has_list_of_own_type_field(g: ClassGraph) -> DataFrame:
    return _self_typed(g).where("collection").select("repo", F.col("owner").alias("class")).distinct()


@checker("class")
def has_single_field_of_own_type(g: ClassGraph) -> DataFrame:
    return _self_typed(g).where("not collection").select("repo", F.col("owner").alias("class")).distinct()


@checker("class", "method")
def fluent_return_self(g: ClassGraph) -> DataFrame:
    """What a method returns is not recorded, so nothing matches."""
    return g.methods.select("repo", "class", F.col("name").alias("method")).limit(0)


@checker("class")
def abstract_method_called_from_concrete_sibling_method(g: ClassGraph) -> DataFrame:
    calls = g.methods.select("repo", "class", F.explode("calls").alias("name"))
    return _abstract(g).join(calls, ["repo", "class", "name"], "left_semi").select("repo", "class").distinct()


@checker("a", "x", "b", "y")
def double_dispatch_pair(g: ClassGraph) -> DataFrame:
    """A's method x calls B's y, and that one A's x."""
    e = g.method_calls().where("target is not null")
    there = e.select("repo", F.col("class").alias("a"), F.col("method").alias("x"), F.col("target").alias("b"), F.col("callee").alias("y"))
    back = e.select("repo", F.col("class").alias("b"), F.col("method").alias("y"), F.col("target").alias("a"), F.col("callee").alias("x"))
    return there.join(back, ["repo", "a", "x", "b", "y"], "left_semi").distinct()


@checker()
def fan_out_to_common_hub(g: ClassGraph, classes: list[str]) -> DataFrame:
    """Projects in which all of ``classes`` call one class outside of them."""
    e = _links(g).where(F.col("class").isin(*classes) & ~F.col("target").isin(*classes))
    per = e.groupBy("repo", "target").agg(F.countDistinct("class").alias("n")).where(F.col("n") == len(set(classes)))
    return per.select("repo").distinct()


@checker()
def no_direct_edges_between(g: ClassGraph, classes: list[str]) -> DataFrame:
    """Projects in which none of ``classes`` calls another."""
    e = _links(g).where(F.col("class").isin(*classes) & F.col("target").isin(*classes))
    return g.classes.select("repo").distinct().join(e.select("repo").distinct(), "repo", "left_anti")


@checker("class", "method")
def cache_keyed_return(g: ClassGraph) -> DataFrame:
    return _caches(g)


@checker("class")
def has_min_subclasses(g: ClassGraph, count: int = 2) -> DataFrame:
    return g.inherits.distinct().groupBy("repo", F.col("parent").alias("class")).agg(F.count("*").alias("k")).where(F.col("k") >= count).select("repo", "class")


def evaluate(g: ClassGraph, spec: dict) -> DataFrame:
    """(repo, pattern, tier, category, confidence, bindings, field, place, evidence) of one spec's matches.

    ``bindings`` maps roles to classes, ``place`` is the file and line of the first role's, ``evidence`` says which predicate holds of what, with its strength. A predicate
    that stands twice counts once, with its least strength. Unknown predicates raise.
    """
    out, roles, strengths, proofs = None, [], {}, []
    for k, req in enumerate(spec["requires"]):
        name = req["predicate"]
        if name not in PREDICATES:
            raise ValueError(f"unknown predicate {name}")
        f, binds, params = PREDICATES[name]
        values = {p: v for p, v in req.items() if p not in ("predicate", "role", *params)}
        rows = f(g, **values)
        strength = f"s{k}"
        rows = rows.withColumnRenamed("strength", strength) if "strength" in rows.columns else rows.withColumn(strength, F.lit(1.0))
        on = ["repo"]
        for p in params:
            bound = req.get(p)
            if p == "field" and req.get("class") in roles:  # the field that the class's role was found by
                rows = rows.withColumnRenamed("field", f"{req['class']}.field")
                on.append(f"{req['class']}.field")
            elif bound in roles:
                rows = rows.withColumnRenamed(p, bound)
                on.append(bound)
            elif bound is not None:
                rows = rows.where(F.col(p) == bound).drop(p)
        if binds:
            role = req.get("role") or name
            rows = rows.withColumnRenamed("binding", role)
            rows = rows.withColumnRenamed("field", f"{role}.field") if "field" in rows.columns else rows.withColumn(f"{role}.field", F.lit(None).cast("string"))
            roles.append(role)
        out = rows if out is None else out.join(rows, on)
        strengths.setdefault(name, []).append(F.col(strength))
        about = roles[-1] if binds else next((req[p] for p in params if req.get(p) in roles), None)
        proofs.append(F.format_string("%s: %s (%.2f)", F.lit(name), F.col(f"`{about}`") if about else F.lit("project"), F.col(strength)))
    total = F.lit(0.0)
    for name, weight in (spec.get("confidence_weights") or {}).items():
        s = strengths.get(name, [F.lit(0.0)])
        total = total + weight * (F.least(*s) if len(s) > 1 else s[0])
    confidence = F.floor(F.least(total, F.lit(1.0)) * 100 + 0.5 + 1e-9) / 100
    category = next((c for c, names in CATEGORIES.items() if spec["pattern"] in names), "Other")
    bindings = F.map_from_arrays(F.array(*[F.lit(r) for r in roles]), F.array(*[F.col(f"`{r}`") for r in roles]))
    field = F.coalesce(*[F.col(f"`{r}.field`") for r in reversed(roles)])
    at = g.classes.select("repo", F.col("name").alias(roles[0]), F.concat("file", F.lit(":"), F.col("line_start").cast("string")).alias("__at"))
    out = out.join(at, ["repo", roles[0]], "left")
    rows = out.select(
        "repo", F.lit(spec["pattern"]).alias("pattern"), F.lit(spec.get("tier", "low")).alias("tier"), F.lit(category).alias("category"),
        confidence.alias("confidence"), bindings.alias("bindings"), field.alias("field"), F.col("__at").alias("place"), F.array(*proofs).alias("evidence"),
    )
    return rows.where(F.col("confidence") >= spec.get("min_confidence_to_report", 0.6))


def detect(g: ClassGraph, specs: list[dict] | None = None) -> DataFrame:
    """Matches of all specs, each unioned; the class graph's relations are read by many rules, so write them first."""
    return reduce(DataFrame.unionByName, [evaluate(g, s) for s in (load_specs() if specs is None else specs)])


def singleton_idioms(files: DataFrame) -> DataFrame:
    """(path, line, idiom): marks of a language's own way to have one instance, by Go and Rust."""
    # The idioms' patterns and names.
    idioms = (("go", r"\bsync\.Once\b", "sync.Once"), ("rust", r"\blazy_static!\s*\{", "lazy_static!"), ("rust", r"\bOnceCell\s*<", "OnceCell"), ("rust", r"\bOnceLock\s*<", "OnceLock"))
    out = []
    for language, pattern, name in idioms:
        rows = files.where((F.col("language") == language) & F.col("content").rlike(pattern)).select("path", F.split("content", pattern).alias("x")).distinct()
        upto = F.transform(F.sequence(F.lit(1), F.size("x") - 1), lambda i: F.array_join(F.slice("x", F.lit(1), i), ""))
        # Text before a mark may itself hold line ends within marks of other matches; marks are one line, so counts are exact.
        out.append(rows.select("path", F.explode(F.transform(upto, lambda t: F.size(F.split(t, "\n")))).alias("line"), F.lit(name).alias("idiom")))
    return reduce(DataFrame.union, out)
