"""Source text to function and class rows, a file at a time in parallel: Java, JavaScript, TypeScript, Go and Rust by
header patterns and matched braces, Python by the standard library's parser.

The five brace languages share one walk: headers of types and functions are found by the language's patterns, braces are
paired once for the whole text, and a function belongs to the smallest type around it. Braces within strings count as
braces. Files that give neither functions nor classes give one row named ``__file__``.
"""

from __future__ import annotations

import ast
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweft.functions import text as text_columns
from codeweft.operators.relations import SENTINEL
from codeweft.sources import python_parser

FUNCTIONS = (
    "file string, language string, name string, virtual_module string, line_start int, line_end int, complexity int, calls array<string>, call_targets map<string,string>, "
    "fan_out int, param_count int, max_nesting_depth int, literal_count int, is_method boolean, is_abstract boolean, class_name string, instantiates array<string>"
)
CLASSES = (
    "file string, language string, name string, kind string, bases array<string>, interfaces array<string>, "
    "fields array<struct<name:string,type:string,is_collection:boolean>>, method_names array<string>, line_start int, line_end int"
)
# Beginnings of types that hold many, in lower case.
COLLECTIONS = ("list<", "vec<", "array<", "set<", "hashset<", "hashmap<", "map<", "dict<", "dict[", "list[", "set[", "frozenset[", "sequence[")
_CONTROL = frozenset("if for while switch catch return new throw super this try else case do synchronized typeof instanceof await yield function".split())
_MAGIC = re.compile(r"(?<!\w)(\d+\.?\d*)(?!\w)")


def is_collection(type_text: str) -> bool:
    t = type_text.lower().strip()
    return t.endswith("[]") or t.startswith("[]") or any(c in t for c in COLLECTIONS)


@dataclass(frozen=True)
class Grammar:
    """Patterns of one language. Function patterns name groups ``name`` and maybe ``owner``; type patterns ``name`` and maybe
    ``kind``, ``mods``, ``bases``, ``interfaces``; ``field`` and ``signature`` are looked for within a type's body."""

    functions: tuple[str, ...]
    types: tuple[str, ...]
    branches: tuple[str, ...]  # texts whose counts make the complexity
    no_calls: frozenset[str]
    kinds: dict[str, str]
    call: str = r"\b([A-Za-z_$][\w$]*)\s*\("
    made: str = r"\bnew\s+([A-Za-z_$][\w$]*)"
    fields: str = ""
    signatures: str = ""
    owned_names: bool = False  # names of methods carry their owner
    scopes: tuple[str, ...] = field(default=())  # blocks that own functions without being types


# The patterns of each language's headers, calls, fields and branches, on which results depend.
_ID = r"[A-Za-z_$][\w$]*"
_JAVA = Grammar(
    functions=(r"(?m)^[ \t]*(?:@[\w.]+(?:\([^)]*\))?\s*)*(?:(?:public|protected|private|static|final|native|synchronized|abstract|strictfp|default)\s+)*(?:<[^>]*>\s*)?(?:[\w<>\[\],.?]+\s+)?(?P<name>[A-Za-z_]\w*)\s*\([^;{}]*\)\s*(?:throws\s+[\w.,\s]+)?\{",),
    types=(r"(?P<mods>(?:\b(?:public|protected|private|abstract|final|static|strictfp)\s+)*)\b(?P<kind>class|interface)\s+(?P<name>[A-Za-z_]\w*)(?:<[^{>]*>)?(?:\s+extends\s+(?P<bases>[A-Za-z_][\w.<>,\s]*?))?(?:\s+implements\s+(?P<interfaces>[A-Za-z_][\w.<>,\s]*?))?\s*\{",),
    branches=("if", "for", "while", "case", "catch", "&&", "||"), no_calls=_CONTROL, kinds={"class": "class", "interface": "interface"},
    fields=r"(?m)^[ \t]*(?:(?:public|protected|private|static|final|transient|volatile)\s+)+(?P<type>[\w.<>\[\],? ]+?)\s+(?P<name>[A-Za-z_]\w*)\s*(?:=[^;{}]*)?;",
    signatures=r"(?m)^[ \t]*(?:(?:public|protected|private|abstract|static)\s+)*[\w<>\[\],.?]+\s+(?P<name>[A-Za-z_]\w*)\s*\([^;{}]*\)\s*(?:throws\s+[\w.,\s]+)?;",
)
_SCRIPT = Grammar(
    functions=(
        rf"\bfunction\s+(?P<name>{_ID})\s*\([^)]*\)\s*(?::\s*[\w<>\[\].|, ]+)?\{{",
        rf"\b(?:const|let|var)\s+(?P<name>{_ID})\s*=\s*(?:async\s+)?function\s*\([^)]*\)\s*\{{",
        rf"\b(?:const|let|var)\s+(?P<name>{_ID})\s*=\s*(?:async\s*)?\([^)]*\)\s*(?::\s*[\w<>\[\].|, ]+)?=>\s*\{{",
        rf"\b(?:module\.exports|exports)\.(?P<name>{_ID})\s*=\s*(?:async\s+)?(?:function\s*\([^)]*\)|\([^)]*\)\s*=>)\s*\{{",
        rf"(?m)^[ \t]*(?:(?:public|private|protected|static|async|get|set|override|readonly)\s+)*(?P<method>{_ID})\s*\([^)]*\)\s*(?::\s*[\w<>\[\].|, ]+)?\{{",
    ),
    types=(rf"(?P<mods>(?:\babstract\s+)?)\bclass\s+(?P<name>{_ID})(?:<[^{{>]*>)?(?:\s+extends\s+(?P<bases>[A-Za-z_$][\w$.]*)(?:<[^{{>]*>)?)?(?:\s+implements\s+(?P<interfaces>[A-Za-z_$][\w$.,<>\s]*?))?\s*\{{",),
    branches=("if", "for", "while", "case", "catch", "&&", "||", "?", "?:"), no_calls=_CONTROL, kinds={"": "class"},
    fields=rf"(?m)^[ \t]*(?:(?:public|private|protected|readonly|static)\s+)*(?P<name>{_ID})\s*[?!]?:\s*(?P<type>[\w<>\[\].,|\s]+?)\s*[=;]|\bthis\.(?P<own>{_ID})\s*=\s*(?P<hint>\[|\{{|new\s+Map|new\s+Set)?",
    signatures=rf"(?m)^[ \t]*(?:(?:public|private|protected|abstract)\s+)*(?P<name>{_ID})\s*\([^;{{}}]*\)\s*:\s*[\w<>\[\].|, ]+;",
)
_TYPED_SCRIPT = Grammar(
    functions=_SCRIPT.functions, types=(*_SCRIPT.types, rf"\b(?P<kind>interface)\s+(?P<name>{_ID})(?:<[^{{>]*>)?(?:\s+extends\s+(?P<bases>[A-Za-z_$][\w$.,<>\s]*?))?\s*\{{"),
    branches=_SCRIPT.branches, no_calls=_CONTROL, kinds={"": "class", "interface": "interface"}, fields=_SCRIPT.fields, signatures=_SCRIPT.signatures,
)
_GO = Grammar(
    functions=(r"\bfunc\s+(?:\((?P<owner>[^)]+)\)\s*)?(?P<name>[A-Za-z_]\w*)\s*(?:\[[^\]]*\])?\([^;{]*\{",),
    types=(r"\btype\s+(?P<name>[A-Za-z_]\w*)(?:\[[^\]]*\])?\s+(?P<kind>struct|interface)\s*\{",),
    branches=("if ", "for ", "switch ", "case ", "select ", "&&", "||"),
    no_calls=frozenset("if for switch select return go defer range make new len cap append copy delete close panic recover print println func".split()),
    kinds={"struct": "struct", "interface": "interface"}, call=r"\b([A-Za-z_]\w*)\s*\(", made=r"&?\b([A-Z]\w*)\{", owned_names=True,
    fields=r"(?m)^[ \t]*(?P<name>[A-Za-z_]\w*)[ \t]+(?P<type>[\[\]*\w.]+)", signatures=r"(?m)^[ \t]*(?P<name>[A-Za-z_]\w*)\s*\(",
)
_RUST = Grammar(
    functions=(r"\bfn\s+(?P<name>[a-zA-Z_]\w*)\s*(?:<[^>]*>)?\s*\([^;{]*\{",),
    types=(r"\b(?P<kind>struct|trait)\s+(?P<name>[A-Za-z_]\w*)(?:<[^>]*>)?[^{;(]*\{",),
    scopes=(r"\bimpl(?:<[^>]*>)?\s+(?:(?P<interfaces>[A-Za-z_][\w:]*)(?:<[^>]*>)?\s+for\s+)?(?P<name>[A-Za-z_]\w*)(?:<[^>]*>)?[^{;]*\{",),
    branches=("if ", "else if", "for ", "while ", "match ", "&&", "||", "?", "unwrap()"),
    no_calls=frozenset(
        "if while for match loop where let return impl trait struct enum type use mod pub crate super self Self move println eprintln print eprint format write writeln "
        "assert assert_eq assert_ne panic todo unimplemented unreachable dbg vec Some None Ok Err Box Vec String HashMap fn".split()
    ),
    kinds={"struct": "struct", "trait": "trait"}, call=r"\b([a-zA-Z_]\w*)\s*(?:::<[^>]*>)?\s*\(", made=r"\b([A-Z]\w*)(?:::new\s*\(|\s*\{)",
    fields=r"(?:pub(?:\([^)]*\))?\s+)?(?P<name>[A-Za-z_]\w*)\s*:\s*(?P<type>[\w<>\[\]:&' ]+?)\s*(?:[,\n}]|\Z)", signatures=r"\bfn\s+(?P<name>[a-zA-Z_]\w*)[^;{}]*;",
)
GRAMMARS = {"java": _JAVA, "javascript": _SCRIPT, "typescript": _TYPED_SCRIPT, "go": _GO, "rust": _RUST}
_COMPILED: dict[str, re.Pattern] = {}


def _find(pattern: str, text: str) -> Iterator[re.Match]:
    if pattern not in _COMPILED:
        _COMPILED[pattern] = re.compile(pattern)
    return _COMPILED[pattern].finditer(text)


class Source:
    """One text with its line starts and paired braces."""

    def __init__(self, text: str):
        self.text = text
        self.starts = [0, *(m.end() for m in re.finditer("\n", text))]
        self.close: dict[int, int] = {}
        self.depth: list[tuple[int, int]] = []
        stack: list[int] = []
        for m in re.finditer(r"[{}]", text):
            if m.group() == "{":
                stack.append(m.start())
            elif stack:
                self.close[stack.pop()] = m.start()

    def line(self, at: int) -> int:
        return bisect_right(self.starts, at)

    def end(self, brace: int) -> int:
        """Where a block ends; an open one ends where it begins."""
        return self.close.get(brace, brace)


def nesting(body: str) -> int:
    depth = most = 0
    for c in re.findall(r"[{}]", body):
        depth += 1 if c == "{" else -1
        most = max(most, depth)
    return max(0, most - 1)


def _parameters(line: str) -> int:
    a, b = line.find("("), line.rfind(")")
    return len([p for p in line[a + 1 : b].split(",") if p.strip()]) if 0 <= a < b else 0


def _names(listed: str | None) -> list[str]:
    """Names of a list, whose type arguments may hold commas."""
    out, depth, now = [], 0, ""
    for c in listed or "":
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(now.strip())
            now = ""
        else:
            now += c
    return [x for x in [*out, now.strip()] if x]


def parse_braces(path: str, content: str, language: str) -> tuple[list[dict], list[dict]]:
    """Rows of FUNCTIONS and CLASSES of one text."""
    g, src = GRAMMARS[language], Source(content)
    types, spans = [], []
    for pattern in g.types:
        for m in _find(pattern, content):
            got = m.groupdict()
            brace, end = m.end() - 1, src.end(m.end() - 1)
            kind = g.kinds.get(got.get("kind") or "", "class")
            kind = "abstract_class" if kind == "class" and "abstract" in (got.get("mods") or "") else kind
            bases, interfaces = _names(got.get("bases")), _names(got.get("interfaces"))
            types.append({"name": got["name"], "kind": kind, "bases": bases, "interfaces": interfaces, "from": m.start(), "brace": brace, "to": end})
            spans.append((m.start(), end, got["name"]))
    implemented: dict[str, list[str]] = {}
    for pattern in g.scopes:
        for m in _find(pattern, content):
            spans.append((m.start(), src.end(m.end() - 1), m.group("name")))
            if m.group("interfaces"):
                implemented.setdefault(m.group("name"), []).append(m.group("interfaces"))
    functions, seen = [], set()
    for pattern in g.functions:
        for m in _find(pattern, content):
            got = m.groupdict()
            name, at = got.get("name") or got["method"], m.start("name" if got.get("name") else "method")
            brace = m.end() - 1
            if name in g.no_calls or name == "constructor" and language != "java" or brace in seen:
                continue
            end = src.end(brace)
            around = [s for s in spans if s[0] <= at and end <= s[1]]
            owner = min(around, key=lambda s: s[1] - s[0])[2] if around else None
            if got.get("method") and owner is None:
                continue  # a call with a block, not a method
            if got.get("owner"):
                of = re.search(r"([A-Za-z_]\w*)\s*(?:\[[^\]]*\])?\s*$", got["owner"])
                owner = of.group(1) if of else None
            seen.add(brace)
            body = content[brace : end + 1]
            calls = sorted({c.group(1) for c in _find(g.call, body)} - g.no_calls - {name})
            functions.append({
                "file": path, "language": language, "name": f"{owner}.{name}" if g.owned_names and owner else name, "virtual_module": owner or path,
                "line_start": src.line(at), "line_end": src.line(end), "complexity": 1 + sum(body.count(w) for w in g.branches), "calls": calls, "call_targets": {},
                "fan_out": len(calls), "param_count": _parameters(content[src.starts[src.line(at) - 1] :].split("\n", 1)[0]), "max_nesting_depth": nesting(body),
                "literal_count": sum(x not in text_columns.COMMON_NUMBERS for x in _MAGIC.findall(body)), "is_method": owner is not None, "is_abstract": False,
                "class_name": owner, "instantiates": sorted({c.group(1) for c in _find(g.made, body)}),
            })
    functions.sort(key=lambda f: (f["line_start"], f["name"]))
    classes = []
    for t in types:
        body = content[t["brace"] + 1 : t["to"]]
        inner = [s for s in ((f["line_start"], f["line_end"]) for f in functions if f["class_name"] == t["name"])]
        plain = "\n".join(x for n, x in enumerate(body.split("\n"), src.line(t["brace"])) if not any(a <= n <= b for a, b in inner))
        fields: dict[str, dict] = {}
        if g.fields and t["kind"] in ("class", "abstract_class", "struct"):
            for m in _find(g.fields, plain):
                got = m.groupdict()
                if got["name"] and got["name"] not in g.no_calls and got["name"] != "constructor" and (language != "java" or got["type"] not in ("return", "throw")):
                    fields[got["name"]] = {"name": got["name"], "type": got["type"].strip(), "is_collection": is_collection(got["type"])}
            for m in _find(g.fields, body) if language in ("javascript", "typescript") else ():
                if m.group("own") and m.group("own") not in fields:
                    fields[m.group("own")] = {"name": m.group("own"), "type": "", "is_collection": bool(m.group("hint"))}
        own = [f["name"].rsplit(".", 1)[-1] for f in functions if f["class_name"] == t["name"]]
        declared = [m.group("name") for m in _find(g.signatures, plain)] if g.signatures and t["kind"] != "struct" else []
        methods = [] if t["kind"] == "struct" and language == "go" else [*dict.fromkeys([*declared, *(own if t["kind"] != "struct" or language == "rust" else [])])]
        classes.append({
            "file": path, "language": language, "name": t["name"], "kind": t["kind"], "bases": t["bases"], "interfaces": [*t["interfaces"], *implemented.get(t["name"], [])],
            "fields": list(fields.values()), "method_names": [m for m in methods if m not in g.no_calls], "line_start": src.line(t["from"]), "line_end": src.line(t["to"]),
        })
    return functions, classes


def parse(path: str, content: str | None, language: str | None) -> tuple[list[dict], list[dict]]:
    """Rows of one file; other languages and null texts have none."""
    if not content or not language:
        return [], []
    if language == "python":
        return python_parser.parse(path, content)
    return parse_braces(path, content, language) if language in GRAMMARS else ([], [])


def _rows(kind: int, schema: str):
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in re.split(r", (?![^<]*>)", schema)]
        for pdf in it:
            out = []
            for p, t, lang in zip(pdf["path"], pdf["content"], pdf["language"]):
                both = parse(p, t if isinstance(t, str) else None, lang if isinstance(lang, str) else None)
                if kind == 0 and not both[0]:
                    empty = {"file": p, "language": lang if isinstance(lang, str) else None, "name": SENTINEL, "virtual_module": p, "line_start": 1, "line_end": 1, "complexity": 0, "calls": [], "call_targets": {}}
                    out.append(empty | {"fan_out": 0, "param_count": 0, "max_nesting_depth": 0, "literal_count": 0, "is_method": False, "is_abstract": False, "class_name": None, "instantiates": []})
                out += both[kind]
            yield pd.DataFrame(out, columns=names)

    return run


def parse_functions(files: DataFrame) -> DataFrame:
    """FUNCTIONS rows with their ``module`` of (path, language, content); a file without functions has a ``__file__`` row."""
    rows = files.select("path", "language", "content").distinct().mapInPandas(_rows(0, FUNCTIONS), FUNCTIONS)
    return rows.withColumn("module", text_columns.module_of(F.col("file")))


def parse_classes(files: DataFrame) -> DataFrame:
    """CLASSES rows with their ``module`` of (path, language, content)."""
    rows = files.select("path", "language", "content").distinct().mapInPandas(_rows(1, CLASSES), CLASSES)
    return rows.withColumn("module", text_columns.module_of(F.col("file")))
