"""Column expressions on source text; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Literals too common to be magic, and the keywords whose counts make the text complexity.
COMMON_NUMBERS = ("0", "1", "2", "3", "-1", "10", "100", "1000")
BRANCH_WORDS = ("if ", "elif ", "else:", "for ", "while ", "case ", "catch", "except", "&&", "||")
COMMENT_MARKS = ("#", "//", "/*", "*", "'''", '"""')
# Endings of generated files' names, and the bounds of a file's strategy.
GENERATED = (".pb.go", ".pb.gw.go", "_grpc.pb.go", ".gen.go", ".generated.go", "_generated.go")
NORMAL_LINES, GENERATED_LINES, FEW_FUNCTIONS, MANY_FUNCTIONS = 10_000, 100_000, 3, 100


#: White space around a line as Python strips it.
_AROUND = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"


def lines(text: Column) -> Column:
    return F.split(text, "\n")


def loc(text: Column) -> Column:
    """Number of lines; an empty text has one, a null text too."""
    return F.size(lines(F.coalesce(text, F.lit(""))))


def sloc(text: Column) -> Column:
    """Lines that are neither blank nor begin with a comment mark or a text of three quotes."""

    def keep(x: Column) -> Column:
        bare = F.regexp_replace(x, _AROUND, "")
        ok = bare != ""
        for mark in COMMENT_MARKS:
            ok = ok & ~bare.startswith(mark)
        return ok

    return F.size(F.filter(lines(F.coalesce(text, F.lit(""))), keep))


def magic_literals(text: Column) -> Column:
    """Number literals that touch no word character and aren't common ones."""
    found = F.regexp_extract_all(text, F.lit(r"(?U)(?<!\w)(\d+\.?\d*)(?!\w)"), 1)
    return F.coalesce(F.size(F.filter(found, lambda x: ~x.isin(*COMMON_NUMBERS))), F.lit(0))


def without_comments(text: Column, language: Column) -> Column:
    """``text`` with its comments left out; quoted texts and the ends of line comments stay as they are.

    Quotes are ' " ` and, in Python, three of a kind; comments begin with # in the script languages, else with // or /*.
    """
    end = lambda q: rf"[^{q}\\]*+(?:\\[\s\S][^{q}\\]*+)*+(?:{q}|\\?\z)"
    single = "|".join(q + end(q) for q in "\"'`")
    triple = "|".join(rf"{q}{{3}}[\s\S]*?(?:{q}{{3}}|\z)" for q in "\"'`")
    script = language.isin("python", "ruby", "bash", "shell", "perl", "r")
    t = F.coalesce(text, F.lit(""))
    python = F.regexp_replace(t, f"({triple}|{single})|#[^\n]*", "$1")
    other_script = F.regexp_replace(t, f"({single})|#[^\n]*", "$1")
    slashed = F.regexp_replace(t, rf"({single})|//[^\n]*|/\*[\s\S]*?(?:\*/|\z)", "$1")
    return F.when(language == "python", python).when(script, other_script).otherwise(slashed)


def parameters(signature: Column, language: Column) -> Column:
    """Parameters between the first ( and the last ) of a signature, without Python's self or cls; null if there are none."""
    start, end = F.instr(signature, "("), F.length(signature) - F.instr(F.reverse(signature), ")") + 1
    has = (start > 0) & (F.instr(signature, ")") > 0) & (end > start)
    inner = F.substring(signature, start + 1, end - start - 1)
    parts = F.filter(F.transform(F.split(inner, ","), lambda x: F.regexp_replace(x, _AROUND, "")), lambda x: x != "")
    own = (language == "python") & F.get(parts, F.lit(0)).isin("self", "cls")
    return F.when(has, F.size(parts) - F.when(F.coalesce(own, F.lit(False)), 1).otherwise(0))


def signature(text: Column, line: Column, most: int = 11) -> Column:
    """The line ``line`` (from 1) of a text with those after it up to the first that holds a ), ``most`` in all."""
    some = F.slice(lines(text), line, most)
    closing = F.array_position(F.transform(some, lambda x: F.contains(x, F.lit(")"))), True)
    return F.array_join(F.when(closing > 0, F.slice(some, F.lit(1), closing.cast("int"))).otherwise(some), " ")


def functions_named(text: Column, language: Column) -> Column:
    """How many functions a text defines, by the patterns of its language (fixed values); 0 for other languages."""
    count = lambda p: F.size(F.regexp_extract_all(text, F.lit(p), 0))
    return (
        F.when(language == "python", count(r"(?m)^[ \t]*(?:async[ \t]+)?def[ \t]+\w+"))
        .when(language == "go", count(r"\bfunc\s+(?:\([^)]*\)\s+)?[A-Za-z_][A-Za-z0-9_]*\s*\("))
        .when(language == "rust", count(r"\bfn\s+[a-zA-Z_][a-zA-Z0-9_]*\s*[<(]"))
        .when(language.isin("javascript", "typescript"), count(r"\bfunction\s+[A-Za-z_$]"))
        .otherwise(0)
    )


def file_strategy(path: Column, text: Column, functions: Column) -> Column:
    """data_file, large_normal, god_file or normal, by the file's name, lines and functions."""
    name = F.lower(F.regexp_extract(path, r"([^/]*)\z", 1))
    generated = F.lit(False)
    for end in GENERATED:
        generated = generated | name.endswith(end)
    n = loc(text)
    made = F.when(n > GENERATED_LINES, "data_file").otherwise("god_file")
    large = F.when(functions < FEW_FUNCTIONS, "data_file").when(functions <= MANY_FUNCTIONS, "large_normal").otherwise("god_file")
    return F.when(generated, made).when(n <= NORMAL_LINES, "normal").otherwise(large)


def render_strategy(nodes: Column) -> Column:
    return F.when(nodes < 100, "show_all").when(nodes <= 500, "make_group").otherwise("search_only")


def effort_label(effort: Column) -> Column:
    return F.when(effort >= 4, "high").when(effort >= 2, "medium").otherwise("low")


def maintainability_label(index: Column) -> Column:
    return F.when(index >= 85, "Highly Maintainable").when(index >= 65, "Maintainable").when(index >= 40, "Needs Attention").otherwise("Hard to Maintain")


def occurrences(text: Column, word: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(word)))) / len(word)).cast("int")


def complexity(text: Column) -> Column:
    """1 plus the branch words' occurrences, as substrings."""
    total = F.lit(1)
    for w in BRANCH_WORDS:
        total = total + occurrences(text, w)
    return F.coalesce(total, F.lit(1))


def nesting(text: Column) -> Column:
    """Deepest nesting of curly brackets less one, not below 0."""
    marks = F.split(F.regexp_replace(text, r"[^{}]", ""), "")
    zero = F.struct(F.lit(0).alias("d"), F.lit(0).alias("m"))

    def step(a, x):
        d = a["d"] + F.when(x == "{", 1).when(x == "}", -1).otherwise(0)
        return F.struct(d.alias("d"), F.greatest(a["m"], d).alias("m"))

    return F.greatest(F.aggregate(marks, zero, step, lambda a: a["m"]) - 1, F.lit(0))


def plain_snippet(text: Column) -> Column:
    """A snippet with escaped line ends and tabs as real ones, where it has no real line end or any escaped one."""
    t = F.coalesce(text, F.lit(""))
    unescaped = F.replace(F.replace(F.replace(t, F.lit("\\r\\n"), F.lit("\n")), F.lit("\\n"), F.lit("\n")), F.lit("\\t"), F.lit("    "))
    t = F.when(~F.contains(t, F.lit("\n")) | F.contains(t, F.lit("\\n")), unescaped).otherwise(t)
    return F.regexp_replace(F.replace(t, F.lit("\r\n"), F.lit("\n")), r"^\n+|\n+\z", "")


def module_of(path: Column) -> Column:
    """The folder below ``src/`` if the path has one, else the parent folder; '' at either top."""
    folder = F.regexp_replace(path, r"/?[^/]*$", "")
    return F.when(F.concat(F.lit("/"), folder).rlike("/src(/|$)"), F.regexp_extract(folder, r"(?:^|/)src(?:/(.*))?$", 1)).otherwise(folder)


def stem(specifier: Column) -> Column:
    """Last component of an import specifier, without its extension; dots, colons and slashes part components."""
    return F.regexp_extract(F.regexp_replace(specifier, r"\\", "/"), r"([A-Za-z0-9_\-]+)/*$", 1)


def round_half_up(c: Column, digits: int) -> Column:
    return F.floor(c * 10**digits + 0.5) / 10**digits


def maintainability(volume: Column, complexity_: Column, length: Column) -> Column:
    raw = 171 - 5.2 * F.log(F.greatest(volume, F.lit(1.0))) - 0.23 * complexity_ - 16.2 * F.log(F.greatest(length, F.lit(1.0)))
    return round_half_up(F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw * 100 / 171)), 1)
